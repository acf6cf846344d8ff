"""Counters, reports and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S


def hit_rate(reads: DataFrame) -> DataFrame:
    """owner, gets, hits, hit_rate."""
    return reads.groupBy("owner").agg(F.count("*").alias("gets"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def owner_usage(state: DataFrame) -> DataFrame:
    return state.groupBy("owner").agg(F.count("*").alias("keys"), F.sum("size_bytes").alias("used_bytes"))


def overhead(state: DataFrame) -> DataFrame:
    """memory_used_bytes and how much more an allocator sets aside; 1 when empty."""
    row = state.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("memory_used_bytes"), F.sum(S.size_class(F.col("size_bytes"))).alias("classes"))
    return row.select("memory_used_bytes", F.when(F.col("memory_used_bytes") == 0, 1.0).otherwise(F.col("classes") / F.col("memory_used_bytes")).alias("memory_overhead_ratio"))


def top_hits(state: DataFrame, n: int = 5) -> DataFrame:
    """One row: topk_hits, the ``n`` keys read most as key:count."""
    best = state.orderBy(F.col("hit_count").desc(), "key").limit(n)
    rank = F.row_number().over(Window.orderBy(F.col("hit_count").desc(), "key"))
    listed = best.select(rank.alias("i"), F.concat("key", F.lit(":"), F.col("hit_count").cast("string")).alias("s"))
    return listed.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), ",").alias("topk_hits"))


def info(log: DataFrame, state: DataFrame, counted: DataFrame, memory_limit: int, policy: str, version: str) -> DataFrame:
    """The report as rows line, name, value, in the protocol's order.

    counted: name, value of the replay's counters. Times of compaction and of the index rebuild are
    left out: they are facts of a running store, not of a log.
    """
    names = ["keys", "memory_used_bytes", "expiration_backlog", "hits", "misses", "evictions", "expirations", "admissions_rejected", "ram_bytes", "ssd_bytes", "ssd_gets", "ssd_hits", "ssd_misses", "promotions", "demotions", "ssd_read_mb", "ssd_write_mb", "tier_backlog"]
    names += ["ssd_gc_runs", "ssd_gc_bytes_reclaimed", "fragmentation_estimate"]
    values = counted.agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in [*names, "ssd_log_bytes"] if n != "fragmentation_estimate"))
    values = values.withColumn("fragmentation_estimate", F.round(F.coalesce(F.try_divide(F.col("ssd_log_bytes") - F.col("ssd_bytes"), F.col("ssd_log_bytes")), F.lit(0.0)), 4))
    row = values.crossJoin(overhead(state).select("memory_overhead_ratio")).crossJoin(top_hits(state))
    text = lambda c: F.col(c).cast("string")
    order = ["policy_mode", "policy_params_version", *names[:2], "memory_limit_bytes", "memory_overhead_ratio", *names[2:], "topk_hits"]
    given = {"policy_mode": F.lit(policy), "policy_params_version": F.lit(version), "memory_limit_bytes": F.lit(str(memory_limit)), "memory_overhead_ratio": F.round("memory_overhead_ratio", 4).cast("string")}
    lines = F.array(*(F.struct(F.lit(i).alias("line"), F.lit(name).alias("name"), given.get(name, text(name)).alias("value")) for i, name in enumerate(order, 1)))
    return row.select(F.inline(lines))


def lower_percentiles(rows: DataFrame, value: str, by: str, shares: dict[str, float]) -> DataFrame:
    """Of each group the value at floor(share * (n - 1)), without interpolation.

    Values are counted first, and the counts of distinct values accumulated: repeats cost nothing.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value))
    counts = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col(value)))
    return counts.groupBy(by).agg(*(at(p).alias(name) for name, p in shares.items()))


def average_request_bytes(requests: DataFrame) -> DataFrame:
    return requests.agg(F.coalesce(F.try_divide(F.sum("bytes"), F.count("*")), F.lit(0.0)).alias("avg_request_bytes"))


def tuned(snapshot: DataFrame, *carry: str) -> DataFrame:
    """Policy weights from miss_rate and avg_size_bytes of a statistics snapshot, beside the columns ``carry``."""
    miss, size = F.coalesce("miss_rate", F.lit(0.1)), F.coalesce("avg_size_bytes", F.lit(1024.0))
    return snapshot.select(*carry, F.round(1 + 5 * miss, 4).alias("w_miss"), F.round(F.least(F.greatest(size / 8192, F.lit(0.1)), F.lit(10.0)), 4).alias("w_mem"), F.lit(1.0).alias("w_reuse"), F.lit(1.0).alias("w_risk"))
