"""Admission and eviction on a snapshot of live entries (key, owner, size_bytes, hit_count, last_access_ms, as_of_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S
from tidemark.model import PolicyParams
from tidemark.session import shared_folder

#: Entries of one step of the running sum over victims.
SLICE = 1 << 20


def victim_order(policy: str, params: PolicyParams = PolicyParams()) -> list[Column]:
    """What a policy evicts first; the key decides ties."""
    if policy == "lru":
        return [F.col("last_access_ms"), F.col("key")]
    if policy == "lfu":
        return [F.col("hit_count"), F.col("last_access_ms"), F.col("key")]
    if policy == "cost":
        return [S.benefit(F.col("size_bytes"), F.col("hit_count"), F.col("as_of_ms") - F.col("last_access_ms"), F.lit(1.0), params), F.col("key")]
    raise ValueError(f"unknown policy {policy}")


def next_victim(state: DataFrame, policy: str, params: PolicyParams = PolicyParams()) -> DataFrame:
    """The one entry that goes first: a least struct, no sort."""
    order = victim_order(policy, params)
    return state.agg(F.min(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("v")).select(F.col(f"v.o{len(order) - 1}").alias("key"))


def victims(state: DataFrame, policy: str, limit_bytes: Column, params: PolicyParams = PolicyParams()) -> DataFrame:
    """key, size_bytes, freed_before of the entries to evict until the rest fits ``limit_bytes`` (an aggregate of state).

    A running sum in victim order. Many entries are dealt to ranges of the whole order, key included,
    so that ties cannot crowd one range; only sums of ranges are accumulated in one place, and
    within a range a window runs. Ranges are cut once and checkpointed: the sums rely on them.
    """
    order = victim_order(policy, params)
    names = [f"o{i}" for i in range(len(order) - 1)]
    rows = state.select("key", "size_bytes", *(c.alias(n) for n, c in zip(names, order[:-1], strict=True)))
    total = state.agg(F.sum("size_bytes").alias("used"), limit_bytes.cast("double").alias("limit"))
    pieces = -(-state.count() // SLICE)
    if pieces > 1:
        shared_folder(state.sparkSession)
        rows = rows.repartitionByRange(pieces, *names, "key").checkpoint().withColumn("piece", F.spark_partition_id())
    else:
        rows = rows.withColumn("piece", F.lit(0))
    sums = rows.groupBy("piece").agg(F.sum("size_bytes").alias("bytes"))
    sums = sums.select("piece", F.coalesce(F.sum("bytes").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("piece").orderBy(*names, "key")
    freed = F.coalesce(F.sum("size_bytes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    gate = F.col("used") >= F.col("limit") * params.evict_pressure if policy == "cost" else F.lit(True)
    rows = rows.join(F.broadcast(sums), "piece").withColumn("freed_before", freed).join(F.broadcast(total))
    return rows.where((F.col("used") - F.col("freed_before") > F.col("limit")) & gate).select("key", "size_bytes", "freed_before")


def admissions(log: DataFrame, params: PolicyParams = PolicyParams()) -> DataFrame:
    """seq, score, nth, admitted of every SET under the cost policy: worth more than the threshold, within the aligned second's cap."""
    sets = log.where("cmd = 'SET'")
    score = S.benefit(F.col("size_bytes"), F.lit(0), F.lit(0), S.owner_miss_cost(F.col("owner")), params)
    second = Window.partitionBy(F.floor(F.col("ts_ms") / 1000)).orderBy("seq")
    rows = sets.withColumn("score", score).withColumn("nth", F.row_number().over(second))
    return rows.select("seq", "score", F.col("nth").cast("long").alias("nth"), ((F.col("score") > params.admit_threshold) & (F.col("nth") <= params.max_admissions_per_second)).alias("admitted"))


def quota_rejections(state: DataFrame, writes: DataFrame, cap_bytes: int) -> DataFrame:
    """key, owner, size_bytes of ``writes`` that would take their owner beyond the cap, given the state before them."""
    usage = state.groupBy("owner").agg(F.sum("size_bytes").alias("used"))
    own = state.select("key", F.col("owner").alias("held_by"), F.col("size_bytes").alias("held"))
    rows = writes.join(own, "key", "left").join(usage, "owner", "left")
    after = F.coalesce("used", F.lit(0)) - F.when(F.col("held_by") == F.col("owner"), F.col("held")).otherwise(0) + F.col("size_bytes")
    return rows.where(after > cap_bytes).select("key", "owner", "size_bytes")
