"""Work that the engine does in ticks, with a budget for each, as queries over what is to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.model import DEMOTION_PRESSURE, TIER_WORK_PER_TICK, TTL_CLEANUP_PER_TICK

#: Queue items that a window takes together.
SLICE = 1 << 20


def served(queue: DataFrame, budget: int = TIER_WORK_PER_TICK, slice_rows: int = SLICE) -> DataFrame:
    """``queue`` (seq, tick of arrival, never falling) with ``served``, the tick in which a first-in first-out queue with ``budget`` items a tick does it.

    With item k at place p(k) = max over j <= k of budget * tick(j) + (k - j), it is done in tick
    p(k) div budget. Both the number k and the running maximum are taken within slices of seq, and
    between slices by one row for each.
    """
    rows = queue.withColumn("slice", F.floor(F.col("seq") / slice_rows))
    within = Window.partitionBy("slice").orderBy("seq")
    rows = rows.withColumn("k", F.row_number().over(within) - 1).withColumn("top", F.max(F.col("tick") * budget - F.col("k")).over(within))
    ends = rows.groupBy("slice").agg(F.count("*").alias("n"), F.max("top").alias("most"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = ends.select("slice", "first", F.max(F.col("most") - F.col("first")).over(before).alias("earlier"))
    place = F.greatest(F.col("top") - F.col("first"), F.col("earlier")) + F.col("first") + F.col("k")
    return rows.join(ends, "slice").withColumn("served", F.floor(place / budget)).drop("slice", "k", "top", "first", "earlier")


def backlog(done: DataFrame) -> DataFrame:
    """tick, tier_backlog: items that have arrived by the end of each tick with arrivals and are not yet done, from ``served``."""
    change = done.select(F.col("tick"), F.lit(1).alias("d")).union(done.select(F.col("served").alias("tick"), F.lit(-1).alias("d")))
    ticks = change.groupBy("tick").agg(F.sum("d").alias("d"))
    arrivals = done.select("tick").distinct()
    return ticks.withColumn("tier_backlog", F.sum("d").over(Window.orderBy("tick"))).join(arrivals, "tick", "left_semi").select("tick", "tier_backlog")


def expired_first(index: DataFrame, now_ms: Column, most: int = TTL_CLEANUP_PER_TICK) -> DataFrame:
    """Those rows of the second tier's index (key, deadline_ms) that one tick drops: the ``most`` that have been over for longest. Their records stay in the log."""
    return index.where(F.col("deadline_ms") <= now_ms).orderBy("deadline_ms", "key").limit(most)


def demotion_due(used: Column, limit: Column, pressure: float = DEMOTION_PRESSURE) -> Column:
    """Whether a tick queues one victim for the second tier."""
    return F.coalesce(F.try_divide(used, limit) >= pressure, F.lit(False))


def synced(appends: DataFrame, mode: str) -> DataFrame:
    """seq of the appends (seq, ts_ms) after which the log is flushed: none (never), all (always), or the first of each second (everysec)."""
    if mode == "never":
        return appends.select("seq").limit(0)
    if mode == "always":
        return appends.select("seq")
    if mode == "everysec":
        return appends.groupBy(F.floor(F.col("ts_ms") / 1000)).agg(F.min("seq").alias("seq")).select("seq")
    raise ValueError(f"unknown durability mode {mode}")
