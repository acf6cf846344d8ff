"""Cache state and reads as queries over the command log (seq, ts_ms, key, cmd, size_bytes, ttl_ms, owner, deadline_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S

#: Log rows of one key that a window takes together; a hot key's history is cut at multiples of it.
SLICE = 1 << 20


def as_of(log: DataFrame) -> DataFrame:
    """One row, as_of_ms: the log's last time."""
    return log.agg(F.max("ts_ms").alias("as_of_ms"))


def versions(log: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """``log`` with ``version``, the last SET or DEL of the row's key before it, and ``deadline``, the one then in force.

    A key's history is cut into slices by seq. The last write of each slice is a sum that combines
    before the shuffle; what earlier slices leave to a slice is a window over one row for each;
    within a slice a window runs over bounded rows. So one hot key spreads over many tasks.
    EXPIRE rows move the deadline of the version that they meet; they are found like writes.
    """
    write = F.when(F.col("cmd").isin("SET", "DEL"), F.struct("seq", "cmd", "ts_ms", "size_bytes", "owner", "deadline_ms"))
    expire = F.when(F.col("cmd") == "EXPIRE", F.struct("seq", "deadline_ms"))
    log = log.withColumn("slice", F.floor(F.col("seq") / slice_rows))
    ends = log.groupBy("key", "slice").agg(F.max(write).alias("w"), F.max(expire).alias("x"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    left = ends.select("key", "slice", F.last("w", ignorenulls=True).over(before).alias("w0"), F.last("x", ignorenulls=True).over(before).alias("x0"))
    rows = log.join(left, ["key", "slice"])
    earlier = Window.partitionBy("key", "slice").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("version", F.coalesce(F.last(write, ignorenulls=True).over(earlier), F.col("w0")))
    moved = F.coalesce(F.last(expire, ignorenulls=True).over(earlier), F.col("x0"))
    rows = rows.withColumn("moved", moved)
    deadline = F.when(F.col("moved.seq") > F.col("version.seq"), F.col("moved.deadline_ms")).otherwise(F.col("version.deadline_ms"))
    return rows.withColumn("deadline", deadline).drop("slice", "w0", "x0", "moved")


def hit() -> Column:
    """Whether the version before a row is there to be read."""
    return F.coalesce((F.col("version.cmd") == "SET") & S.alive(F.col("deadline"), F.col("ts_ms")), F.lit(False))


def reads(log: DataFrame) -> DataFrame:
    """seq, key, owner, hit, version_seq, size_bytes of every GET, as of its place in the log."""
    rows = versions(log).where("cmd = 'GET'").withColumn("hit", hit())
    return rows.select("seq", "ts_ms", "key", "owner", "hit", F.when(F.col("hit"), F.col("version.seq")).alias("version_seq"), F.when(F.col("hit"), F.col("version.size_bytes")).alias("size_bytes"))


def entries(log: DataFrame) -> DataFrame:
    """What the log leaves per key, live or not: key, owner, size_bytes, created_ms, deadline_ms, set_seq."""
    write = F.when(F.col("cmd").isin("SET", "DEL"), F.struct("seq", "cmd", "ts_ms", "size_bytes", "owner", "deadline_ms"))
    expire = F.when(F.col("cmd") == "EXPIRE", F.struct("seq", "deadline_ms"))
    last = log.groupBy("key").agg(F.max(write).alias("w"), F.max(expire).alias("x")).where("w.cmd = 'SET'")
    moved = F.when(F.col("x.seq") > F.col("w.seq"), F.col("x.deadline_ms")).otherwise(F.col("w.deadline_ms"))
    return last.select("key", "w.owner", "w.size_bytes", F.col("w.ts_ms").alias("created_ms"), moved.alias("deadline_ms"), F.col("w.seq").alias("set_seq"))


def live_entries(log: DataFrame) -> DataFrame:
    """The live entries at the log's last time, with hit_count and last_access_ms since their SET."""
    now = as_of(log)
    state = entries(log)
    used = reads(log).where("hit").groupBy(F.col("version_seq").alias("set_seq")).agg(F.count("*").alias("hits"), F.max("ts_ms").alias("read_ms"))
    rows = state.join(used, "set_seq", "left").join(F.broadcast(now)).where(S.alive(F.col("deadline_ms"), F.col("as_of_ms")))
    return rows.select("key", "owner", "size_bytes", "created_ms", F.coalesce("read_ms", "created_ms").alias("last_access_ms"), F.coalesce("hits", F.lit(0)).alias("hit_count"), "deadline_ms", "as_of_ms")


def mget(requests: DataFrame, state: DataFrame) -> DataFrame:
    """req, position, key, size_bytes (null for a miss) of requests (req, keys array), in order, repeats kept."""
    asked = requests.select("req", F.posexplode("keys").alias("position", "key"))
    return asked.join(state.select("key", "size_bytes"), "key", "left").select("req", "position", "key", "size_bytes")


def deletes(log: DataFrame, indexed: bool = False) -> DataFrame:
    """seq, key, removed (1 or 0) of every DEL. indexed: as in the second tier, whose index counts keys that are over but not collected."""
    found = F.coalesce(F.col("version.cmd") == "SET", F.lit(False)) if indexed else hit()
    return versions(log).where("cmd = 'DEL'").select("seq", "key", found.cast("long").alias("removed"))


def without(state: DataFrame, keys: DataFrame) -> DataFrame:
    """``state`` less the keys that were deleted."""
    return state.join(keys.select("key").distinct(), "key", "left_anti")


def tiers(ram: DataFrame, ssd: DataFrame) -> DataFrame:
    """Both tiers as one: a key's row from the first tier goes before that of the second."""
    both = ram.withColumn("tier", F.lit("ram")).unionByName(ssd.withColumn("tier", F.lit("ssd")))
    columns = [c for c in both.columns if c != "key"]
    return both.groupBy("key").agg(F.min(F.struct("tier", *(c for c in columns if c != "tier"))).alias("r")).select("key", *(F.col(f"r.{c}").alias(c) for c in columns))
