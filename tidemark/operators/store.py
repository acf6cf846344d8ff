"""The log-structured store: winners, live rows, compaction and fragmentation over (segment_id, offset, seq, key, tombstone, ttl_epoch_ms, len)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def latest(records: DataFrame) -> DataFrame:
    """The winning record of each key: greatest seq, then segment, then offset (a sum that combines before the shuffle)."""
    rest = [c for c in records.columns if c not in ("seq", "segment_id", "offset", "key")]
    best = records.groupBy("key").agg(F.max(F.struct("seq", "segment_id", "offset", *rest)).alias("r"))
    return best.select("key", *(F.col(f"r.{c}").alias(c) for c in ("seq", "segment_id", "offset", *rest)))


def live(records: DataFrame, now: DataFrame) -> DataFrame:
    """Winners that are neither tombstones nor over at now_ms."""
    rows = latest(records).join(F.broadcast(now))
    return rows.where(S.log_alive(F.col("tombstone"), F.col("ttl_epoch_ms"), F.col("now_ms"))).drop("now_ms")


def fragmentation(records: DataFrame, now: DataFrame) -> DataFrame:
    """live_bytes, total_bytes and the share that is not live; 0 when empty."""
    kept = live(records, now).agg(F.coalesce(F.sum("len"), F.lit(0)).alias("live_bytes"))
    total = records.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("total_bytes"))
    share = F.when(F.col("total_bytes") == 0, 0.0).otherwise(1 - F.col("live_bytes") / F.col("total_bytes"))
    return kept.join(total).select("live_bytes", "total_bytes", share.alias("fragmentation"))


def compact(records: DataFrame, now: DataFrame, path: str, threshold: float) -> bool:
    """Rewrites the live rows to ``path`` if the log is fragmented enough; whether it did."""
    if fragmentation(records, now).first()["fragmentation"] < threshold:
        return False
    live(records, now).write.mode("overwrite").parquet(path)
    return True


def append(records: DataFrame, path: str) -> None:
    """Adds records to a stored log; each write is atomic by the commit protocol of the file source."""
    records.write.mode("append").partitionBy("segment_id").parquet(path)


def within_limit(records: DataFrame, live_bytes: int, max_bytes: int) -> DataFrame:
    """records with ``error`` where an append would take the store beyond its limit."""
    return records.withColumn("error", F.when(F.col("len") + live_bytes > max_bytes, "ssd tier full"))
