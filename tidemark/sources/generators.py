"""Synthetic workloads as DataFrames: reproducible from a seed, generated where the rows are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of writes of each workload.
WRITE_SHARE = {"hotset": 0.0, "uniform": 0.0, "writeheavy": 0.8, "tier_on_pressure_demotion": 0.8, "mixed": 0.35, "tier_off_ram_only": 0.35, "ttlheavy": 1.0, "ttl_storm_with_tier": 1.0}


def workload(spark: SparkSession, name: str, ops: int, keyspace: int, value_bytes: int = 128, key_bytes: int = 16, seed: int = 424242) -> DataFrame:
    """seq, ts_ms, key, cmd, size_bytes, ttl_ms, owner, deadline_ms: one operation a millisecond.

    hotset asks for few keys often (the square of a uniform number over a tenth of the keys);
    pipeline alternates writes and reads; names that are not known read all keys alike.
    """
    u = F.rand(seed)
    index = F.floor(u * u * (keyspace // 10)) if name == "hotset" else F.floor(u * keyspace)
    write = (F.col("id") % 2 == 0) if name == "pipeline" else (F.rand(seed + 1) < WRITE_SHARE.get(name, 0.0))
    size = max(value_bytes, 64 << 10) if name == "tier_on_large_values" else value_bytes
    rows = spark.range(ops).select(F.col("id").alias("seq"), F.col("id").alias("ts_ms"), F.rpad(F.concat(F.lit("key"), index.cast("string")), key_bytes, "x").alias("key"), F.when(write, "SET").otherwise("GET").alias("cmd"))
    is_set = F.col("cmd") == "SET"
    ttl = F.lit(2000) if name.startswith("ttl") else F.lit(None)
    rows = rows.withColumn("size_bytes", F.when(is_set, F.lit(size).cast("long"))).withColumn("ttl_ms", F.when(is_set, ttl.cast("long"))).withColumn("owner", F.lit("default"))
    return rows.withColumn("deadline_ms", F.col("ts_ms") + F.col("ttl_ms"))


def artifact_workload(spark: SparkSession, name: str, ops: int, seed: int = 424242) -> DataFrame:
    """seq, type, key of artifact reads: embedding_zipf, prompt_response_churn, rerank_ttl_storm, mixed_rag_pipeline (five kinds for each operation)."""
    u = F.rand(seed)
    base = spark.range(ops).select(F.col("id").alias("seq"), F.floor(F.pow(u, 2.2) * 300).cast("long").alias("k"))
    kinds = {"embedding_zipf": ["embedding"], "prompt_response_churn": ["prompt", "response"], "rerank_ttl_storm": ["rerank_buffer"]}.get(name, ["embedding", "prompt", "rag_chunk", "rerank_buffer", "response"])
    rows = base.select("seq", "k", F.explode(F.array(*(F.lit(t) for t in kinds))).alias("type"))
    return rows.select("seq", "type", F.concat_ws(":", "type", F.col("k").cast("string")).alias("key"))
