"""Command and artifact logs from the star-schema tables, by fixed mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

# The owner of a user is the one at user_id modulo their number.
OWNERS = ("default", "premium", "vector", "prompt", "rag", "rerank", "response")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: str) -> F.Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts_ms, key, cmd, size_bytes, ttl_ms, owner, deadline_ms from ``events``."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    is_set = kind.isin("purchase", "signup")
    owner = F.get(F.array(*(F.lit(o) for o in OWNERS)), (F.col("user_id") % len(OWNERS)).cast("int"))
    log = e.select(
        F.col("event_id").alias("seq"),
        epoch_ms("ts").alias("ts_ms"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
        F.when(is_set, "SET").when(kind == "error", "DEL").otherwise("GET").alias("cmd"),
        F.when(is_set, F.floor(F.col("value") * 10) + 1).cast("long").alias("size_bytes"),
        F.when(kind == "signup", (F.get_json_object("props", "$.k").cast("long") + 1) * 3_600_000).alias("ttl_ms"),
        owner.alias("owner"),
    )
    return log.withColumn("deadline_ms", S.deadline_ms(F.col("ts_ms"), F.col("ttl_ms")))


def artifact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, key, owner, model_id, snapshot_epoch, payload (text) of embeddings, documents and conversations."""
    text = lambda c: F.col(c).cast("string")
    e, d, c = (table(spark, sf_dir, t) for t in ("embeddings", "documents", "conversations"))
    epoch = lambda c: F.concat(F.lit("ix"), (F.col(c) % 5).cast("string"))
    model = F.concat(F.lit("m"), text("label"))
    embeddings = e.select(
        F.lit("embedding").alias("type"),
        S.embedding_key(model, F.col("vec_id"), F.lit(64), F.lit("float")).alias("key"),
        F.lit("vector").alias("owner"),
        model.alias("model_id"),
        epoch("vec_id").alias("snapshot_epoch"),
        F.concat(F.lit("v"), text("vec_id")).alias("payload"),
    )
    chunks = d.select(F.lit("rag_chunk"), S.rag_key(F.col("source"), F.col("doc_id"), F.lit("r1")), F.lit("rag"), F.lit(None).cast("string"), epoch("doc_id"), F.col("text"))
    turn = F.concat_ws("-", text("conv_id"), text("turn"))
    prompts = c.where("role = 'user'").select(F.lit("prompt"), S.prompt_key(F.lit("tok"), turn), F.lit("prompt"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("text"))
    by = F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string"))
    responses = c.where("role = 'assistant'").select(F.lit("response"), S.response_key(turn, F.lit("p"), by), F.lit("response"), by, F.lit(None).cast("string"), F.col("text"))
    return embeddings.union(chunks).union(prompts).union(responses)
