"""The artifact layer: content-addressed blobs, metadata, invalidation and reports.

Artifacts have type, key, owner, model_id, snapshot_epoch, blob_hash, size_bytes, miss_cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S
from tidemark.model import MAX_VALUE_BYTES


def parsed_meta(puts: DataFrame, meta: str = "meta_json", kind: str = "type") -> DataFrame:
    """``puts`` with the members of their flat JSON, and why it is refused (null if not)."""
    m = F.col(meta)
    rows = puts
    for name in ("artifact_type", "owner", "schema_version", "model_id", "tokenizer_id", "dataset_id", "source_id", "chunk_id", "source_rev", "snapshot_epoch", "content_hash"):
        rows = rows.withColumn(f"m_{name}", S.meta_string(m, name))
    rows = rows.withColumn("m_ttl_ms", S.meta_number(m, "ttl_deadline")).withColumn("m_created_at", S.meta_number(m, "created_at"))
    rows = rows.withColumn("m_miss_cost", F.nullif(F.regexp_extract(m, r'"miss_cost"\s*:\s*([0-9]+(?:\.[0-9]+)?)', 1), F.lit("")).try_cast("double"))
    missing = F.col("m_artifact_type").isNull() | F.col("m_owner").isNull() | F.col("m_schema_version").isNull()
    return rows.withColumn("error", F.when(missing, "missing required metadata fields").when(F.col("m_artifact_type") != F.col(kind), "artifact type mismatch"))


def with_defaults(puts: DataFrame) -> DataFrame:
    """Size, time to live and miss cost filled in from payload, owner and type."""
    column = lambda c, kind: F.col(c) if c in puts.columns else F.lit(None).cast(kind)
    return (
        puts.withColumn("size_bytes", F.octet_length("payload").cast("long"))
        .withColumn("ttl_ms", F.coalesce(F.nullif(column("ttl_ms", "long"), F.lit(0)), S.owner_ttl_ms(F.col("owner"))))
        .withColumn("miss_cost", F.coalesce(column("miss_cost", "double"), S.type_miss_cost(F.col("type"))))
        .withColumn("blob_hash", F.coalesce(column("blob_hash", "string"), F.md5(F.coalesce("payload", F.lit("")))))
    )


def meta_json(created_ms: Column) -> Column:
    """The metadata of an artifact as JSON, members in the order of the protocol."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.to_json(
        F.struct(
            F.col("type").alias("artifact_type"),
            F.col("owner").alias("owner"),
            F.lit("1").alias("schema_version"),
            text("model_id").alias("model_id"),
            created_ms.alias("created_at"),
            F.col("ttl_ms").alias("ttl_deadline"),
            F.col("size_bytes").alias("size_bytes"),
            F.col("blob_hash").alias("content_hash"),
            F.lit("local").alias("tenant"),
            text("snapshot_epoch").alias("snapshot_epoch"),
            F.lit("").alias("source_rev"),
        )
    )


def put_errors(puts: DataFrame, max_value: int = MAX_VALUE_BYTES) -> DataFrame:
    """key and why its blob cannot be stored."""
    return puts.where(F.col("size_bytes") > max_value).select("key", F.lit("blob put failed: value too large").alias("error"))


def blobs(artifacts: DataFrame) -> DataFrame:
    """blob_hash, refcount, size_bytes: one row for each content."""
    return artifacts.groupBy("blob_hash").agg(F.countDistinct("key").alias("refcount"), F.max("size_bytes").alias("size_bytes"))


def dedup_hits(artifacts: DataFrame) -> DataFrame:
    """type, puts, blobs, dedup_hits: puts of distinct keys that found their content stored already."""
    first = artifacts.groupBy("type", "blob_hash").agg(F.countDistinct("key").alias("n"))
    return first.groupBy("type").agg(F.sum("n").alias("puts"), F.count("*").alias("blobs"), F.sum(F.col("n") - 1).alias("dedup_hits"))


def get(requests: DataFrame, artifacts: DataFrame, stored: DataFrame) -> DataFrame:
    """``requests`` (req, key) with hit, type and size: key and blob must both be there."""
    found = artifacts.select("key", "type", "blob_hash").join(stored.select("blob_hash", F.col("size_bytes").alias("payload_bytes")), "blob_hash")
    return requests.join(found.drop("blob_hash"), "key", "left").withColumn("hit", F.col("type").isNotNull())


def get_live(requests: DataFrame, artifacts: DataFrame, stored: DataFrame) -> DataFrame:
    """``requests`` (req, key, now_ms) with hit, payload_bytes and engine_hits: the reference of a key and its blob must both live (expires_ms; null: for ever).

    Each read that finds something counts in the store, so that a hit counts twice there and a lost blob once.
    """
    alive = lambda c: F.col(c).isNull() | (F.col(c) > F.col("now_ms"))
    keys = artifacts.select("key", "blob_hash", F.col("expires_ms").alias("key_until"), F.lit(True).alias("indexed"))
    content = stored.select("blob_hash", F.col("size_bytes").alias("payload_bytes"), F.col("expires_ms").alias("blob_until"), F.lit(True).alias("kept"))
    rows = requests.join(keys.join(content, "blob_hash", "left"), "key", "left")
    found = F.coalesce(F.col("indexed"), F.lit(False)) & alive("key_until")
    rows = rows.withColumn("found", found).withColumn("hit", F.col("found") & F.coalesce(F.col("kept"), F.lit(False)) & alive("blob_until"))
    size = F.when(F.col("hit"), F.col("payload_bytes"))
    return rows.select("req", "key", "hit", size.alias("payload_bytes"), (F.col("found").cast("int") + F.col("hit").cast("int")).alias("engine_hits"))


def mget(requests: DataFrame, artifacts: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests (req, keys array) answered in order: req, position, key, hit, payload_bytes."""
    asked = requests.select("req", F.posexplode("keys").alias("position", "key"))
    return get(asked, artifacts, stored).select("req", "position", "key", "hit", "payload_bytes")


def invalidated(artifacts: DataFrame, by: str, value: str, compat: bool = False) -> DataFrame:
    """Keys that go: by EPOCH or MODEL (equal) or PREFIX. compat: prefixes of 1 to 32 bytes alone."""
    if by == "EPOCH":
        chosen = artifacts.where(F.col("snapshot_epoch") == value)
    elif by == "MODEL":
        chosen = artifacts.where(F.col("model_id") == value)
    elif by == "PREFIX":
        allowed = bool(value) and (not compat or len(value.encode()) <= 32)
        chosen = artifacts.where(F.col("key").startswith(value)) if allowed else artifacts.limit(0)
    else:
        raise ValueError(f"unknown mode {by}")
    return chosen.select("key").distinct()


def after_invalidation(artifacts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The artifacts that stay, and blob_hash of the blobs that no key holds any more."""
    stay = artifacts.join(gone, "key", "left_anti")
    released = artifacts.select("blob_hash").distinct().join(stay.select("blob_hash").distinct(), "blob_hash", "left_anti")
    return stay, released


def stats(artifacts: DataFrame) -> DataFrame:
    """type, n of the indexed keys."""
    return artifacts.groupBy("type").agg(F.countDistinct("key").alias("n"))


def stats_lines(puts: DataFrame, answered: DataFrame) -> DataFrame:
    """nr, line: the report of the artifact layer, from all ``puts`` (key, type, blob_hash) and the ``answered`` reads (hit); types in order."""
    put = puts.agg(F.count("*").alias("puts"))
    content = puts.groupBy("blob_hash").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dedup_hits"), F.count("*").alias("blob_count"))
    read = answered.agg(F.count("*").alias("gets"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    names = ["puts", "gets", "hits", "misses", "dedup_hits", "blob_count"]
    # each side is one row
    one = put.join(content).join(read).select(F.posexplode(F.array(*(F.format_string(f"{n}:%d", n) for n in names))).alias("at", "line"))
    # one row a type
    types = stats(puts).select((F.row_number().over(Window.orderBy("type")) + len(names)).alias("nr"), F.format_string("type.%s:%d", "type", "n").alias("line"))
    return one.select((F.col("at") + 1).alias("nr"), "line").union(types)


def top(artifacts: DataFrame, value: str, n: int = 10) -> DataFrame:
    """The ``n`` keys of the highest value, ties by key."""
    return artifacts.orderBy(F.col(value).desc(), "key").limit(n).select("key", value)


def explained(requests: DataFrame, artifacts: DataFrame) -> DataFrame:
    """requests (key) and why each artifact was let in."""
    said = artifacts.select("key", S.explain(F.lit("score"), F.lit("threshold"), F.col("owner"), F.col("type")).alias("explain"))
    return requests.join(said, "key", "left").withColumn("explain", F.coalesce("explain", F.lit("MISS:no metadata")))
