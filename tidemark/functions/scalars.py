"""Scalar functions as Column expressions; all stay in generated code but the bulk hash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.model import CONTENT_BASIS, DEFAULT_TTL_MS, FNV64_PRIME, MAX_KEY_BYTES, MAX_VALUE_BYTES, OWNER_MISS_COST, OWNER_TTL_MS, PARAM_BOUNDS, TYPE_MISS_COST, PolicyParams
from tidemark.session import ship


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _key(prefix: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), *(_text(p) for p in parts))


def embedding_key(model: Column, content_hash: Column, dim: Column, dtype: Column) -> Column:
    return _key("emb", model, content_hash, dim, dtype)


def prompt_key(tokenizer: Column, content_hash: Column) -> Column:
    return _key("prm", tokenizer, content_hash)


def rag_key(source: Column, chunk: Column, rev: Column) -> Column:
    return _key("rag", source, chunk, rev)


def rerank_key(query: Column, epoch: Column, top_k: Column, params: Column) -> Column:
    return _key("rrk", query, epoch, top_k, params)


def response_key(prompt: Column, params: Column, model: Column) -> Column:
    return _key("rsp", prompt, params, model)


def size_class(size: Column) -> Column:
    """Bytes that an allocator would set aside: powers of two to 1 KiB, then steps of 512, then of 4096."""
    step = lambda n: F.ceil(size / n) * n
    small = reduce(lambda rest, n: F.when(size <= n, F.lit(n)).otherwise(rest), (1024, 512, 256, 128, 64), F.when(size <= 4096, step(512)).otherwise(step(4096)))
    return small.cast("long")


def lookup(name: Column, values: dict[str, float], default: float) -> Column:
    """A small fixed dimension as an expression, with a default."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(default))


def owner_or_default(owner: Column) -> Column:
    return F.coalesce(F.nullif(owner, F.lit("")), F.lit("default"))


def owner_miss_cost(owner: Column) -> Column:
    return lookup(owner, OWNER_MISS_COST, 1.0)


def owner_ttl_ms(owner: Column) -> Column:
    return lookup(owner, OWNER_TTL_MS, DEFAULT_TTL_MS).cast("long")


def type_miss_cost(kind: Column) -> Column:
    return lookup(kind, TYPE_MISS_COST, 1.0)


def benefit(size: Column, hits: Column, idle_ms: Column, miss_cost: Column, p: PolicyParams = PolicyParams()) -> Column:
    """Worth of keeping an entry: cost of a miss and chance of reuse, less memory and the risk of large values."""
    age = F.greatest(F.lit(1), F.floor(idle_ms / 1000))
    reuse = F.least(F.lit(1.0), (hits + 1) / (age + 1))
    memory = size / 1024.0 + (size % 64) * 0.01
    risk = F.when(size > 262_144, 1.0).otherwise(0.0)
    return p.w_miss * miss_cost + p.w_reuse * reuse - p.w_mem * memory - p.w_risk * risk


def deadline_ms(at_ms: Column, ttl_ms: Column) -> Column:
    """When an entry ends; null without a time to live."""
    return at_ms + ttl_ms


def alive(deadline: Column, as_of_ms: Column) -> Column:
    return deadline.isNull() | (deadline > as_of_ms)


def log_alive(tombstone: Column, ttl_epoch_ms: Column, now_ms: Column) -> Column:
    return ~tombstone & ((ttl_epoch_ms < 0) | (ttl_epoch_ms > now_ms))


def ttl_seconds(present: Column, deadline: Column, as_of_ms: Column) -> Column:
    """Whole seconds left; -1 without a deadline, -2 if missing or over."""
    left = F.floor((deadline - as_of_ms) / 1000)
    return F.when(~present, F.lit(-2)).when(deadline.isNull(), F.lit(-1)).when(deadline <= as_of_ms, F.lit(-2)).otherwise(left).cast("long")


def write_error(key: Column, size: Column, max_value: int = MAX_VALUE_BYTES) -> Column:
    """Why a write is refused for its size; null if it is not."""
    return F.when(~F.octet_length(key).between(1, MAX_KEY_BYTES), "invalid key length").when(size > max_value, "value too large")


def unsigned(arg: Column) -> Column:
    """A number argument; null unless it is digits alone and fits 64 bits."""
    return F.when(arg.rlike("^[0-9]+$"), arg.try_cast("bigint"))


def clamp(name: str, value: Column, current: Column) -> Column:
    lo, hi = PARAM_BOUNDS[name]
    return F.least(F.greatest(F.coalesce(value, current), F.lit(lo)), F.lit(hi))


def meta_string(meta: Column, name: str) -> Column:
    """A text member of flat JSON, wherever it stands first; null if there is none."""
    return F.nullif(F.regexp_extract(meta, rf'"{name}"\s*:\s*"([^"]*)"', 1), F.lit(""))


def meta_number(meta: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(meta, rf'"{name}"\s*:\s*([0-9]+)', 1), F.lit("")).try_cast("bigint")


def explain(score: Column, threshold: Column, owner: Column, kind: Column) -> Column:
    return F.concat(F.lit("admit:"), score, F.lit(">"), threshold, F.lit(" owner="), owner, F.lit(" type="), kind)


def fnv64(payloads: list[bytes], basis: int = CONTENT_BASIS) -> np.ndarray:
    """FNV-1a of many byte strings at once: all rows take their n-th byte together, longest first."""
    lengths = np.fromiter(map(len, payloads), np.int64, len(payloads))
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(payloads), np.uint8)
    starts = (np.cumsum(lengths) - lengths)[order]
    h = np.full(len(payloads), basis, np.uint64)
    left = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    with np.errstate(over="ignore"):
        for i, n in enumerate(left.tolist()):
            h[:n] = (h[:n] ^ data[starts[:n] + i]) * np.uint64(FNV64_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def content_hash_rows(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in rows:
        yield pd.Series([format(int(h), "x") for h in fnv64([bytes(b) if b is not None else b"" for b in s])], dtype=str)


def content_hash(payload: Column) -> Column:
    """Lower-case hex, without leading zeros, of a payload's hash (Arrow batches)."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)
    return F.pandas_udf(content_hash_rows, "string")(payload.cast("binary"))


def reply_bulk(value: Column) -> Column:
    return F.when(value.isNull(), "$-1\r\n").otherwise(F.concat(F.lit("$"), F.octet_length(value).cast("string"), F.lit("\r\n"), value, F.lit("\r\n")))


def reply_integer(value: Column) -> Column:
    return F.concat(F.lit(":"), value.cast("string"), F.lit("\r\n"))


def reply_simple(value: Column) -> Column:
    return F.concat(F.lit("+"), value, F.lit("\r\n"))


def reply_error(value: Column) -> Column:
    return F.concat(F.lit("-ERR "), value, F.lit("\r\n"))


def reply_array(replies: Column) -> Column:
    """From an array of encoded replies."""
    return F.concat(F.lit("*"), F.size(replies).cast("string"), F.lit("\r\n"), F.array_join(replies, ""))
