"""Binary log segments: one file each, records with a fixed header, checked on reading."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.scalars import fnv64
from tidemark.model import FNV32_BASIS, FNV32_PRIME, FNV64_BASIS
from tidemark.session import ship

# Fixed value: what a record begins with.
MAGIC = 0x504D3443
#: magic, checksum, key hash, seq, next offset, ttl, key length, value length, tombstone, reserved: 56 bytes.
HEADER = struct.Struct("<IIQQQqIIB7s")


def checksum(parts: tuple[bytes, ...]) -> int:
    h = FNV32_BASIS
    for part in parts:
        for b in part:
            h = ((h ^ b) * FNV32_PRIME) & 0xFFFFFFFF
    return h


def pack(seq: int, key: bytes, value: bytes, ttl_epoch_ms: int = -1, tombstone: bool = False, offset: int = 0) -> bytes:
    """One record; the checksum covers all of it but itself."""
    rest = (int(fnv64([key], FNV64_BASIS)[0]), seq, offset + HEADER.size + len(key) + len(value), ttl_epoch_ms, len(key), len(value), int(tombstone), b"\0" * 7)
    plain = HEADER.pack(MAGIC, 0, *rest)
    return HEADER.pack(MAGIC, checksum((plain[:4], plain[8:], key, value)), *rest) + key + value


def scan(data: bytes) -> Iterator[tuple[int, int, str, bytes, int, bool]]:
    """offset, seq, key, value, ttl_epoch_ms, tombstone of the records up to the first that is damaged or cut."""
    at = 0
    while at + HEADER.size <= len(data):
        magic, check, _, seq, _, ttl, n_key, n_value, tombstone, _ = HEADER.unpack_from(data, at)
        end = at + HEADER.size + n_key + n_value
        if magic != MAGIC or end > len(data):
            return
        head, key, value = data[at : at + HEADER.size], data[at + HEADER.size : at + HEADER.size + n_key], data[at + HEADER.size + n_key : end]
        if checksum((head[:4], head[8:], key, value)) != check:
            return
        yield at, seq, key.decode("utf-8", "replace"), value, ttl, bool(tombstone)
        at = end


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """segment_id, offset, seq, key, value, ttl_epoch_ms, tombstone, len of all files segment_<id>.log; a damaged tail is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(scan(data.as_py()))
                number = int(name.rsplit("_", 1)[-1].split(".")[0])
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(rows), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.bool_()), pa.array([len(v) for v in cols[3]], pa.int64())],
                    names=["segment_id", "offset", "seq", "key", "value", "ttl_epoch_ms", "tombstone", "len"],
                )

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "segment_*.log").load(path).select("path", "content")
    return files.mapInArrow(run, "segment_id int, offset long, seq long, key string, value binary, ttl_epoch_ms long, tombstone boolean, len long")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """segment_id, active from lines segment=<id> and active=<id>."""
    from pyspark.sql import functions as F

    lines = spark.read.text(path).select(F.split("value", "=").alias("p")).select(F.get("p", F.lit(0)).alias("name"), F.get("p", F.lit(1)).try_cast("int").alias("id"))
    found = lines.where("name IN ('segment', 'active') AND id IS NOT NULL")
    return found.groupBy(F.col("id").alias("segment_id")).agg(F.max(F.col("name") == "active").alias("active"))
