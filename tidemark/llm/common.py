"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside the ASCII white space 0x20 and 0x09-0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, through Spark's own file server."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def trim() -> None:
    """Gives freed memory of this worker, which may stay idle for long, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow``, with this package on the executors."""
    ship(df.sparkSession)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(trimmed, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows, but for the last, that hold every group of equal ``column`` whole; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        g = np.asarray(t.column(column))
        others = np.flatnonzero(g != g[-1])
        if len(others):
            yield t.slice(0, int(others[-1]) + 1)
            held = t.slice(int(others[-1]) + 1).to_batches()
            n = sum(b.num_rows for b in held)
    if n:
        yield pa.Table.from_batches(held)


def in_groups(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema, least: int = 20_000) -> DataFrame:
    """``run`` over tables of whole groups (by g) of ``rows``, of ``least`` rows or more, but for the last."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for t in whole_groups(batches, "g", least):
                yield from run(t).to_batches()

    return mapped(rows.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g"), whole, schema)


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The columns ``names`` of ``docs``, and all of its columns in one named packed, so that no name can clash."""
    return docs.select(*names, F.struct(*(docs[c] for c in docs.columns)).alias("packed"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``docs`` has it."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application.

    It is in the one that the session names in spark.checkpoint.dir. Where that is unset, a folder
    of this machine serves a local session (as in tests); on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def laid_out(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` checkpointed in hash partitions by ``keys``, which later joins on them use as they are; without keys, in those it has.

    Spark keeps the partitioning of a checkpoint only where it was planned without adaptive execution.
    """
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    df = df.repartition(partitions(df.sparkSession), *keys) if keys else df
    conf.set(name, "false")
    try:
        return checkpointed(df)
    finally:
        conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of finished steps.

    Spark deletes them when the driver collects the objects that stand for them; between
    checkpoints of a long query that would happen too late to matter.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]):
    """A join condition on ``keys`` under which nulls match nulls."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column, without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes each, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and how many words the rows have. Words end with their row.

    inside: which bytes belong to words; those that are not white space, if not given.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    if inside is None:
        inside = ~is_space(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


_ODD = 0x9E3779B97F4A7C15
_BYTES = (np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            base, inverse = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 2**64))
            cls.up = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, base, np.uint64))])
            cls.down = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, inverse, np.uint64))])
        return cls.up[:n], cls.down[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 2 << 20) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, by prefix sums, mixed with its length.

    Sums are kept for about ``block`` bytes at a time, so that memory does not follow the text.
    """
    found = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, side="right")))
        first = int(starts[i])
        part = data[first : int(ends[j - 1])]
        up, down = _Powers.get(len(part) + 1)
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[:-1], out=prefix[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        found[i:j] = mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return found


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8, copy=False)
