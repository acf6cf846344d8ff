"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target number of words, so each of its documents should be taken
target / source_size times: whole copies, and a fraction that is rounded. Two documents with
fractions meet and one randomly gives words to the other until one of them is whole; their
expectations and the words of both together stay. Documents of a source are dealt over buckets;
each bucket leaves one fractional residual at most, and residuals meet in a tree of fixed fan-in
until one is left, which is rounded by itself. What that adds or lacks, less than the words of one
document, is taken back at the root: documents there whose size is closest to it change sides as
long as that brings the source nearer to its target.

Draws are hashes of the document's key and the seed: reruns agree, wherever tasks run.

Null sources are one source, the last; null and wordless texts have size 0 and are never taken;
rows with the same doc_id, source and size are one unit, taken or left together; an empty table
gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, packed, ship, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents of one bucket, and residuals that meet in one node of the tree.
BUCKET, FAN_IN = 1024, 64
SEED = 20240229
#: Decisions that are broadcast to where the texts lie.
BROADCAST_DECISIONS = 300_000


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null. Splitting at white space leaves at most an empty first and last part."""
    parts = F.split(text, r"[\x20\x09-\x0D]+")
    return F.coalesce(F.size(F.array_remove(parts, "")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A join key under which null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s:"), source), F.lit("n"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source_key, source_size, target of every source, from rows source, source_key, size.

    Raising all targets in step with their weights, a source stops at ``most`` times its size:
    target = min(most * size, level * weight). Sources are ordered by the level at which they
    stop; the first whose stop is not reached by what is left gives the level. There is one row
    for each source here, not for each document.
    """
    sources = sized.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    weight = F.lit(float(weights[-1]))
    for i in range(len(weights) - 1):
        weight = F.when(nth % len(weights) == i, F.lit(float(weights[i]))).otherwise(weight)
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    everything = Window.partitionBy()
    sources = (
        sources.withColumn("stopped", F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("weights"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.max(F.when(F.col("open"), F.struct(-F.col("stopped"), F.col("level")))).over(everything)["level"])
    )
    return sources.select("source_key", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _draw(a: np.ndarray, b: int) -> float:
    h = (int(a) * 0x9E3779B97F4A7C15 + b * 0xD6E8FEB86659FD93 + SEED) & (2**64 - 1)
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & (2**64 - 1)
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & (2**64 - 1)
    return ((h ^ h >> 31) >> 11) / 2**53


def pivotal(fraction: np.ndarray, size: np.ndarray, key: np.ndarray, last: bool) -> tuple[np.ndarray, int]:
    """Fractions rounded to 0 or 1 one after another, and the index of the one that stays fractional (-1 if none).

    When i and j meet, words move one way or the other until one of them is 0 or 1; each way has
    the chance that keeps both expectations, and size * fraction of both together is unchanged.
    """
    out = fraction.astype(float).copy()
    i = -1
    for j in range(len(out)):
        if not 1e-12 < out[j] < 1 - 1e-12:
            out[j] = round(out[j])
            continue
        if i < 0:
            i = j
            continue
        si, sj = size[i], size[j]
        give = min(out[i] * si, (1 - out[j]) * sj)  # words from i to j
        take = min((1 - out[i]) * si, out[j] * sj)  # words from j to i
        words = -give if _draw(key[i], int(key[j])) < take / (give + take) else take
        out[i] += words / si
        out[j] -= words / sj
        for k in (i, j):
            if out[k] < 1e-9 or out[k] > 1 - 1e-9:
                out[k] = round(out[k])
        i = i if 0 < out[i] < 1 else j if 0 < out[j] < 1 else -1
    if last and i >= 0:
        words = out[i] * size[i]
        out[i] = float(_draw(key[i], -1) < out[i])
        over, i = out[i] * size[i] - words, -1
        free = (fraction > 1e-12) & (fraction < 1 - 1e-12)
        while True:
            able = np.flatnonzero(free & (out == (1.0 if over > 0 else 0.0)))
            if not len(able):
                break
            k = able[np.argmin(np.abs(size[able] - abs(over)))]
            left = over - size[k] if over > 0 else over + size[k]
            if abs(left) >= abs(over):
                break
            out[k], over = 1 - out[k], left
    return out, i


def _level(units: DataFrame, last: bool) -> DataFrame:
    """One level of the tree: rounds the units of each node; open marks its residual. Works on unit rows, no texts."""

    def run(group: pa.Table) -> pa.Table:
        size, key = np.asarray(group.column("unit_size")).astype(float), np.asarray(group.column("unit_key"))
        doc = group.column("doc_key").to_pylist()
        order = np.array(sorted(range(len(size)), key=lambda i: (-size[i], key[i], doc[i])), np.int64)
        rounded, left = pivotal(np.asarray(group.column("fraction"))[order], size[order], key[order], last)
        is_open = np.zeros(len(order), bool)
        if left >= 0:
            is_open[left] = True
        group = group.take(order)
        group = group.set_column(group.schema.get_field_index("fraction"), "fraction", pa.array(rounded))
        return group.set_column(group.schema.get_field_index("open"), "open", pa.array(is_open))

    ship(units.sparkSession)
    return units.groupBy("source_key", "node").applyInArrow(run, units.schema)


def copies(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """doc_id, source_key, size, source_size, target, copies of every distinct unit of ``sized`` (doc_id, source, source_key, size)."""
    targets = checkpointed(source_targets(sized, weights, most))
    n_sources, largest = targets.agg(F.count("*"), F.max("source_size")).first()
    units = sized.groupBy("doc_id", "source_key", "size").agg(F.count("*").alias("m"))
    # one row for each source: broadcast while they are few, else an ordinary join
    joined = units.join(F.broadcast(targets) if n_sources <= 100_000 else targets, "source_key")
    counts = units.groupBy("source_key").agg(F.count("*").alias("units"))
    joined = joined.join(F.broadcast(counts) if n_sources <= 100_000 else counts, "source_key")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a share within rounding error of a whole number is that number
    share = F.when(F.abs(share - F.round(share)) < 1e-12, F.round(share)).otherwise(share)
    doc_key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    units = (
        joined.withColumn("share", share)
        .withColumn("fraction", F.when(F.col("size") > 0, F.col("share") - F.floor("share")).otherwise(0.0))
        .withColumn("whole", F.when(F.col("size") > 0, F.floor("share")).otherwise(0))
        .withColumn("unit_size", F.col("size") * F.col("m"))
        .withColumn("doc_key", doc_key)
        .withColumn("unit_key", F.xxhash64("doc_key", "source_key", "size"))
        .withColumn("node", F.pmod(F.xxhash64("unit_key", F.lit(SEED)), F.ceil(F.col("units") / BUCKET)))
        .withColumn("open", F.lit(False))
    )
    columns = ["doc_id", "source_key", "size", "source_size", "target", "whole", "fraction", "unit_size", "unit_key", "doc_key", "node", "open"]
    most_units = joined.agg(F.max("units")).first()[0] or 0
    nodes = -(-most_units // BUCKET)
    level = checkpointed(_level(units.select(columns), last=nodes <= 1))
    done = [level.where("NOT open")]
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        rest = level.where("open").withColumn("node", F.floor(F.col("node") / FAN_IN)).withColumn("open", F.lit(False))
        level = checkpointed(_level(rest.select(columns), last=nodes <= 1))
        done.append(level.where("NOT open"))
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found.select("doc_id", "source_key", "size", "source_size", "target", (F.col("whole") + F.col("fraction").cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES, prefix: str = "mix_") -> DataFrame:
    """``docs`` (doc_id, text, source, any others) with how often each row is taken, in columns that begin with ``prefix``."""
    size, source = f"{prefix}size", f"{prefix}source"
    docs = docs.withColumn(size, n_words(F.col("text"))).withColumn(source, source_key(F.col("source")))
    sized = checkpointed(docs.select("doc_id", "source", F.col(source).alias("source_key"), F.col(size).alias("size")))
    taken = copies(sized, weights, most).select(
        F.col("doc_id").alias(f"{prefix}doc_id"), F.col("source_key").alias(f"{prefix}key"), F.col("size").alias(f"{prefix}n"), F.col("source_size").alias(f"{prefix}source_size"), F.col("target").alias(f"{prefix}target"), F.col("copies").alias(f"{prefix}copies")
    )
    # decisions have a row for each document, so they are broadcast only up to a count; else texts are shuffled
    taken = checkpointed(taken)
    taken = F.broadcast(taken) if taken.count() <= BROADCAST_DECISIONS else taken
    on = docs["doc_id"].eqNullSafe(taken[f"{prefix}doc_id"]) & (docs[source] == taken[f"{prefix}key"]) & (docs[size] == taken[f"{prefix}n"])
    return docs.join(taken, on).drop(f"{prefix}doc_id", f"{prefix}key", f"{prefix}n", source)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns."""
    taken = mix(packed(docs, "doc_id", "text", "source"), weights, most).where("mix_copies > 0")
    return taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select("packed.*")


def sizes_and_copies(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; texts are read once and never shuffled."""
    sized = docs.select("doc_id", "source", source_key(F.col("source")).alias("source_key"), n_words(F.col("text")).alias("size"))
    sized = checkpointed(sized)
    taken = copies(sized).withColumnsRenamed({"doc_id": "d", "source_key": "k", "size": "n"})
    on = sized["doc_id"].eqNullSafe(taken["d"]) & (sized["source_key"] == taken["k"]) & (sized["size"] == taken["n"])
    return sized.join(taken, on).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes_and_copies(table(spark, sf_dir, "documents"))
