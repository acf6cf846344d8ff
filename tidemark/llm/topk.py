"""Exact top-k search by inner product with MaxScore, over integer vectors.

A dimension is a term, a vector's distance from the dimension's least useful value is its impact.
For a query every dimension then adds between nothing and a bound, and a score is a base that the
query determines plus such parts. Each query orders dimensions by bound, for each shard anew. As
many of the last ones as together cannot lift a vector from the base above the score to beat are
non-essential. The essential ones are traversed; the others are probed a few at a time, and only for
vectors that are still competitive with the bounds of what is left. Vectors come in strips by falling
norm: the score to beat rises with each strip, and the split moves with it. A shard, or a strip, whose bounds together
stay below the score to beat is left out without looking at its vectors.

The score to beat starts as the k-th score among ``SEEDS`` vectors of the whole table, those of
greatest norm, which is a lower bound of the k-th score of all; it only saves work.

Vectors are packed in shards and queries in blocks, both of bounded size; every shard meets every
block once, as rows of a join on (shard, block). A shard's k best of each query are merged by a
ranking that is cut to k before the shuffle.

Null vectors and such with null or non-finite components take no part, as queries or candidates;
vectors shorter than others have 0 in the dimensions that they lack; an empty vector scores 0.
A query's own row is left out by its vec_id, and with it all rows that share the vec_id; a query
that is given twice is answered twice. Ties go to the smaller vec_id. Components are floor(64 * x);
scores are exact, by integers of any size where floats would round, and held within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, mapped, ship, table

K = 20
SCALE = 64
EVERY = 20
SHARD, BLOCK = 8192, 512
#: Vectors in a strip, dimensions that are probed together, and vectors that give the first score to beat.
STRIP, PROBE, SEEDS = 1024, 8, 256


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _packed(rows: DataFrame, name: str, size: int, n: int) -> DataFrame:
    """``rows`` (vec_id, v) dealt into groups of about ``size``: ``name``, ids and components as bytes, and the width."""
    groups = max(1, -(-n // size))

    def run(group: pa.Table) -> pa.Table:
        ids = np.asarray(group.column("vec_id"))
        vectors = [np.floor(np.asarray(v, float) * SCALE) for v in group.column("v").to_pylist()]
        width = max((len(v) for v in vectors), default=0)
        matrix = np.zeros((len(ids), width))
        for i, v in enumerate(vectors):
            matrix[i, : len(v)] = v
        order = np.argsort(ids, kind="stable")
        # 16-bit integers where they suffice
        fits = matrix.size == 0 or np.abs(matrix).max() < 1 << 15
        matrix = matrix[order].astype(np.int16 if fits else np.float64)
        return pa.table({name: pa.array([group.column("group")[0].as_py()], pa.int64()), "ids": [ids[order].tobytes()], "m": [matrix.tobytes()], "width": pa.array([width], pa.int64()), "fits": [bool(fits)]})

    ship(rows.sparkSession)
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(groups)).cast("int"))
    return dealt.groupBy("group").applyInArrow(run, f"{name} long, ids binary, m binary, width long, fits boolean")


def _matrix(data: bytes, width: int, fits: bool, columns: int) -> np.ndarray:
    m = np.frombuffer(data, np.int16 if fits else np.float64)
    m = m.reshape(-1, width).astype(np.float64) if width else np.zeros((0, 0))
    return np.pad(m, ((0, 0), (0, columns - width))) if m.shape[1] < columns else m


def split(bounds: np.ndarray, room: float) -> int:
    """How many of the dimensions, whose ``bounds`` fall, are essential: the others together add no more than ``room``."""
    rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0.0]])
    return int(np.argmax(rest < room)) if room > 0 else len(bounds)


def max_score(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, to_beat: np.ndarray | None = None, touched: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of its k best vectors and their scores, for exact float arithmetic.

    to_beat: for each query a score that its k best reach; lower ones may be left out. touched: gets
    (essential dimensions, vectors, components looked at) of each query and strip.
    """
    order = np.lexsort((ids, -np.einsum("ij,ij->i", vectors, vectors)))
    strips = []
    for at in range(0, len(order), STRIP):
        rows = order[at : at + STRIP]
        own = vectors[rows]
        # by dimension, so that what is traversed lies together
        strips.append((rows, own.min(axis=0), own.max(axis=0), np.ascontiguousarray(own.T)))
    found = []
    for i, q in enumerate(queries):
        threshold = -np.inf if to_beat is None else to_beat[i]
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        for rows, least, most, own in strips:
            low, high = np.minimum(q * least, q * most), np.maximum(q * least, q * most)
            base = low.sum()
            if high.sum() < threshold:
                if touched is not None:
                    touched.append((0, len(rows), 0))
                continue
            by = np.argsort(low - high, kind="stable")
            n = max(1, split((high - low)[by], threshold - base)) if len(by) else 0
            able = np.flatnonzero(ids[rows] != query_ids[i])
            part = q[by[:n]] @ own[by[:n]]
            looked = n * len(rows)
            while n < len(by):
                able = able[part[able] + high[by[n:]].sum() >= threshold]
                dims = by[n : n + PROBE]
                if len(able) * 4 > len(rows):
                    part += q[dims] @ own[dims]
                    looked += len(dims) * len(rows)
                else:
                    part[able] += q[dims] @ own[np.ix_(dims, able)]
                    looked += len(dims) * len(able)
                n += len(dims)
            able = able[part[able] >= threshold]
            if touched is not None:
                touched.append((min(len(by), max(1, split((high - low)[by], threshold - base))), len(rows), looked))
            best, scores = np.concatenate([best, rows[able]]), np.concatenate([scores, part[able]])
            if len(best) > k:
                top = np.lexsort((ids[best], -scores))[:k]
                best, scores = best[top], scores[top]
            if len(best) == k:
                threshold = max(threshold, scores.min())
        top = np.lexsort((ids[best], -scores))[:k]
        found.append((best[top], scores[top]))
    return found


def _exact(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, list[int]]]:
    """The same by integers of any size, for components that floats would round."""
    found, whole = [], [[int(x) for x in v] for v in vectors]
    for q, own in zip(queries, query_ids, strict=True):
        q = [int(x) for x in q]
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), int(i), row) for row, (v, i) in enumerate(zip(whole, ids, strict=True)) if i != own)[:k]
        found.append((np.array([row for _, _, row in scores], np.int64), [max(-(2**63), min(2**63 - 1, -s)) for s, _, _ in scores]))
    return found


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best vectors of every query among all rows (vec_id, ``vector``)."""
    rows = vectors.where(usable(F.col(vector))).where("vec_id IS NOT NULL").select("vec_id", F.col(vector).alias("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x.cast("double")))
    asked = rows.where(is_query)
    n, n_asked = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_asked // BLOCK))
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    seeds = [(r.vec_id, np.floor(np.array(r.v) * SCALE)) for r in rows.orderBy(norm.desc(), "vec_id").limit(SEEDS).collect()]
    left = checkpointed(_packed(rows, "shard", SHARD, n)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = checkpointed(_packed(asked, "block", BLOCK, n_asked)).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    right = right.select("shard", "block", *(F.col(c).alias(f"q_{c}") for c in ("ids", "m", "width", "fits")))
    parts = min(shards * blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * 8)
    met = left.repartition(parts, "shard", "block").join(right.repartition(parts, "shard", "block"), ["shard", "block"])

    def first_to_beat(q: np.ndarray, query_ids: np.ndarray) -> np.ndarray:
        """The k-th score of each query among the seeds, where floats are exact."""
        width = max([q.shape[1], *(len(v) for _, v in seeds)])
        m = np.zeros((len(seeds), width))
        for i, (_, v) in enumerate(seeds):
            m[i, : len(v)] = v
        if not m.size or not q.size or float(np.abs(m).max()) * float(np.abs(q).max()) * width >= 2**52:
            return np.full(len(q), -np.inf)
        scores = np.pad(q, ((0, 0), (0, width - q.shape[1]))) @ m.T
        scores[query_ids[:, None] == np.array([i for i, _ in seeds])[None, :]] = -np.inf
        return np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                value = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
                width = max(value("width"), value("q_width"))
                ids, query_ids = np.frombuffer(value("ids"), np.int64), np.frombuffer(value("q_ids"), np.int64)
                v = _matrix(value("m"), value("width"), value("fits"), width).reshape(len(ids), width)
                q = _matrix(value("q_m"), value("q_width"), value("q_fits"), width).reshape(len(query_ids), width)
                exact = not v.size or not q.size or float(np.abs(v).max()) * float(np.abs(q).max()) * width < 2**52
                best = max_score(q, query_ids, v, ids, k, first_to_beat(q, query_ids)) if exact else _exact(q, query_ids, v, ids, k)
                number = value("block") * (1 << 32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.full(len(x), number + i, np.int64) for i, (x, _) in enumerate(best)])),
                        pa.array(np.concatenate([np.full(len(x), query_ids[i], np.int64) for i, (x, _) in enumerate(best)])),
                        pa.array(np.concatenate([ids[x] for x, _ in best])),
                        pa.array(np.concatenate([np.array(s, np.float64 if exact else object).astype(np.int64) for _, s in best])),
                    ],
                    names=["query", "query_id", "vec_id", "score"],
                )

    scored = mapped(met, run, "query long, query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH c AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM c AS q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
