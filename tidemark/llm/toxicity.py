"""Toxic passages by maximum-scoring segments over token log-odds.

Labelled rows give each token a log-odds of toxic against other texts, with a Dirichlet prior in
proportion to its overall frequency; only what is left of it beyond 1.96 standard deviations
counts. Every token also costs ``DRIFT``, so that the scores of clean text fall on average. One
linear scan finds all maximal scoring segments of a text. The largest score of n random tokens
follows an extreme-value law with a rate that the clean token distribution determines; a
segment's expected number of chance equals, K n exp(-rate * score), says whether it is significant.
K and a logistic curve over the evidence of all segments are fitted on labelled rows that the
log-odds have not seen.

Learning takes a bounded sample of labelled rows, the ``LABELS`` least by a hash of doc_id; all
tokens of that sample that tell the kinds apart are broadcast. Labels count only in learning; lang,
source and doc_id are no inputs of a score. Texts are never shuffled. A null doc_id is in no fold.

Tokens are runs of ASCII letters, digits, apostrophes and other than ASCII characters, in lower
case for A-Z. Nulls and texts without tokens have no segments; their score is that of a text
without evidence. Without labels of both kinds every score is the share of toxic labels (0 with
none). A doc_id labelled twice counts as toxic if one label says so; null labels are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, mapped, slices, strings, table, word_hashes, word_spans

LABELS = 100_000
#: Weight of the prior in occurrences of an average token for each token of the sample's vocabulary.
PRIOR = 0.5
DRIFT = 0.15
SIGNIFICANT = 0.01
BATCH_BYTES = 4 << 20

_TOKEN = np.zeros(256, bool)
_TOKEN[128:] = True
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = True


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray  # hashes, sorted
    scores: np.ndarray
    rate: float = 1.0
    k: float = 0.1
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the tokens of all rows, and how many tokens each row has."""
    data = lower_ascii(data)
    starts, ends, counts = word_spans(data, offsets, _TOKEN[data])
    return word_hashes(data, starts, ends), starts, ends, counts


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a sequence, in one pass.

    Each positive score opens a segment; it is joined to the nearest earlier one that began lower
    and ended no higher than it, as often as there is one.
    """
    found: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum with
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, low = i, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((first, i + 1, low, total))
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, high - low) for a, b, low, high in found]


def _scan(model: Model, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """Of each row: tokens, and its segments as (first byte, end, score), offsets in the row."""
    hashes, starts, ends, counts = tokens_of(data, offsets)
    if len(model.tokens) and len(hashes):
        at = np.minimum(np.searchsorted(model.tokens, hashes), len(model.tokens) - 1)
        scores = np.where(model.tokens[at] == hashes, model.scores[at], 0.0) - DRIFT
    else:
        scores = np.full(len(hashes), -DRIFT)
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    positive = np.flatnonzero(scores > 0)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    spans = np.searchsorted(positive, firsts)
    for row in range(len(counts)):
        own = positive[spans[row] : spans[row + 1]]
        if not len(own):
            yield row, int(counts[row]), []
            continue
        # between positive scores only the sum of the others matters
        steps: list[float] = []
        last = own[0]
        for p in own:
            steps += [float(upto[p] - upto[last + 1]) if p > last else 0.0, float(scores[p])]
            last = p
        yield row, int(counts[row]), [(int(starts[own[a // 2]] - offsets[row]), int(ends[own[(b - 1) // 2]] - offsets[row]), s) for a, b, s in maximal_segments(steps)]


def evidence(model: Model, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
    """The best segment's score beyond what n tokens reach by chance, and the summed excess of all."""
    if not segments:
        return 0.0, 0.0
    chance = np.log(max(model.k * n, 1e-9))
    excess = [model.rate * s - chance for _, _, s in segments]
    return max(0.0, max(excess)), float(np.log1p(sum(max(0.0, x) for x in excess)))


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic, fold of the sampled training rows."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", "fold")


def _token_counts(rows: DataFrame) -> DataFrame:
    """h, clean, toxic: how often each token is found in texts of either kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = strings(batch.column(0))
                toxic = np.asarray(batch.column(1)).astype(np.int64) > 0
                for i, j in slices(offsets, 4 * BATCH_BYTES):
                    hashes, _, _, counts = tokens_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    bad = np.repeat(toxic[i:j], counts)
                    h, where = np.unique(hashes, return_inverse=True)
                    n, n_bad = np.bincount(where, minlength=len(h)), np.bincount(where[bad], minlength=len(h))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array((n - n_bad).astype(np.int64)), pa.array(n_bad.astype(np.int64))], names=["h", "clean", "toxic"])

    return mapped(rows.select("text", "toxic"), run, "h long, clean long, toxic long").groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _newton(z: np.ndarray, y: np.ndarray, ridge: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the columns of ``z`` that have the greatest penalised log likelihood, and it.

    Full Newton steps swing between bounds where a few rows lie far out, so each is halved until it climbs.
    """

    def height(w: np.ndarray) -> float:
        at = z @ w
        return float((y * at - np.logaddexp(0, at)).sum() - (ridge * w * w).sum() / 2)

    w = np.zeros(z.shape[1])
    w[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    top = height(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -700, 700)))
        slope = z.T @ (y - p) - ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), slope)
        while (now := height(w + step)) < top + 1e-4 * float(slope @ step) and np.abs(step).max() > 1e-9:
            step = step / 2
        if now <= top:
            break
        w, top = w + step, now
        if np.abs(step).max() < 1e-8:
            break
    return w, top


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Weights of (1, x0, x1), fitted with a small ridge; those of evidence are never negative, so that more of it never lowers a score."""
    z = np.column_stack([np.ones(len(x)), x])
    ridge = np.array([1e-6, 1e-1, 1e-1])
    best, top = np.zeros(3), -np.inf
    # the best weights within the bounds are the best of some columns, with nothing for the others
    for columns in ([0, 1, 2], [0, 1], [0, 2], [0]):
        w, height = _newton(z[:, columns], y, ridge[columns])
        if height > top and (w[1:] >= 0).all():
            best, top = np.zeros(3), height
            best[columns] = w
    return tuple(float(v) for v in best)


def learn(docs: DataFrame, labels: DataFrame, most_labels: int = LABELS) -> Model:
    """A model from the labelled rows outside the held-out fold; what reaches the driver is bounded by their number."""
    rows = _labelled(docs, labels, most_labels)
    counted = _token_counts(rows.where("fold <> 4")).persist()
    n0, n1, v = counted.agg(F.sum("clean"), F.sum("toxic"), F.count("*")).first()
    n0, n1 = n0 or 0, n1 or 0
    model = Model(np.zeros(0, np.uint64), np.zeros(0))
    if n0 and n1:
        a0 = PRIOR * v
        prior = F.lit(PRIOR) * 0.5 + (F.col("clean") + F.col("toxic")) * (a0 * 0.5 / (n0 + n1))
        y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
        odds = F.log(y1 / (n1 + a0 - y1)) - F.log(y0 / (n0 + a0 - y0))
        scored = counted.withColumn("odds", odds).withColumn("sure", F.abs(F.col("odds")) - 1.96 * F.sqrt(1 / y1 + 1 / y0)).where("sure > 0")
        scored = scored.withColumn("score", F.signum("odds") * F.col("sure"))
        best = scored.select("h", "score", "clean").toPandas()
        h = best["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(h)
        scores = best["score"].to_numpy(float)
        share = best["clean"].to_numpy(float) / n0
        rest = max(0.0, 1 - share.sum())
        # the rate at which exceeding a score by chance gets rarer: sum of p * exp(rate * score) = 1
        lo, hi = 1e-6, 1.0
        value = lambda r: float((share * np.exp(np.minimum(r * (scores - DRIFT), 700))).sum() + rest * np.exp(-r * DRIFT))
        while value(hi) < 1 and hi < 64:
            hi *= 2
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if value(mid) < 1 else (lo, mid)
        model = Model(h[order], scores[order], rate=(lo + hi) / 2)
    counted.unpersist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = strings(batch.column(0))
                found = []
                for i, j in slices(offsets, BATCH_BYTES):
                    found += [(n, [s for _, _, s in segments]) for _, n, segments in _scan(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.float64())), batch.column(1).cast(pa.int64())], names=["n", "scores", "toxic"])

    unseen = mapped(rows.where("fold = 4").select("text", "toxic"), run, "n long, scores array<double>, toxic long").toPandas()
    y = (unseen["toxic"].to_numpy(float) > 0).astype(float)
    if not len(y) or not n0 or not n1 or y.min() == y.max():
        total = (n0 > 0) + (n1 > 0)
        rate = (y.mean() if len(y) else 0.0) if total else 0.0
        return Model(model.tokens, model.scores, model.rate, 0.1, (float(np.log(rate / (1 - rate))) if 0 < rate < 1 else (30.0 if rate else -30.0), 0.0, 0.0))
    clean = [(n, max(s)) for n, s, bad in zip(unseen["n"], unseen["scores"], y, strict=True) if not bad and len(s)]
    # the mean of n * exp(-rate * best score) over clean texts is 1 / K; texts without a segment count as score 0
    empty = [n for n, s, bad in zip(unseen["n"], unseen["scores"], y, strict=True) if not bad and not len(s)]
    mean = (sum(n * np.exp(-model.rate * s) for n, s in clean) + sum(empty)) / max(1, len(clean) + len(empty))
    model = Model(model.tokens, model.scores, model.rate, float(np.clip(1 / max(mean, 1e-9), 1e-6, 1.0)))
    x = np.array([evidence(model, n, [(0, 0, v) for v in s]) for n, s in zip(unseen["n"], unseen["scores"], strict=True)])
    return Model(model.tokens, model.scores, model.rate, model.k, _logistic(x, y))


def passages(docs: DataFrame, model: Model, significant: float = SIGNIFICANT) -> DataFrame:
    """doc_id, n_tokens, score, and the significant passages (first byte, end, score, expected by chance) of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = strings(batch.column(1))
                tokens, scores, spans = [], [], []
                for i, j in slices(offsets, BATCH_BYTES):
                    for _, n, segments in _scan(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                        a, b = evidence(model, n, segments)
                        w = model.curve
                        tokens.append(n)
                        scores.append(float(1 / (1 + np.exp(-np.clip(w[0] + w[1] * a + w[2] * b, -30, 30)))))
                        e = [model.k * n * float(np.exp(-model.rate * s)) for _, _, s in segments]
                        spans.append([{"start": p, "end": q, "score": s, "expected": x} for (p, q, s), x in zip(segments, e, strict=True) if x <= significant])
                kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, kinds)], names=["doc_id", "n_tokens", "score", "passages"])

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, score double, passages array<struct<start: long, end: long, score: double, expected: double>>")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = passages(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
