"""Scores by a Brown class-based bigram model.

Words of the training texts are counted and assigned to classes by exchange clustering, so that
class bigrams tell most about each other:

1. The ``CORE`` most frequent words in turn move to the class that raises the likelihood most, with
   fresh counts between the sweeps, until a sweep adds less than ``SETTLED`` of what classes tell.
2. Every other word that occurs twice or more moves from the class of the rest to the class where
   the slope of the same likelihood, by the classes around its occurrences, is greatest. Its own
   counts are small against those of a class, so that slope and gain order the classes alike.

There is no cap: the words with a class grow with the corpus. Words that occur once, which have no
distribution of their own, stay in the class of the rest and stand for those not seen at all; the
end of a text, before and after it, is a class too. A token's probability is that of its class
after the class before it, times that of the word in its class, both smoothed, mixed with the
unigram base model, so that no token is impossible.

Texts of the core are kept as sequences of 16-bit word numbers; each sweep counts words by the
classes around them, in one matrix of fixed size for each task, and sums those by word, a row of packed
counts for each. What reaches the driver comes as Arrow tables, not as Python rows. Contexts of
other words are summed within tasks, then by word where its class is chosen. Counts and classes of
words are a distributed table. The ``KNOWN`` most frequent ones are also sent to all tasks, which only
saves work: bigrams with a rarer word are joined with the table on either side, for transition
counts as for scores, each text's equal bigrams as one row.

Nulls are empty texts, which are one end token. Without training texts all scores are 0. Rows are
told apart even if they share a doc_id or have none (a null doc_id is in training, as no remainder
says otherwise); words are told apart by 64-bit hashes. Only doc_id and text are read, so that other
columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, in_groups, lower_ascii, mapped, partitions, release, slices, strings, table, word_hashes, word_spans

CORE, KNOWN = 8192, 400_000
CLASSES = 48
#: Sweeps end when one adds less than this share of the mutual information of neighbouring classes.
SETTLED = 1e-3
#: Words that occur as often have a class of their own kind; rarer ones are in the class of the rest.
SEEN = 2
#: Weight of the class model against the base model; prior observations of each class's successors.
SHARE, PRIOR = 0.85, 10.0
BATCH_BYTES = 4 << 20


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = lower_ascii(data)
    starts, ends, counts = word_spans(data, offsets)
    return word_hashes(data, starts, ends), counts


def word_counts(texts: DataFrame) -> DataFrame:
    """h, n of every word of ``texts`` (text), with one row h = 0 for the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = strings(batch.column(0))
                for i, j in slices(offsets, 4 * BATCH_BYTES):
                    hashes, _ = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    h, n = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(h.view(np.int64), 0)), pa.array(np.append(n, j - i).astype(np.int64))], names=["h", "n"])

    return mapped(texts.select("text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def least_known(counts: DataFrame, most: int) -> int:
    """The least count that no more than ``most`` words reach."""
    order = Window.orderBy(F.col("n").desc())
    # one row for each count that occurs
    levels = counts.groupBy("n").agg(F.count("*").alias("words")).withColumn("upto", F.sum("words").over(order))
    found = levels.where(F.col("upto") <= most).agg(F.min("n")).first()[0]
    return 2**62 if found is None else int(found)


def _find(sorted_hashes: np.ndarray, numbers: np.ndarray, h: np.ndarray, missing: int) -> np.ndarray:
    if not len(sorted_hashes) or not len(h):
        return np.full(len(h), missing, np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == h, numbers[at], missing)


def sequences(texts: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Of each text the numbers of its words (binary of 16-bit integers), words beyond the vocabulary as its size, the end as size + 1."""
    order = np.argsort(vocabulary)
    hashes, size = vocabulary[order], len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = strings(batch.column(0))
                for i, j in slices(offsets, BATCH_BYTES):
                    h, counts = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    ends = np.cumsum(counts)
                    numbers = np.insert(_find(hashes, order, h, size), ends, size + 1).astype(np.uint16)
                    # one row for each slice: what matters is which words are neighbours
                    yield pa.RecordBatch.from_arrays([pa.array([numbers.tobytes()], pa.binary())], names=["numbers"])

    return mapped(texts.select("text"), run, "numbers binary")


def _word_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """w, cells: of each word that has counts in ``total`` (words x cells), these as one binary of 64-bit integers."""
    words = np.flatnonzero(total.any(axis=1))
    for i in range(0, len(words), 1024):
        part = words[i : i + 1024]
        upto = np.arange(len(part) + 1, dtype=np.int32) * np.int32(total.shape[1] * 8)
        cells = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(upto), pa.py_buffer(np.ascontiguousarray(total[part]))])
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), cells], names=["w", "cells"])


def _add_rows(total: np.ndarray, batch: pa.RecordBatch | pa.Table) -> None:
    for w, cells in zip(np.asarray(batch.column(0)).tolist(), batch.column(1), strict=True):
        total[w] += np.frombuffer(cells.as_buffer(), np.int64)


def word_cells(seqs: DataFrame, classes: np.ndarray, n_classes: int) -> DataFrame:
    """w, cells: how often word w is followed by each class, then how often it follows each. One row a word."""
    words = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, words, n_classes), np.int64)
        after, before = total[0].reshape(-1), total[1].reshape(-1)
        for batch in batches:
            for b in batch.column(0):
                w = np.frombuffer(b.as_buffer(), np.uint16).astype(np.int64)
                if not len(w):
                    continue
                c = classes[w]
                after += np.bincount(np.concatenate([[words - 1], w[:-1]]) * n_classes + c, minlength=words * n_classes)
                before += np.bincount(w * n_classes + np.concatenate([[classes[words - 1]], c[:-1]]), minlength=words * n_classes)
        yield from _word_rows(np.concatenate([total[0], total[1]], axis=1))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words, 2 * n_classes), np.int64)
        for batch in batches:
            _add_rows(total, batch)
        yield from _word_rows(total)

    schema = "w int, cells binary"
    return mapped(mapped(seqs, run, schema).repartition(partitions(seqs.sparkSession), "w"), summed, schema)


def _cells(seqs: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """[0, w, c]: how often word w is followed by class c; [1, w, c]: how often it follows class c. Of bounded size."""
    found = np.zeros((len(classes), 2 * n_classes), np.int64)
    _add_rows(found, word_cells(seqs, classes, n_classes).toArrow())
    return np.stack([found[:, :n_classes], found[:, n_classes:]]).astype(float)


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(after: np.ndarray, before: np.ndarray, classes: np.ndarray, movable: int) -> tuple[np.ndarray, int]:
    """One sweep: each of the first ``movable`` words moves to the class that raises the likelihood of class bigrams most.

    after[w, c] and before[w, c] count classes next to each word as they were before the sweep; class counts follow every move.
    """
    classes = classes.copy()
    k = after.shape[1]
    pairs, left, right = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    np.add.at(pairs, classes, after)
    left, right = pairs.sum(axis=1), pairs.sum(axis=0)
    moved = 0
    fixed = set(classes[movable:].tolist())
    allowed = np.array([c not in fixed for c in range(k)])
    for w in range(movable):
        s, p, a = after[w], before[w], classes[w]
        ns, np_ = s.sum(), p.sum()
        pairs[a] = np.maximum(pairs[a] - s, 0)
        pairs[:, a] = np.maximum(pairs[:, a] - p, 0)
        left[a] -= ns
        right[a] -= np_
        gain = (_x_log_x(pairs + s) - _x_log_x(pairs)).sum(axis=1) + (_x_log_x(pairs + p[:, None]) - _x_log_x(pairs)).sum(axis=0)
        gain -= _x_log_x(left + ns) - _x_log_x(left) + _x_log_x(right + np_) - _x_log_x(right)
        gain[~allowed] = -np.inf
        b = int(np.argmax(gain))
        if gain[b] <= gain[a] + 1e-9:
            b = a
        moved += b != a
        classes[w] = b
        pairs[b] += s
        pairs[:, b] += p
        left[b] += ns
        right[b] += np_
    return classes, moved


def clustered(texts: DataFrame, vocabulary: np.ndarray, n: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the words of ``vocabulary`` (most frequent first, n times each), of the rest and the end; and the counts of class pairs."""
    m, k = len(vocabulary), n_classes + 2
    seqs = checkpointed(sequences(texts, vocabulary))
    # words begin in classes by frequency, so that each has about as many tokens to start with
    share = np.cumsum(n) - n
    classes = np.concatenate([(share * n_classes // max(1, int(n.sum()))).astype(np.int64), [n_classes, n_classes + 1]])
    best, told, found = classes, -np.inf, np.zeros((k, k))
    while True:
        cells = _cells(seqs, classes, k)
        pairs = np.zeros((k, k))
        np.add.at(pairs, classes, cells[0])
        total = max(1.0, pairs.sum())
        now = (_x_log_x(pairs).sum() - _x_log_x(pairs.sum(axis=0)).sum() - _x_log_x(pairs.sum(axis=1)).sum()) / total + np.log(total)
        before = told
        if now > told:
            best, told, found = classes, now, pairs
        if now - before <= SETTLED * abs(now):
            return best, found
        classes, moved = exchange(cells[0], cells[1], classes, m)
        if not moved:
            return best, found


def _integers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(np.int64, copy=True)


def _lookup(words: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(words)
    return (words[order], *(v[order] for v in values))


def other_words(texts: DataFrame, vocabulary: np.ndarray, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """h, n, c of the words of ``texts`` beyond ``vocabulary``: how often they occur, and their class."""
    k = len(pairs)
    rest, end = k - 2, k - 1
    hashes, of_word = _lookup(vocabulary, classes[: len(vocabulary)])
    # slopes of the likelihood for one more class c after, or before, a word of class b
    smooth = pairs + PRIOR / k
    after = (np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))).T[:, :rest]
    before = (np.log(smooth) - np.log(smooth.sum(axis=0, keepdims=True)))[:, :rest]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> pa.RecordBatch:
            h, cell = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.lexsort((cell, h))
            h, cell = h[order], cell[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])]))
            n = np.diff(np.append(first, len(h)))
            h, value = h[first], (cell[first].astype(np.uint32) << np.uint32(24)) | n.astype(np.uint32)
            word = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            cells = pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(np.append(word, len(h)).astype(np.int32) * np.int32(4)), pa.py_buffer(value)])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h[word].view(np.int64)), cells], names=["g", "cells"])

        with np.errstate(over="ignore"):
            size = 0
            for batch in batches:
                data, offsets = strings(batch.column(0))
                for i, j in slices(offsets, BATCH_BYTES):
                    h, counts = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    c = _find(hashes, of_word, h, -1)
                    other, ends = np.flatnonzero(c < 0), np.cumsum(counts)
                    c[other] = rest
                    own, at = h[other], other + np.searchsorted(ends, other, side="right")
                    c = np.insert(c, ends, end)
                    # a text begins after an end
                    left, right = np.concatenate([[end], c[:-1]])[at], np.append(c[1:], end)[at]
                    # a cell's count has 24 bits
                    for x in range(0, len(own), 1 << 22):
                        part = slice(x, x + (1 << 22))
                        held += [(own[part], right[part].astype(np.uint8)), (own[part], (left[part] + k).astype(np.uint8))]
                        size += 2 * len(own[part])
                        if size >= 2_000_000:
                            yield summed()
                            size = 0
            if size:
                yield summed()

    def assigned(t: pa.Table) -> pa.Table:
        h, column = np.asarray(t.column("g")), t.column("cells").combine_chunks()
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        value = np.frombuffer(column.buffers()[2], np.uint32, offset=int(ends[0]), count=int(ends[-1] - ends[0]) // 4)
        first = np.concatenate([[True], h[1:] != h[:-1]])
        word = np.repeat(np.cumsum(first) - 1, np.diff(ends) // 4)
        size = int(first.sum())
        counts = np.bincount(word * 2 * k + (value >> np.uint32(24)), weights=value & np.uint32(2**24 - 1), minlength=size * 2 * k).reshape(size, 2 * k)
        n = counts[:, :k].sum(axis=1).astype(np.int64)
        c = np.where(n < SEEN, rest, np.argmax(counts[:, :k] @ after + counts[:, k:] @ before, axis=1))
        return pa.table({"h": pa.array(h[first]), "n": pa.array(n), "c": pa.array(c.astype(np.int32))})

    return in_groups(mapped(texts.select("text"), contexts, "g long, cells binary"), assigned, "h long, n long, c int")


@dataclass(frozen=True)
class Model:
    tokens: int  # N
    types: int  # V
    ends: int
    known: np.ndarray  # hashes of the most frequent words, sorted
    counts: np.ndarray  # of each
    classes: np.ndarray  # of each
    mass: np.ndarray  # of each class: the tokens of its words; of the rest: those, its words and one more
    transition: np.ndarray  # [class before, class]

    @property
    def floor(self) -> int:
        return self.tokens + self.types + 1

    @property
    def rest(self) -> int:
        return len(self.mass) - 2

    def probability(self, before: np.ndarray, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of words of classes ``c`` that occur ``n`` times, after classes ``before``."""
        word = np.where(c == self.rest, n + 1, n) / self.mass[c]
        return SHARE * self.transition[before, c] * word + (1 - SHARE) * (n + 1) / self.floor


def resolved(bigrams: DataFrame, words: DataFrame, rest: int) -> DataFrame:
    """``bigrams`` (hb, gb, h, c, n and others) without hb and h: classes and counts of the words hb (before) and h come from ``words``, where these are given.

    Words that are not in ``words`` were never seen. Rows without a hash are not joined.
    """
    others = [c for c in bigrams.columns if c not in ("hb", "gb", "h", "c", "n")]
    named = words.select(F.col("h").alias("hb"), F.col("c").alias("gb_"))
    left = bigrams.where("hb IS NOT NULL").join(named, "hb", "left").withColumn("gb", F.coalesce("gb_", F.lit(rest)))
    half = bigrams.where("hb IS NULL").select("gb", "h", "c", "n", *others).union(left.select("gb", "h", "c", "n", *others))
    named = words.select("h", F.col("n").alias("n_"), F.col("c").alias("c_"))
    right = half.where("h IS NOT NULL").join(named, "h", "left").select("gb", F.coalesce("c_", F.lit(rest)).alias("c"), F.coalesce("n_", F.lit(0).cast("long")).alias("n"), *others)
    return half.where("h IS NULL").select("gb", "c", "n", *others).union(right)


BIGRAM = "hb long, gb int, h long, c int, n long"


def _bigrams(h: np.ndarray, counts: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """Of each token, ends included: the hash before it and its own (0: at hand), the class before it, its own class and count, both -1 where they are not at hand."""
    where = _find(model.known, np.arange(len(model.known)), h, -1)
    rare = where < 0
    if len(model.known):
        c, n = np.where(rare, -1, model.classes[where].astype(np.int64)), np.where(rare, -1, model.counts[where])
    else:
        c, n = np.full(len(h), -1), np.full(len(h), -1)
    ends, end = np.cumsum(counts), len(model.mass) - 1
    h, c, n = np.insert(np.where(rare, h, np.uint64(0)), ends, 0), np.insert(c, ends, end), np.insert(n, ends, model.ends)
    rare = np.insert(rare, ends, False)
    return np.concatenate([np.zeros(1, np.uint64), h[:-1]]), np.concatenate([[end], c[:-1]]), h, c, n, rare


def _hashes(h: np.ndarray, given: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), mask=~given)


def pair_counts(texts: DataFrame, model: Model, words: DataFrame) -> np.ndarray:
    """[class before, class]: how often it occurs in ``texts``."""
    k = len(model.mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)

        def rows(hb, gb, h, c, m, before, own):
            return pa.RecordBatch.from_arrays([_hashes(hb, before), pa.array(gb.astype(np.int32)), _hashes(h, own), pa.array(c.astype(np.int32)), pa.array(np.zeros(len(c), np.int64)), pa.array(m)], names=["hb", "gb", "h", "c", "n", "m"])

        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = strings(batch.column(0))
                for i, j in slices(offsets, BATCH_BYTES):
                    hb, gb, h, c, _, _ = _bigrams(*_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), model)
                    open_ = (gb < 0) | (c < 0)
                    total += np.bincount(gb[~open_] * k + c[~open_], minlength=k * k)
                    hb, gb, h, c = hb[open_], gb[open_], h[open_], c[open_]
                    yield rows(hb, gb, h, c, np.ones(len(c), np.int64), gb < 0, c < 0)
            at = np.flatnonzero(total)
            none, zero = np.zeros(len(at), bool), np.zeros(len(at), np.uint64)
            yield rows(zero, at // k, zero, at % k, total[at], none, none)

    bigrams = checkpointed(mapped(texts.select("text"), run, f"{BIGRAM}, m long"))
    found = np.zeros((k, k))
    for r in resolved(bigrams, words, model.rest).groupBy("gb", "c").agg(F.sum("m").alias("m")).collect():
        found[r.gb, r.c] = r.m
    return found


def learn(texts: DataFrame, counts: DataFrame, core: int = CORE, known: int = KNOWN, n_classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of ``texts``, and h, n, c of the words that are not at hand in it."""
    total, types, ends = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("h") == 0, F.col("n")))).first()
    total, ends = int(total or 0), int(ends or 0)
    k = n_classes + 2
    # the core is what the feature is: so many most frequent words
    first = counts.where("h <> 0").orderBy(F.col("n").desc(), "h").limit(core).toArrow()
    vocabulary, n = _integers(first, "h").view(np.uint64), _integers(first, "n")
    classes, pairs = clustered(texts, vocabulary, n, n_classes)
    words = checkpointed(other_words(texts, vocabulary, classes, pairs))
    release(texts.sparkSession)
    m = len(vocabulary)
    mass = np.bincount(classes[:m], weights=n, minlength=k).astype(float)
    rest_types = 0
    for r in words.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        mass[r.c] += r.n
        rest_types += r.words if r.c == n_classes else 0
    mass[n_classes] += rest_types + 1
    mass[n_classes + 1] = ends
    least = least_known(counts.where("h <> 0"), known)
    more = words.where(F.col("n") >= least).toArrow()
    at_hand = _lookup(
        np.concatenate([vocabulary, _integers(more, "h").view(np.uint64)]),
        np.concatenate([n, _integers(more, "n")]),
        np.concatenate([classes[:m], _integers(more, "c")]).astype(np.uint8),
    )
    words = words.where(F.col("n") < least)
    model = Model(total, int(types), ends, *at_hand, np.maximum(mass, 1), np.zeros((k, k)))
    pairs = pair_counts(texts, model, words)
    release(texts.sparkSession)
    of_class = pairs.sum(axis=0)
    prior = (of_class + 1) / (of_class.sum() + k)
    transition = (pairs + PRIOR * prior) / (pairs.sum(axis=1, keepdims=True) + PRIOR)
    return Model(total, int(types), ends, *at_hand, np.maximum(mass, 1), transition), words


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with n_tokens, n_known, base and score but for what words that are not at hand add: their bigrams, m times each, are in ``rare``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data, offsets = strings(batch.column(1))
                for i, j in slices(offsets, BATCH_BYTES):
                    h, counts = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    hb, gb, h, c, n, own = _bigrams(h, counts, model)
                    row = np.repeat(np.arange(j - i), counts + 1)
                    open_ = own | (gb < 0)
                    per = lambda rows, x=None: np.bincount(rows, weights=x, minlength=j - i)  # noqa: B023, E731
                    base = per(row[~own], np.log10((n[~own] + 1) / model.floor)) - per(row[own]) * np.log10(model.floor)
                    score = per(row[~open_], np.log10(model.probability(gb[~open_], c[~open_], n[~open_])))
                    known = per(row[~own & (n > 0)])
                    some = pd.DataFrame({"row": row[open_], "hb": hb[open_], "gb": gb[open_], "h": h[open_], "c": c[open_], "n": n[open_]})
                    some = some.groupby(list(some.columns), sort=True).size().reset_index(name="m")
                    bigrams = pa.StructArray.from_arrays(
                        [
                            _hashes(some["hb"].to_numpy(), some["gb"].to_numpy() < 0),
                            pa.array(some["gb"].to_numpy().astype(np.int32)),
                            _hashes(some["h"].to_numpy(), some["c"].to_numpy() < 0),
                            pa.array(some["c"].to_numpy().astype(np.int32)),
                            pa.array(some["n"].to_numpy()),
                            pa.array(some["m"].to_numpy()),
                        ],
                        names=["hb", "gb", "h", "c", "n", "m"],
                    )
                    upto = np.concatenate([[0], np.cumsum(per(some["row"].to_numpy()))]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), pa.array((counts + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(upto), bigrams)],
                        names=["doc_id", "n_tokens", "n_known", "base_score", "score", "rare"],
                    )

    rare = ", ".join(f"{x.split()[0]}: {'bigint' if x.endswith('long') else 'int'}" for x in f"{BIGRAM}, m long".split(", "))
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double, rare array<struct<{rare}>>")


def score_all(docs: DataFrame, in_training: Column, core: int = CORE, known: int = KNOWN, n_classes: int = CLASSES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document, by a model of those ``in_training``."""
    texts = docs.where(in_training)
    counts = checkpointed(word_counts(texts))
    if counts.isEmpty():
        tokens = mapped(docs.select("doc_id", "text"), _only_counts, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")
        return tokens.select("doc_id", "n_tokens", F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    model, words = learn(texts, counts, core, known, n_classes)
    # numbered after the checkpoint, where neither rows nor partitions change any more
    rows = checkpointed(scored(docs, model)).withColumn("row", F.monotonically_increasing_id())
    bigrams = resolved(rows.select("row", F.explode("rare").alias("b")).select("b.*", "row", F.col("b.h").isNotNull().alias("own")), words, model.rest)
    # a small table: one row for each pair of classes, with its probability and the mass of the second
    k = len(model.mass)
    cells = docs.sparkSession.createDataFrame([(a, b, float(model.transition[a, b] / model.mass[b])) for a in range(k) for b in range(k)], "gb int, c int, share double")
    word = F.col("n") + F.when(F.col("c") == model.rest, 1).otherwise(0)
    p = F.lit(SHARE) * F.col("share") * word + F.lit((1 - SHARE) / model.floor) * (F.col("n") + 1)
    own = F.when(F.col("own"), F.col("m")).otherwise(0)
    rare = bigrams.join(F.broadcast(cells), ["gb", "c"]).groupBy("row").agg(
        F.sum(F.col("m") * F.log10(p)).alias("score_"), F.sum(own * F.log10(F.col("n") + 1)).alias("base_"), F.sum(F.when(F.col("n") > 0, own).otherwise(0)).alias("known_")
    )
    plus = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0).cast("long"))).alias(name)
    return rows.drop("rare").join(rare, "row", "left").select(
        "doc_id", "n_tokens", plus("n_known", "known_"), F.lit(model.tokens).cast("long").alias("train_tokens"), plus("base_score", "base_"), plus("score", "score_")
    )


def _only_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, _, counts = word_spans(*strings(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((counts + 1).astype(np.int64))], names=["doc_id", "n_tokens"])


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_all(docs, ~held_out(F.col("doc_id")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
