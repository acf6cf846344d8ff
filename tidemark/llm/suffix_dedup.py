"""Repeated byte strings by a sparse distributed suffix array.

Every byte that a string of ``LENGTH`` bytes covers which also starts elsewhere is removed. Sorting
a suffix for each byte would move each byte hundreds of times, so suffixes are sorted at anchors
that the content chooses: of the 161 places in a 200-byte string where its 40-byte grams begin, those
of least hash. Equal strings have equal anchors at equal offsets, so none is missed.

1. Anchors whose gram occurs once are dropped: grams are counted by least and greatest place, which
   combines before the shuffle however often a text is copied. Copies of a text share one
   representative; a text that occurs twice is removed as a whole.
2. Suffixes at the remaining anchors, with the bytes before them, are dealt to ranges of leading
   bytes by splitters from a sample. Splitters compare whole grams, so equal grams never part.
3. Each range sorts its suffixes, and the reversed bytes before them, by multikey quicksort on
   eight-byte characters. Neighbours' common prefixes then divide rows into classes for every
   offset of a string around its anchor; two rows in one class are two places of one string.
4. Grams at more than ``HOT`` places, which could fill a range alone, are compared beyond one
   range: their strings are counted by 128-bit hashes, again by least and greatest place.

Long runs with a period of up to 40 bytes repeat themselves; they are removed as a whole, and only
anchors near their ends are kept for comparison with others.

Nulls are empty texts; texts shorter than ``LENGTH`` keep all bytes; an empty text is kept as such.
Rows are told apart by doc_id and text; repeated rows are copies of each other. Rows without
doc_id are known by their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTES, _Powers, checkpointed, mapped, mix, release, ship, slices, strings, table

LENGTH, GRAM = 200, 40
#: Places in a string where its grams begin; the most bytes before an anchor.
PLACES = LENGTH - GRAM + 1
BEFORE = PLACES - 1
#: Suffixes that a range should have, and places of a gram beyond which its strings are hashed.
RANGE, HOT = 20_000, 30_000
#: Texts whose keys are broadcast to read them alone; for more all texts are shuffled.
BROADCAST_KEYS = 2_000_000
#: Anchors for each range in the sample that gives the splitters.
SAMPLE = 20
BATCH_BYTES = 2 << 20
CONTEXT = BEFORE + LENGTH


def _sliding(x: np.ndarray, width: int, combine) -> np.ndarray:
    """combine over x[i : i + width] for each i, by doubling."""
    span = 1
    while span * 2 <= width:
        x = combine(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return combine(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Positions and gram hashes of the anchors of all rows, and periodic runs (first, end), as positions in ``data``.

    One very long row is taken in pieces that share all but one byte of a string: each string lies
    within a piece, and its anchors depend on nothing else.
    """
    if len(data) <= 2 * BATCH_BYTES or len(offsets) > 2:
        return _anchors(data, offsets)
    at, g, runs = [], [], []
    for first in range(0, len(data), BATCH_BYTES):
        piece = data[first : first + BATCH_BYTES + LENGTH - 1]
        a, b, c = _anchors(piece, np.array([0, len(piece)]))
        at.append(a + first)
        g.append(b)
        runs += [(x + first, y + first) for x, y in c]
    places, where = np.unique(np.concatenate(at), return_index=True)
    return places, np.concatenate(g)[where], runs


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), []
    n = len(data)
    if n < LENGTH:
        return none
    up, down = _Powers.get(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=prefix[1:])
    h = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1]) | np.uint64(1)
    least = _sliding(h, PLACES, np.minimum)
    # strings must lie within one row
    room = np.zeros(n - LENGTH + 2, np.int64)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            room[a] += 1
            room[b - LENGTH + 1] -= 1
    least = np.where(np.cumsum(room[:-1]) > 0, least, np.uint64(0))
    border = np.zeros(BEFORE, np.uint64)
    top = _sliding(np.concatenate([border, least, border]), PLACES, np.maximum)
    at = np.flatnonzero(top == h)
    if not len(at):
        return none
    g = h[at]
    # runs of equal grams at one short distance are periodic: of long ones only the ends are kept
    gap = np.diff(at)
    same = (g[1:] == g[:-1]) & (gap <= GRAM)
    runs: list[tuple[int, int]] = []
    if same.any():
        keep = np.ones(len(at), bool)
        change = np.flatnonzero(np.concatenate([[True], (same[1:] != same[:-1]) | (gap[1:] != gap[:-1]), [True]]))
        for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
            first, last, period = int(at[a]), int(at[b]), int(gap[a])
            if same[a] and last - first > 7 * LENGTH and np.array_equal(data[first : last + GRAM - period], data[first + period : last + GRAM]):
                row_end = int(offsets[np.searchsorted(offsets, first, side="right")])
                if last + GRAM <= row_end:
                    runs.append((first, last + GRAM))
                    keep[(at > first + 3 * LENGTH) & (at < last - 3 * LENGTH)] = False
        at, g = at[keep], g[keep]
    return at, g, runs


def _text_hash(data: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data.tobytes())


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, place: every anchor's gram, and which place of which text it is at."""
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = strings(batch.column(0))
            for i, j in slices(offsets, BATCH_BYTES):
                own = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                at, g, _ = anchors(part, own)
                row = np.searchsorted(own, at, side="right") - 1
                texts = np.array([_text_hash(part[a:b]) for a, b in zip(own[:-1], own[1:], strict=True)], np.uint64)
                place = mix(texts[row] + (at - own[row]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(place.view(np.int64))], names=["h", "place"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, k, t, pos, stop: every anchor with its text; periodic runs have no h but an end."""
    with np.errstate(over="ignore"):
        for batch in batches:
            keys, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = strings(batch.column(2))
            for i, j in slices(offsets, BATCH_BYTES):
                own = offsets[i : j + 1] - offsets[i]
                at, g, runs = anchors(data[offsets[i] : offsets[j]], own)
                first = np.concatenate([at, np.array([a for a, _ in runs], np.int64)])
                row = np.searchsorted(own, first, side="right") - 1
                stop = np.concatenate([np.zeros(len(at), np.int64), np.array([b for _, b in runs], np.int64) - own[row[len(at) :]]])
                h = pa.array(np.concatenate([g.view(np.int64), np.zeros(len(runs), np.int64)]), mask=np.arange(len(first)) >= len(at))
                yield pa.RecordBatch.from_arrays([h, pa.array(keys[i:j][row]), pa.array(tags[i:j][row]), pa.array((first - own[row]).astype(np.int32)), pa.array(stop.astype(np.int32))], names=["h", "k", "t", "pos", "stop"])


def contexts(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each anchor the BEFORE bytes before it and the LENGTH bytes from it on, with zeros beyond the text."""
    padded = np.zeros(len(text) + CONTEXT, np.uint8)
    padded[BEFORE : BEFORE + len(text)] = text
    return np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[at]


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte strings of one length, and the common prefix of each with the one before it.

    Multikey quicksort on characters of eight bytes: strings are sorted by one character, and
    those that are equal so far, and they alone, by the next.
    """
    n, width = rows.shape
    keys = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 8)))).view(">u8").astype(np.uint64)
    order, block = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)
    for c in range(keys.shape[1]):
        if not len(tied):
            break
        within = np.lexsort((keys[order[tied], c], block[tied]))
        order[tied] = order[tied[within]]
        new = keys[order[tied], c]
        starts = np.concatenate([[True], (block[tied][1:] != block[tied][:-1]) | (new[1:] != new[:-1])])
        block[tied] = tied[np.maximum.accumulate(np.where(starts, np.arange(len(tied)), 0))]
        alone = starts & np.concatenate([starts[1:], [True]])
        tied = tied[~alone]
    ordered = rows[order]
    differ = np.concatenate([ordered[1:] != ordered[:-1], np.ones((max(0, n - 1), 1), bool)], axis=1)
    return order, np.concatenate([[-1], differ.argmax(axis=1)]) if n else np.zeros(0, np.int64)


def repeated(context: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix the fewest and most bytes before its anchor at which a string found twice begins; -1 if none.

    left and right: how many bytes of the text there are before and from the anchor on.
    """
    n = len(context)
    least, most = np.full(n, -1), np.full(n, -1)
    order, common = multikey_order(context[:, BEFORE:])
    back_order, back_common = multikey_order(context[:, :BEFORE][:, ::-1])
    forward, backward = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(PLACES):
        able = np.flatnonzero((left >= d) & (right >= LENGTH - d))
        if len(able) < 2:
            continue
        forward[order] = np.cumsum(common < LENGTH - d)
        backward[back_order] = np.cumsum(back_common < d)
        key = forward[able] * (n + 1) + backward[able]
        by = np.argsort(key, kind="stable")
        equal = key[by[1:]] == key[by[:-1]]
        twice = able[by[np.concatenate([equal, [False]]) | np.concatenate([[False], equal])]]
        least[twice] = np.where(least[twice] < 0, d, least[twice])
        most[twice] = d
    return least, most


def _string_hashes(text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the strings that begin at ``begins``."""
    up, down = _Powers.get(len(text) + 1)
    found = []
    for values in (_BYTES, mix(_BYTES)):
        prefix = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(values[text] * up[:-1], out=prefix[1:])
        found.append(mix((prefix[begins + LENGTH] - prefix[begins]) * down[begins]))
    return found[0], found[1]


def _only(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts (k, t, text) whose k is in ``keys`` (k, distinct); keys are broadcast while they are few, else the join that follows selects."""
    return texts.join(F.broadcast(keys), "k", "left_semi") if keys.count() <= BROADCAST_KEYS else texts


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, k, t, n_bytes, sha), texts by their hash with a representative (sha, k, t, m), and what is repeated in representatives: k, t, spans (first and end, not merged)."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    sha = F.sha2(text, 256)
    tag = F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")
    key = F.coalesce(F.col("doc_id").cast("long"), tag)
    texts = docs.select(key.alias("k"), tag.alias("t"), text.alias("text"))
    base = checkpointed(docs.select("doc_id", key.alias("k"), tag.alias("t"), F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha")))
    # one representative of each text; how often the text occurs
    heads = base.where(f"n_bytes >= {LENGTH}").groupBy("sha").agg(F.min("k").alias("k"), F.first("t").alias("t"), F.count("*").alias("m"))
    heads = checkpointed(heads)

    long = texts.where(F.octet_length("text") >= LENGTH)
    shared = mapped(long.select("text"), _grams, "h long, place long").groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count("*").alias("n"))
    shared = checkpointed(shared.where("a <> b").select("h", "n"))
    release(spark)
    placed = mapped(long, _places, "h long, k long, t long, pos int, stop int")
    placed = placed.join(shared, "h", "left").where("n IS NOT NULL OR stop > 0").select("k", "t", "pos", "stop", (F.col("n") > HOT).alias("hot"))
    placed = checkpointed(placed.join(heads.select("k", "t"), ["k", "t"], "left_semi"))
    at = placed.where("stop = 0").groupBy("k", "t").agg(F.collect_list(F.when(~F.col("hot"), F.col("pos"))).alias("cool"), F.collect_list(F.when(F.col("hot"), F.col("pos"))).alias("hot"))
    at = checkpointed(at)
    release(spark)
    n_cool, any_hot = at.agg(F.sum(F.size("cool")), F.max(F.size("hot"))).first()
    n_cool, any_hot = n_cool or 0, bool(any_hot)
    some = _only(long, at.select("k").distinct()).join(at, ["k", "t"])

    # splitters: quantiles of the grams at anchors drawn by a hash from all texts that have some
    ranges = max(1, -(-n_cool // RANGE))
    every = max(1, n_cool // (SAMPLE * ranges))
    drawn = F.filter("cool", lambda p: F.pmod(F.xxhash64("k", "t", p), F.lit(every)) == 0)
    sample = some.withColumn("cool", drawn).where("size(cool) > 0").select("text", "cool")
    sample = mapped(sample, _leading, "lead binary").toPandas() if ranges > 1 else {"lead": []}
    leads = np.sort(np.array([bytes(x) for x in sample["lead"]], f"S{GRAM}"))
    splitters = leads[(np.arange(1, ranges) * len(leads)) // ranges] if len(leads) else leads

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(2))
            for i in range(batch.num_rows):
                pos = np.sort(np.array(batch.column(3)[i].as_py(), np.int64))
                own = data[offsets[i] : offsets[i + 1]]
                for p in range(0, len(pos), 20_000):
                    mine = pos[p : p + 20_000]
                    rows = contexts(own, mine)
                    lead = np.ascontiguousarray(rows[:, BEFORE : BEFORE + GRAM]).view(f"S{GRAM}").ravel()
                    values = pa.Array.from_buffers(pa.binary(CONTEXT), len(mine), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())
                    const = lambda c: pa.array(np.full(len(mine), batch.column(c)[i].as_py(), np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.searchsorted(splitters, lead, side="right").astype(np.int32)), const(0), const(1), pa.array(mine), pa.array(len(own) - mine), values],
                        names=["range", "k", "t", "pos", "rest", "context"],
                    )

    def compare(group: pa.Table) -> pa.Table:
        context = np.frombuffer(b"".join(group.column("context").to_pylist()), np.uint8).reshape(-1, CONTEXT)
        pos, rest = np.asarray(group.column("pos")), np.asarray(group.column("rest"))
        least, most = repeated(context, np.minimum(pos, BEFORE), np.minimum(rest, LENGTH))
        hit = np.flatnonzero(least >= 0)
        return pa.table({"k": group.column("k").take(pa.array(hit)), "t": group.column("t").take(pa.array(hit)), "first": pos[hit] - most[hit], "end": pos[hit] - least[hit] + LENGTH})

    ranged = mapped(some.where("size(cool) > 0").select("k", "t", "text", "cool"), suffixes, "range int, k long, t long, pos long, rest long, context binary")
    found = ranged.groupBy("range").applyInArrow(compare, "k long, t long, first long, end long")
    found = found.union(placed.where("stop > 0").select("k", "t", F.col("pos").cast("long"), F.col("stop").cast("long")))
    if any_hot:
        strings_at = mapped(some.where("size(hot) > 0").select("k", "t", "text", "hot"), _hot_strings, "w1 long, w2 long, k long, t long, first long")
        place = F.struct("k", "t", "first")
        twice = strings_at.groupBy("w1", "w2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("w1", "w2")
        found = found.union(strings_at.join(twice, ["w1", "w2"], "left_semi").select("k", "t", "first", (F.col("first") + LENGTH).alias("end")).distinct())
    found = found.groupBy("k", "t").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    return base, heads, checkpointed(found)


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lead: the grams at the places ``cool`` of each text."""
    for batch in batches:
        data, offsets = strings(batch.column(0))
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([own[p : p + GRAM].tobytes() for p in batch.column(1)[i].as_py()], pa.binary())], names=["lead"])


def _hot_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = strings(batch.column(2))
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                pos = np.array(batch.column(3)[i].as_py(), np.int64)
                begins = np.zeros(len(own) + 1, np.int64)
                np.add.at(begins, np.maximum(pos - BEFORE, 0), 1)
                np.add.at(begins, pos + 1, -1)
                begins = np.flatnonzero(np.cumsum(begins)[: max(0, len(own) - LENGTH + 1)] > 0)
                if len(begins):
                    a, b = _string_hashes(own, begins)
                    const = lambda c: pa.array(np.full(len(begins), batch.column(c)[i].as_py(), np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), const(0), const(1), pa.array(begins)], names=["w1", "w2", "k", "t", "first"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, t, n_removed, n_spans, kept text (bytes) from k, t, text, spans."""
    for batch in batches:
        data, offsets = strings(batch.column(2))
        removed, n_spans, kept = [], [], []
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            cover = np.zeros(len(own) + 1, np.int32)
            span = batch.column(3)[i].values
            np.add.at(cover, np.asarray(span.field(0)), 1)
            np.add.at(cover, np.asarray(span.field(1)), -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed.append(int(gone.sum()))
            n_spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and bool(gone[0]))))
            kept.append(own[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=["k", "t", "n_removed", "n_spans", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _cut(batches):
        shas = [hashlib.sha256(b).hexdigest() for b in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shas)], names=["k", "t", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    base, heads, found = spans(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), tag).alias("k"), tag.alias("t"), text.alias("text"))
    # texts that occur once and have repeated parts; those that occur more often go as a whole
    once = found.join(heads.where("m = 1").select("k", "t"), ["k", "t"], "left_semi")
    cut = mapped(_only(texts, once.select("k").distinct()).join(once, ["k", "t"]).select("k", "t", "text", "spans"), _digest, "k long, t long, n_removed long, n_spans long, kept_sha256 string")
    copies = heads.where("m > 1").select("sha", F.lit(True).alias("copied"))
    rows = base.join(cut, ["k", "t"], "left").join(copies, "sha", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(encode(coalesce(text, ''))) AS whole, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400)),
q AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
f AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS first FROM q),
g AS (SELECT doc_id, i, sum(CAST(first AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM f),
r AS (SELECT doc_id, s, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, s),
k AS (SELECT r.doc_id, s, a, b, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY s), 0) AS z, coalesce(lead(a) OVER (PARTITION BY r.doc_id ORDER BY s), -1) AS nxt, x FROM r JOIN d ON r.doc_id = d.doc_id),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, sha256(unhex(coalesce(string_agg(substr(x, 2 * z + 1, 2 * (a - z)) || CASE WHEN nxt < 0 THEN substr(x, 2 * b + 1) ELSE '' END, '' ORDER BY s), ''))) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, length(d.x) // 2 AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, coalesce(t.kept, d.whole) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""
