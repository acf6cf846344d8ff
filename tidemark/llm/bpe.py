"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each task splits its texts into pre-tokens and hands the distinct ones to a DuckDB connection in
the worker. There a recursive query unnests token positions, joins the neighbouring pairs with
the merge table and contracts each word's leftmost pair of least rank, until no word has a pair
left. Ids are decoded by joining token positions with the vocabulary and aggregating the pieces
in the order of their positions, those of each distinct pre-token once, as they are encoded once.
No row leaves its task: nothing is shuffled or collected.

Words of more than ``LONG_WORD`` bytes, for which one contraction a step would be quadratic, are
merged by a heap of pairs, in the same order and so with the same result.

Nulls are encoded as empty texts, which have no ids; repeated rows are encoded each on their own.
Byte strings travel through DuckDB as text with one code point below 256 for each byte.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, slices, strings, table

LONG_WORD = 256
#: Words whose ids a worker remembers; beyond it starts anew.
CACHE_WORDS = 300_000
#: Bytes of text, and words of one huge text, that are handled at once.
BATCH_BYTES = 2 << 20
BATCH_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_ENCODE = """
WITH RECURSIVE step(i, fixed, w, toks) AS (
    SELECT 0, false, w, list(t ORDER BY p) FROM token_positions GROUP BY w
    UNION ALL
    SELECT * FROM (
        WITH cur AS (SELECT * FROM step WHERE NOT fixed),
        pairs AS (
            SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[2:], 1) AS p
            FROM cur WHERE len(toks) > 1
        ),
        best AS (
            SELECT w, min(m::BIGINT * 65536 + p) AS b
            FROM pairs JOIN merges ON pairs.l = merges.l AND pairs.r = merges.r GROUP BY w
        )
        SELECT i + 1, b IS NULL, cur.w,
               CASE WHEN b IS NULL THEN toks ELSE toks[:(b & 65535) - 1] || [(b >> 16)::INTEGER] || toks[(b & 65535) + 2:] END
        FROM cur LEFT JOIN best ON cur.w = best.w
    )
)
SELECT w, toks, array_to_string(toks, ' ') FROM step WHERE fixed
"""

_DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS decoded
FROM ids JOIN vocabulary USING (id) GROUP BY doc
"""


class Bpe:
    """One vocabulary of ranks with its splitting pattern, in this process."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.split = regex.compile(pattern)
        self.ranks = read_ranks(path)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = self._pairs()
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        left, right = zip(*pairs, strict=True)
        found = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "m": pa.array(pairs.values(), pa.int32())})
        del pairs, left, right
        pieces = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "piece": pa.array([b.decode("latin-1") for b in self.ranks])})
        for name, rows in (("merges", found), ("vocabulary", pieces)):
            self.con.register("arriving", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM arriving")
            self.con.unregister("arriving")
        self._forget()

    def _pairs(self) -> dict[tuple[int, int], int]:
        """The rank of every pair of tokens that is a token."""
        ranks = self.ranks
        return {(ranks[b[:i]], ranks[b[i:]]): m for b, m in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks}

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        return self._pairs()

    def _heap(self, word: bytes) -> list[int]:
        """Ids of one long word: the least pair of least position first, from a heap with lazy deletion."""
        toks: list[int] = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(toks)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, toks[i], toks[i + 1]) for i in range(n - 1) if (m := self.pairs.get((toks[i], toks[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, left, right = heapq.heappop(heap)
            j = after[i]
            if toks[i] != left or j >= n or toks[j] != right:
                continue
            toks[i], toks[j] = m, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := self.pairs.get((m, toks[k]))) is not None:
                    heapq.heappush(heap, (x, i, m, toks[k]))
            if (h := before[i]) >= 0 and (x := self.pairs.get((toks[h], m))) is not None:
                heapq.heappush(heap, (x, h, toks[h], m))
        return [t for t in toks if t >= 0]

    def _forget(self) -> None:
        #: The number of each known word; where its ids begin in ``flat``, how many they are, and as text.
        self.known: dict[str, int] = {}
        self.begins, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.spelled: list[str] = []
        #: What the ids of known words decode to, a code point for each byte, of as many as were asked for.
        self.unspelled: list[str] = []

    def _add(self, words: list[str], lengths: np.ndarray, flat: np.ndarray, spelled: list[str]) -> None:
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])
        self.spelled += spelled

    def _learn(self, fresh: list[str]) -> None:
        """Makes the ids of distinct words known that are not."""
        coded = [w.encode() for w in fresh]
        whole, long, short = [], [], []
        for i, b in enumerate(coded):
            (whole if b in self.ranks else long if len(b) > LONG_WORD else short).append(i)
        if whole:
            ranks = [self.ranks[coded[i]] for i in whole]
            self._add([fresh[i] for i in whole], np.ones(len(ranks), np.int64), np.array(ranks, np.int32), list(map(str, ranks)))
        for i in long:
            ids = self._heap(coded[i])
            self._add([fresh[i]], np.array([len(ids)]), np.array(ids, np.int32), [" ".join(map(str, ids))])
        if not short:
            return
        lengths = np.fromiter((len(coded[i]) for i in short), np.int64, len(short))
        data = np.frombuffer(b"".join([coded[i] for i in short]), np.uint8)
        w = np.repeat(np.arange(len(short), dtype=np.int32), lengths)
        p = (np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        self.con.register("token_positions", pa.table({"w": w, "p": p, "t": self.byte_ids[data]}))
        got = self.con.sql(_ENCODE).to_arrow_table().combine_chunks()
        self.con.unregister("token_positions")
        ids = got.column(1).combine_chunks()
        self._add([fresh[short[i]] for i in got.column(0).to_pylist()], np.asarray(ids.value_lengths()).astype(np.int64), np.asarray(ids.flatten()).astype(np.int32), got.column(2).to_pylist())

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of words, which are made known; they hold until the next call."""
        if len(self.known) > CACHE_WORDS:
            self._forget()
        n = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(n < 0)
        if len(missing):
            fresh = list(map(words.__getitem__, missing.tolist()))
            self._learn(list(set(fresh)))
            n[missing] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        return n

    def ids(self, n: np.ndarray) -> np.ndarray:
        """All ids, in order, of the words with these numbers."""
        lengths = self.lengths[n]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.begins[n] - ends + lengths, lengths) + np.arange(total)]

    def decoded(self) -> list[str]:
        """What the ids of every known word decode to, by its number, a code point for each byte."""
        done = len(self.unspelled)
        if done < len(self.known):
            lengths = self.lengths[done:]
            words, pieces = self._decoded(np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), self.flat[self.begins[done] :])
            got = pieces.to_pylist()
            self.unspelled += map(got.__getitem__, np.argsort(np.asarray(words)).tolist())
        return self.unspelled

    def _decoded(self, docs: np.ndarray, ids: np.ndarray) -> tuple[pa.ChunkedArray, pa.ChunkedArray]:
        self.con.register("ids", pa.table({"doc": docs, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
        got = self.con.sql(_DECODE).to_arrow_table()
        self.con.unregister("ids")
        return got.column(0), got.column(1)

    def decode(self, docs: np.ndarray, ids: np.ndarray) -> dict[int, bytes]:
        """The bytes of each of ``docs``; ids are in order, docs[i] owns ids[i]."""
        if not len(ids):
            return {}
        return {d: s.encode("latin-1") for d, s in zip(*(c.to_pylist() for c in self._decoded(docs, ids)), strict=True)}

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text, a bounded number at a time."""
        if len(text) < BATCH_BYTES:
            yield self.split.findall(text)
            return
        words = (m.group() for m in self.split.finditer(text))
        while part := list(islice(words, BATCH_WORDS)):
            yield part

    def encode(self, text: str) -> np.ndarray:
        found = [np.zeros(0, np.int32)]
        for words in self.pieces(text or ""):
            found.append(self.ids(self.numbers(words)))
        return np.concatenate(found)


_models: dict[tuple[str, str], Bpe] = {}


def model(path: str, pattern: str) -> Bpe:
    if (path, pattern) not in _models:
        _models[path, pattern] = Bpe(path, pattern)
    return _models[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, column: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int); no shuffle. A column named ``into`` is replaced."""
    from pyspark.sql import types as T

    kept = [f for f in docs.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            texts = batch.column(column)
            for i, j in slices(strings(texts)[1], BATCH_BYTES):
                ids = [bpe.encode(x) for x in texts.slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(i, j - i) for n in names), pa.array(ids, pa.list_(pa.int32()))], names=[*names, into])

    return mapped(docs, run, schema)


def decode(docs: DataFrame, path: str, pattern: str, column: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the bytes (binary) that a column of token ids stands for; null ids give empty bytes."""
    from pyspark.sql import types as T

    kept = [f for f in docs.schema.fields if f.name != into]
    schema = T.StructType([*kept, T.StructField(into, T.BinaryType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column(column)
                lengths = np.nan_to_num(np.array(lists.value_lengths().fill_null(0)), nan=0).astype(np.int64)
                ids = np.array(lists.flatten(), np.int32)
                got = bpe.decode(np.repeat(np.arange(len(lists), dtype=np.int32), lengths), ids)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([got.get(k, b"") for k in range(len(lists))], pa.binary())], names=[*names, into])

    return mapped(docs, run, schema)


def digests(docs: DataFrame, path: str, pattern: str, carry: tuple[str, ...] = ("doc_id",), ids_into: str | None = None) -> DataFrame:
    """The columns ``carry``, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded again.

    ids_into: a column for the ids themselves.
    """
    from pyspark.sql import types as T

    n_carried = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            texts, n = batch.column(n_carried), batch.num_rows
            all_ids: list[list[np.ndarray]] = [[] for _ in range(n)] if ids_into else []
            counts = np.zeros(n, np.int64)
            ids_sha, decoded_sha = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
            for i, j in slices(strings(texts)[1], BATCH_BYTES):
                parts = ((i + k, words) for k, x in enumerate(texts.slice(i, j - i).to_pylist()) for words in bpe.pieces(x or ""))
                if j - i > 1:
                    parts = [list(parts)]
                else:
                    parts = ([p] for p in parts)
                for group in parts:
                    numbers = bpe.numbers(list(chain.from_iterable(words for _, words in group)))
                    decoded, at = bpe.decoded(), 0
                    for k, words in group:
                        mine = numbers[at : at + len(words)]
                        at += len(words)
                        if words:
                            if counts[k]:
                                ids_sha[k].update(b" ")
                            each = mine.tolist()
                            ids_sha[k].update(" ".join(map(bpe.spelled.__getitem__, each)).encode())
                            decoded_sha[k].update("".join(map(decoded.__getitem__, each)).encode("latin-1"))
                            counts[k] += int(bpe.lengths[mine].sum())
                        if ids_into:
                            all_ids[k].append(bpe.ids(mine))
            columns = [*batch.columns[:n_carried], pa.array(counts), pa.array([h.hexdigest() for h in ids_sha]), pa.array([h.hexdigest() for h in decoded_sha])]
            if ids_into:
                flat = [x for own in all_ids for x in own]
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        bpe._forget()

    fields = [docs.schema[c] for c in carry] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids_into:
        fields.append(T.StructField(ids_into, T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    return mapped(docs.select(*carry, "text"), run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
