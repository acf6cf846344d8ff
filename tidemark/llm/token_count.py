"""Token counts by overlap resynchronisation.

A document longer than ``chunk_chars`` is encoded in overlapping chunks with offsets. Two
neighbouring chunks are spliced at a position that starts a pre-token in both: the splitting
pattern never looks back, so from such a position on both chunks, and the whole text, split
alike. Positions close to a chunk's end, where a special string may be cut, are not used. If an
overlap has no such position it is widened, at last to a chunk that begins at the last proven
boundary. So counts equal those of encoding the whole text, while memory is that of a chunk.

Nulls count as empty texts; empty texts have 0 tokens; repeated rows are counted each on their
own; other columns of the input are not touched.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import mapped, slices, strings, table

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
LIMIT_TOKENS = 512
#: Bytes of text that are encoded at once.
BATCH_BYTES = 1 << 20


class Counter:
    """Counts tokens as the library for the file does; huge texts in chunks where that is proven to be the same."""

    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        self.chunk, self.overlap = max(64, chunk_chars), max(1, overlap_chars)
        self.widened = 0
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.resync = False
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            os.environ["RAYON_NUM_THREADS"] = "1"
            from tokenizers import Tokenizer

            self.pieces = None
            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            with open(path) as f:
                about = json.load(f)
            split = about.get("pre_tokenizer") or {}
            added = about.get("added_tokens") or []
            # the proof above holds for this splitter, and for special strings that are matched as they are
            self.resync = (
                not about.get("normalizer")
                and split.get("type") == "ByteLevel"
                and split.get("use_regex", True)
                and not split.get("add_prefix_space")
                and not any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
            )
            self.margin = 2 + 2 * max((len(a["content"]) for a in added), default=0)

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces is not None:
            return [len(x) for x in self.pieces.encode(texts, num_threads=1)]
        huge = {i for i, x in enumerate(texts) if self.resync and len(x) > self.chunk}
        plain = [x for i, x in enumerate(texts) if i not in huge]
        found = iter([len(x) for x in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)])
        return [self.spliced(x) if i in huge else next(found) for i, x in enumerate(texts)]

    def _chunk(self, text: str, at: int, size: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Where pre-tokens start, in the text; the number of the first token of each; tokens; end."""
        e = self.tokenizer.encode(text[at : at + size], add_special_tokens=False)
        words = np.array(e.word_ids, np.int64)
        first = np.flatnonzero(np.diff(words, prepend=-1) != 0)
        begins = np.array([o[0] for o in e.offsets], np.int64)[first] + at
        return begins, first, len(words), min(len(text), at + size)

    def spliced(self, text: str) -> int:
        total, true_from, size = 0, 0, self.chunk
        begins, first, n, end = self._chunk(text, 0, size)
        while end < len(text):
            overlap = self.overlap
            while True:
                at = end - overlap
                if at <= true_from:
                    # no shared boundary in the whole chunk: encode a longer one from the last proven boundary
                    size *= 2
                    self.widened += 1
                    new = self._chunk(text, true_from, size)
                    skip = 0
                    break
                new = self._chunk(text, at, size)
                common = np.intersect1d(begins[begins >= true_from], new[0])
                common = common[common <= end - self.margin]
                if len(common):
                    p = int(common[-1])
                    skip = int(first[np.searchsorted(begins, p)])
                    start = int(first[np.searchsorted(begins, true_from)]) if true_from > begins[0] else 0
                    total += skip - start
                    true_from, size = p, self.chunk
                    break
                overlap *= 2
                self.widened += 1
            begins, first, n, end = new
        return total + n - (int(first[np.searchsorted(begins, true_from)]) if n and true_from > begins[0] else 0)


_counters: dict[tuple, Counter] = {}


def _counter(*key) -> Counter:
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT_TOKENS, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, chunk_chars, overlap_chars)
        for batch in batches:
            _, offsets = strings(batch.column(1))
            counts: list[int] = []
            for i, j in slices(offsets, BATCH_BYTES):
                counts += counter.counts([x or "" for x in batch.column(1).slice(i, j - i).to_pylist()])
            tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets), pa.int64()), tokens, pa.array(np.array(counts, np.int64) > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
