"""The wire protocol: commands as arrays of bulk strings, from pieces of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import MAX_BULK_BYTES, MAX_COMMAND_ARGS
from tidemark.session import ship

MALFORMED = b"__MALFORMED__"


class Parser:
    """Takes bytes as they arrive; gives each complete command once. A malformed line gives one marker."""

    def __init__(self) -> None:
        self.buffer = b""

    def feed(self, data: bytes) -> None:
        self.buffer += data

    def _line(self, at: int) -> tuple[bytes, int] | None:
        end = self.buffer.find(b"\r\n", at)
        return None if end < 0 else (self.buffer[at:end], end + 2)

    @staticmethod
    def _number(text: bytes) -> int | None:
        try:
            return int(text) if text.lstrip(b"-").isdigit() else None
        except ValueError:
            return None

    def _drop(self, to: int) -> list[bytes]:
        self.buffer = self.buffer[to:]
        return [MALFORMED]

    def next_command(self) -> list[bytes] | None:
        """The next command; None while it is incomplete."""
        if not self.buffer:
            return None
        if (head := self._line(0)) is None:
            return None
        line, at = head
        n = self._number(line[1:]) if line[:1] == b"*" else None
        if n is None or not 0 <= n <= MAX_COMMAND_ARGS:
            return self._drop(at)
        args = []
        for _ in range(n):
            if (head := self._line(at)) is None:
                return None
            line, start = head
            size = self._number(line[1:]) if line[:1] == b"$" else None
            if size is None or not 0 <= size <= MAX_BULK_BYTES:
                return self._drop(start)
            if len(self.buffer) < start + size + 2:
                return None
            if self.buffer[start + size : start + size + 2] != b"\r\n":
                return self._drop(start + size)
            args.append(self.buffer[start : start + size])
            at = start + size + 2
        self.buffer = self.buffer[at:]
        return args


def encode_commands(commands: DataFrame) -> DataFrame:
    """client, seq, bytes from client, seq, args (array of text)."""
    one = lambda x: F.concat(F.lit("$"), F.octet_length(x).cast("string"), F.lit("\r\n"), x, F.lit("\r\n"))
    text = F.concat(F.lit("*"), F.size("args").cast("string"), F.lit("\r\n"), F.array_join(F.transform("args", one), ""))
    return commands.select("client", "seq", F.encode(text, "UTF-8").alias("bytes"))


def split_chunks(encoded: DataFrame, size: int) -> DataFrame:
    """client, seq, part, bytes: the same bytes, cut into pieces of ``size``."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / size).cast("int"))
    rows = encoded.select("client", "seq", "bytes", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return rows.select("client", "seq", "part", F.substring(F.col("bytes"), F.col("part") * size + 1, F.lit(size)).alias("bytes"))


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """client, n, args of every command in each client's chunks (client, seq, part, bytes), in order.

    Chunks are sorted within partitions and streamed through one parser for each client, so memory is that of a command.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, parser, n = None, Parser(), 0
        for batch in batches:
            clients, numbers, found = [], [], []
            for c, data in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if c != client:
                    client, parser, n = c, Parser(), 0
                parser.feed(data)
                while (args := parser.next_command()) is not None:
                    clients.append(c)
                    numbers.append(n)
                    found.append(args)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(clients, pa.int64()), pa.array(numbers, pa.int64()), pa.array(found, pa.list_(pa.binary()))], names=["client", "n", "args"])

    ship(chunks.sparkSession)
    ordered = chunks.select(F.col("client").cast("long").alias("client"), "seq", "part", "bytes").repartition("client").sortWithinPartitions("client", "seq", "part")
    return ordered.mapInArrow(run, "client long, n long, args array<binary>")
