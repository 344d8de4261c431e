"""Packing: token sequences of bounded length from whole documents (bounded-space online packing).

Each task keeps a fixed number of open windows. A document's full windows leave at
once; its rest goes to the open window with the least room that still holds it. If
none does, the fullest window takes the head of the rest and is emitted. What stays
open at the end of a task is merged with its neighbours' leftovers by the same rule,
and the few windows still open then are cut into sequences whose lengths are powers
of two, so they need no padding.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.word_tokens import WordTokens
from furrow.session import work_path

LENGTH = 2048
OPEN_WINDOWS = 48
# A rest is not cut to fill a gap smaller than this.
LEAST_CUT = 8
END_ID = 1
MERGED_TASKS = 16

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)

# A piece: doc_id, start, doc_tokens, ids.
Piece = tuple[int | None, int, int, np.ndarray]


class Windows:
    """The open windows of one task; `add` and `close` give finished windows as lists of pieces."""

    def __init__(self, length: int, limit: int, least_cut: int):
        self.length, self.limit, self.least_cut = length, limit, least_cut
        self.open: list[tuple[int, int]] = []  # room and number, by room
        self.held: dict[int, list[Piece]] = {}
        self.count = 0

    def _put(self, place: int, piece: Piece) -> list[Piece] | None:
        room, number = self.open.pop(place)
        self.held[number].append(piece)
        room -= len(piece[3])
        if room == 0:
            return self.held.pop(number)
        bisect.insort(self.open, (room, number))
        return None

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        doc, start, total, ids = piece
        while len(ids) >= self.length:
            yield [(doc, start, total, ids[: self.length])]
            start, ids = start + self.length, ids[self.length :]
        if not len(ids):
            return
        best = bisect.bisect_left(self.open, (len(ids), -1))
        if best == len(self.open) and len(self.open) >= self.limit:
            room, number = self.open[0]
            if room >= self.least_cut and len(ids) - room >= self.least_cut:
                yield self._put(0, (doc, start, total, ids[:room]))
                start, ids = start + room, ids[room:]
            else:
                self.open.pop(0)
                yield self.held.pop(number)
            best = bisect.bisect_left(self.open, (len(ids), -1))
        if best == len(self.open):
            self.held[self.count] = []
            bisect.insort(self.open, (self.length, self.count))
            self.count += 1
            best = bisect.bisect_left(self.open, (len(ids), -1))
        done = self._put(best, (doc, start, total, ids))
        if done:
            yield done

    def close(self) -> Iterator[list[Piece]]:
        for _, number in self.open:
            yield self.held.pop(number)
        self.open = []


def powers_of_two(window: list[Piece]) -> Iterator[list[Piece]]:
    """The window's pieces cut into sequences with falling powers of two as lengths."""
    total = sum(len(p[3]) for p in window)
    part, room = [], 1 << (total.bit_length() - 1)
    for doc, start, tokens, ids in window:
        while len(ids):
            part.append((doc, start, tokens, ids[:room]))
            taken = len(part[-1][3])
            start, ids, room, total = start + taken, ids[taken:], room - taken, total - taken
            if room == 0:
                yield part
                part, room = [], 1 << (total.bit_length() - 1) if total else 0


def _rows(sequences: list[tuple[int, list[Piece]]]) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in _SCHEMA]
    for number, pieces in sequences:
        offset = 0
        for doc, start, total, ids in pieces:
            for column, value in zip(columns, (doc, start, len(ids), total, number, offset, ids.astype("<u4").tobytes())):
                column.append(value)
            offset += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _packer(path: str, length: int, limit: int, least_cut: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokens.shared(path)
        windows = Windows(length, limit, least_cut)
        number, ready = TaskContext.get().partitionId() << 32, []
        end = np.array([END_ID], np.uint32)

        def out(rows: list, whole: bool) -> pa.RecordBatch:
            batch = _rows(rows)
            return batch.append_column("whole", pa.array([whole] * len(batch), pa.bool_()))

        for batch in batches:
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"])):
                ids = np.concatenate([ids, end])
                for done in windows.add((doc, 0, len(ids), ids)):
                    ready.append((number, done))
                    number += 1
                if len(ready) >= 512:
                    yield out(ready, True)
                    ready = []
        yield out(ready, True)
        yield out([(number + i, w) for i, w in enumerate(windows.close())], False)

    return pack


def _merger(length: int, limit: int, least_cut: int) -> Callable:
    def merge(key: tuple, table: pa.Table) -> pa.Table:
        windows = Windows(length, limit, least_cut)
        number, rows = (1 << 62) + (key[0].as_py() << 32), []
        # By place, so that a repeated task gives the same windows.
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        for doc, start, total, ids in zip(*(table[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
            for done in windows.add((doc, start, total, np.frombuffer(ids, "<u4"))):
                rows.append((number, done))
                number += 1
        rest = [piece for window in windows.close() for piece in window]
        while rest:
            # The open windows end to end: full ones first, then powers of two.
            total = sum(len(p[3]) for p in rest)
            if total < length:
                for part in powers_of_two(rest):
                    rows.append((number, part))
                    number += 1
                break
            window, room = [], length
            while room:
                doc, start, tokens, ids = rest.pop(0)
                window.append((doc, start, tokens, ids[:room]))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, tokens, ids[room:]))
                room -= len(window[-1][3])
            rows.append((number, window))
            number += 1
        return pa.Table.from_batches([_rows(rows)])

    return merge


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most `length` ids.

    Reads `doc_id` and `text`; other columns are left aside. Every row is a document
    of its own, repeated rows and equal ids included. A null text counts as empty; an
    empty document is its end id. A null doc_id stays null. An empty table gives no rows.
    Columns: doc_id, start, length, doc_tokens, sequence_id, offset, and ids as
    little-endian unsigned 32-bit numbers. `tokenizer` is the path of a tokenizer file
    that every executor can open.

    The tokens are written once to the shared folder; only the leftovers of each task
    (`open_windows` windows) are shuffled, and merged for `MERGED_TASKS` tasks at a time.
    """
    spark = docs.sparkSession
    place = work_path(spark, "packed")
    packed = docs.select("doc_id", "text").mapInArrow(_packer(tokenizer, length, open_windows, least_cut), PIECES + ", whole boolean")
    packed.write.partitionBy("whole").option("compression", "zstd").parquet(place)
    kept = spark.read.schema(PIECES + ", whole boolean").parquet(place)
    columns = [c.name for c in _SCHEMA]
    group = F.floor(F.shiftright("sequence_id", 32) / MERGED_TASKS)
    rest = kept.filter(~F.col("whole")).select(*columns).groupBy(group.cast("long")).applyInArrow(_merger(length, open_windows, least_cut), PIECES)
    return kept.filter("whole").select(*columns).unionByName(rest)
