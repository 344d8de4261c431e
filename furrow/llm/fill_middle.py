"""Fill in the middle: texts cut at two token boundaries and put together in another order.

The boundaries of a text's tokens are a sorted array of offsets. Every text gets a
learned rank index over all of them: line segments that miss no boundary by more than
`MISS` bytes, and one residual byte per boundary. A cut after k tokens is predicted from
the segment that holds boundary k and put right by the stored residual, which is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.blocks import SPACE, ranges, spread, text_blocks, words

SEED = 42
# Of 100 texts so many are transformed, and of 100 transformed ones so many start with the suffix.
RATE = 50
SUFFIX_FIRST = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Largest miss of a segment; residuals then fit into one signed byte.
MISS = 127

_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, n_segments long, output string"


@dataclass
class RankIndex:
    """Offset of boundary k of text i, for the texts of one block.

    `base[i]` is the place of text i's boundary 0 among all boundaries. A segment starts
    at the place `start` with the offset `offset` and rises by `slope` per boundary.
    """

    base: np.ndarray
    start: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def at(self, texts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        place = self.base[texts] + ranks
        segment = np.searchsorted(self.start, place, "right") - 1
        return _predicted(self.offset[segment], self.slope[segment], place - self.start[segment]) + self.residual[place]

    def segments(self) -> np.ndarray:
        """How many segments each text has."""
        return np.diff(np.searchsorted(self.start, self.base))


def _predicted(offset: np.ndarray, slope: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return offset + np.floor(slope * steps + 0.5).astype(np.int64)


def fit_index(bounds: np.ndarray, base: np.ndarray, miss: int = MISS) -> RankIndex:
    """An index over `bounds`, text i's boundaries at base[i]..base[i + 1].

    Each text starts as one segment through its ends; a segment that misses a boundary
    by more than `miss` is halved. Segments of two boundaries or one miss nothing.
    """
    low, high = base[:-1], base[1:]
    residual = np.zeros(len(bounds), np.int8)
    fitted: list[tuple[np.ndarray, np.ndarray]] = []
    while len(low):
        size = high - low
        slope = (bounds[high - 1] - bounds[low]) / np.maximum(size - 1, 1)
        place = spread(low, size)
        gap = bounds[place] - _predicted(np.repeat(bounds[low], size), np.repeat(slope, size), ranges(size))
        fits = np.maximum.reduceat(np.abs(gap), np.cumsum(size) - size) <= miss
        kept = np.repeat(fits, size)
        residual[place[kept]] = gap[kept]
        fitted.append((low[fits], slope[fits]))
        middle = low[~fits] + size[~fits] // 2
        low, high = np.concatenate([low[~fits], middle]), np.concatenate([middle, high[~fits]])
    start = np.concatenate([f[0] for f in fitted]) if fitted else np.zeros(0, np.int64)
    slope = np.concatenate([f[1] for f in fitted]) if fitted else np.zeros(0)
    order = np.argsort(start)
    return RankIndex(base, start[order], bounds[start[order]], slope[order], residual)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all token boundaries of each text, 0 first, and where each text's begin.

    A token is a word with the white space before it; white space at a text's end is a
    token of its own.
    """
    _, ends, rows = words(data, offsets)
    length = np.diff(offsets)
    count = np.bincount(rows, minlength=len(length))
    tail = np.zeros(len(length), bool)
    filled = length > 0
    tail[filled] = SPACE[data[offsets[1:][filled] - 1]]
    base = np.concatenate([[0], np.cumsum(count + tail + 1)])
    bounds = np.zeros(base[-1], np.int64)
    bounds[base[rows] + 1 + ranges(count)] = ends - offsets[rows]
    bounds[base[1:][tail] - 1] = length[tail]
    return bounds, base


def _numbers(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def _cutter(seed: int, rate: int, suffix_first: int) -> Callable:
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for row, data, offsets in text_blocks(batch["text"]):
                size = len(offsets) - 1
                bounds, base = boundaries(data, offsets)
                index = fit_index(bounds, base)
                n = np.diff(base) - 1
                drawn = np.array([_numbers(seed, i) for i in ids[row : row + size]], np.int64).reshape(-1, 4)
                cuts = drawn[:, :2] % (n + 1)[:, None]
                every = np.arange(size)
                one, two = (index.at(every, c) + offsets[:-1] for c in (cuts.min(1), cuts.max(1)))
                # Code points before each byte.
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                form, output = [], []
                for i, (a, x, y, b) in enumerate(zip(offsets[:-1].tolist(), one.tolist(), two.tolist(), offsets[1:].tolist())):
                    text = data[a:b].tobytes()
                    if not text or drawn[i, 2] % 100 >= rate or any(mark in text for mark in marks):
                        form.append("plain")
                        output.append(text)
                        continue
                    prefix, middle, suffix = text[: x - a], text[x - a : y - a], text[y - a :]
                    if drawn[i, 3] % 100 < suffix_first:
                        form.append("spm")
                        output.append(b"".join((s, suffix, p, prefix, m, middle)))
                    else:
                        form.append("psm")
                        output.append(b"".join((p, prefix, s, suffix, m, middle)))
                plain = np.array([f == "plain" for f in form], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(row, size),
                        pa.array(n),
                        pa.array(form, pa.string()),
                        pa.array(points[one] - points[offsets[:-1]], mask=plain),
                        pa.array(points[two] - points[one], mask=plain),
                        pa.array(index.segments()),
                        pa.array(output, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "n_segments", "output"],
                )

    return cut


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Each whole text of `docs` (doc_id, text) cut in three and reordered, one row per row.

    Tokens are words with the white space before them, white space at the end apart.
    Both cuts, the choice of texts and the form follow from a hash of the seed and
    doc_id, so equal ids are cut at the same draws and repeated rows give equal rows. A
    null doc_id draws as an empty one. A null text counts as empty. Empty texts and texts
    that hold one of the marks stay as they are (`plain`), and so do those not drawn;
    their prefix_chars and middle_chars are null. Other columns are left aside; an empty
    table gives no rows. n is the number of tokens, n_segments that of the line segments
    in the text's rank index. No rows move.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cutter(seed, rate, suffix_first), _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that `fill_middle` was given, from its output and form alone."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
