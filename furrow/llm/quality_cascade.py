"""Quality rules as a short-circuit cascade.

The rules say when a text is rejected. On a bounded sample each rule's cost (time per
text) and selectivity (share rejected) are estimated; the cascade then tries rules in
falling order of rejections per cost, and a text that one rule rejects is not shown to
the next. The order decides how much work is done, never which texts are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.blocks import SPACE, mix, shingles, span_hashes, text_blocks, words

WINDOW = 8
SAMPLE_ROWS = 500
SAMPLE_CHARACTERS = 20_000
_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord("!"), ord("?")]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass
class Block:
    """Texts of some rows; what several rules need is worked out once, when first asked for."""

    data: np.ndarray
    offsets: np.ndarray
    known: dict = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def part(self, rows: np.ndarray) -> "Block":
        """The block of some of the rows."""
        if len(rows) == len(self):
            return self
        size = np.diff(self.offsets)[rows]
        pieces = [self.data[self.offsets[r] : self.offsets[r + 1]] for r in rows]
        known = {name: self.known[name][rows] for name in COLUMNS if name in self.known}
        return Block(np.concatenate(pieces) if pieces else self.data[:0], np.concatenate([[0], np.cumsum(size)]), known)

    def _get(self, name: str, make: Callable):
        if name not in self.known:
            self.known[name] = make()
        return self.known[name]

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self):
        return self._get("words", lambda: words(self.data, self.offsets))

    def hashes(self) -> np.ndarray:
        starts, ends, _ = self.words()
        return self._get("hashes", lambda: span_hashes(self.data, starts, ends))

    def n_words(self) -> np.ndarray:
        return self._get("n_words", lambda: np.bincount(self.words()[2], minlength=len(self)))

    def word_chars(self) -> np.ndarray:
        return self._get("word_chars", lambda: self.per_row(((self.data & 0xC0) != 0x80) & ~SPACE[self.data]))

    def n_symbols(self) -> np.ndarray:
        return self._get("n_symbols", lambda: self.per_row(_SYMBOL[self.data]))

    def n_repeat_words(self) -> np.ndarray:
        return self._get("n_repeat_words", self._repeats)

    def _repeats(self) -> np.ndarray:
        rows = self.words()[2]
        value, owner, first = shingles(self.hashes(), rows, WINDOW)
        _, back, times = np.unique(mix(value + owner.astype(_U) * _U(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        again = first[times[back] > 1]
        edge = np.zeros(len(rows) + 1, np.int64)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + WINDOW, -1)
        return np.bincount(rows[np.cumsum(edge)[:-1] > 0], minlength=len(self))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of every line that holds a word."""
        return self._get("lines", self._lines)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        breaks = np.flatnonzero(self.data == 10)
        starts = np.union1d(self.offsets[:-1], breaks + 1)
        starts = starts[starts < len(self.data)]
        ends = np.minimum(np.append(breaks, len(self.data))[np.searchsorted(breaks, starts)], self.offsets[np.searchsorted(self.offsets, starts, "right")])
        first = self.words()[0]
        full = np.searchsorted(first, ends) > np.searchsorted(first, starts)
        starts, ends = starts[full], ends[full]
        return np.searchsorted(self.offsets, starts, "right") - 1, span_hashes(self.data, starts, ends)

    def n_dup_lines(self) -> np.ndarray:
        return self._get("n_dup_lines", self._dup_lines)

    def _dup_lines(self) -> np.ndarray:
        rows, value = self.lines()
        keyed = mix(value + rows.astype(_U) * _U(0x9E3779B97F4A7C15))
        _, first = np.unique(keyed, return_index=True)
        return np.bincount(rows, minlength=len(self)) - np.bincount(rows[first], minlength=len(self))

    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines()[0], minlength=len(self))

    def top_word(self) -> np.ndarray:
        """Occurrences of each row's most frequent word."""
        rows = self.words()[2]
        _, first, times = np.unique(mix(self.hashes() + rows.astype(_U) * _U(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        best = np.zeros(len(self), np.int64)
        np.maximum.at(best, rows[first], times)
        return best


Rule = Callable[[Block], np.ndarray]

# A rule gives True for the rows it rejects. The first two are the base rules.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda b: b.n_words() < 20,
    "repeated_words": lambda b: 100 * b.n_repeat_words() > 30 * b.n_words(),
}
RULES: dict[str, Rule] = BASE_RULES | {
    "symbols": lambda b: 10 * b.n_symbols() > b.n_words(),
    "repeated_lines": lambda b: 10 * b.n_dup_lines() > 3 * b.n_lines(),
    "word_length": lambda b: (b.word_chars() < 2 * b.n_words()) | (b.word_chars() > 14 * b.n_words()),
    "capitals": lambda b: 2 * b.per_row(_UPPER[b.data]) > b.per_row(_LETTER[b.data]),
    "shouting": lambda b: 5 * b.per_row(_CLOSING[b.data]) > b.n_words(),
    "digits": lambda b: 3 * b.per_row(_DIGIT[b.data]) > b.word_chars(),
    "one_word": lambda b: 4 * b.top_word() > b.n_words(),
}


@dataclass(frozen=True)
class Step:
    name: str
    cost: float
    rejected: float


def _blocks(column: pa.Array) -> Iterator[tuple[int, Block]]:
    for row, data, offsets in text_blocks(column):
        yield row, Block(data, offsets)


def _sample(docs: DataFrame, rows: int, characters: int) -> list[str]:
    """At most `rows` distinct texts, the first in the order of a hash; hashes are chosen first, so only chosen texts move."""
    short = docs.select("text").filter((F.char_length("text") <= characters) & F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), "text")
    # `rows` bounds both sides of the join.
    chosen = F.broadcast(short.select("h").distinct().orderBy("h").limit(rows))
    return [r.text for r in sorted(short.join(chosen, "h").groupBy("h").agg(F.min("text").alias("text")).collect())]


def plan(docs: DataFrame, rules: dict[str, Rule] = RULES, rows: int = SAMPLE_ROWS, characters: int = SAMPLE_CHARACTERS) -> list[Step]:
    """Rules in falling order of rejections per cost, as estimated on `rows` texts of at most `characters` at most.

    A rule's cost is the time it takes where the numbers of COLUMNS are known, as they
    are when the cascade starts. Without texts the rules keep their given order.
    """
    sample = _sample(docs, rows, characters)
    if not sample:
        return [Step(name, 1.0, 0.0) for name in rules]
    blocks = [block for _, block in _blocks(pa.array(sample, pa.string()))]
    for block in blocks:
        for column in COLUMNS:
            getattr(block, column)()
    steps = []
    for name, rule in rules.items():
        fresh = [Block(b.data, b.offsets, dict(b.known)) for b in blocks]
        began, rejected = time.perf_counter(), 0
        for block in fresh:
            rejected += int(rule(block).sum())
        steps.append(Step(name, (time.perf_counter() - began) / len(sample), rejected / len(sample)))
    return sorted(steps, key=lambda s: (-(s.rejected + 1e-6) / s.cost, s.name))


def cascade(block: Block, steps: list[Step], rules: dict[str, Rule]) -> np.ndarray:
    """Number of the rule that rejects each row, or -1; rows that a rule rejects are not shown to the next."""
    by = np.full(len(block), -1)
    shown = np.arange(len(block))
    for number, step in enumerate(steps):
        bad = rules[step.name](block) & (by[shown] < 0)
        by[shown[bad]] = number
        gone = by[shown] >= 0
        # Below this share a smaller block costs more than it saves.
        if gone.sum() * 20 > len(shown):
            block, shown = block.part(np.flatnonzero(~gone)), shown[~gone]
        if not len(shown):
            break
    return by


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(steps: list[Step], rules: dict[str, Rule]) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _blocks(batch["text"]):
                numbers = [pa.array(getattr(block, c)(), pa.int64()) for c in COLUMNS]
                base = np.zeros(len(block), bool)
                for rule in BASE_RULES.values():
                    base |= rule(block)
                by = cascade(block, steps, rules)
                names = pa.array([steps[i].name if i >= 0 else None for i in by], pa.string())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, len(block)), *numbers, pa.array(base), names], ["doc_id", *COLUMNS, "base_failed", "rejected_by"])

    return judge


def judge(docs: DataFrame, steps: list[Step] | None = None, rules: dict[str, Rule] = RULES) -> DataFrame:
    """For each row of `docs` (doc_id, text): doc_id, its numbers, base_failed, and rejected_by, null for texts that stay.

    Numbers are taken over the whole text; words are runs of characters other than
    space and \\t..\\r. A null or empty text has no words and fails the base rules. Every
    row is judged, repeated rows and null ids included; other columns are left aside.
    `rejected_by` names the first rule in the cascade's order, so it may differ between
    runs; whether it is null does not.
    """
    steps = plan(docs, rules) if steps is None else steps
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, rejected_by string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_judge(steps, rules), schema)
