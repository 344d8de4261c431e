"""Token ids of whole texts at the speed of their distinct pre-tokens.

A tokenizer of this kind cuts a text into pre-tokens and encodes each for itself. Here a
block of texts is cut with array operations, every distinct pre-token is encoded once per
task by the tokenizers library, and the ids of a text are put together from those. Texts
with characters beyond plain Latin, or with a special token's string, go to the tokenizer
whole.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from furrow.llm.blocks import span_hashes, spread, text_blocks

# Below this code point every character is stable under composition.
PLAIN = 0x250
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 0
_KEPT = "furrow_kept_tokenizers"
# Beyond this size the table of distinct pre-tokens drops those that came in one block only.
CACHE_WORDS = 150_000
LEARNED_WORDS = 1024
# Small, as are the blocks elsewhere: the arrays of a block take a hundred times its bytes.
BLOCK_BYTES = 250_000


class IdTable:
    """Ids of pre-tokens by their hash: an open table that is probed for many keys at once."""

    def __init__(self):
        self.keys, self.slots = np.zeros(1 << 17, np.uint64), np.zeros(1 << 17, np.int32)
        self.at, self.size, self.flat = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32)
        # Blocks that asked for a word, up to 255.
        self.asked = np.zeros(1 << 16, np.uint8)
        self.words = self.used = 0

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for unknown ones. Keys are hashes other than 0."""
        mask = np.uint64(len(self.keys) - 1)
        place, out, open_rows = keys & mask, np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(open_rows):
            at = place[open_rows]
            found = self.keys[at]
            hit = found == keys[open_rows]
            out[open_rows[hit]] = self.slots[at[hit]]
            open_rows = open_rows[~hit & (found != 0)]
            place[open_rows] = (place[open_rows] + np.uint64(1)) & mask
        return out

    def _insert(self, keys: np.ndarray, slots: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        place, open_rows = keys & mask, np.arange(len(keys))
        while len(open_rows):
            at = place[open_rows]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[open_rows[free]]
            # Of several keys for one place the last written has it.
            won = self.keys[at] == keys[open_rows]
            self.slots[at[won]] = slots[open_rows[won]]
            open_rows = open_rows[~won]
            place[open_rows] = (place[open_rows] + np.uint64(1)) & mask

    @staticmethod
    def _roomy(array: np.ndarray, needed: int) -> np.ndarray:
        return array if needed <= len(array) else np.concatenate([array, np.zeros(max(needed, 2 * len(array)) - len(array), array.dtype)])

    def learn(self, keys: np.ndarray, found: list[list[int]]) -> None:
        """Adds unknown, distinct keys."""
        first, n = self.words, len(keys)
        size = np.fromiter(map(len, found), np.int32, n)
        self._append(size, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())))
        slots = np.arange(first, first + n, dtype=np.int32)
        if 2 * self.words > len(self.keys):
            held = self.keys != 0
            old = self.keys[held], self.slots[held]
            room = 1 << int(4 * self.words - 1).bit_length()
            self.keys, self.slots = np.zeros(room, np.uint64), np.zeros(room, np.int32)
            self._insert(*old)
        self._insert(keys, slots)

    def _append(self, size: np.ndarray, ids: np.ndarray) -> None:
        first, last, used = self.words, self.words + len(size), self.used + len(ids)
        self.at, self.size, self.flat = self._roomy(self.at, last), self._roomy(self.size, last), self._roomy(self.flat, used)
        self.asked = self._roomy(self.asked, last)
        self.at[first:last] = self.used + np.cumsum(size) - size
        self.size[first:last] = size
        self.flat[self.used : used] = ids
        self.words, self.used = last, used

    def ask(self, slots: np.ndarray) -> None:
        """Notes that a block holds these words."""
        once = np.zeros(self.words, bool)
        once[slots] = True
        self.asked[: self.words] += once & (self.asked[: self.words] < 255)

    def trimmed(self, limit: int) -> "IdTable":
        """A table of the words that more than one block asked for; an empty one if these are more than `limit`."""
        found = IdTable()
        held = np.flatnonzero(self.keys)
        held = held[self.asked[self.slots[held]] > 1]
        if not 0 < len(held) <= limit:
            return found
        keys, slots = self.keys[held], self.slots[held]
        size = self.size[slots]
        found._append(size, self.flat[spread(self.at[slots], size)])
        room = max(len(found.keys), 1 << int(4 * len(held) - 1).bit_length())
        found.keys, found.slots = np.zeros(room, np.uint64), np.zeros(room, np.int32)
        found._insert(keys, np.arange(len(held), dtype=np.int32))
        return found


class CachedTokens:
    """Encodes Arrow string columns; a subclass says how plain texts are cut."""

    @classmethod
    def shared(cls, path: str) -> "CachedTokens":
        """One per process: later tasks of a worker find the tokenizer loaded and its pre-tokens known.

        This package travels with the job by value, so its own modules keep nothing from
        one task to the next; a module of the process does.
        """
        kept = sys.modules.setdefault(_KEPT, ModuleType(_KEPT)).__dict__
        if (cls.__name__, path) not in kept:
            kept[cls.__name__, path] = cls(path)
        return kept[cls.__name__, path]

    def __init__(self, path: str):
        # Tasks share the cores already; the library's own threads only cost memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.kind, self.lower, self.odd = self.character_tables()
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.table = IdTable()

    def character_tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kind and normal form of plain characters as the tokenizer itself treats them, and which it treats otherwise."""
        raise NotImplementedError

    def cuts(self, codes: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens; `heads` are the first characters of texts that are not empty."""
        raise NotImplementedError

    def _plain(self, text: str, codes: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Which texts of the block the tables cover."""
        plain = np.ones(len(points) - 1, bool)
        beyond = codes >= PLAIN
        odd = np.flatnonzero(beyond | self.odd[np.where(beyond, 0, codes)])
        plain[np.searchsorted(points, odd, "right") - 1] = False
        for special in self.special:
            place = text.find(special)
            while place >= 0:
                plain[np.searchsorted(points, place, "right") - 1] = False
                place = text.find(special, place + 1)
        return plain

    def _plain_ids(self, codes: np.ndarray, points: np.ndarray) -> list[np.ndarray]:
        codes = self.lower[codes]
        heads = points[:-1][np.diff(points) > 0]
        starts, ends = self.cuts(codes, self.kind[codes], heads)
        keys = np.maximum(span_hashes(codes, starts, ends), np.uint64(1))
        if self.table.words > CACHE_WORDS:
            self.table = self.table.trimmed(CACHE_WORDS // 2)
        place = self.table.places(keys)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            low = codes.tobytes().decode("utf-32-le")
            # A few at a time: an encoding is far larger than its ids.
            for at in range(0, len(new), LEARNED_WORDS):
                part = first[at : at + LEARNED_WORDS]
                words = [low[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist())]
                self.table.learn(new[at : at + LEARNED_WORDS], [e.ids for e in self.bare.encode_batch_fast(words, add_special_tokens=False)])
            place[missing] = self.table.places(keys[missing])
        self.table.ask(place)
        size = self.table.size[place]
        ids = self.table.flat[spread(self.table.at[place], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        cuts = total[np.searchsorted(starts, points)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of the column in turn; a null text counts as empty."""
        for _, data, offsets in text_blocks(column, BLOCK_BYTES):
            raw = data.tobytes()
            text = raw.decode()
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            points = offsets if len(codes) == len(data) else np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            plain = self._plain(text, codes, points)
            lengths = np.diff(points)
            if not plain.all():
                codes = codes[np.repeat(plain, lengths)]
                lengths = lengths[plain]
            fast = iter(self._plain_ids(codes, np.concatenate([[0], np.cumsum(lengths)])))
            for i, p in enumerate(plain.tolist()):
                yield next(fast) if p else np.array(self.whole.encode(raw[offsets[i] : offsets[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)


def runs(codes: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a kind of character begins, and where texts do."""
    head = np.zeros(len(codes) + 1, bool)
    head[heads] = True
    begin = np.ones(len(codes), bool)
    begin[1:] = kind[1:] != kind[:-1]
    return begin | head[:-1], head


def cut_contractions(codes: np.ndarray, kind: np.ndarray, start: np.ndarray, head: np.ndarray) -> None:
    """English contractions at an apostrophe that starts a pre-token become pre-tokens of their own."""
    for q in np.flatnonzero(start & (codes == 39)).tolist():
        rest = "".join(map(chr, codes[q + 1 : q + 3]))
        size = 1 if rest[:1] in ("s", "t", "m", "d") and rest else 2 if rest in ("re", "ve", "ll") else 0
        # The contraction must lie inside the text.
        if size and not head[q + 1 : q + 1 + size].any():
            start[q + 1] = False
            after = q + 1 + size
            if after < len(codes) and kind[after] != SPACE:
                start[after] = True


class ByteTokens(CachedTokens):
    """The byte-level tokenizer: a pre-token takes the space before it, other white space stays apart."""

    def character_tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind, odd = np.zeros(PLAIN, np.uint8), np.zeros(PLAIN, bool)
        for code in range(PLAIN):
            # A character is of the kind whose characters it joins.
            joins = [k for k, c in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"), (SPACE, "\n")) if len(self.whole.pre_tokenizer.pre_tokenize_str(c + chr(code) + c)) == 1]
            odd[code] = len(joins) != 1
            kind[code] = joins[0] if joins else SPACE
        return kind, np.arange(PLAIN, dtype=np.uint32), odd

    def cuts(self, codes: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, head = runs(codes, kind, heads)
        # The last white space before a character that is none stands alone, or with it if it is a space.
        last = np.zeros(len(codes), bool)
        last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:-1]
        start |= last
        joined = np.flatnonzero(last & (codes == 32)) + 1
        start[joined] = False
        cut_contractions(codes, kind, start, head)
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], len(codes))
