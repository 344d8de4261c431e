"""The lower-casing word tokenizer, whose pre-tokens leave white space out."""

from __future__ import annotations

import numpy as np

from furrow.llm.cached_tokens import LETTER, NUMBER, OTHER, PLAIN, SPACE, CachedTokens, cut_contractions, runs


class WordTokens(CachedTokens):
    """Runs of letters, single numbers, runs of others, English contractions."""

    def character_tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind, lower, odd = np.zeros(PLAIN, np.uint8), np.arange(PLAIN, dtype=np.uint32), np.zeros(PLAIN, bool)
        for code in range(PLAIN):
            normal = self.whole.normalizer.normalize_str(chr(code))
            if len(normal) != 1 or ord(normal) >= PLAIN:
                odd[code] = True
                continue
            lower[code] = ord(normal)
            pieces = [b - a for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(f"a{normal}{normal}b")]
            shape = {(4,): LETTER, (1, 1, 1, 1): NUMBER, (1, 2, 1): OTHER, (1, 1): SPACE}
            kind[code] = shape.get(tuple(pieces), 0)
            odd[code] = tuple(pieces) not in shape
        return kind, lower, odd

    def cuts(self, codes: np.ndarray, kind: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, head = runs(codes, kind, heads)
        start = (start | (kind == NUMBER)) & (kind != SPACE)
        cut_contractions(codes, kind, start, head)
        starts = np.flatnonzero(start)
        # A pre-token ends where the next one starts or at the next space or text.
        stop = start | (kind == SPACE) | head[:-1]
        stops = np.append(np.flatnonzero(stop), len(codes))
        return starts, stops[np.cumsum(stop)[starts]]
