"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a whole text are densities: of a lexicon of words and of a lexicon of
word beginnings (both learned from labelled texts), of lexicon words near the second
person, of capitals, of punctuation and of words with characters put in to hide them.
Trees and lexicons are fitted on a bounded sample of labelled rows; every text is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Training reads this many labelled rows at most, none of them longer than so many characters.
SAMPLE_ROWS = 6000
SAMPLE_CHARACTERS = 40_000
TREES = 60
DEPTH = 3
RATE = 0.2
BINS = 32
# A word enters a lexicon with this many labelled texts and this log odds at least.
LEAST_TEXTS = 4
LEAST_ODDS = 2.0
BEGINNING = 4
NEAR = 5
FOLDS = 3

# Second persons in the languages at hand (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes vosotros ti tú".split())
# Characters that stand in for letters (fixed values).
DISGUISE = str.maketrans("013457@$!|", "oieastasil")
_WORD = re.compile(r"[^\W_]+(?:[^\w\s]?[^\W_]+)*|[^\s]*[0-9@$!|*][^\s]*")
_PLAIN = re.compile(r"[^\W\d_]+")
_STAND_IN = re.compile(r"[013457@$!|]")
_RUN = re.compile(r"(?:[^\W_]|[@$!|])+")
_HIDDEN = re.compile(r"[^\W\d_][0-9@$!|*]+[^\W\d_]|(?:\b[^\W\d_][ .*-]){3,}")


def tokens(text: str) -> list[str]:
    return _PLAIN.findall(text.lower())


def disguised(text: str) -> Iterator[set[str]]:
    """For each run of letters, digits and stand-ins that holds a stand-in: what it may say, with and without marks at its ends."""
    for token in text.lower().split():
        if _STAND_IN.search(token):
            for run in _RUN.findall(token):
                ends = {run, run.rstrip("!|"), run.strip("!|"), run.lstrip("!|")}
                yield {e.translate(DISGUISE) for e in ends if _STAND_IN.search(e)}


@dataclass
class Lexicon:
    """Weights of words and of beginnings."""

    words: dict[str, float]
    beginnings: dict[str, float]

    def features(self, text: str) -> list[float]:
        found = tokens(text)
        n = max(len(found), 1)
        marks = [i for i, w in enumerate(found) if w in self.words]
        starts = [w[:BEGINNING] for w in found if len(w) > BEGINNING]
        start_marks = sum(1 for s in starts if s in self.beginnings)
        near = 0
        if marks:
            second = np.array([i for i, w in enumerate(found) if w in SECOND_PERSON] or [-(10**9)])
            place = np.searchsorted(second, marks)
            gaps = np.minimum(np.abs(second[np.minimum(place, len(second) - 1)] - marks), np.abs(second[np.maximum(place - 1, 0)] - marks))
            near = int((gaps <= NEAR).sum())
        size = max(len(text), 1)
        hidden = _HIDDEN.findall(text)
        unmasked = sum(1 for said in disguised(text) if not said.isdisjoint(self.words))
        letters = max(sum(map(len, found)), 1)
        return [
            100.0 * len(marks) / n,
            float(min(len(marks), 20)),
            sum(self.words[found[i]] for i in marks) / n,
            100.0 * start_marks / max(len(starts), 1),
            float(min(start_marks, 20)),
            sum(self.beginnings[s] for s in starts if s in self.beginnings) / n,
            100.0 * near / n,
            sum(map(str.isupper, text)) / letters,
            (text.count("!") + text.count("?")) / size,
            sum(text.count(c) for c in ".,;:-\"'()") / size,
            len(hidden) / n,
            float(unmasked),
            float(np.log1p(n)),
        ]


def _terms(text: str) -> tuple[set[str], set[str]]:
    """The words and the beginnings of longer words that a text holds."""
    found = set(tokens(text))
    return found, {w[:BEGINNING] for w in found if len(w) > BEGINNING}


class TermCounts:
    """In how many texts of each fold and label a term stands; of clean texts only terms that could enter a lexicon count.

    Texts are taken one by one, toxic ones first, so nothing but the counts stays.
    """

    def __init__(self, texts: list[str], labels: np.ndarray, folds: np.ndarray):
        self.kinds = []
        self.rows = {y: np.bincount(folds[(labels > 0) == y], minlength=FOLDS) for y in (True, False)}
        toxic = [[Counter() for _ in range(FOLDS)] for _ in range(2)]
        for i in np.flatnonzero(labels > 0).tolist():
            for counts, terms in zip(toxic, _terms(texts[i])):
                counts[folds[i]].update(terms)
        possible = [{t for t, c in sum(counts, Counter()).items() if c >= LEAST_TEXTS} for counts in toxic]
        clean = [[Counter() for _ in range(FOLDS)] for _ in range(2)]
        for i in np.flatnonzero(labels <= 0).tolist():
            for counts, terms, wanted in zip(clean, _terms(texts[i]), possible):
                counts[folds[i]].update(terms & wanted)
        self.kinds = list(zip(possible, toxic, clean))

    def lexicon(self, without: int | None = None) -> "Lexicon":
        """Terms that toxic texts hold far more often than others, by smoothed log odds of texts; one fold may stay out."""
        kept = [k for k in range(FOLDS) if k != without]
        n1, n0 = (max(int(self.rows[y][kept].sum()), 1) for y in (True, False))
        found = []
        for possible, toxic, clean in self.kinds:
            odds = {}
            for term in possible:
                c, other = sum(toxic[k][term] for k in kept), sum(clean[k][term] for k in kept)
                if c >= LEAST_TEXTS:
                    odds[term] = float(np.log((c + 0.5) / (n1 + 1)) - np.log((other + 0.5) / (n0 + 1)))
            found.append({t: o for t, o in odds.items() if o >= LEAST_ODDS})
        return Lexicon(*found)


class Trees:
    """Boosted regression trees for the logistic loss, on binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate = trees, depth, rate
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(1) for c in x.T]
        # A feature that is nearly always zero still gets an edge at zero.
        self.edges = [np.unique(np.append(e, 0.0)) for e in self.edges]
        binned = self._bin(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.base)
        for _ in range(self.trees if len(y) else 0):
            p = 1 / (1 + np.exp(-raw))
            tree: list = []
            self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), 0, tree)
            self.nodes.append(tree)
            raw += self.rate * self._one(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def _grow(self, b, g, h, rows, depth, tree) -> int:
        place = len(tree)
        tree.append([-1, 0, 0, 0, float(g[rows].sum() / (h[rows].sum() + 1.0))])
        if depth == self.depth or len(rows) < 10:
            return place
        best = (1e-6, -1, 0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f in range(b.shape[1]):
            bins = len(self.edges[f]) + 1
            left_g = np.cumsum(np.bincount(b[rows, f], g[rows], bins))[:-1]
            left_h = np.cumsum(np.bincount(b[rows, f], h[rows], bins))[:-1]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] >= 0:
            left = b[rows, best[1]] <= best[2]
            if left.any() and not left.all():
                tree[place][:2] = best[1], best[2]
                tree[place][2] = self._grow(b, g, h, rows[left], depth + 1, tree)
                tree[place][3] = self._grow(b, g, h, rows[~left], depth + 1, tree)
        return place

    @staticmethod
    def _one(tree: list, b: np.ndarray) -> np.ndarray:
        at = np.zeros(len(b), int)
        table = np.array(tree, float)
        for _ in range(64):
            feature = table[at, 0].astype(int)
            inner = feature >= 0
            if not inner.any():
                break
            left = b[np.arange(len(b)), np.maximum(feature, 0)] <= table[at, 1]
            at = np.where(inner, np.where(left, table[at, 2], table[at, 3]).astype(int), at)
        return table[at, 4]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return self.base + self.rate * sum((self._one(t, b) for t in self.nodes), np.zeros(len(x)))


class Isotonic:
    """Non-decreasing step fit by pooling adjacent violators, with values kept inside (0, 1)."""

    def fit(self, raw: np.ndarray, y: np.ndarray) -> "Isotonic":
        values, back = np.unique(np.round(raw, 6), return_inverse=True)
        weight = np.bincount(back, minlength=len(values)).astype(float)
        mean = np.bincount(back, y, len(values)) / np.maximum(weight, 1)
        blocks: list[list[float]] = []
        for v, m, w in zip(values, mean, weight):
            blocks.append([v, m, w])
            while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
                _, m2, w2 = blocks.pop()
                first = blocks[-1]
                first[1], first[2] = (first[1] * first[2] + m2 * w2) / (first[2] + w2), first[2] + w2
        self.starts = np.array([b[0] for b in blocks]) if blocks else np.zeros(1)
        # Pulled towards one half by one pseudo row, so that scores differ where counts do.
        self.values = np.array([(b[1] * b[2] + 0.5) / (b[2] + 1) for b in blocks]) if blocks else np.full(1, 0.5)
        self.values = np.maximum.accumulate(self.values)
        return self

    def at(self, raw: np.ndarray) -> np.ndarray:
        return self.values[np.maximum(np.searchsorted(self.starts, np.round(raw, 6), "right") - 1, 0)]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def scores(self, texts: list[str]) -> np.ndarray:
        raw = self.trees.raw(np.array([self.lexicon.features(t) for t in texts]).reshape(len(texts), -1))
        # Inside a step the raw score keeps the order.
        return np.clip(self.calibration.at(raw) + 1e-4 * np.tanh(raw), 0.0, 1.0)


def fit(texts: list[str], labels: np.ndarray) -> ToxicityModel:
    """Lexicons for a text's features come from the other folds, so trees see densities as new texts have them."""
    labels = labels.astype(float)
    fold = np.arange(len(texts)) % FOLDS
    x = np.zeros((len(texts), len(Lexicon({}, {}).features(""))))
    counts = TermCounts(texts, labels, fold)
    for k in range(FOLDS):
        part = counts.lexicon(without=k)
        for i in np.flatnonzero(fold == k):
            x[i] = part.features(texts[i])
    raw = np.zeros(len(texts))
    for k in range(FOLDS):
        held = fold == k
        if held.any():
            raw[held] = Trees().fit(x[~held], labels[~held]).raw(x[held])
    return ToxicityModel(counts.lexicon(), Trees().fit(x, labels), Isotonic().fit(raw, labels))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, characters: int = SAMPLE_CHARACTERS) -> ToxicityModel:
    """A model from at most `rows` labelled texts of at most `characters`, taken in the order of a hash of doc_id.

    Labelled rows with a null id or label and null texts are not learned from; several
    labels of one id count as their maximum. Without any row every text scores one half.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    # The sample is drawn from the labels alone, so only its texts move; `rows` bounds the broadcast.
    chosen = F.broadcast(marks.orderBy(order, "doc_id").limit(rows))
    found = docs.select("doc_id", "text").filter(F.char_length("text") <= characters).join(chosen, "doc_id").dropDuplicates(["doc_id"])
    sample = sorted(found.select(order.alias("o"), "doc_id", "text", "toxic").collect())
    return fit([r.text for r in sample], np.array([r.toxic > 0 for r in sample], float))


def _scorer(model: ToxicityModel, out: str) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            yield batch.append_column(out, pa.array(model.scores(texts), pa.float64()))

    return score


def score(docs: DataFrame, model: ToxicityModel, out: str = "score") -> DataFrame:
    """`docs` with a score between 0 and 1 of every whole text in column `out`; a null text counts as empty.

    All rows and columns stay, repeated rows included; a column called like `out` is replaced.
    """
    docs = docs.drop(out)
    return docs.mapInArrow(_scorer(model, out), StructType([*docs.schema.fields, StructField(out, DoubleType())]))
