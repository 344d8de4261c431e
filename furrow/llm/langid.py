"""Language of whole texts: averaged embeddings of hashed subwords with a linear softmax.

A text is the mean of its subwords' embeddings; subwords are the byte n-grams of its
words with their edges marked, hashed into a fixed number of buckets. Embeddings and
softmax are trained together by stochastic gradient descent in numpy on a bounded sample
of texts with a known language. A temperature fitted on texts kept from training makes
the scores probabilities, and the score below which a prediction is rejected is chosen
there too. Scoring works each distinct word of a block out once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from furrow.llm.blocks import LOWER, mix, ranges, span_hashes, text_blocks, words

BUCKETS = 1 << 13
DIMENSIONS = 16
GRAMS = (2, 3, 4)
# Training reads this many texts at most, none of them longer than so many characters.
SAMPLE_ROWS = 4000
SAMPLE_CHARACTERS = 40_000
EPOCHS = 12
BATCH = 32
RATE = 0.5
# Share of accepted predictions that should be right.
PRECISION = 0.99
UNKNOWN = "und"
_U = np.uint64


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and number of the word of every subword of the given words."""
    size = ends - starts + 2
    first = np.cumsum(size) - size
    marked = np.zeros(int(size.sum()), np.uint64)
    inner = np.repeat(starts, ends - starts) + ranges(ends - starts)
    marked[np.repeat(first + 1, ends - starts) + ranges(ends - starts)] = data[inner].astype(_U) + _U(3)
    marked[first], marked[first + size - 1] = 1, 2
    owner = np.repeat(np.arange(len(starts)), size)
    buckets, owners = [], []
    for n in GRAMS:
        count = len(marked) - n + 1
        if count <= 0:
            continue
        value = np.full(count, n, _U)
        for i in range(n):
            value = value * _U(259) + marked[i : i + count]
        inside = owner[:count] == owner[n - 1 :]
        buckets.append((mix(value[inside]) & _U(BUCKETS - 1)).astype(np.int64))
        owners.append(owner[:count][inside])
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _distinct_words(data: np.ndarray, offsets: np.ndarray):
    """First place of each distinct word, the word number and row of each occurrence."""
    starts, ends, rows = words(data, offsets)
    _, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return starts[first], ends[first], back, rows


def averages(texts: list[str]) -> np.ndarray:
    """Share of each bucket among the subwords of each text; zeros for texts without words."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, data, offsets in text_blocks(pa.array(texts, pa.string())):
        data = LOWER[data]
        starts, ends, back, rows = _distinct_words(data, offsets)
        bucket, owner = _grams(data, starts, ends)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(starts) + 1))
        size = np.diff(cuts)[back]
        grams = bucket[order][np.repeat(cuts[:-1][back], size) + ranges(size)]
        n = len(offsets) - 1
        out[row : row + n] = np.bincount(np.repeat(rows, size) * BUCKETS + grams, minlength=n * BUCKETS).reshape(n, BUCKETS)
    return out / np.maximum(out.sum(1, keepdims=True), 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    # Logits of each bucket: embeddings times softmax weights.
    buckets: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, sums: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return _softmax((sums / np.maximum(grams, 1)[:, None] + self.bias) / self.temperature)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each text of a block."""
        data, n = LOWER[data], len(offsets) - 1
        starts, ends, back, rows = _distinct_words(data, offsets)
        bucket, owner = _grams(data, starts, ends)
        count = np.bincount(owner, minlength=len(starts))
        sums = [np.bincount(rows, np.bincount(owner, column[bucket], len(starts))[back], n) for column in self.buckets.T]
        return self.probabilities(np.stack(sums, 1), np.bincount(rows, count[back], n))


def fit(texts: list[str], languages: list[str], seed: int = 7) -> LanguageModel:
    """Trains on four fifths of the texts and calibrates on the rest. Without texts nothing can be predicted."""
    names = sorted(set(languages))
    if not names:
        return LanguageModel([UNKNOWN], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 1.0)
    y = np.array([names.index(x) for x in languages])
    x = averages(texts)
    kept = np.arange(len(y)) % 5 == 4
    draw = np.random.default_rng(seed)
    embed = draw.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight, bias = np.zeros((DIMENSIONS, len(names)), np.float32), np.zeros(len(names), np.float32)
    weight += draw.normal(0, 0.1, weight.shape).astype(np.float32)
    train = np.flatnonzero(~kept)
    goal = np.eye(len(names), dtype=np.float32)[y]
    scale = 100.0  # shares are small numbers
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for rows in np.array_split(draw.permutation(train), max(1, len(train) // BATCH)):
            used = np.flatnonzero(x[rows].any(0))
            mean = x[np.ix_(rows, used)] * scale
            hidden = mean @ embed[used]
            error = (_softmax(hidden @ weight + bias) - goal[rows]) / len(rows)
            back = error @ weight.T
            weight -= rate * hidden.T @ error
            bias -= rate * error.sum(0)
            embed[used] -= rate * mean.T @ back
    logits = scale * (embed @ weight).astype(np.float64)
    model = LanguageModel(names, logits, bias.astype(np.float64), 1.0, 0.0)
    z, goal_kept = x[kept] @ logits + bias, y[kept]
    if len(goal_kept):
        grid = np.geomspace(0.2, 20, 60)
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(z)), goal_kept], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / model.temperature)
        best, right = p.max(1), p.argmax(1) == goal_kept
        order = np.argsort(-best, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
        model.threshold = float(best[order][good[-1]]) if len(good) else 1.0
    return model


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, characters: int = SAMPLE_CHARACTERS) -> LanguageModel:
    """A model from at most `rows` texts with a language, taken in the order of a hash of doc_id. Null ids, texts and languages are not learned from."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = docs.select("doc_id", "lang").filter("doc_id is not null and lang is not null").dropDuplicates(["doc_id"])
    # Ids first: only the sample's texts move. `rows` bounds the broadcast.
    chosen = F.broadcast(known.orderBy(order, "doc_id").limit(rows))
    found = docs.select("doc_id", "text").filter(F.char_length("text") <= characters).join(chosen, "doc_id").dropDuplicates(["doc_id"])
    sample = sorted(found.select(order.alias("o"), "doc_id", "text", "lang").collect())
    return fit([r.text for r in sample], [r.lang for r in sample])


def _predictor(model: LanguageModel) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, object)
        for batch in batches:
            parts = [model.block(data, offsets) for _, data, offsets in text_blocks(batch["text"])]
            p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            letters = np.array(pc.match_substring_regex(batch["text"].fill_null(""), r"\p{L}"), bool).reshape(len(batch))
            best, score = p.argmax(1), p.max(1) if len(p) else np.zeros(0)
            lang = np.where(letters, names[best], UNKNOWN)
            score = np.where(letters, score, 0.0)
            accepted = letters & (score >= model.threshold)
            for name, values in (("lang_pred", pa.array(lang.tolist(), pa.string())), ("score", pa.array(score)), ("accepted", pa.array(accepted))):
                batch = batch.append_column(name, values)
            yield batch

    return predict


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with lang_pred, score (the prediction's calibrated probability) and accepted, for every whole text.

    Texts that are null or hold no letter get "und" with score 0 and are not accepted;
    other texts get the likeliest language, accepted if its score reaches the model's
    threshold. All rows and columns stay, except that columns of those names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())]
    return docs.mapInArrow(_predictor(model), StructType([*docs.schema.fields, *new]))
