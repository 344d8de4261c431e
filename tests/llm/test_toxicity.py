import random

import numpy as np

from furrow.llm import toxicity
from furrow.llm.toxicity import Isotonic, Lexicon, Trees, fit, score, train
from tests.llm.cases import SCHEMA, document_rows, prose

MARKS = ["skelm", "gruk", "vrotz"]


def labelled(seed, n=300):
    rng = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        words = prose(rng, rng.randrange(5, 60)).split(" ")
        y = rng.random() < 0.3
        for _ in range(rng.randrange(1, 3) if y else 0):
            words.insert(rng.randrange(len(words)), rng.choice(MARKS))
        texts.append(" ".join(words))
        labels.append(y)
    return texts, np.array(labels, float)


def test_held_out_texts_are_told_apart():
    model = fit(*labelled(1))
    texts, labels = labelled(2)
    scores = model.scores(texts)
    assert ((scores >= 0.5) == (labels > 0)).mean() >= 0.97
    assert scores[labels > 0].min() > np.median(scores[labels == 0])


def test_lexicons_equal_plain_counts():
    texts, labels = labelled(5, 400)
    folds = np.arange(len(texts)) % toxicity.FOLDS
    counts = toxicity.TermCounts(texts, labels, folds)
    for without in (None, 0, 2):
        rows = [(set(toxicity.tokens(t)), y > 0) for t, y, k in zip(texts, labels, folds) if k != without]
        n1, n0 = sum(y for _, y in rows), sum(not y for _, y in rows)
        for cut, got in ((None, counts.lexicon(without).words), (toxicity.BEGINNING, counts.lexicon(without).beginnings)):
            sets = [({w[:cut] for w in found if cut is None or len(w) > cut}, y) for found, y in rows]
            want = {}
            for term in set().union(*(s for s, _ in sets)):
                c, other = (sum(term in s for s, y in sets if y == label) for label in (True, False))
                odds = np.log((c + 0.5) / (n1 + 1)) - np.log((other + 0.5) / (n0 + 1))
                if c >= toxicity.LEAST_TEXTS and odds >= toxicity.LEAST_ODDS:
                    want[term] = odds
            assert want and got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-12 for t in want)
    assert toxicity.TermCounts([], np.zeros(0), np.zeros(0, int)).lexicon() == Lexicon({}, {})


def test_isotonic_fit_rises_and_trees_learn_a_step():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=500)
    fitted = Isotonic().fit(raw, (raw + rng.normal(size=500) > 0).astype(float)).at(np.sort(raw))
    assert (np.diff(fitted) >= 0).all() and fitted.min() >= 0 and fitted.max() <= 1
    x = rng.uniform(size=(400, 2))
    y = (x[:, 1] > 0.6).astype(float)
    assert ((Trees().fit(x, y).raw(x) > 0) == (y > 0)).mean() > 0.97


def test_features_of_odd_texts_are_finite():
    lexicon = Lexicon({"you": 1.0}, {"abcd": 2.0})
    for text in ("", " ", "\U0001f600", "you " * 5, "!" * 1000, "a.b.c.d y0u 1d10t", "x" * 100_000):
        assert np.isfinite(lexicon.features(text)).all()


def test_disguises_at_the_ends_and_before_punctuation_are_undone():
    lexicon = Lexicon({"stupid": 1.0, "ass": 1.0, "idiot": 1.0}, {})
    for text, times in (("$tupid", 1), ("an a$$", 1), ("1diot", 1), ("what an id1ot, really.", 1), ("(ID1OT!) a$$!!", 2), ("stupid! 100 $5 id-iot", 0), ("!diot|a b", 0)):
        assert lexicon.features(text)[11] == times, text
    assert Lexicon({"you": 1.0}, {}).features("you you")[6] == 100.0


def test_every_row_is_scored_with_and_without_labels(spark):
    docs = spark.createDataFrame(document_rows(2), SCHEMA)
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    for labels in (none, spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (3, 0)], "doc_id long, toxic int")):
        rows = score(docs, train(docs, labels)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in score(docs, train(docs, none)).collect()} == {0.5}
    assert score(docs.limit(0), train(docs.limit(0), none)).count() == 0
