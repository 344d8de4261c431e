import random

import numpy as np

from furrow.llm.langid import averages, fit, predict, train
from furrow.llm.blocks import text_blocks
from tests.llm.cases import SCHEMA, document_rows
import pyarrow as pa

SYLLABLES = {"aa": "ka lo mi tu ren sal".split(), "bb": "szy prz cho wie dz łą".split(), "cc": "ää öö kki uus lla tte".split()}


def texts(seed, n=240):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((" ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang))
    return out


def test_held_out_texts_get_their_language():
    train_texts = texts(1)
    model = fit([t for t, _ in train_texts], [y for _, y in train_texts])
    held = texts(2)
    p = np.concatenate([model.block(d, o) for _, d, o in text_blocks(pa.array([t for t, _ in held]))])
    assert np.mean([model.languages[i] == y for i, (_, y) in zip(p.argmax(1), held)]) >= 0.98
    assert np.allclose(p.sum(1), 1)
    # Block scoring by distinct words equals the averages the model was trained on.
    z = averages([t for t, _ in held]) @ model.buckets + model.bias
    assert (z.argmax(1) == p.argmax(1)).all()


def test_odd_texts_and_empty_tables(spark):
    rows = [(i, t, y, "s", 1, "x") for i, (t, y) in enumerate(texts(3, 60))] + document_rows(7)
    docs = spark.createDataFrame(rows + [(99, "12 34 !!", "aa", "s", 1, "x")], SCHEMA)
    out = predict(docs, train(docs)).collect()
    assert len(out) == docs.count()
    for r in out:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
        else:
            assert r.lang_pred in ("aa", "bb", "cc", "en") and 0 < r.score <= 1
    assert predict(docs.limit(0), train(docs.limit(0))).count() == 0
    assert {r.lang_pred for r in predict(docs, train(docs.limit(0))).collect()} == {"und"}
