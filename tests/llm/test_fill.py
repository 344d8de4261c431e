import hashlib
import random
import re

import numpy as np
import pytest

from furrow.llm.fill_middle import boundaries, fill_middle, fit_index, restored
from pyspark.sql import functions as F
from tests.llm.cases import SCHEMA, document_rows

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
ODD = ["a<P>b c", "x <S>", "<M>", "  lead", "tail \n\t ", " ", "\x0b\x0c", "a\x1cb \x85c", "é" * 40 + " ü", "w" * 5000 + " " + "v " * 300, "\U0001f600 \U0001f600\n"]


def brute(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_outputs_equal_brute_force_and_can_be_undone(spark):
    rows = document_rows(4) + [(10_000 + i, t, None, None, None, None) for i, t in enumerate(ODD * 8)]
    made = fill_middle(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    found = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got]
    assert sorted(found, key=repr) == sorted((brute(r[0], r[1]) for r in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(((r.doc_id, r.back) for r in got), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)


def test_an_empty_table_gives_no_rows(spark):
    made = fill_middle(spark.createDataFrame([], SCHEMA + ", output int, form int"))
    assert made.count() == 0 and "lang" not in made.columns


@pytest.mark.parametrize("miss", [0, 3, 127])
def test_the_index_gives_every_boundary_exactly(miss):
    rng = random.Random(miss)
    texts = ["", " ", "a", *("".join(rng.choice(["w", "long-er", " ", "  ", "x" * 300, "\n"]) for _ in range(rng.randrange(400))) for _ in range(40))]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    bounds, base = boundaries(np.frombuffer(b"".join(raw), np.uint8), offsets)
    index = fit_index(bounds, base, miss)
    assert np.abs(index.residual.astype(int)).max() <= miss
    for i, text in enumerate(texts):
        ends = [0]
        for token in TOKEN.findall(text):
            ends.append(ends[-1] + len(token))
        assert bounds[base[i] : base[i + 1]].tolist() == ends
        assert index.at(np.full(len(ends), i), np.arange(len(ends))).tolist() == ends
    assert index.segments().sum() == len(index.start) and (index.segments() >= 1).all()


def test_even_tokens_need_one_segment():
    raw = b"word " * 5000
    bounds, base = boundaries(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert fit_index(bounds, base).segments().tolist() == [1]
