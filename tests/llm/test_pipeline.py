import random

import pytest
from pyspark.sql import functions as F
from tests.llm.cases import SCHEMA, document_rows, near, prose

import corpus_pipeline

MARKS = ["skelm", "gruk", "vrotz"]
# Names that the operators use themselves, and odd ones.
EXTRA = ["score", "matched", "base", "others", "candidates", "pii", "row", "node", "component", "toxicity0", "a b", "count", "k"]


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    """A folder of small tables: toxic texts, copies, benchmark passages, personal data and the usual odd rows."""
    rng = random.Random(9)
    root = tmp_path_factory.mktemp("tables")
    rows = [(i + 10_000, prose(rng, rng.randrange(20, 60)), "en", "s", 1, "x") for i in range(240)]
    toxic = set(range(10_000, 10_240, 4))
    rows = [(r[0], r[1] + " " + " ".join(rng.choices(MARKS, k=2)) if r[0] in toxic else r[1], *r[2:]) for r in rows]
    item = prose(rng, 25)
    rows += [(20_000, prose(rng, 10) + " " + item + " " + prose(rng, 10), "en", "s", 1, "x"), (20_001, "write to me@x.org now " + prose(rng, 30), "en", "s", 1, "x")]
    story = prose(rng, 80)
    rows += [(30_000 + i, near(rng, story, i % 2), "en", "s", 1, "x") for i in range(5)]
    rows += document_rows(11)
    spark.createDataFrame(rows, SCHEMA).drop("score").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] and 10_000 <= r[0] < 10_240] + [(None, 1, 1), (10_001, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), toxic


def test_each_stage_does_its_work_on_what_is_left(spark, base):
    root, toxic = base
    docs = spark.read.parquet(f"{root}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.persist_reliably(stage(spark, seen[-1], root)))
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in seen]
    assert all(s.columns == docs.columns for s in seen[:-1])
    assert not toxic & set(ids[1]) and len(set(ids[0]) - set(ids[1])) <= len(toxic) + 3
    assert set(ids[2]) & set(range(30_000, 30_005)) == {30_000} and {20_000, 20_001} <= set(ids[2])
    assert set(ids[2]) - set(ids[3]) == {20_000}
    assert sorted(map(str, ids[3])) == sorted(map(str, ids[4]))
    masked = seen[4].filter("doc_id = 20001").first()
    assert "me@x.org" not in masked.text and "<email>" in masked.text and masked.n_chars == len(masked.text)
    totals = seen[5].groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in totals} == set(ids[4]) and all(r.n % r.doc_tokens == 0 for r in totals)
    whole = corpus_pipeline.run(spark, root).select("doc_id", "start", "length", "ids_crc32")
    assert whole.agg(F.sum("length")).first()[0] == seen[5].agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_bear_odd_rows_clashing_columns_and_empty_tables(spark, base, name, stage):
    root, _ = base
    rows = [(*r[:5], *[f"v{i}" for i in range(len(EXTRA))]) for r in document_rows(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, root)
    assert name == "packing" or out.columns == docs.columns
    found = out.collect()
    assert found
    if name != "packing":
        assert all(r[c] == f"v{i}" for r in found for i, c in enumerate(EXTRA))
        # Rows without an id or text stay in every stage.
        assert sum(r.doc_id is None and r.text is None for r in found) == 1
    assert stage(spark, docs.limit(0), root).count() == 0


def test_without_labels_all_documents_stay(spark, base, tmp_path):
    docs = spark.createDataFrame(document_rows(1), SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()
