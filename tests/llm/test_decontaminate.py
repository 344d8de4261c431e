import random
import re
from collections import Counter

from furrow.llm.decontaminate import contained_items, item_shingles, sketches, without_items
from tests.llm.cases import SCHEMA, document_rows, near, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def tables(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(5, 50))) for i in range(12)] + [(12, "too few words here"), (13, None), (None, prose(rng, 9)), (14, "")]
    docs = document_rows(6)
    for i, (_, text) in enumerate(items[:12]):
        for edits in (0, 1, 3):
            inside = near(rng, text, edits).upper() if i % 2 else near(rng, text, edits)
            docs.append((1000 + 10 * i + edits, prose(rng, rng.randrange(0, 900)) + "\n" + inside + "\t" + prose(rng, 40), "en", "s", 1, "x"))
    docs += [docs[-1], (None, items[0][1], "en", "s", 1, "x")]
    return docs, items, spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")


def test_pairs_equal_brute_force(spark):
    docs, items, docs_table, items_table = tables(spark)
    by_id = {}
    for d, text, *_ in docs:
        if d is not None:
            by_id.setdefault(d, set()).update(shingle_set(text))
    want = set()
    for item, text in items:
        s = shingle_set(text)
        for d, held in by_id.items():
            if item is not None and s and 100 * len(s & held) >= 80 * len(s):
                want.add((d, item, len(s), len(s & held)))
    got = contained_items(docs_table, items_table).select("doc_id", "item_id", "n_item", "n_shared").collect()
    assert Counter(map(tuple, got)) == Counter(want) and len(want) >= 12
    kept = without_items(docs_table, items_table)
    gone = {w[0] for w in want}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d[0] for d in docs if d[0] not in gone)
    assert kept.columns == docs_table.columns


def test_sketches_reach_every_document_that_counts(spark):
    _, _, docs, items = tables(spark)
    rows = sketches(item_shingles(items.select("item_id", "text"), 5), 80).groupBy("item_id", "n").count().collect()
    assert all(r["count"] >= min(r.n, r.n - -(-80 * r.n // 100) + 1) for r in rows)
    assert contained_items(docs.limit(0), items).count() == 0
    assert contained_items(docs, items.limit(0)).count() == 0


def test_main_path_is_native(spark):
    _, _, docs, items = tables(spark)
    plan = contained_items(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
