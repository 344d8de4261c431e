import re
from collections import Counter, defaultdict

import pyarrow as pa

from furrow.llm import quality_cascade as q
from tests.llm.cases import SCHEMA, document_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def numbers(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_numbers_equal_a_plain_count(spark):
    rows = document_rows(3)
    rows += [(900, "a b c d e f g h " * 3 + "\nx\nx\n\n x\nx", "en", "s", 1, "x"), (901, "# * <é> é|\r\n# *", None, None, None, None)]
    got = q.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    want = Counter()
    for r in rows:
        n = numbers(r[1])
        want[(r[0], *n, n[0] < 20 or 100 * n[4] > 30 * n[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert all(r.rejected_by for r in got if r.base_failed)


def test_order_does_not_change_the_verdict():
    texts = [r[1] for r in document_rows(4)] + ["WHY!! NOT!! " * 20, "1 2 3 4 " * 20, "a | b | " * 30]
    blocks = [b for _, b in q._blocks(pa.array(texts, pa.string()))]
    steps = [q.Step(name, 1.0, 0.0) for name in q.RULES]
    verdicts = []
    for order in (steps, steps[::-1], steps[3:] + steps[:3]):
        verdicts.append([(q.cascade(q.Block(b.data, b.offsets), order, q.RULES) < 0).tolist() for b in blocks])
    assert verdicts[0] == verdicts[1] == verdicts[2]
    alone = [[not any(rule(q.Block(b.data, b.offsets))[i] for rule in q.RULES.values()) for i in range(len(b))] for b in blocks]
    assert verdicts[0] == alone


def test_rejections_per_cost_decide_the_order(spark):
    docs = spark.createDataFrame(document_rows(5), SCHEMA)
    steps = q.plan(docs)
    value = [(s.rejected + 1e-6) / s.cost for s in steps]
    assert value == sorted(value, reverse=True) and {s.name for s in steps} == set(q.RULES)
    assert [s.name for s in q.plan(docs.limit(0))] == list(q.RULES)
    assert q.judge(docs.limit(0)).count() == 0
