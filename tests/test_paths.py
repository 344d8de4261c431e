import json
import random
import re
from pathlib import PurePosixPath

from pyspark.sql import functions as F

from furrow.functions import paths
from furrow.operators.prefix import rewrite_by_rule_table

RULES = [
    ("C:\\r\\out\\rel\\run1", "/N/rel/run1"),
    ("C:/r/out/rel", "/N/rel"),
    ("C:/r/out/", "/N"),
    ("/", "/X"),
    ("tmp", ""),
]

CASES = {
    "C:\\r\\out\\rel\\run1\\m.pkl": "/N/rel/run1/m.pkl",
    "C:/r/out/rel/run1": "/N/rel/run1",
    "C:/r/out/rel/run10/x": "/N/rel/run10/x",
    "C:/r/out/x.csv": "/N/x.csv",
    "C:/r/out/": "/N/",
    "C:/r/out//x": "/N//x",
    "C:/r/outer/z": "C:/r/outer/z",
    "c:/r/out/x": "c:/r/out/x",
    "D:\\a\\b": "D:\\a\\b",
    "/": "/",
    "/etc": "/etc",
    "tmp/x": "x",
    "tmp": "",
    "tmp/": "",
    "": "",
}


def by_parts(text, rules):
    """The expected text, told from lists of path parts: the first rule whose parts lead the text's parts."""
    split = lambda path: re.split(r"[/\\\\]", path)
    parts = split(text)
    leads = [(old if old[-1] else old[: max((i + 1 for i, p in enumerate(old) if p), default=0)], new) for old, new in ((split(o), n) for o, n in rules)]
    hits = [(old, new) for old, new in leads if old and parts[: len(old)] == old]
    if not hits:
        return text
    old, new = hits[0]
    return "/".join(([new] if new else []) + parts[len(old) :])


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "text string")


def random_texts(count, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "ab", "C:", "", ".", "é"]
    return sorted(
        {rng.choice("/\\").join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(count)}
    )


def test_rewrite_cases_by_row_rules(spark):
    out = texts(spark, CASES).select("text", paths.rewrite_prefix(F.col("text"), paths.rule_array(RULES)).alias("r"))
    assert {row.text: row.r for row in out.collect()} == CASES


def test_rewrite_cases_by_known_rules(spark):
    out = texts(spark, CASES).select("text", paths.rewrite_with(F.col("text"), RULES).alias("r"))
    assert {row.text: row.r for row in out.collect()} == CASES


def test_rewrite_cases_by_rule_table(spark):
    table = spark.createDataFrame([(o, n, i) for i, (o, n) in enumerate(RULES)], "old string, new string, ord int")
    for limit in (0, 1 << 20):
        out = rewrite_by_rule_table(texts(spark, CASES), "text", table, max_bytes=limit)
        assert {row.text: row.rewritten for row in out.collect()} == CASES


def test_no_rules_leave_text(spark):
    out = texts(spark, CASES).select("text", paths.rewrite_prefix(F.col("text"), paths.rule_array([])).alias("r"))
    assert all(row.text == row.r for row in out.collect())


def test_first_listed_rule_wins(spark):
    rules = [("a", "1"), ("a/b", "2")]
    plain = paths.rewrite_prefix(F.col("text"), paths.rule_array(rules))
    longest = paths.rewrite_prefix(F.col("text"), paths.longest_first(paths.rule_array(rules)))
    row = texts(spark, ["a/b/c"]).select(plain.alias("p"), longest.alias("l")).first()
    assert (row.p, row.l) == ("1/b/c", "2/c")


def test_random_texts_match_part_lists(spark):
    values = random_texts(400, 1)
    rules = [(v, f"/new{i}") for i, v in enumerate(random_texts(30, 2))]
    ordered = sorted(rules, key=lambda r: len(r[0].replace("\\", "/").rstrip("/")), reverse=True)
    table = spark.createDataFrame([(o, n, i) for i, (o, n) in enumerate(rules)], "old string, new string, ord int")
    frame = texts(spark, values).withColumn("by_row", paths.rewrite_prefix(F.col("text"), paths.rule_array(ordered)))
    frame = frame.withColumn("known", paths.rewrite_with(F.col("text"), ordered))
    rows = rewrite_by_rule_table(frame, "text", table).collect()
    assert len(rows) == len(values)
    for row in rows:
        assert row.by_row == by_parts(row.text, ordered), row.text
        assert row.rewritten == row.by_row == row.known, row.text


def test_scoped_rules_stay_in_their_scope(spark):
    frame = spark.createDataFrame([(1, "a/x"), (2, "a/x")], "run int, text string")
    table = spark.createDataFrame([(1, "a", "one", 0)], "run int, old string, new string, ord int")
    out = rewrite_by_rule_table(frame, "text", table, scope=["run"])
    assert {r.run: r.rewritten for r in out.collect()} == {1: "one/x", 2: "a/x"}


def test_tidy_parent_and_name_agree_with_pathlib(spark):
    values = [v.replace("\\", "/") for v in random_texts(200, 3)] + ["/", "//", "//a", "//a/b", "///a", "/a", "a", "", "./a"]
    frame = texts(spark, values).select("text", paths.tidy(F.col("text")).alias("t"))
    rows = frame.select("text", "t", paths.parent(F.col("t")).alias("p"), paths.base_name(F.col("t")).alias("n")).collect()
    for row in rows:
        want = PurePosixPath(row.text)
        assert row.t == want.as_posix(), row.text
        assert row.p == want.parent.as_posix(), row.text
        assert row.n == want.name, row.text


def test_component_order(spark):
    values = ["a/b", "a-b", "a", "B"]
    out = texts(spark, values).orderBy(paths.components(F.col("text"))).collect()
    assert [r.text for r in out] == ["B", "a", "a/b", "a-b"]


def test_marked_strings_are_rewritten_like_all_strings(spark):
    rng = random.Random(11)
    bits = ["/", "\\", "a", "b", "/a", "C:", '"', "\n", "é", "发", ".", ",", "]", " ", "\x01", "\x03", "😀"]
    text = lambda most: "".join(rng.choice(bits if rng.random() < 0.3 else bits[:5]) for _ in range(rng.randrange(most)))

    def value(depth=0):
        kind = rng.randrange(7)
        if kind < 4 or depth > 3:
            return text(6)
        if kind == 4:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {text(4) + str(i): value(depth + 1) for i in range(rng.randrange(4))} if kind == 5 else rng.choice([1, 1.5, None, True])

    def document():
        found = json.dumps(value(), ensure_ascii=rng.random() < 0.3, separators=rng.choice([None, (",", ":"), (" , ", "\t:\n")]))
        return found.replace("/", "\\/") if rng.random() < 0.2 else found

    rows = [(document(), [(text(4), text(4)) for _ in range(rng.randrange(4))]) for _ in range(3000)]
    rows += [(None, [("a", "b")]), ('["a/b"]', None), ('["a/b", "a"]', [("a", None)]), ('["\\ud800/a", "a/b"]', [("a", "b")]), ('{"a/b": "a/b", "a" : ["a\\\\c"]}', [("a", "")])]
    frame = spark.createDataFrame(rows, "document string, rules array<struct<old:string,new:string>>").withColumn("rules", paths.clean_rules(F.col("rules")))
    whole = paths.map_json_strings(F.col("document"), lambda v: paths.rewrite_cleaned(v, F.col("rules")))
    found = frame.select("document", whole.alias("whole"), paths.rewrite_json_strings(F.col("document"), F.col("rules")).alias("marked")).collect()
    assert [r.marked for r in found] == [r.whole for r in found]
    assert sum(r.whole != r.document for r in found if r.document) > 30
    assert found[-1].marked == '{"a/b": "b", "a" : ["c"]}'
