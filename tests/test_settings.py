import itertools

from pyspark.sql import functions as F

from furrow.functions import text
from furrow.operators import settings


def test_flags(spark):
    cases = {" TRUE ": True, "on": True, "yes": True, "1": True, "0": False, "2": False, "\u3000On\x1f": True}
    frame = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.f for r in frame.select("v", text.parse_flag(F.col("v")).alias("f")).collect()} == cases
    blank = spark.createDataFrame([("",), ("  ",), (None,)], "v string")
    for default in (True, False):
        assert {r[0] for r in blank.select(text.parse_flag(F.col("v"), default)).collect()} == {default}


def test_strip_takes_the_same_characters_as_python(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert sorted(spaces) == sorted(text.WHITESPACE)


def test_templates_fill_in_order(spark):
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in [("A", "B"), ("B", "c")]])
    assert spark.range(1).select(text.render_template(F.lit("A-B"), pairs)).first()[0] == "c-c"


def test_layers_and_latest(spark):
    rows = [
        ("e", "s", "k", "base", "1", 9), ("e", "s", "k", "overlay", "2", 1), ("e", "s", "k", "overlay", "3", 2),
        ("e", "artifacts", "repo_id", "environment", "env", 1), ("e", "artifacts", "repo_id", "argument", "arg", 1),
        ("e", "artifacts", "revision", "environment", "env", 1), ("e", "artifacts", "revision", "argument", "arg", 1),
    ]
    frame = spark.createDataFrame(rows, "entity string, section string, key string, layer string, value string, seq int")
    got = {(r.section, r.key): r.value for r in settings.resolve(frame, "seq").collect()}
    assert got == {("s", "k"): "3", ("artifacts", "repo_id"): "arg", ("artifacts", "revision"): "env"}


def test_environment_blanks(spark):
    rows = [
        ("e", "CROP_LLM_MODEL", " m "), ("e", "CROP_LLM_PROVIDER", " "), ("e", "CROP_LLM_ENABLED", "TRUE"),
        ("e", "HF_ARTIFACTS_REPO_TYPE", ""), ("e", "HF_ARTIFACTS_REVISION", " "), ("e", "HF_ARTIFACTS_REPO_ID", ""), ("e", "PATH", "x"),
    ]
    frame = spark.createDataFrame(rows, "entity string, env_name string, value string")
    got = {r.key: r.value for r in settings.environment_layer(frame).collect()}
    assert got == {"model": "m", "enabled": "true", "repo_type": "dataset", "revision": None}


def test_gate_truth_table(spark):
    configured, held, want = [], [], {}
    options = itertools.product(["true", "false", None], ["", "k"], [None, "", "OWN"], [(), ("DEEPSEEK_API_KEY",), ("OWN",), ("CROP_LLM_API_KEY",)])
    for i, (enabled, api_key, name, names) in enumerate(options):
        entity = f"e{i}"
        for key, value in (("enabled", enabled), ("api_key", api_key), ("api_key_env", name), ("model", "m")):
            if value is not None:
                configured.append((entity, "llm", key, value))
        held += [(entity, n, "secret") for n in names] + [(entity, "DEEPSEEK_API_KEY", " ")]
        source, direct = (name or "DEEPSEEK_API_KEY"), api_key
        if "CROP_LLM_API_KEY" in names:
            source, direct = "CROP_LLM_API_KEY", ""
        want[entity] = enabled == "true" and bool(direct or source in names)
    resolved = spark.createDataFrame(configured, "entity string, section string, key string, value string")
    environment = spark.createDataFrame(held, "entity string, env_name string, value string")
    got = {r.entity: r.enabled for r in settings.enable_gate(resolved, environment).collect()}
    assert got == want


def test_upsert_last_write_wins(spark):
    current = spark.createDataFrame([("e", "a", "1"), ("e", "b", "2")], "entity string, key string, value string")
    incoming = spark.createDataFrame([("e", "b", "3", 1), ("e", "b", "4", 2), ("e", "c", "5", 1)], "entity string, key string, value string, seq int")
    got = {r.key: (r.value, r.was_set) for r in settings.upsert(current, incoming).collect()}
    assert got == {"a": ("1", False), "b": ("4", True), "c": ("5", True)}
