"""Settings queries: flags, layers, environment overrides, the enable gate and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import text
from furrow.operators import settings
from furrow.plans.registry import query
from furrow.plans.standins import EVENT_NUMBER_SQL, event_number
from furrow.sources.tables import table

_RAW_FLAGS = [" TRUE ", "on", "Yes", "1", "0", "2", "  ", "\ttrue\n", "off", "　on\xa0"]


def _pick(values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(event_number(), F.lit(len(values))))


def _pick_sql(values: list[str]) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[{EVENT_NUMBER_SQL} % {len(values)} + 1]"


_SPACES = "'" + text.WHITESPACE + "'"
_TRUE = "('1', 'true', 'yes', 'on')"


@query(
    "flag_parse",
    f"""
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE {_pick_sql(_RAW_FLAGS)} END AS raw
           FROM events),
c AS (SELECT event_id, trim(coalesce(raw, ''), {_SPACES}) AS cleaned FROM e)
SELECT event_id, cleaned, coalesce(nullif(cleaned, ''), 'champion') AS filled,
       CASE WHEN cleaned = '' THEN false ELSE lower(cleaned) IN {_TRUE} END AS flag,
       CASE WHEN cleaned = '' THEN true ELSE lower(cleaned) IN {_TRUE} END AS flag_default_on,
       cleaned = '' AS is_blank
FROM c
""",
)
def flag_parse(spark: SparkSession, base: str) -> DataFrame:
    raw = F.when(F.col("event_type") != "error", _pick(_RAW_FLAGS))
    events = table(spark, base, "events").select("event_id", raw.alias("raw"))
    return events.select(
        "event_id",
        text.clean(F.col("raw")).alias("cleaned"),
        text.first_nonblank(F.col("raw"), F.lit("champion")).alias("filled"),
        text.parse_flag(F.col("raw")).alias("flag"),
        text.parse_flag(F.col("raw"), True).alias("flag_default_on"),
        text.blank_to_null(F.col("raw")).isNull().alias("is_blank"),
    )


_LAYER_SQL = """CASE event_type WHEN 'view' THEN 'base' WHEN 'click' THEN 'overlay' WHEN 'signup' THEN 'argument'
            WHEN 'purchase' THEN 'environment' ELSE 'default' END"""


def _layer() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "view", "base")
        .when(kind == "click", "overlay")
        .when(kind == "signup", "argument")
        .when(kind == "purchase", "environment")
        .otherwise("default")
    )


_RANK_SQL = """CASE layer WHEN 'default' THEN 0 WHEN 'base' THEN 1 WHEN 'overlay' THEN 2
        WHEN 'argument' THEN 3 WHEN 'environment' THEN 4 ELSE -1 END"""


@query(
    "settings_overlay",
    f"""
WITH s AS (
  SELECT user_id AS entity, 'section' || CAST(k % 3 AS VARCHAR) AS section, 'key' || CAST(k % 5 AS VARCHAR) AS key,
         layer, CAST(value AS DECIMAL(18,2)) AS value, event_id
  FROM (SELECT *, {EVENT_NUMBER_SQL} AS k, {_LAYER_SQL} AS layer FROM events)),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, section, key ORDER BY {_RANK_SQL} DESC, event_id DESC) AS rn
      FROM s)
SELECT entity, section, key, layer, CAST(value AS VARCHAR) AS value FROM r WHERE rn = 1
""",
)
def settings_overlay(spark: SparkSession, base: str) -> DataFrame:
    number = event_number()
    rows = table(spark, base, "events").select(
        F.col("user_id").alias("entity"),
        F.concat(F.lit("section"), (number % 3).cast("string")).alias("section"),
        F.concat(F.lit("key"), (number % 5).cast("string")).alias("key"),
        _layer().alias("layer"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("value"),
        "event_id",
    )
    return settings.resolve(rows, "event_id")


_ENV_NAMES = [row[0] for row in settings.ENVIRONMENT_KEYS] + ["PATH", "HOME", settings.DIRECT_KEY_ENV]
_ENV_VALUES = [" a ", "", "b", "true", "  ", "0.7", "TRUE"]
_MAPPING_SQL = "(VALUES " + ", ".join(str(row) for row in settings.ENVIRONMENT_KEYS) + ") m(env_name, section, key)"


@query(
    "settings_env_override",
    f"""
WITH e AS (
  SELECT event_id, user_id AS entity, event_type, {_pick_sql(_ENV_NAMES)} AS env_name, {_pick_sql(_ENV_VALUES)} AS raw
  FROM events),
env AS (
  SELECT entity, m.section, m.key, 'environment' AS layer, trim(raw, {_SPACES}) AS v, event_id
  FROM e JOIN {_MAPPING_SQL} USING (env_name) WHERE event_type IN ('view', 'purchase')),
env_set AS (
  SELECT entity, section, key, layer,
         CASE WHEN v = '' THEN (CASE key WHEN 'repo_type' THEN 'dataset' ELSE NULL END)
              WHEN key = 'enabled' THEN (CASE WHEN lower(v) IN {_TRUE} THEN 'true' ELSE 'false' END)
              ELSE v END AS value, event_id
  FROM env WHERE v <> '' OR (section = 'artifacts' AND key IN ('repo_type', 'revision'))),
arg AS (
  SELECT entity, m.section, m.key, 'argument' AS layer, raw AS value, event_id
  FROM e JOIN {_MAPPING_SQL} USING (env_name) WHERE event_type = 'click'),
s AS (
  SELECT *, CASE WHEN layer = 'environment' THEN 4 WHEN section = 'artifacts' AND key = 'repo_id' THEN 5 ELSE 3 END AS p
  FROM (SELECT * FROM env_set UNION ALL SELECT * FROM arg)),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, section, key ORDER BY p DESC, event_id DESC) AS rn FROM s)
SELECT entity, section, key, layer, coalesce(value, '<none>') AS value FROM r WHERE rn = 1
""",
)
def settings_env_override(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "events").select(
        "event_id",
        F.col("user_id").alias("entity"),
        "event_type",
        _pick(_ENV_NAMES).alias("env_name"),
        _pick(_ENV_VALUES).alias("value"),
    )
    environment = settings.environment_layer(
        rows.filter(F.col("event_type").isin("view", "purchase")).drop("event_type")
    )
    mapping = F.broadcast(settings.environment_mapping(spark))
    arguments = (
        rows.filter(F.col("event_type") == "click")
        .join(mapping, "env_name")
        .select("entity", "section", "key", F.lit("argument").alias("layer"), "value", "event_id")
    )
    resolved = settings.resolve(environment.unionByName(arguments), "event_id")
    return resolved.withColumn("value", F.coalesce("value", F.lit("<none>")))


_GATE_KEYS = ["enabled", "api_key", "api_key_env", "model"]
_GATE_VALUES = {
    "enabled": ["true", "false", "on", " ", "1"],
    "api_key": ["", " ", "k-1"],
    "api_key_env": ["", "TEAM_KEY", "OTHER_KEY", " "],
    "model": ["m1", "m2"],
}
_HELD_NAMES = [settings.DIRECT_KEY_ENV, settings.DEFAULT_KEY_ENV, "TEAM_KEY", "OTHER_KEY", "PATH"]
_HELD_VALUES = ["secret", "", " ", "x", "", "", ""]


def _gate_value() -> Column:
    key = _pick(_GATE_KEYS)
    value = F.lit(None).cast("string")
    for name, values in _GATE_VALUES.items():
        place = F.pmod(F.col("event_id"), F.lit(len(values))).cast("int")
        value = F.when(key == name, F.get(F.array(*[F.lit(v) for v in values]), place)).otherwise(value)
    return value


def _gate_value_sql() -> str:
    cases = []
    for name, values in _GATE_VALUES.items():
        quoted = ", ".join(f"'{v}'" for v in values)
        cases.append(f"WHEN '{name}' THEN ([{quoted}])[event_id % {len(values)} + 1]")
    return f"CASE {_pick_sql(_GATE_KEYS)} " + " ".join(cases) + " END"


_HELD_VALUE_SQL = "([" + ", ".join(f"'{v}'" for v in _HELD_VALUES) + f"])[event_id % {len(_HELD_VALUES)} + 1]"


@query(
    "enable_gate",
    f"""
WITH conf AS (
  SELECT user_id AS entity, {_pick_sql(_GATE_KEYS)} AS key, {_gate_value_sql()} AS value, event_id
  FROM events WHERE event_type IN ('view', 'click', 'signup')),
latest AS (SELECT entity, key, arg_max(value, event_id) AS value FROM conf GROUP BY 1, 2),
wide AS (
  SELECT entity, max(value) FILTER (key = 'enabled') AS enabled, max(value) FILTER (key = 'api_key') AS api_key,
         max(value) FILTER (key = 'api_key_env') AS api_key_env
  FROM (SELECT DISTINCT user_id AS entity FROM events) LEFT JOIN (SELECT * FROM latest WHERE key <> 'model') USING (entity) GROUP BY 1),
held AS (
  SELECT DISTINCT user_id AS entity, {_pick_sql(_HELD_NAMES)} AS env_name
  FROM events WHERE event_type IN ('purchase', 'error') AND trim({_HELD_VALUE_SQL}) <> ''),
named AS (
  SELECT w.*, d.entity IS NOT NULL AS direct,
         CASE WHEN d.entity IS NOT NULL THEN '{settings.DIRECT_KEY_ENV}'
              ELSE coalesce(nullif(trim(coalesce(api_key_env, '')), ''), '{settings.DEFAULT_KEY_ENV}') END AS key_source
  FROM wide w LEFT JOIN (SELECT entity FROM held WHERE env_name = '{settings.DIRECT_KEY_ENV}') d USING (entity))
SELECT entity, key_source,
       lower(trim(coalesce(enabled, ''))) IN {_TRUE}
       AND ((NOT direct AND trim(coalesce(api_key, '')) <> '')
            OR EXISTS (SELECT 1 FROM held h WHERE h.entity = named.entity AND h.env_name = named.key_source)) AS enabled
FROM named
""",
)
def enable_gate(spark: SparkSession, base: str) -> DataFrame:
    events = table(spark, base, "events")
    configured = events.filter(F.col("event_type").isin("view", "click", "signup")).select(
        F.col("user_id").alias("entity"),
        F.lit("llm").alias("section"),
        _pick(_GATE_KEYS).alias("key"),
        F.lit("base").alias("layer"),
        _gate_value().alias("value"),
        "event_id",
    )
    held_value = F.get(F.array(*[F.lit(v) for v in _HELD_VALUES]), F.pmod("event_id", F.lit(len(_HELD_VALUES))).cast("int"))
    environment = events.filter(F.col("event_type").isin("purchase", "error")).select(
        F.col("user_id").alias("entity"), _pick(_HELD_NAMES).alias("env_name"), held_value.alias("value")
    )
    return settings.enable_gate(settings.resolve(configured, "event_id"), environment).drop("direct")


@query(
    "settings_upsert",
    f"""
WITH c AS (SELECT c_custkey AS entity, 'segment' AS key, c_mktsegment AS value FROM customer
           UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer),
i AS (SELECT user_id AS entity, CASE WHEN {EVENT_NUMBER_SQL} % 2 = 0 THEN 'segment' ELSE event_type END AS key,
             arg_max(event_type || CAST({EVENT_NUMBER_SQL} AS VARCHAR), event_id) AS value
      FROM events GROUP BY 1, 2)
SELECT coalesce(c.entity, i.entity) AS entity, coalesce(c.key, i.key) AS key,
       coalesce(i.value, c.value) AS value, i.entity IS NOT NULL AS was_set
FROM c FULL OUTER JOIN i ON c.entity = i.entity AND c.key = i.key
""",
)
def settings_upsert(spark: SparkSession, base: str) -> DataFrame:
    customers = table(spark, base, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment", "c_nationkey")
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    current = customers.select(
        "entity",
        F.inline(F.array(pair("segment", F.col("c_mktsegment")), pair("nation", F.col("c_nationkey").cast("string")))),
    )
    number = event_number()
    incoming = table(spark, base, "events").select(
        F.col("user_id").alias("entity"),
        F.when(number % 2 == 0, "segment").otherwise(F.col("event_type")).alias("key"),
        F.concat("event_type", number.cast("string")).alias("value"),
        F.col("event_id").alias("seq"),
    )
    return settings.upsert(current, incoming)
