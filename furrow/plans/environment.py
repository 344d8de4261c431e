"""The whole preparation job: a release tree brought in place and settings for every customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators.environment import prepare_environment
from furrow.plans.files import write_source
from furrow.plans.registry import query
from furrow.plans.standins import EVENT_NUMBER_SQL, event_number
from furrow.session import work_path
from furrow.sources.tables import table


# Which variable the newest event of each type sets, with which value.
_VARIABLES = {
    "view": "CROP_LLM_MODEL",
    "click": "CROP_LLM_PROVIDER",
    "signup": "CROP_LLM_ENABLED",
    "purchase": "DEEPSEEK_API_KEY",
    "error": "CROP_LLM_API_KEY",
}


@query(
    "environment_prepare",
    f"""
WITH base AS (
  SELECT c_custkey AS entity, 'serving' AS section, 'log_file' AS key, c_name AS value FROM customer
  UNION ALL SELECT c_custkey, 'llm', 'model', c_mktsegment FROM customer
  UNION ALL SELECT c_custkey, 'llm', 'api_key', c_name FROM customer WHERE c_nationkey < 5),
newest AS (SELECT user_id AS entity, event_type, arg_max({EVENT_NUMBER_SQL}, event_id) AS n FROM events GROUP BY 1, 2),
env AS (
  SELECT entity, 'model' AS key, 'view' || n AS value FROM newest WHERE event_type = 'view'
  UNION ALL SELECT entity, 'provider', 'click' || n FROM newest WHERE event_type = 'click'
  UNION ALL SELECT entity, 'enabled', CAST(n % 2 = 0 AS VARCHAR) FROM newest WHERE event_type = 'signup'),
overlay(section, key, value) AS (VALUES
  ('release', 'enabled', 'true'), ('release', 'root_dir', '<root>/output/release'), ('output', 'out_dir', '<root>/output'),
  ('serving', 'active_release_policy', 'champion'), ('serving', 'strict_model_loading', 'true'),
  ('serving', 'log_file', '<root>/output/service.log'),
  ('feedback', 'inference_log_file', '<root>/output/feedback/inference_events.jsonl'),
  ('feedback', 'feedback_log_file', '<root>/output/feedback/user_feedback.jsonl'),
  ('feedback', 'training_sample_file', '<root>/output/feedback/training_samples.jsonl'),
  ('feedback', 'training_sample_csv', '<root>/output/feedback/training_samples.csv'),
  ('feedback', 'training_summary_file', '<root>/output/feedback/training_summary.json'),
  ('feedback', 'competition_overview_file', '<root>/output/feedback/competition_overview.json'),
  ('auth', 'users_file', '<root>/data/system/users.json')),
entities AS (SELECT DISTINCT entity FROM (SELECT entity FROM base UNION ALL SELECT entity FROM newest)),
keys AS (
  SELECT entity, coalesce(max(n) FILTER (event_type = 'signup') % 2 = 0, false) AS wanted,
         count(*) FILTER (event_type = 'error') > 0 AS direct, count(*) FILTER (event_type = 'purchase') > 0 AS named
  FROM entities LEFT JOIN newest USING (entity) GROUP BY 1),
gate AS (
  SELECT entity, direct, wanted AND (direct OR named OR entity IN (SELECT entity FROM base WHERE key = 'api_key')) AS enabled FROM keys),
layers AS (
  SELECT entity, section, key, value, 1 AS p FROM base
  UNION ALL SELECT entity, section, key, value, 2 FROM entities, overlay
  UNION ALL SELECT entity, 'llm', key, value, 4 FROM env
  UNION ALL SELECT entity, 'llm', 'enabled', CAST(enabled AS VARCHAR), 9 FROM gate
  UNION ALL SELECT entity, 'llm', 'api_key', '', 9 FROM gate WHERE direct
  UNION ALL SELECT entity, 'llm', 'api_key_env', 'CROP_LLM_API_KEY', 9 FROM gate WHERE direct),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, section, key ORDER BY p DESC) AS rn FROM layers)
SELECT entity, section, key, value, 'replaced' AS sync_state, CAST(24 AS BIGINT) AS n_repaired, CAST(1 AS BIGINT) AS n_rejected
FROM r WHERE rn = 1
""",
)
def environment_prepare(spark: SparkSession, base: str) -> DataFrame:
    root = work_path(spark, "environment")
    write_source(spark, base, f"{root}/source")
    customers = table(spark, base, "customer").select(
        F.col("c_custkey").alias("entity"), "c_name", "c_mktsegment", F.when(F.col("c_nationkey") < 5, F.col("c_name")).alias("key_text")
    )
    row = lambda section, key, value: F.struct(
        F.lit(section).alias("section"), F.lit(key).alias("key"), F.col(value).alias("value")
    )
    rows = F.array(
        row("serving", "log_file", "c_name"), row("llm", "model", "c_mktsegment"), row("llm", "api_key", "key_text")
    )
    settings = customers.select("entity", F.inline(rows)).filter(F.col("value").isNotNull())
    newest = table(spark, base, "events").groupBy(F.col("user_id").alias("entity"), "event_type").agg(
        F.max_by(event_number(), "event_id").alias("n")
    )
    names = F.create_map(*[F.lit(x) for pair in _VARIABLES.items() for x in pair])
    flag = F.when(F.col("n") % 2 == 0, "on").otherwise("no")
    value = F.when(F.col("event_type") == "signup", flag).otherwise(F.concat("event_type", F.col("n").cast("string")))
    environment = newest.select("entity", names[F.col("event_type")].alias("env_name"), value.alias("value"))
    summary = prepare_environment(spark, f"{root}/runtime", f"{root}/source", settings, environment, "/srv/app")
    facts = summary.select("runtime_settings", "runtime_root", "sync_state", "n_repaired", "n_rejected").first()
    return spark.read.parquet(facts.runtime_settings).select(
        "entity",
        "section",
        "key",
        F.replace("value", F.lit(facts.runtime_root), F.lit("<root>")).alias("value"),
        F.lit(facts.sync_state).alias("sync_state"),
        F.lit(facts.n_repaired).cast("bigint").alias("n_repaired"),
        F.lit(facts.n_rejected).cast("bigint").alias("n_rejected"),
    )
