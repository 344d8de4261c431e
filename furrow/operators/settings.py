"""Layered settings as a long table: (entity, section, key, layer, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.text import blank_to_null, clean, first_nonblank, parse_flag

# Environment name, the section and key it sets.
ENVIRONMENT_KEYS = [
    ("CROP_LLM_ENABLED", "llm", "enabled"),
    ("CROP_LLM_PROVIDER", "llm", "provider"),
    ("CROP_LLM_MODEL", "llm", "model"),
    ("CROP_LLM_ENDPOINT", "llm", "endpoint"),
    ("CROP_LLM_API_KEY_ENV", "llm", "api_key_env"),
    ("CROP_LLM_TIMEOUT_SECONDS", "llm", "timeout_seconds"),
    ("CROP_LLM_MAX_TOKENS", "llm", "max_tokens"),
    ("CROP_LLM_TEMPERATURE", "llm", "temperature"),
    ("CROP_ACTIVE_RELEASE_POLICY", "serving", "active_release_policy"),
    ("HF_ARTIFACTS_REPO_ID", "artifacts", "repo_id"),
    ("HF_ARTIFACTS_REPO_TYPE", "artifacts", "repo_type"),
    ("HF_ARTIFACTS_REVISION", "artifacts", "revision"),
]

# The environment variable that may hold the key itself, and the default name.
DIRECT_KEY_ENV = "CROP_LLM_API_KEY"
DEFAULT_KEY_ENV = "DEEPSEEK_API_KEY"

# The default of keys whose environment variable hides the argument
# even when it is blank; null means no value.
BLANK_HIDES_ARGUMENT = [
    ("artifacts", "repo_type", "dataset"),
    ("artifacts", "revision", None),
]

LAYERS = {"default": 0, "base": 1, "overlay": 2, "argument": 3, "environment": 4}

# Keys for which the argument beats the environment.
ARGUMENT_FIRST = {("artifacts", "repo_id")}


def environment_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENVIRONMENT_KEYS, "env_name string, section string, key string")


def fixed_overlay(output_root: str, release_root: str, data_root: str) -> list[tuple[str, str, str]]:
    """The (section, key, value) rows every runtime configuration gets."""
    out = output_root.rstrip("/")
    feedback = f"{out}/feedback"
    # Section, key and value of the runtime overlay.
    return [
        ("release", "enabled", "true"),
        ("release", "root_dir", release_root),
        ("output", "out_dir", out),
        ("serving", "active_release_policy", "champion"),
        ("serving", "strict_model_loading", "true"),
        ("serving", "log_file", f"{out}/service.log"),
        ("feedback", "inference_log_file", f"{feedback}/inference_events.jsonl"),
        ("feedback", "feedback_log_file", f"{feedback}/user_feedback.jsonl"),
        ("feedback", "training_sample_file", f"{feedback}/training_samples.jsonl"),
        ("feedback", "training_sample_csv", f"{feedback}/training_samples.csv"),
        ("feedback", "training_summary_file", f"{feedback}/training_summary.json"),
        ("feedback", "competition_overview_file", f"{feedback}/competition_overview.json"),
        ("auth", "users_file", f"{data_root.rstrip('/')}/system/users.json"),
    ]


def layer_priority(
    section: Column, key: Column, layer: Column, argument_first: Sequence[tuple[str, str]] = tuple(ARGUMENT_FIRST)
) -> Column:
    """Rank of a layer for a key; unknown layers rank lowest."""
    ranks = F.create_map(*[F.lit(x) for item in LAYERS.items() for x in item])
    rank = F.coalesce(ranks[layer], F.lit(-1))
    swapped = F.lit(False)
    for s, k in argument_first:
        swapped = swapped | ((section == s) & (key == k))
    top = LAYERS["environment"] + 1
    return F.when(swapped & (layer == "argument"), F.lit(top)).otherwise(rank)


def resolve(settings: DataFrame, sequence: str | None = None) -> DataFrame:
    """One value per (entity, section, key): highest layer, then latest `sequence`.

    Combines before the shuffle, so one entity may own any share of the rows.
    """
    order = [layer_priority(F.col("section"), F.col("key"), F.col("layer")).alias("rank")]
    if sequence:
        order.append(F.col(sequence).alias("seq"))
    best = F.max(F.struct(*order, F.col("value").alias("value"), F.col("layer").alias("layer")))
    return (
        settings.groupBy("entity", "section", "key")
        .agg(best.alias("best"))
        .select("entity", "section", "key", F.col("best.layer").alias("layer"), F.col("best.value").alias("value"))
    )


def environment_layer(environment: DataFrame) -> DataFrame:
    """Mapped, non-blank environment values as a settings layer; values stay texts.

    A blank counts only for the keys of BLANK_HIDES_ARGUMENT, as their default.
    `environment` has (entity, env_name, value) and may carry further columns.
    """
    mapping = F.broadcast(environment_mapping(environment.sparkSession))
    extra = [c for c in environment.columns if c not in ("entity", "env_name", "value")]
    value = blank_to_null(F.col("value"))
    flagged = F.when(F.col("key") == "enabled", parse_flag(value).cast("string")).otherwise(value)
    hides = F.lit(False)
    for section, key, default in BLANK_HIDES_ARGUMENT:
        here = (F.col("section") == section) & (F.col("key") == key)
        hides = hides | here
        flagged = F.when(here & value.isNull(), F.lit(default)).otherwise(flagged)
    return (
        environment.join(mapping, "env_name")
        .filter(value.isNotNull() | hides)
        .select("entity", "section", "key", F.lit("environment").alias("layer"), flagged.alias("value"), *extra)
    )


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Set every incoming (entity, key, value); keys not named stay as they are.

    Incoming rows carry `seq`; the last write of a key wins.
    """
    rows = current.select("entity", "key", "value", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("seq"))
    rows = rows.unionByName(
        incoming.select("entity", "key", "value", F.lit(1).alias("level"), F.col("seq").cast("bigint").alias("seq"))
    )
    return (
        rows.groupBy("entity", "key")
        .agg(F.max(F.struct("level", "seq", "value")).alias("best"))
        .select("entity", "key", F.col("best.value").alias("value"), (F.col("best.level") == 1).alias("was_set"))
    )


def enable_gate(resolved: DataFrame, environment: DataFrame, section: str = "llm") -> DataFrame:
    """Per entity of either table: enabled only when switched on and a key can be found.

    A key given straight through the environment takes the place of the
    configured one. Otherwise the configured key counts, or the variable that
    `api_key_env` names.
    """
    value_of: Mapping[str, Column] = {
        key: F.max(F.when(F.col("key") == key, F.col("value")))
        for key in ("enabled", "api_key", "api_key_env")
    }
    entities = resolved.select("entity").unionByName(environment.select("entity")).distinct()
    settled = (
        resolved.filter((F.col("section") == section) & F.col("key").isin(*value_of))
        .groupBy("entity")
        .agg(*[column.alias(key) for key, column in value_of.items()])
    )
    configured = entities.join(settled, "entity", "left")
    held = environment.filter(blank_to_null(F.col("value")).isNotNull()).select("entity", "env_name").distinct()
    direct = held.filter(F.col("env_name") == DIRECT_KEY_ENV).select("entity", F.lit(True).alias("direct"))
    named = (
        configured.join(direct, "entity", "left")
        .withColumn("direct", F.coalesce("direct", F.lit(False)))
        .withColumn(
            "env_name",
            F.when(F.col("direct"), F.lit(DIRECT_KEY_ENV)).otherwise(
                first_nonblank(F.col("api_key_env"), F.lit(DEFAULT_KEY_ENV))
            ),
        )
    )
    found = held.withColumn("env_key", F.lit(True))
    has_direct_key = ~F.col("direct") & (clean(F.col("api_key")) != "")
    return named.join(found, ["entity", "env_name"], "left").select(
        "entity",
        F.col("env_name").alias("key_source"),
        "direct",
        (parse_flag(F.col("enabled")) & (has_direct_key | F.coalesce("env_key", F.lit(False)))).alias("enabled"),
    )


def gate_layer(resolved: DataFrame, environment: DataFrame, section: str = "llm") -> DataFrame:
    """The settings that the gate sets for every entity, over all layers: (entity, section, key, value).

    `enabled` is always written. A key given straight through the environment empties
    `api_key` and names its variable in `api_key_env`.
    """
    row = lambda key, value: F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), value.alias("value"))
    gate = enable_gate(resolved, environment, section)
    always = F.array(row("enabled", F.col("enabled").cast("string")))
    direct = F.array(row("api_key", F.lit("")), row("api_key_env", F.lit(DIRECT_KEY_ENV)))
    return gate.select("entity", F.inline(F.when(F.col("direct"), F.concat(always, direct)).otherwise(always)))
