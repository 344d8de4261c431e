"""Weighted scores, top-k ranking, precomputed lookups and environment matching."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions import exact
from furrow.functions.keys import join_with_nulls
from furrow.session import BROADCAST_BYTES, broadcast_if_small, measure, persist_reliably

# Pairs of request and profile that one task keeps at a time.
PAIRS_PER_TASK = 1 << 22


def weights_of(table: DataFrame) -> dict[str, float]:
    """A (criterion, weight) table as a mapping: one entry per criterion column."""
    return {row.criterion: row.weight for row in table.select("criterion", "weight").collect()}


def weighted_score(
    candidates: DataFrame, weights: Mapping[str, float], within: Sequence[str], out: str = "score"
) -> DataFrame:
    """Sum of weight x min-max normalised criterion inside each group.

    A negative weight marks a criterion where less is better: it is turned
    round before weighting. Extremes come from a partial aggregate, not from a
    window, so a group may hold any share of the rows.
    """
    spans = candidates.groupBy(*within).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in weights], *[F.max(c).alias(f"_hi_{c}") for c in weights]
    )
    joined = join_with_nulls(candidates, broadcast_if_small(spans), within)
    total = None
    for criterion, weight in weights.items():
        low, high = F.col(f"_lo_{criterion}"), F.col(f"_hi_{criterion}")
        share = F.coalesce(F.try_divide(F.col(criterion) - low, high - low), F.lit(0.0))
        part = F.lit(abs(float(weight))) * (share if weight >= 0 else F.lit(1.0) - share)
        total = part if total is None else total + part
    return joined.withColumn(out, total).drop(*[f"_{e}_{c}" for c in weights for e in ("lo", "hi")])


def top_k(scored: DataFrame, within: Sequence[str], k: int, score: str = "score", tie: str = "crop_id") -> DataFrame:
    """The k best rows of each group, ties by key.

    Spark cuts every input partition to k rows per group before the shuffle.
    """
    order = Window.partitionBy(*within).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def lookup_with_default(
    requests: DataFrame, precomputed: DataFrame, key: Sequence[str], default_key: Sequence[str], value: str
) -> DataFrame:
    """Answer requests from a precomputed table, else with the group's best entry."""
    precomputed = persist_reliably(precomputed)
    exact_hit = precomputed.select(*key, F.col(value).alias("_hit"))
    default = precomputed.groupBy(*default_key).agg(F.max(value).alias("_default"))
    return (
        requests.join(broadcast_if_small(exact_hit), list(key), "left")
        .join(broadcast_if_small(default), list(default_key), "left")
        .withColumn(value, F.coalesce("_hit", "_default"))
        .withColumn(
            "origin",
            F.when(F.col("_hit").isNotNull(), "exact").when(F.col("_default").isNotNull(), "default").otherwise("none"),
        )
        .drop("_hit", "_default")
    )


def suitable(requests: DataFrame, profiles: DataFrame, factors: Sequence[str], width: float) -> DataFrame:
    """(request, crop) pairs where every factor lies within the crop's range.

    Profiles have `<factor>_lo` and `<factor>_hi`. The first factor is cut into
    steps of `width`; a profile joins by equality on the steps it covers, and
    the other factors are checked on those candidates only.
    """
    lead = factors[0]
    step = lambda c: F.floor(F.col(c) / F.lit(width))
    covered = profiles.withColumn("_step", F.explode(F.sequence(step(f"{lead}_lo"), step(f"{lead}_hi"))))
    inside = None
    for factor in factors:
        check = F.col(factor).between(F.col(f"{factor}_lo"), F.col(f"{factor}_hi"))
        inside = check if inside is None else inside & check
    return (
        requests.withColumn("_step", step(lead))
        .join(broadcast_if_small(covered), "_step")
        .filter(inside)
        .drop("_step")
    )


def profile_matches(
    requests: DataFrame, factors: Sequence[str], request: str, profile: str, match: Callable[[DataFrame], DataFrame], *facts: Column
) -> DataFrame:
    """Per profile: n_requests, the distinct requests as n_places, and `facts` over its matches.

    `match` gives the rows of a frame of factors with every profile that fits. Only the
    distinct values of the factors go through it. Requests take the profiles of their
    values and are dealt out by their number, into so many tasks that none keeps more
    than about `PAIRS_PER_TASK` pairs, so a task's memory does not grow with the input.
    """
    points = persist_reliably(requests.dropna(subset=list(factors)).groupBy(*factors).agg(F.count(F.lit(1)).alias("times")))
    pairs = persist_reliably(match(points).select(profile, *factors, "times"))
    found = persist_reliably(pairs.groupBy(profile).agg(F.sum("times").alias("n_requests"), *facts).withColumn("_no", F.monotonically_increasing_id()))
    names = broadcast_if_small(found.select(profile, "_no"))
    spots, known = measure(pairs.join(names, profile).groupBy(*factors).agg(F.collect_set("_no").alias("_profiles")))
    total = found.agg(F.coalesce(F.sum("n_requests"), F.lit(0)).alias("n")).first().n
    tasks = max(requests.sparkSession.sparkContext.defaultParallelism, -(-int(total) // PAIRS_PER_TASK))
    rows = requests.select(request, *factors).dropna(subset=list(factors))
    # Lists of profiles are long beside a request, so they join it after the shuffle if they can.
    if known.size <= BROADCAST_BYTES:
        dealt = rows.repartition(tasks, request).join(F.broadcast(spots), list(factors))
    else:
        dealt = rows.join(spots, list(factors)).select(request, "_profiles").repartition(tasks, request)
    places = dealt.select(request, F.explode("_profiles").alias("_no")).distinct().groupBy("_no").agg(F.count(request).alias("n_places"))
    joined = found.join(places, "_no", "left").withColumn("n_places", F.coalesce("n_places", F.lit(0).cast("bigint")))
    return joined.drop("_no")


def centroids(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key, added up position by position before the shuffle."""
    return (
        vectors.select(key, F.posexplode(vector).alias("pos", "x"))
        .groupBy(key, "pos")
        .agg(exact.ratio(F.sum(exact.decimal(F.col("x").cast("double"), 12, 28)), F.count("x")).alias("mean"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("cells"))
        .select(key, F.transform("cells", lambda c: c["mean"]).alias("centroid"))
    )


def closeness(catalogue: Column, vector: Column) -> Column:
    """Sorted (negated cosine, key) of one packed catalogue slice against a vector."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = lambda p: F.try_divide(dot(vector, p["v"]), norm(vector) * p["size"])
    return F.transform(
        catalogue, lambda p: F.struct((-F.round(cosine(p), 9)).alias("neg"), p["key"].alias("key"))
    )


def cosine_top_k(
    requests: DataFrame,
    profiles: DataFrame,
    vector: str,
    profile_key: str,
    k: int,
    slice_bytes: int = 16 * 1024 * 1024,
    slices_per_stage: int = 4,
) -> DataFrame:
    """The k profiles closest by cosine, per request: adds rank, the profile key and similarity.

    Profiles are one vector per crop. They are measured and cut into slices of
    bounded size; each slice is broadcast as one packed row and ranked inside
    the request's row, where the best k so far are kept. Requests never move and
    no pair becomes a row. Lineage is cut before a stage holds too many slices.
    """
    catalogue, known = measure(profiles.select(profile_key, "centroid"))
    count = max(1, -(-int(known.size) // slice_bytes))
    norm = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
    packed = (
        catalogue.select(
            F.pmod(F.xxhash64(profile_key), F.lit(count)).alias("slice"),
            F.struct(F.col(profile_key).alias("key"), F.col("centroid").alias("v"), norm.alias("size")).alias("p"),
        )
        .groupBy("slice")
        .agg(F.collect_list("p").alias("packed"))
    )
    key_type = profiles.schema[profile_key].dataType.simpleString()
    rows = requests.withColumn("_v", F.transform(vector, lambda x: x.cast("double"))).withColumn(
        "_best", F.array().cast(f"array<struct<neg:double,key:{key_type}>>")
    )
    for number in range(count):
        one = F.broadcast(packed.filter(F.col("slice") == number))
        # A request without a vector looks at no slice and gets no match.
        rows = rows.withColumn("_slice", F.when(F.col("_v").isNotNull(), F.lit(number).cast("bigint")))
        near = closeness(F.coalesce("packed", F.array()), F.col("_v"))
        rows = (
            rows.join(one, F.col("_slice") == F.col("slice"), "left")
            .withColumn("_best", F.slice(F.array_sort(F.concat("_best", near)), 1, k))
            .drop("slice", "packed", "_slice")
        )
        if (number + 1) % slices_per_stage == 0 and number + 1 < count:
            rows = persist_reliably(rows)
    kept = [c for c in requests.columns if c != vector]
    return rows.select(*kept, F.posexplode("_best").alias("pos", "hit")).select(
        *kept,
        (F.col("pos") + 1).alias("rank"),
        F.col("hit.key").alias(profile_key),
        (-F.col("hit.neg")).alias("similarity"),
    )
