"""Known names within a small edit distance of unknown ones, by segments that must survive the edits.

A name within `distance` edits of a known one holds at least one of distance + 1 segments
of the known name unchanged, moved by no more than the edits can move it. Known names are
indexed by their segments, unknown ones are looked up by the few places where a segment
can stand, and only names that meet there are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import broadcast_if_small

DISTANCE = 2


def _segment(length: Column, number: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of a segment of a name of some length; segments differ by one character at most."""
    start = F.floor(length * number / parts)
    return start, F.floor(length * (number + 1) / parts) - start


def segments(names: DataFrame, distance: int) -> DataFrame:
    """(name, length, number, segment) of known names: one row per segment."""
    length = F.char_length("name")
    numbered = names.select("name", length.alias("length"), F.explode(F.sequence(F.lit(0), F.lit(distance))).alias("number"))
    start, size = _segment(F.col("length"), F.col("number"), distance + 1)
    return numbered.select("name", "length", "number", F.substring(F.col("name"), (start + 1).cast("int"), size.cast("int")).alias("segment"))


def lookups(names: DataFrame, distance: int) -> DataFrame:
    """(query, length, number, segment): the places of an unknown name where a known one's segment can stand.

    (2 * distance + 1) lengths, distance + 1 segments, 2 * distance + 1 shifts: a number
    that does not depend on the name.
    """
    shifts = F.sequence(F.lit(-distance), F.lit(distance))
    rows = names.select(F.col("name").alias("query"), F.explode(F.transform(shifts, lambda d: F.char_length("name") + d)).alias("length")).filter("length >= 0")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(distance))).alias("number"))
    start, size = _segment(F.col("length"), F.col("number"), distance + 1)
    rows = rows.select("*", start.alias("start"), size.cast("int").alias("size"))
    rows = rows.select("*", F.explode(F.transform(shifts, lambda d: F.col("start") + d)).alias("place"))
    inside = (F.col("place") >= 0) & (F.col("place") + F.col("size") <= F.char_length("query"))
    found = rows.filter(inside).select("query", "length", "number", F.substring(F.col("query"), (F.col("place") + 1).cast("int"), F.col("size")).alias("segment"))
    return found.distinct()


def nearest_names(unknown: DataFrame, known: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(name, candidate, distance) for every pair of names within `distance` edits.

    Both tables have a column `name`; repeats count once and nulls match nothing. An edit
    puts in, takes out or changes one character. Names that meet in several segments are
    compared once.
    """
    if distance < 0:
        raise ValueError("a distance is not negative")
    distinct = lambda names: names.select(F.col("name").cast("string").alias("name")).filter("name is not null").distinct()
    index = broadcast_if_small(segments(distinct(known), distance))
    met = lookups(distinct(unknown), distance).join(index, ["length", "number", "segment"]).select("query", F.col("name").alias("candidate"))
    near = met.distinct().withColumn("distance", F.levenshtein("query", "candidate", distance))
    return near.filter("distance >= 0").select(F.col("query").alias("name"), "candidate", "distance")
