"""Comparison of two file trees by folder digests, so that equal subtrees are never opened.

A folder's digest is a sum over its entries of a hash of name and digest, kept twice with
different seeds. Sums merge, so a folder with any number of entries is added up where its
rows lie, level by level from the deepest folder to the root. Two trees are then compared
from the root down: only folders whose digests differ are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import persist_reliably

_LIMB = "decimal(20,0)"


def _parent(path: Column) -> Column:
    """The folder of an entry; the root is the empty path."""
    cut = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.when(F.contains(path, F.lit("/")), F.substring(path, F.lit(1), cut)).otherwise("")


def _added(part: Column) -> Column:
    """Sum of unsigned 64-bit hashes, modulo 2**64."""
    whole = F.lit(str(1 << 64)).cast(_LIMB)
    unsigned = part.cast(_LIMB) + F.when(part < 0, whole).otherwise(F.lit("0").cast(_LIMB))
    return (F.sum(unsigned) % whole).cast("string")


def tree_nodes(listing: DataFrame) -> DataFrame:
    """(path, parent, folder, digest) of every file and folder of a listing (rel_path, sha256).

    One row per path; the root has the empty path and no parent, and is missing only from
    an empty listing.
    """
    files = listing.select(F.col("rel_path").alias("path"), _parent(F.col("rel_path")).alias("parent"), F.lit(False).alias("folder"), F.col("sha256").alias("digest"))
    depth = lambda path: F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    files = persist_reliably(files.withColumn("depth", depth(F.col("path"))))
    deepest = files.agg(F.max("depth").alias("d")).first().d
    nodes, below = files.drop("depth"), None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        entries = files.filter(F.col("depth") == level).drop("depth")
        entries = entries if below is None else entries.unionByName(below)
        one, two = (F.xxhash64(F.lit(seed), "path", "folder", "digest") for seed in (0, 1))
        folders = entries.groupBy(F.col("parent").alias("path")).agg(F.concat_ws(":", F.count(F.lit(1)), _added(one), _added(two)).alias("digest"))
        parent = F.when(F.col("path") != "", _parent(F.col("path")))
        below = persist_reliably(folders.select("path", parent.alias("parent"), F.lit(True).alias("folder"), "digest"))
        nodes = nodes.unionByName(below)
    return nodes


def compare_trees(source: DataFrame, target: DataFrame) -> tuple[DataFrame, int]:
    """What turns `target` into `source`, both as `tree_nodes`: (path, action), and how many folders were opened.

    Actions are upload, update and delete; a path that is a file on one side and a folder
    on the other is deleted and uploaded anew. Files below folders of equal digest are
    kept and not listed.
    """
    spark = source.sparkSession
    sides = [persist_reliably(t.select("path", "parent", "folder", "digest")) for t in (source, target)]
    roots = [t.filter("path = ''").select(F.col("digest").alias(f"{n}_digest")) for n, t in zip("st", sides)]
    first = [r.first() for r in roots]
    plan = spark.createDataFrame([], "path string, action string")
    opened = 0
    if first[0] == first[1] or (first[0] is not None and first[1] is not None and first[0][0] == first[1][0]):
        return plan, opened
    pending = spark.createDataFrame([("",)], "parent string")
    while (count := pending.count()) > 0:
        opened += count
        s, t = (side.join(pending, "parent", "left_semi").select("path", F.col("folder").alias(f"{n}_folder"), F.col("digest").alias(f"{n}_digest")) for n, side in zip("st", sides))
        met = s.join(t, "path", "full_outer").filter(~F.col("s_digest").eqNullSafe(F.col("t_digest")) | ~F.col("s_folder").eqNullSafe(F.col("t_folder")))
        met = persist_reliably(met)
        s_file, t_file = F.col("s_folder") == F.lit(False), F.col("t_folder") == F.lit(False)
        actions = F.array_compact(
            F.array(
                F.when(s_file & t_file, "update"),
                F.when(t_file & ~F.coalesce(s_file, F.lit(False)), "delete"),
                F.when(s_file & ~F.coalesce(t_file, F.lit(False)), "upload"),
            )
        )
        plan = plan.unionByName(met.select("path", F.explode(actions).alias("action")))
        pending = persist_reliably(met.filter("s_folder or t_folder").select(F.col("path").alias("parent")))
    return plan, opened


def flat_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """The same plan from two listings (rel_path, sha256), by comparing every file."""
    s = source.select(F.col("rel_path").alias("path"), F.col("sha256").alias("s"))
    t = target.select(F.col("rel_path").alias("path"), F.col("sha256").alias("t"))
    action = F.when(F.col("t").isNull(), "upload").when(F.col("s").isNull(), "delete").when(F.col("s") != F.col("t"), "update")
    return s.join(t, "path", "full_outer").select("path", action.alias("action")).filter("action is not null")
