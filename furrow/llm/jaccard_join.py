"""Jaccard join of whole texts on word n-grams (size-aware heavy-light join).

Texts are sets of word shingles; equal sets are one node. Small sets are joined by
enumerating their fixed-size subsets: two sets link when they share a subset large
enough for both. Large sets scan inverted lists of their rarest shingles; a list's
pairs are tried against one leader at a time and only across components that are not
linked yet, so groups of near copies never turn into all pairs. The boundary between
small and large is the size at which both ways cost least on the sizes at hand.
Every candidate is decided on the full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.blocks import LOWER, mix, shingles, span_hashes, text_blocks, words
from furrow.llm.components import components
from furrow.session import BROADCAST_BYTES, broadcast_if_small, persist_reliably, release

SIZE = 3
PERCENT = 90
# Sets above this size are never enumerated.
LARGEST_ENUMERATED = 29
# Counters of the frequency sketches of words and of shingles: fixed, whatever the corpus.
COUNTERS = (1 << 23, 1 << 20)
SLICES = 64
PARTNER_ROUNDS = 2
LEADER_ROUNDS = 1
PARITY_BITS = 512
# Room of a pair of nodes in a broadcast table.
PAIR_BYTES = 56
# Cost of trying one entry of an inverted list, in enumerated subsets.
LIST_ENTRY_COST = 4
_U = np.uint64


def least_overlap(n: int, percent: int) -> int:
    """Smallest overlap that a set of n shingles needs with any set it links to."""
    return -(-percent * n // 100)


def _sets(column: pa.Array, size: int, grades: tuple[np.ndarray, ...] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of each text, and their frequency grades; texts below `size` words are one shingle."""
    for _, data, offsets in text_blocks(column):
        value, rows, listed, owner, first_word = _hashed(data, offsets, size)
        n = len(offsets) - 1
        grade = np.zeros(len(listed), np.uint8)
        if grades is not None:
            # A shingle is no more frequent than the rarest of its words.
            of_words = grades[0][_counter_of(value, 0)]
            grade = grades[1][_counter_of(listed, 1)]
            for i in range(size):
                grade = np.minimum(grade, of_words[first_word + i])
        cuts = np.searchsorted(owner, np.arange(n + 1))
        first = np.searchsorted(rows, np.arange(n + 1))
        for i in range(n):
            if cuts[i + 1] > cuts[i]:
                own, at = np.unique(listed[cuts[i] : cuts[i + 1]], return_index=True)
                yield own, grade[cuts[i] : cuts[i + 1]][at]
            elif first[i + 1] > first[i]:
                own = np.zeros(1, _U)
                for w in range(first[i], first[i + 1]):
                    own = mix(own * _U(3) + value[w : w + 1])
                yield own, np.zeros(1, np.uint8)
            else:
                yield np.zeros(0, _U), np.zeros(0, np.uint8)


def _hashed(data: np.ndarray, offsets: np.ndarray, size: int):
    """Word hashes and their rows; shingle hashes, their rows and first words."""
    data = LOWER[data]
    starts, ends, rows = words(data, offsets)
    value = span_hashes(data, starts, ends)
    return value, rows, *shingles(value, rows, size)


def _counter_of(hashes: np.ndarray, sketch: int) -> np.ndarray:
    return (hashes & _U(COUNTERS[sketch] - 1)).astype(np.int64)


def _counter(size: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(n, np.uint32) for n in COUNTERS]
        for batch in batches:
            for _, data, offsets in text_blocks(batch["text"]):
                value, _, listed, *_ = _hashed(data, offsets, size)
                for sketch, hashes in enumerate((value, listed)):
                    np.add.at(total[sketch], _counter_of(hashes, sketch), np.uint32(1))
        for sketch, counts in enumerate(total):
            for i, part in enumerate(np.split(counts, SLICES)):
                packed = zstandard.ZstdCompressor(level=1).compress(part.astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict({"sketch": pa.array([sketch], pa.int32()), "slice": pa.array([i], pa.int32()), "counts": pa.array([packed], pa.binary())})

    return count


def _add_slices(key: tuple, table: pa.Table) -> pa.Table:
    total = np.uint64(0)
    for part in table["counts"].to_pylist():
        total = total + np.frombuffer(zstandard.ZstdDecompressor().decompress(part), "<u4").astype(np.uint64)
    grade = np.ceil(np.log2(total.astype(float) + 1)).astype(np.uint8)
    return pa.table({"sketch": pa.array([key[0].as_py()], pa.int32()), "slice": pa.array([key[1].as_py()], pa.int32()), "grade": pa.array([grade.tobytes()], pa.binary())})


def frequency_grades(docs: DataFrame, size: int) -> tuple[np.ndarray, ...]:
    """Binary logarithms of how often words and shingles of each counter occur, over all texts.

    Counters are shared, so a grade can only be too high. Grades order the shingles of a
    set, so that inverted lists are short, and decide nothing else.
    """
    counts = docs.select("text").mapInArrow(_counter(size), "sketch int, slice int, counts binary")
    grades = counts.groupBy("sketch", "slice").applyInArrow(_add_slices, "sketch int, slice int, grade binary")
    # Two times SLICES rows of fixed size.
    rows = sorted(grades.collect())
    found = [[np.frombuffer(r.grade, np.uint8) for r in rows if r.sketch == sketch] for sketch in range(len(COUNTERS))]
    return tuple(np.concatenate(f) if f else np.zeros(n, np.uint8) for f, n in zip(found, COUNTERS))


def _parity(own: np.ndarray) -> np.ndarray:
    """Bit per hash residue, set where an odd number of shingles fall: differing bits bound the difference from below."""
    odd = np.bincount((own >> _U(32)).astype(np.int64) & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketch(own: np.ndarray) -> bytes:
    """Parity bits in a width that follows the set, at least one for each shingle, so that they tell long sets apart too."""
    width = max(PARITY_BITS, 1 << (len(own) - 1).bit_length()) if len(own) else PARITY_BITS
    odd = np.bincount((own >> _U(32)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _differing(x: np.ndarray, y: np.ndarray) -> int:
    """Differing bits of two sketches (as words of 64 bits) in the width of the smaller one: a bit of a half is the sum of both halves'."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _set_key(own: np.ndarray) -> int:
    mixed = mix(own)
    both = np.array([np.bitwise_xor.reduce(mixed), mixed.sum(dtype=_U)])
    return int(mix(both[:1] + mix(both[1:] + np.array([len(own)], _U))).view(np.int64)[0])


def _profiler(size: int, percent: int, grades) -> Callable:
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            columns: dict[str, list] = {k: [] for k in ("n", "node", "prefix", "few", "parity", "sketch")}
            for own, grade in _sets(batch["text"], size, grades.value):
                n = len(own)
                order = np.lexsort((own, grade))
                keep = order[: n - least_overlap(n, percent) + 1] if n else order
                columns["n"].append(n)
                columns["node"].append(_set_key(own) if n else None)
                columns["prefix"].append(own[keep].view(np.int64))
                columns["few"].append(own.view(np.int64) if n <= LARGEST_ENUMERATED else None)
                columns["parity"].append(_parity(own))
                columns["sketch"].append(_sketch(own))
            arrays = [batch["doc_id"], pa.array(np.arange(row, row + len(batch)))] + [
                pa.array(columns[k], t)
                for k, t in (("n", pa.int64()), ("node", pa.int64()), ("prefix", pa.list_(pa.int64())), ("few", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64())), ("sketch", pa.binary()))
            ]
            row += len(batch)
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "n", "node", "prefix", "few", "parity", "sketch"])

    return profile


def _lister(size: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own for own, _ in _sets(batch["text"], size)]
            nodes = pa.array([_set_key(own) if len(own) else None for own in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], nodes, pa.array([own.astype("<u8").tobytes() for own in found], pa.binary())], ["doc_id", "node", "hashes"])

    return sets


_PROFILE = "doc_id long, row long, n long, node long, prefix array<long>, few array<long>, parity array<long>, sketch binary"


def subsets_of(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in range(least_overlap(n, percent), n + 1))


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """Size from which sets go to the inverted lists: the least total of both costs."""

    def lists(n: int) -> float:
        return (n - least_overlap(n, percent) + 1) * list_length * LIST_ENTRY_COST

    def cost(b: int) -> float:
        light = sum(c * subsets_of(n, percent) for n, c in sizes.items() if n < b)
        return light + sum(c * lists(n) for n, c in sizes.items() if n >= least_overlap(b, percent))

    return min(range(1, LARGEST_ENUMERATED + 2), key=lambda b: (cost(b), b))


def _subset_rows(percent: int) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, c, key = [], [], [], []
            for one, few in zip(batch["node"].to_pylist(), batch["few"].to_pylist()):
                own = mix(np.array(few, np.int64).view(_U))
                total = own.sum(dtype=_U)
                # A subset's key is the sum of its mixed members: the whole less what is left out.
                for left_out in range(len(own) - least_overlap(len(own), percent) + 1):
                    gone = np.array([own[list(x)].sum(dtype=_U) for x in combinations(range(len(own)), left_out)], _U)
                    keys = mix(total - gone)
                    key.append(keys.view(np.int64))
                    node += [one] * len(keys)
                    n += [len(own)] * len(keys)
                    c += [len(own) - left_out] * len(keys)
            flat = np.concatenate(key) if key else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64())], ["key", "c", "n", "node"])

    return rows


def _light_links(nodes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links among small sets. Of all sets that share a subset, the smallest links with every set that links with any."""
    rows = nodes.filter((F.col("n") > 0) & (F.col("n") < boundary)).select("node", "few").mapInArrow(_subset_rows(percent), "key long, c long, n long, node long")
    hubs = rows.groupBy("key", "c").agg(F.min(F.struct("n", "node")).alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    enough = F.lit(100) * F.col("c") >= F.lit(percent) * (F.col("n") + F.col("hub.n") - F.col("c"))
    return rows.join(hubs, ["key", "c"]).filter(enough & (F.col("node") != F.col("hub.node"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))


def _judge(percent: int) -> Callable:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["hashes_a"], batch["hashes_b"])):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(ok))

    return judge


def _sizes_fit(percent: int) -> Column:
    return F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")


def _could_link(percent: int) -> Column:
    """Whether sizes and parity bits of a and b leave a link possible."""
    sized = _sizes_fit(percent)
    differing = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    # |x ^ y| = n + m - 2 * overlap, and the overlap is at least percent / (100 + percent) of n + m.
    return sized & (F.lit(100 + percent) * differing <= F.lit(100 - percent) * (F.col("n_a") + F.col("n_b")))


def _side(nodes: DataFrame, x: str, *columns: str) -> DataFrame:
    return nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    joined = pairs.join(_side(nodes, "a", "n", "parity"), "a").join(_side(nodes, "b", "n", "parity"), "b")
    return joined.filter(_could_link(percent)).select("a", "b")


def _alike(percent: int) -> Callable:
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
            ok = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["sketch_a"], batch["sketch_b"])):
                differing = _differing(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"))
                ok[i] = (100 + percent) * differing <= (100 - percent) * total[i]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(ok))

    return alike


def _compared(pairs: DataFrame, known: DataFrame, columns: list[str], judge: Callable) -> DataFrame:
    """The stored pairs (a, b) that `judge` lets pass on these columns. Only rows of `known` that a pair names are moved."""
    few = pairs.count() * PAIR_BYTES <= BROADCAST_BYTES
    named, others = (F.broadcast(x) if few else x for x in (pairs, pairs.select("b")))
    left = _side(known, "a", *columns).join(named, "a")
    right = _side(known, "b", *columns).join(others, "b", "left_semi")
    return left.join(right, "b").mapInArrow(judge, "a long, b long")


def _resembling(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave a link possible; the others never move their full sets."""
    pairs = persist_reliably(pairs)
    found = persist_reliably(_compared(pairs, nodes, ["n", "sketch"], _alike(percent)))
    release(pairs)
    return found


def _decide(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The stored pairs (a, b) whose full sets link."""
    return _compared(pairs, sets, ["hashes"], _judge(percent))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _with_component(entries: DataFrame, parts: DataFrame) -> DataFrame:
    joined = entries.join(parts, "node", "left")
    return joined.select("token", "node", "place", F.coalesce("component", "node").alias("component"))


def _facing(known: DataFrame, apart: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Two copies of list entries with columns named for a and b."""
    columns = [c for c in ("token", "node", "place", "component", "n", "parity") if c in known.columns]
    one = known if apart is None else known.filter(apart)
    return tuple(x.select(*(F.col(c).alias(f"{c}_{name}") for c in columns)) for x, name in ((one, "a"), (known, "b")))


def _first_fits(percent: int) -> Column:
    """Whether a link is possible if the entries of a and b are their first common one: no shingle before it is shared."""
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return F.lit(100 + percent) * left >= F.lit(percent) * (F.col("n_a") + F.col("n_b"))


def _met(one: DataFrame, other: DataFrame, apart: str, percent: int, how: str) -> DataFrame:
    """Entries of one list that differ in `apart`, could link and could be their sets' first common ones."""
    same = (F.col("token_a") == F.col("token_b")) & (F.col(f"{apart}_a") != F.col(f"{apart}_b"))
    return one.join(other, same & _first_fits(percent) & _could_link(percent), how)


def _with_partner(known: DataFrame, apart: str, percent: int) -> DataFrame:
    """Entries of which their list holds a partner that differs in `apart` and could link; one is enough, so no pairs come out."""
    met = _met(*_facing(known), apart, percent, "left_semi")
    return persist_reliably(met.select(*(F.col(f"{c}_a").alias(c) for c in ("token", "node", "place"))))


def _shared_entries(sets: DataFrame, percent: int) -> DataFrame:
    """Entries (token, node, place, n) of the inverted lists with another set in their list that fits in size.

    In the order of sizes that is the one before or after, so a list is read once and
    nothing is joined.
    """
    entries = sets.select(F.posexplode("prefix").alias("place", "token"), "node", F.col("n").cast("int").alias("n"))
    by_size = Window.partitionBy("token").orderBy("n", "node")
    less, more = F.lag("n").over(by_size), F.lead("n").over(by_size)
    fits = (F.lit(100) * F.col("less") >= F.lit(percent) * F.col("n")) | (F.lit(100) * F.col("n") >= F.lit(percent) * F.col("more"))
    return entries.withColumns({"less": less, "more": more}).filter(fits).select("token", "node", "place", "n")


def _full_sets(docs: DataFrame, wanted: DataFrame, profile: DataFrame, owners: DataFrame, size: int) -> DataFrame:
    """(node, hashes) for the nodes in `wanted`, from the document with the smallest id of each."""
    keyed = wanted.join(owners.select("node", F.col("least").alias("doc_id")), "node")
    found = docs.select("doc_id", "text").mapInArrow(_lister(size), "doc_id long, node long, hashes binary")
    keys = broadcast_if_small(keyed).alias("k")
    found = found.alias("f").join(keys, (F.col("f.node") == F.col("k.node")) & F.col("f.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi").select("node", "hashes")
    repeated = profile.filter("node is not null").groupBy("node", "doc_id").count().filter("count > 1")
    return found if repeated.isEmpty() else found.dropDuplicates(["node"])


def _with_heavy_links(docs: DataFrame, profile: DataFrame, owners: DataFrame, nodes: DataFrame, boundary: int, percent: int, size: int, links: DataFrame) -> DataFrame:
    """Components of the nodes under `links` and the links of pairs with at least one large set."""
    sets = nodes.filter(F.col("n") >= least_overlap(boundary, percent))
    shared = persist_reliably(_shared_entries(sets, percent))
    # Entries with a possible partner in their list, by place and parity bits.
    entries = _with_partner(shared.join(nodes.select("node", "parity"), "node"), "node", percent)
    release(shared)
    first_entries = entries
    # Only their full sets are written and moved.
    full = persist_reliably(_full_sets(docs, entries.select("node").distinct(), profile, owners, size))
    tested = placed = None
    parts = components(links)
    for turn in range(PARTNER_ROUNDS + LEADER_ROUNDS + 1):
        every, old = persist_reliably(_with_component(entries, parts)), placed
        # What the last turn placed was read for the last time.
        release(old)
        lists = every.groupBy("token").agg(F.min(F.struct("node", "component")).alias("lead"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        placed = persist_reliably(every.join(lists.filter("lo <> hi").select("token", "lead"), "token"))
        release(every)
        apart = F.col("component") != F.col("lead.component")
        if turn < PARTNER_ROUNDS + LEADER_ROUNDS:
            # The leader of each list against all entries it is not linked with yet.
            pairs = _ordered(placed.filter(apart).select(F.col("lead.node").alias("a"), F.col("node").alias("b")))
            pairs = _possible(pairs, nodes, percent)
        else:
            # What is left: entries outside the leader's component against their whole list.
            known = placed.join(nodes.select("node", "n", "parity"), "node")
            met = _with_partner(known, "component", percent)
            one, other = _facing(known.join(met.select("token", "node"), ["token", "node"], "left_semi"), apart)
            pairs = _ordered(_met(one, other, "component", percent, "inner").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = _resembling(pairs, nodes, percent)
        if turn < PARTNER_ROUNDS:
            # First one partner for each node: that already joins most of a group of near copies.
            every, pairs = pairs, persist_reliably(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
            release(every)
        elif turn < PARTNER_ROUNDS + LEADER_ROUNDS:
            # Then all; the leader's entry is done with.
            entries = placed.filter(F.col("node") != F.col("lead.node")).select("token", "node", "place")
        links = persist_reliably(_decide(pairs, full, percent))
        if not links.isEmpty():
            # A component stands for the links that made it.
            parts, old = components(links.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b")))), parts
            release(old)
        release(links)
        if tested is None:
            tested = pairs
        else:
            tested, old = persist_reliably(tested.unionByName(pairs)), tested
            release(old, pairs)
    release(first_entries, placed, full, tested)
    return parts


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """n_shingles and component_id of every row of `docs` (doc_id, text).

    Words are runs of characters other than space and \\t..\\r, with A-Z lower-cased. A
    set holds the distinct shingles of `size` words; a shorter text is one shingle, a
    null text or one without words has the empty set and links with nothing. Sets link
    when percent/100 of their union is shared. component_id is the smallest doc_id
    reachable by links, a row's own id included; rows of one set always share it. A
    null doc_id joins its set's component and never names one (a component without ids
    has a null component_id). Rows with equal ids and different texts are judged one
    by one. Other columns are left aside; an empty table gives no rows.

    Sets are compared through 64-bit hashes of their shingles. Nothing but a frequency
    sketch of fixed size and counts per small set size reaches the driver.
    """
    return _components_of(docs, percent, size)[0]


def _components_of(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result of `jaccard_components`, and the tables it reads, which go when it has been written."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grades = spark.sparkContext.broadcast(frequency_grades(docs, size))
    profile = persist_reliably(docs.mapInArrow(_profiler(size, percent, grades), _PROFILE))
    # One profile for each distinct set.
    owners = profile.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"))
    owners = persist_reliably(owners)
    nodes = persist_reliably(profile.join(owners.select("row"), "row", "left_semi").select("node", "n", "prefix", "few", "parity", "sketch"))
    small = nodes.filter(F.col("n") <= LARGEST_ENUMERATED).groupBy("n").count().collect()
    lengths = nodes.select(F.explode("prefix").alias("token")).agg((F.count(F.lit(1)) / F.greatest(F.approx_count_distinct("token"), F.lit(1))).alias("mean")).first().mean
    boundary = choose_boundary({r["n"]: r["count"] for r in small}, float(lengths or 1.0), percent)
    light = persist_reliably(_light_links(nodes, boundary, percent).distinct())
    parts = _with_heavy_links(docs, profile, owners, nodes, boundary, percent, size, light)
    release(light, nodes)
    placed = owners.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "least")
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "component").select("node", "component_id")
    found = profile.select("doc_id", F.col("n").alias("n_shingles"), "node").join(classes, "node", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id")), [profile, owners, parts]


def keep_one(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """`docs` with one document of each group of linked ones: that with the smallest id.

    Texts without words and rows without an id stay. An id goes when none of its rows
    names its component; repeated rows of a kept id (same id and text) leave one.
    """
    every, tables = _components_of(docs, percent, size)
    found = persist_reliably(every.filter("doc_id is not null and n_shingles > 0"))
    release(*tables)
    ids = found.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("names"), F.count(F.lit(1)).alias("times"))
    ids = persist_reliably(ids.filter("not names or times > 1"))
    release(found)
    gone = broadcast_if_small(ids.filter("not names").select("doc_id"))
    repeated = broadcast_if_small(ids.filter("names").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    if ids.filter("names").isEmpty():
        return once
    return once.unionByName(kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
