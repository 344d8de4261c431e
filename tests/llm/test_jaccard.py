import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from furrow.llm.components import components
from furrow.llm.jaccard_join import _differing, _sketch, choose_boundary, jaccard_components, keep_one
from tests.llm.cases import SCHEMA, document_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, percent, size):
    """(doc_id, n, component) of each row by comparing all sets."""
    sets = [shingle_set(r[1], size) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(x), (min(least[find(i)]) if least[find(i)] else None) if x else r[0]) for i, (r, x) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("percent,size,seed", [(90, 3, 1), (70, 2, 2)])
def test_components_equal_brute_force(spark, percent, size, seed):
    rows = document_rows(seed, groups=14, copies=8)
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4), percent, size).collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows, percent, size))


def test_one_document_of_each_group_stays(spark):
    rows = [r for r in document_rows(5, groups=4) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    again = [r for r in rows if (r[1] or "").split()][:2]
    kept = keep_one(spark.createDataFrame(rows + again, SCHEMA), 80, 5)
    want = {c for d, n, c in brute(rows, 80, 5)}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]


def test_empty_tables_and_boundary(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard_components(empty).count() == 0
    assert keep_one(empty).count() == 0
    assert choose_boundary({}, 1.0, 90) == 1
    assert choose_boundary({5: 100, 29: 100}, 2.0, 90) < 29
    links = spark.createDataFrame([(5, 4), (4, 9), (7, 7), (None, 3), (20, 21), (21, 22), (22, 23)], "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(4, 4), (5, 4), (9, 4), (20, 20), (21, 20), (22, 20), (23, 20)}


def test_sketches_tell_long_sets_apart_and_never_part_linked_ones():
    rng = np.random.default_rng(4)

    def differing(x, y):
        return _differing(*(np.frombuffer(_sketch(np.unique(s)), "<u8") for s in (x, y)))

    for n in (1, 40, 600, 5000, 20000):
        x, other = rng.integers(0, 1 << 63, (2, n), np.uint64)
        for gone in (0, n // 20, n // 5):
            # A subset, so that widths may differ.
            assert differing(x, x[gone:]) <= gone
            y = np.concatenate([x[gone:], other[:gone]])
            assert differing(x, y) <= 2 * gone
        if n >= 40:
            # Above what a similarity of 0.8 leaves, however long the sets are; 512 bits could not show that.
            assert 180 * differing(x, other) > 20 * 2 * n
