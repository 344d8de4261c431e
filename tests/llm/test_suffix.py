import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from furrow.llm import suffix_dedup
from furrow.llm.suffix_dedup import difference_cover, remove_repeats
from tests.llm.cases import SCHEMA, document_rows


def brute(rows, length):
    first = {}
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for doc, raw in texts:
        if doc is not None:
            for i in range(len(raw) - length + 1):
                s = raw[i : i + length]
                first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if doc is not None and first[raw[i : i + length]] < doc:
                gone[i : i + length] = b"\x01" * length
        runs = len([x for x in bytes(gone).split(b"\x00") if x])
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(left).hexdigest(), left))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,block", [(1, 1_000_000), (2, 200)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK_STRINGS", block)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 30_000)
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 40_000)
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 3_000)
    rows = document_rows(seed)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=repr) == brute(rows, 50)


def phrase_rows(n=400):
    """Texts of different letters around one phrase whose hash is small, so that it is the anchor there."""
    rng = random.Random(5)
    letters = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    tries = "".join(letters(14) for _ in range(4000)).encode()
    at = int(np.argmin(suffix_dedup._anchors(np.frombuffer(tries, np.uint8), 50)[1]))
    phrase = tries[at : at + 14].decode()
    rows = [(i, letters(60) + phrase + letters(60)) for i in range(n)]
    return rows + [(n + i, letters(9) + rows[i][1][20 + i : 100 + i] + letters(9)) for i in range(20)]


def test_strings_of_a_frequent_anchor_are_dealt_apart(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_STRINGS", 2_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 3_000)
    monkeypatch.setattr(suffix_dedup, "SPLIT_CHUNKS", 70)
    held = Counter()
    rows = phrase_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hot = suffix_dedup.hot_anchors(frame.selectExpr("doc_id", "text", "0L row"), 50, 1)
    assert len(hot) == 1
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "row": [0] * len(rows), "text": [r[1] for r in rows]})
    for out in suffix_dedup._dealer(50, 19, 19, hot)([batch]):
        for bucket, blob in zip(out["bucket"].to_pylist(), out["chunks"].to_pylist()):
            if blob is not None:
                columns, _ = suffix_dedup._read(blob)
                held[bucket] += int((columns["size"].astype(int) - 49)[columns["hash"] == hot[0]].sum())
    assert max(held.values()) < 0.1 * sum(held.values())
    got = remove_repeats(frame).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=repr) == brute(rows, 50)
    assert sum(r.n_removed for r in got) >= 20 * 80


@pytest.mark.parametrize("length", [50, 57, 64, 78])
def test_strings_that_differ_late_are_told_apart(length):
    rng = random.Random(3)
    start = bytes(rng.choice(b"abcdefgh") for _ in range(length))
    # One anchor and place for all, so that only the last bytes tell them apart; each content comes several times between others.
    ends = [bytes([97 + i % 5] * 6) for i in range(60)]
    rng.shuffle(ends)
    texts = [start[:-6] + e for e in ends]
    n, data = len(texts), np.frombuffer(b"".join(texts), np.uint8)
    columns = {"before": np.full(n, 3, np.uint8), "size": np.full(n, length, np.uint8), "place": np.array([rng.randrange(99) for _ in texts], np.int32)}
    numbers = suffix_dedup.Suffixes(columns, data, np.zeros(n, np.int64), length).classes()
    assert len(set(zip(numbers.tolist(), texts))) == len(set(numbers.tolist())) == 5


def test_bucket_numbers_of_groups_stay_apart():
    columns = {"before": np.array([64, 0], np.uint8), "size": np.array([78, 78], np.uint8), "place": np.zeros(2, np.int32)}
    found = suffix_dedup.Suffixes(columns, np.zeros(156, np.uint8), np.array([0, 1]), 78)
    assert len(set(found.bucket.tolist())) == 2


@pytest.mark.parametrize("length", [14, 78])
def test_shortest_and_longest_strings(spark, length):
    rows = document_rows(4)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), length).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=repr) == brute(rows, length)


def test_cover_and_empty_table(spark):
    for period in (8, 16, 31):
        cover = difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_strings_of_one_document_are_not_sorted(spark, monkeypatch):
    rows = phrase_rows(300)
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "row": [0] * len(rows), "text": [r[1] for r in rows]})
    dealt = pa.Table.from_batches(suffix_dedup._dealer(50, 1, 1, np.zeros(0, np.uint64))([batch]))
    held, classes = [], suffix_dedup.Suffixes.classes

    def watched(self):
        held.append(len(self.at))
        return classes(self)

    monkeypatch.setattr(suffix_dedup.Suffixes, "classes", watched)
    found = suffix_dedup._sorter(50, 1)((0,), dealt)
    # The phrase anchors 37 strings of every document; 20 pairs of documents share 20 of them or more.
    assert 2 * 20 * 20 <= sum(held) < 0.3 * 37 * len(rows)
    assert len(found)


def test_chunks_come_back_as_they_were_written():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, 300).astype(np.uint8)) for _ in range(30)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.arange(31) * 300
    columns, bytes_ = suffix_dedup._chunks(rng.integers(0, 1 << 60, 30), rng.integers(-(1 << 62), 1 << 62, 30), np.arange(30), data, offsets, 50)
    back, back_bytes = suffix_dedup._read(suffix_dedup._write(columns, bytes_))
    assert all(np.array_equal(columns[n], back[n]) and columns[n].dtype == back[n].dtype for n in columns) and np.array_equal(bytes_, back_bytes)
