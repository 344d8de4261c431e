"""Repeated passages by blockwise suffix sorting with a difference cover.

A byte goes when some string of LENGTH bytes covers it that also starts in a document
with a smaller doc_id. Strings of equal content share their anchor - the smallest hash
among their K-byte substrings - so suffixes are dealt into buckets by anchor, each with
the few bytes around it, and suffixes of different buckets are never equal. A bucket of
suffixes is sorted on its own: by the first COVER bytes, and where these tie, by ranks
computed beforehand for the suffixes at a difference cover sample, which contains a
common offset for any two suffixes. Neighbours in sorted order that agree over LENGTH
bytes are repeats. Strings of an anchor that would fill more than a block are dealt one by
one by all their bytes instead. Memory is bounded by the bucket, not by the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.blocks import mix, ranges, span_hashes, text_blocks

LENGTH = 50
K = 14
COVER = 16
# Bytes of text for each bucket of suffixes and for each bucket of documents.
BUCKET_BYTES = 6_000_000
SEGMENT_BYTES = 400_000
FLUSH_BYTES = 20_000_000
# Strings sorted at a time, unless one bucket of suffixes holds more; an anchor with more is split.
BLOCK_STRINGS = 1_000_000
# Anchors are counted in about so many bytes of text, and in one of so many documents at least.
COUNTED_BYTES = 20_000_000
COUNTED_STEP = 64
# Chunks of hot anchors that are split at a time.
SPLIT_CHUNKS = 20_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def difference_cover(period: int) -> list[int]:
    """A small set of residues whose differences give every residue; found greedily."""
    cover = [0, 1]
    missing = set(range(period)) - {0, 1, period - 1}
    while missing:
        def gain(x: int) -> int:
            return len(missing & {d for c in cover for d in ((x - c) % period, (c - x) % period)})

        best = max((x for x in range(period) if x not in cover), key=lambda x: (gain(x), -x))
        missing -= {d for c in cover for d in ((best - c) % period, (c - best) % period)}
        cover.append(best)
    return sorted(cover)


def _k_sums(data: np.ndarray) -> np.ndarray:
    """The polynomial value of each K-byte substring, from those of half its width and so on."""
    single = data.astype(_U)
    value, width = single, 1
    for bit in bin(K)[3:]:
        value = value[:-width] * _U(pow(int(_BASE), width, 1 << 64)) + value[width:]
        width *= 2
        if bit == "1":
            value = value[:-1] * _BASE + single[width:]
            width += 1
    return value


def _anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the anchor of each string of `length` bytes, and the hash of each K-byte substring."""
    k_hash = mix(_k_sums(data))
    # High bits of the hash, then the place: among equal substrings the first counts.
    best = ((k_hash >> _U(24)) << _U(24)) | np.arange(len(k_hash), dtype=_U)
    span, width = length - K + 1, 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if span > width:
        best = np.minimum(best[: width - span], best[span - width :])
    return (best & _U((1 << 24) - 1)).astype(np.int64), k_hash


_NAMES = ("hash", "doc", "row", "place", "before", "size")
_KINDS = (np.uint64, np.int64, np.int64, np.int32, np.uint8, np.uint8)


_VIEW = np.dtype([("size", "<i4"), ("lead", "<u4"), ("buffer", "<i4"), ("start", "<i4")])
# Bytes up to which a view holds its value itself.
_INLINE = 12


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many intervals end to end, each longer than _INLINE; copied interval by interval, as views that are laid out."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.uint8)
    views = np.zeros(len(sizes), _VIEW)
    views["size"], views["start"] = sizes, starts
    held = pa.Array.from_buffers(pa.binary_view(), len(views), [None, pa.py_buffer(views), pa.py_buffer(np.ascontiguousarray(data))])
    return np.frombuffer(held.cast(pa.large_binary()).buffers()[2], np.uint8)[:total]


def _chunks(docs: np.ndarray, rows: np.ndarray, shift: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Anchors of texts standing end to end, each with its strings: the bytes from the first string's start to the last one's end.

    `shift` is the place in its document of each text's first byte.
    """
    n = len(data)
    none = {name: np.zeros(0, kind) for name, kind in zip(_NAMES, _KINDS)}
    if n < length:
        return none, data[:0]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(owner[: n - length + 1] == owner[length - 1 :])
    if not len(starts):
        return none, data[:0]
    anchor, k_hash = _anchors(data, length)
    anchor = anchor[starts]
    head = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(starts) != 1)))
    first, last, place = starts[head], starts[np.append(head[1:], len(starts)) - 1], anchor[head]
    size, text = last - first + length, owner[first]
    values = (k_hash[place], docs[text], rows[text], first - offsets[text] + shift[text], place - first, size)
    columns = {name: v.astype(kind) for name, kind, v in zip(_NAMES, _KINDS, values)}
    return columns, _gather(data, first, size)


def _contents(columns: dict[str, np.ndarray], data: np.ndarray) -> np.ndarray:
    """One number for each distinct pair of anchor place and bytes."""
    size = columns["size"].astype(np.int64)
    ends = np.cumsum(size)
    parts = []
    # In slices, so that the hashing stays small.
    for a in range(0, len(size), 20_000):
        b = min(a + 20_000, len(size))
        low = ends[a] - size[a]
        parts.append(span_hashes(data[low : ends[b - 1]], ends[a:b] - size[a:b] - low, ends[a:b] - low))
    value = np.concatenate(parts) if parts else np.zeros(0, _U)
    return mix(value + columns["before"].astype(_U) * _BASE)


def _pick(columns: dict[str, np.ndarray], data: np.ndarray, rows: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    size = columns["size"].astype(np.int64)
    first = (np.cumsum(size) - size)[rows]
    return {n: c[rows] for n, c in columns.items()}, _gather(data, first, size[rows])


def _least_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's key, and the least value of each key."""
    _, first, back = np.unique(keys, return_index=True, return_inverse=True)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, back, values)
    return back, least


def _write(columns: dict[str, np.ndarray], data: np.ndarray) -> bytes:
    # Ids and places as differences, first bytes of all numbers first; anchors' hashes come back from the bytes.
    head = np.array([len(columns["doc"])], "<i8").tobytes()
    sent = {**columns, "doc": np.diff(columns["doc"], prepend=np.int64(0)), "place": np.diff(columns["place"], prepend=np.int32(0))}
    turned = [sent[n].view(np.uint8).reshape(-1, sent[n].itemsize).T.tobytes() for n in _NAMES[1:]]
    return zstandard.ZstdCompressor(level=5).compress(head + b"".join(turned) + data.tobytes())


def _read(blob: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, columns = int(np.frombuffer(raw, "<i8", 1)[0]), 8, {}
    for name, kind in zip(_NAMES[1:], _KINDS[1:]):
        width = np.dtype(kind).itemsize
        turned = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        columns[name] = np.ascontiguousarray(turned.T).view(kind).reshape(n)
        at += n * width
    data = np.frombuffer(raw, np.uint8, offset=at)
    columns["doc"], columns["place"] = np.cumsum(columns["doc"]), np.cumsum(columns["place"], dtype=np.int32)
    size = columns["size"].astype(np.int64)
    anchor = np.cumsum(size) - size + columns["before"]
    value = np.zeros(n, np.uint64)
    for i in range(K):
        value = value * _BASE + data[anchor + i]
    columns["hash"] = mix(value)
    return columns, data


_SPAN = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _spans(doc, row, start, end) -> np.ndarray:
    out = np.zeros(len(doc), _SPAN)
    out["doc"], out["row"], out["start"], out["end"] = doc, row, start, end
    return out


def _span_blobs(spans: np.ndarray, doc_buckets: int) -> Iterator[tuple[int, bytes]]:
    """Compressed spans for each bucket of documents."""
    bucket = spans["doc"] % doc_buckets
    order = np.lexsort((spans["start"], spans["row"], spans["doc"], bucket))
    spans, bucket = spans[order], bucket[order]
    edges = np.flatnonzero(np.append(True, np.diff(bucket) != 0)) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(bucket))):
        yield int(bucket[a]), zstandard.ZstdCompressor(level=3).compress(spans[a:b].tobytes())


_ROWS = pa.schema([("bucket", pa.int32()), ("chunks", pa.binary()), ("doc_bucket", pa.int32()), ("spans", pa.binary())])
ROWS = "bucket int, chunks binary, doc_bucket int, spans binary"


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list]:
    """Chunks of the texts, gathered up to FLUSH_BYTES."""
    held, size = [], 0
    for batch in batches:
        docs, rows = (np.array(batch[c].to_numpy(zero_copy_only=False), np.int64) for c in ("doc_id", "row"))
        for first, data, offsets in text_blocks(batch["text"], SEGMENT_BYTES):
            n = len(offsets) - 1
            # A long text is cut into segments that share length - 1 bytes, so each string lies in one.
            for at in range(0, max(len(data), 1), SEGMENT_BYTES) if n == 1 else (0,):
                piece = data[at : at + SEGMENT_BYTES + length - 1] if n == 1 else data
                cuts = np.array([0, len(piece)]) if n == 1 else offsets
                found = _chunks(docs[first : first + n], rows[first : first + n], np.full(n, at), piece, cuts, length)
                held.append(found)
                size += len(found[1])
                if size >= FLUSH_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _joined(held: list) -> tuple[dict[str, np.ndarray], np.ndarray]:
    columns = {n: np.concatenate([c[n] for c, _ in held]) for n in _NAMES}
    data = np.concatenate([d for _, d in held])
    held.clear()
    return columns, data


def _without_copies(columns: dict[str, np.ndarray], data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks are not copies of a smaller document's chunk, and the spans of those that are."""
    back, least = _least_by(_contents(columns, data), columns["doc"])
    later = columns["doc"] > least[back]
    gone = {n: c[later] for n, c in columns.items()}
    return np.flatnonzero(~later), _spans(gone["doc"], gone["row"], gone["place"], gone["place"].astype(np.int64) + gone["size"])


def _counter(length: int) -> Callable:
    """Strings of each anchor, copies of a chunk counted once a flush."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _pieces(batches, length):
            columns, data = _joined(held)
            first = np.unique(_contents(columns, data), return_index=True)[1]
            anchor, back = np.unique(columns["hash"][first], return_inverse=True)
            strings = np.bincount(back, columns["size"][first].astype(np.int64) - length + 1, len(anchor)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(strings)], ["anchor", "strings"])

    return count


def hot_anchors(texts: DataFrame, length: int, total: int) -> np.ndarray:
    """Anchors that seem to have more than BLOCK_STRINGS strings, by a sample of documents; which ones decides where strings meet, not what is found."""
    step = max(1, min(COUNTED_STEP, total // COUNTED_BYTES))
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    counted = sample.mapInArrow(_counter(length), "anchor long, strings long").groupBy("anchor").agg(F.sum("strings").alias("strings"))
    return np.sort(np.array([r.anchor for r in counted.filter(F.col("strings") * step > BLOCK_STRINGS).collect()], np.int64).view(_U))


def _one_by_one(columns: dict[str, np.ndarray], data: np.ndarray, length: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The strings of some chunks as chunks of their own."""
    size = columns["size"].astype(np.int64)
    count = size - length + 1
    chunk, inner = np.repeat(np.arange(len(size)), count), ranges(count)
    split = {n: c[chunk] for n, c in columns.items()}
    split["place"] = (split["place"] + inner).astype(np.int32)
    split["before"] = (split["before"] - inner).astype(np.uint8)
    split["size"] = np.full(len(chunk), length, np.uint8)
    return split, _gather(data, (np.cumsum(size) - size)[chunk] + inner, split["size"].astype(np.int64))


def _dealer(length: int, buckets: int, doc_buckets: int, hot: np.ndarray) -> Callable:
    """Chunks of each text, per bucket of anchors; copies within a flush keep one chunk, that of the smallest document.

    Strings of hot anchors are dealt one by one, by a hash of their bytes.
    """

    def rows_of(columns: dict[str, np.ndarray], data: np.ndarray, chosen: np.ndarray, key: np.ndarray) -> list[tuple]:
        rows: list[tuple] = []
        bucket = (key % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        columns, data = _pick(columns, data, chosen[order])
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        cuts = np.concatenate([[0], np.cumsum(columns["size"], dtype=np.int64)])[edges]
        for b in np.flatnonzero(np.diff(edges)):
            part = {n: c[edges[b] : edges[b + 1]] for n, c in columns.items()}
            rows.append((int(b), _write(part, data[cuts[b] : cuts[b + 1]]), None, None))
        return rows

    def flush(held: list) -> pa.RecordBatch:
        columns, data = _joined(held)
        kept, spans = _without_copies(columns, data)
        split = np.isin(columns["hash"][kept], hot) if len(hot) else np.zeros(len(kept), bool)
        rows: list[tuple] = []
        found = [spans]
        for a in range(0, int(split.sum()), SPLIT_CHUNKS):
            single, bytes_ = _one_by_one(*_pick(columns, data, kept[split][a : a + SPLIT_CHUNKS]), length)
            alone, copies = _without_copies(single, bytes_)
            rows += rows_of(single, bytes_, alone, _contents(single, bytes_)[alone])
            found.append(copies)
        whole = kept[~split]
        rows += rows_of(columns, data, whole, columns["hash"][whole])
        spans = np.concatenate(found)
        # What is decided already passes through some bucket.
        rows += [(d % buckets, None, d, blob) for d, blob in _span_blobs(spans, doc_buckets)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS)], schema=_ROWS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _pieces(batches, length):
            yield flush(held)

    return deal


def _in_several(data: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Strings that may come in several documents: every string that does, and few others.

    Equal strings have equal hashes, so a string whose slot knows one document has no equal elsewhere.
    """
    bits = max(16, len(at).bit_length() + 2)
    slot = (span_hashes(data, at, at + length) >> _U(64 - bits)).astype(np.int64)
    least, most = np.full(1 << bits, np.iinfo(np.int64).max), np.full(1 << bits, np.iinfo(np.int64).min)
    np.minimum.at(least, slot, doc)
    np.maximum.at(most, slot, doc)
    return np.flatnonzero(least[slot] < most[slot])


class Suffixes:
    """The strings of some chunks, sorted one bucket (anchor and place of the anchor) at a time.

    With `several` only strings that may come in several documents are held; `index` is their number among all.
    """

    def __init__(self, columns: dict[str, np.ndarray], data: np.ndarray, group: np.ndarray, length: int, several: bool = False):
        self.length = length
        size = columns["size"].astype(np.int64)
        first = np.cumsum(size) - size
        count = size - length + 1
        self.chunk = np.repeat(np.arange(len(size)), count)
        inner = ranges(count)
        self.at = first[self.chunk] + inner
        self.index = np.arange(len(self.at))
        if several:
            self.index = _in_several(data, self.at, columns["doc"][self.chunk], length)
            self.chunk, self.at, inner = self.chunk[self.index], self.at[self.index], inner[self.index]
        self.bucket = group[self.chunk] * (length - K + 2) + (columns["before"].astype(np.int64)[self.chunk] - inner)
        self.residue = (columns["place"].astype(np.int64)[self.chunk] + inner) % COVER
        # Eight bytes from every place as a big-endian number; zeros after the end.
        padded = np.concatenate([data, np.zeros(COVER + length + 16, np.uint8)]).astype(_U)
        self.word = np.zeros(len(data) + COVER + length + 8, _U)
        for i in range(8):
            self.word = (self.word << _U(8)) | padded[i : i + len(self.word)]
        self.place_residue = np.repeat((columns["place"].astype(np.int64) - first) % COVER, size)

    def sample_ranks(self, at: np.ndarray) -> np.ndarray:
        """Rank of the suffix at each place of the difference cover sample within COVER bytes from `at`, by its first `length` bytes or a few more."""
        cover = difference_cover(COVER)
        near = np.zeros(len(self.place_residue) + COVER, np.int32)
        near[at] += 1
        near[at + COVER] -= 1
        places = np.flatnonzero(np.cumsum(near[: len(self.place_residue)]) > 0)
        places = places[np.isin((places + self.place_residue[places]) % COVER, cover)]
        keys = [self.word[places + 8 * i] for i in range(-(-self.length // 8) - 1, -1, -1)]
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        for key in keys:
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
        rank = np.full(len(self.word), -1)
        rank[places[order]] = np.cumsum(new)
        return rank

    def classes(self) -> np.ndarray:
        """A number for each string, equal for strings of equal content."""
        order = np.lexsort((self.word[self.at + 8], self.word[self.at], self.bucket))
        head = np.arange(len(order)) == 0
        at = self.at[order]
        for key in (self.bucket[order], self.word[at], self.word[at + 8]):
            head[1:] |= key[1:] != key[:-1]
        if not head.all():
            order, head = self._resolve(order, head)
            at = self.at[order]
        same = ~head
        for step in (*range(COVER, self.length - 8, 8), self.length - 8):
            word = self.word[at + step]
            same[1:] &= word[1:] == word[:-1]
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.cumsum(~same)
        return numbers

    def _resolve(self, order: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order within ties of the first COVER bytes: each tie is split around its first suffix by sample ranks, again and again."""
        tie = np.cumsum(head) - 1
        rank = self.sample_ranks(self.at[order[np.bincount(tie)[tie] > 1]])
        cover = set(difference_cover(COVER))
        common = np.array([[next(d for d in range(COVER) if (i + d) % COVER in cover and (j + d) % COVER in cover) for j in range(COVER)] for i in range(COVER)])
        part = head.copy()  # heads of what is still to be split
        done = np.zeros(len(order), bool)
        while True:
            heads = np.flatnonzero(part)
            number = np.cumsum(part) - 1
            size = np.diff(np.append(heads, len(order)))
            open_rows = np.flatnonzero((size[number] > 1) & ~done)
            if not len(open_rows):
                break
            mine, lead = order[open_rows], order[heads[number[open_rows]]]
            shift = common[self.residue[mine], self.residue[lead]]
            sign = np.sign(rank[self.at[mine] + shift] - rank[self.at[lead] + shift])
            move = np.lexsort((sign, number[open_rows]))
            order[open_rows] = mine[move]
            sign, at = sign[move], number[open_rows][move]
            cut = np.append(True, (np.diff(sign) != 0) | (np.diff(at) != 0))
            part[open_rows] = cut
            done[open_rows] = sign == 0
        new = np.zeros(len(order), bool)
        new[np.flatnonzero(np.append(True, np.diff(tie) != 0))] = True
        return order, new


def _sorter(length: int, doc_buckets: int) -> Callable:
    """Decides the strings of one bucket of anchors."""

    def decide(columns: dict[str, np.ndarray], data: np.ndarray) -> Iterator[np.ndarray]:
        back, least = _least_by(_contents(columns, data), columns["doc"])
        later = columns["doc"] > least[back]
        whole = {n: c[later] for n, c in columns.items()}
        yield _spans(whole["doc"], whole["row"], whole["place"], whole["place"].astype(np.int64) + whole["size"])
        # One chunk of each content; the others of its document share what comes out.
        first = np.full(len(least), len(back))
        keep = np.flatnonzero(~later)
        np.minimum.at(first, back[keep], keep)
        group, members = np.unique(columns["hash"][first], return_inverse=True, return_counts=True)[1:]
        order = np.argsort(group, kind="stable")
        order = order[members[group[order]] > 1]
        sizes = columns["size"].astype(np.int64)[first[order]]
        # Suffix buckets in blocks of bounded size; a bucket is never split here, large ones come dealt by string.
        total, a = np.cumsum(sizes), 0
        edges = np.flatnonzero(np.append(np.diff(group[order]) != 0, True)) + 1 if len(order) else np.zeros(0, np.int64)
        users = np.argsort(back[keep], kind="stable")
        user_edges = np.searchsorted(back[keep][users], np.arange(len(least) + 1))
        while a < len(order):
            limit = (total[a - 1] if a else 0) + BLOCK_STRINGS
            b = edges[max(np.searchsorted(edges, np.searchsorted(total, limit, "right"), "right") - 1, np.searchsorted(edges, a, "right"))]
            block = order[a:b]
            part, part_data = _pick(columns, data, first[block])
            strings = Suffixes(part, part_data, group[block], length, several=True)
            a = b
            if not len(strings.at):
                continue
            number = strings.classes()
            best = np.full(number.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(best, number, part["doc"][strings.chunk])
            found = np.flatnonzero(best[number] < part["doc"][strings.chunk])
            gone, gone_chunk = strings.index[found], strings.chunk[found]
            # Runs of strings that go, as spans relative to their chunk.
            head = np.append(True, (np.diff(gone) != 1) | (np.diff(gone_chunk) != 0)) if len(gone) else np.zeros(0, bool)
            begin, end = gone[head], gone[np.append(head[1:], True)] if len(gone) else gone
            count = part["size"].astype(np.int64) - length + 1
            base = np.cumsum(count) - count
            chunk = gone_chunk[head]
            content = block[chunk]
            n = user_edges[content + 1] - user_edges[content]
            user = keep[users[np.repeat(user_edges[content], n) + ranges(n)]]
            start = columns["place"][user].astype(np.int64) + np.repeat(begin - base[chunk], n)
            yield _spans(columns["doc"][user], columns["row"][user], start, start + np.repeat(end - begin, n) + length)

    def sort(key: tuple, table: pa.Table) -> pa.Table:
        held = [_read(blob) for blob in table["chunks"].to_pylist() if blob is not None]
        rows = [(d, s) for d, s in zip(table["doc_bucket"].to_pylist(), table["spans"].to_pylist()) if s is not None]
        if held:
            columns = {n: np.concatenate([c[n] for c, _ in held]) for n in _NAMES}
            data = np.concatenate([d for _, d in held])
            del held
            # Only anchors of several documents can repeat.
            back, least = _least_by(columns["hash"], columns["doc"])
            most = np.full(len(least), np.iinfo(np.int64).min)
            np.maximum.at(most, back, columns["doc"])
            columns, data = _pick(columns, data, np.flatnonzero(least[back] < most[back]))
            if len(columns["doc"]):
                rows += _span_blobs(np.concatenate(list(decide(columns, data))), doc_buckets)
        return pa.table({"doc_bucket": pa.array([d for d, _ in rows], pa.int32()), "spans": pa.array([s for _, s in rows], pa.binary())})

    return sort


def _sender(buckets: int) -> Callable:
    """Documents as compressed blobs, per bucket of documents."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 7))

        def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            bucket = np.array(batch["doc_bucket"].to_numpy(zero_copy_only=False), np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else order
            blobs = []
            for a, b in zip(edges, np.append(edges[1:], len(order))):
                part = batch.take(pa.array(order[a:b]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as stream:
                    stream.write_batch(part)
                blobs.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[order][edges], pa.int32()), pa.array(blobs, pa.binary())], ["doc_bucket", "docs"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(b.nbytes for b in held) >= FLUSH_BYTES:
                yield pack(held)
        if held:
            yield pack(held)

    return send


def _remover(key: tuple, sent: pa.Table, found: pa.Table) -> pa.Table:
    """Cuts the spans out of the documents of one bucket."""
    parts = [pa.ipc.open_stream(b.as_buffer()).read_all() for b in sent["docs"]]
    docs = pa.concat_tables(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
    blobs = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), _SPAN) for b in found["spans"].to_pylist()]
    spans = np.concatenate(blobs) if blobs else np.zeros(0, _SPAN)
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    columns: list[list] = [[] for _ in _RESULT]
    for doc, row, text in zip(docs["doc_id"].to_pylist(), docs["row"].to_pylist(), docs["text"]):
        raw = text.as_buffer() if text.is_valid else b""
        own = spans[:0]
        if len(spans):
            own = spans[np.searchsorted(spans["doc"], doc, "left") : np.searchsorted(spans["doc"], doc, "right")]
            own = own[own["row"] == row]
        digest, at, removed, runs = hashlib.sha256(), 0, 0, []
        view = memoryview(raw)
        if len(own):
            # Spans that meet or overlap are one run.
            reach = np.maximum.accumulate(own["end"])
            head = np.append(True, own["start"][1:] > reach[:-1])
            starts, ends = own["start"][head], reach[np.append(head[1:], True)]
            runs = list(zip(starts.tolist(), ends.tolist()))
        kept = []
        for start, end in runs:
            kept.append(bytes(view[at:start]))
            removed, at = removed + end - start, end
        kept.append(bytes(view[at:]))
        left = b"".join(kept)
        digest.update(left)
        for column, value in zip(columns, (doc, len(view), removed, len(runs), digest.hexdigest(), left)):
            column.append(value)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT)], schema=_RESULT)


def _untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without an id, which stay as they are."""
    for batch in batches:
        texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch["text"]]
        n = len(texts)
        values = ([None] * n, [len(t) for t in texts], [0] * n, [0] * n, [hashlib.sha256(t).hexdigest() for t in texts], texts)
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _RESULT)], schema=_RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes of every row of `docs` (doc_id, text).

    Texts are their UTF-8 bytes, null as none. A byte is removed when it is covered by a
    string of `length` bytes (K to 64 + K at most) that also starts in a document with a
    smaller doc_id; strings lie within one document and are judged on the input. Spans are maximal
    removed runs; the kept bytes may cut a character. Rows with a null doc_id have no
    place in the order: they lose nothing and take nothing from others. Repeated rows and
    rows with equal ids do not take from each other. Other columns are left aside.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    buckets = -(-total // BUCKET_BYTES) | 1
    # Only where ids repeat do their rows need another mark.
    repeated = not keyed.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
    keyed = keyed.withColumn("row", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    named = keyed.filter("doc_id is not null")
    texts = named.filter("text is not null")
    dealt = texts.mapInArrow(_dealer(length, buckets, buckets, hot_anchors(texts, length, total)), ROWS)
    spans = dealt.groupBy("bucket").applyInArrow(_sorter(length, buckets), "doc_bucket int, spans binary")
    placed = named.withColumn("doc_bucket", F.pmod("doc_id", F.lit(buckets)).cast("int"))
    sent = placed.mapInArrow(_sender(buckets), "doc_bucket int, docs binary")
    removed = sent.groupBy("doc_bucket").cogroup(spans.groupBy("doc_bucket")).applyInArrow(_remover, RESULT)
    return removed.union(keyed.filter("doc_id is null").mapInArrow(_untouched, RESULT))
