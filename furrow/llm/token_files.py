"""Token-id files with a shared dictionary: short documents can be read without their neighbours.

A data set is a folder of token files, a dictionary and a manifest table. The zstandard
dictionary is trained on serialized id arrays of a bounded sample of documents; every
document is then a frame of its own, so short ones compress as if they shared a window.
Files hold the documents in ascending order of doc_id.

A token file is

    magic (8 bytes) | SHA-256 of the dictionary (32) | bytes per id (4) | 0 (4)
    frames of the documents, end to end
    index: one `INDEX` record per document
    place of the index (8) | documents (8) | ids of all documents (8) | magic (8)

with little-endian numbers. The manifest names the files of successful tasks only, so
what a lost attempt leaves behind is never read.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.blocks import text_blocks
from furrow.llm.cached_tokens import ByteTokens
from furrow.operators.order import running_totals
from furrow.session import persist_reliably, work_path
from furrow.sources.stores import open_store, qualify

MAGIC = b"TOKFILE1"
HEAD = len(MAGIC) + 40
TAIL = 32
INDEX = np.dtype([("doc_id", "<i8"), ("known", "<i8"), ("at", "<u8"), ("size", "<u8"), ("n_tokens", "<u8"), ("start", "<u8")])
END_ID = 2
LEVEL = 3
# The dictionary learns from this many documents at most, none of them longer than so many characters.
SAMPLE_ROWS = 2000
SAMPLE_CHARACTERS = 20_000
DICTIONARY_BYTES = 64 * 1024
FILE_BYTES = 64 * 1024 * 1024
# Frames and ids of this many bytes make one batch on their way in and out.
BATCH_BYTES = 4_000_000

MANIFEST = "path string, file long, documents long, tokens long, least long, most long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"
_FRAMES = "doc_id long, n_tokens long, digest long, row long, frame binary"


def _tokenizer(path: str) -> tuple[ByteTokens, int]:
    """The tokenizer and the bytes per id that its vocabulary needs."""
    # Tasks share their machine's cores, so the tokenizer keeps to one.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    found = ByteTokens.shared(path)
    return found, 2 if max(found.whole.get_vocab_size(with_added_tokens=True), END_ID + 1) <= 1 << 16 else 4


def _serialized(tokenizer: ByteTokens, texts: pa.Array, width: int) -> Iterator[bytes]:
    """Ids of each text with the end id, as little-endian numbers of `width` bytes."""
    end = np.array([END_ID], f"<u{width}").tobytes()
    for ids in tokenizer.encode(texts):
        yield ids.astype(f"<u{width}").tobytes() + end


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if shared:
        # Digested once, not for every document.
        shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True)


def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def train_dictionary(docs: DataFrame, tokenizer: str, rows: int = SAMPLE_ROWS, characters: int = SAMPLE_CHARACTERS, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary from at most `rows` texts of at most `characters`, taken in the order of a hash.

    The sample is drawn by hashes alone, so only its texts reach the driver. Empty where
    the sample is too small to train on; documents are then compressed without one.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = docs.select(order.alias("o")).orderBy("o").limit(rows).distinct()
    # One text per hash; `rows` bounds both sides of the join.
    fitting = docs.filter((F.char_length("text") > 0) & (F.char_length("text") <= characters)).select(order.alias("o"), "text")
    texts = fitting.join(F.broadcast(chosen), "o").groupBy("o").agg(F.min("text").alias("text"))
    encoding, width = _tokenizer(tokenizer)
    sample = list(_serialized(encoding, pa.array([r.text for r in sorted(texts.collect())], pa.string()), width))
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, sample)) // 8), sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _encoder(tokenizer: str, dictionary: bytes) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encoding, width), compressor = _tokenizer(tokenizer), _compressor(dictionary)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, _, offsets in text_blocks(batch["text"], BATCH_BYTES):
                ids = list(_serialized(encoding, batch["text"].slice(first, len(offsets) - 1), width))
                frames = [compressor.compress(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, len(ids)),
                        pa.array([len(i) // width for i in ids], pa.int64()),
                        pa.array(map(zlib.crc32, ids), pa.int64()),
                        pa.array(np.arange(row, row + len(ids))),
                        pa.array(frames, pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "digest", "row", "frame"],
                )
                row += len(ids)

    return encode


def _file_writer(home: str, width: int, dictionary_hash: bytes) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, start, sink, path, index = TaskContext.get().partitionId(), HEAD, 0, None, "", []
        for batch in batches:
            if not len(batch):
                continue
            if sink is None:
                # Every attempt has a file of its own; the manifest tells which one counts.
                path = f"{home}/tokens-{number:06d}-{uuid.uuid4().hex}.tok"
                store, place = open_store(path)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                sink = store.open_output_stream(place)
                sink.write(MAGIC + dictionary_hash + np.array([width, 0], "<u4").tobytes())
            part = np.zeros(len(batch), INDEX)
            frames = batch["frame"].cast(pa.large_binary())
            ends = np.frombuffer(frames.buffers()[1], np.int64)[frames.offset : frames.offset + len(frames) + 1]
            size = np.diff(ends)
            tokens = batch["n_tokens"].to_numpy()
            part["doc_id"] = batch["doc_id"].fill_null(0).to_numpy()
            part["known"] = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            part["size"], part["n_tokens"] = size, tokens
            part["at"] = at + np.cumsum(size) - size
            part["start"] = start + np.cumsum(tokens) - tokens
            # The frames lie end to end in the batch as they will in the file.
            sink.write(frames.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])))
            at, start = at + int(size.sum()), start + int(tokens.sum())
            index.append(part)
        if sink is None:
            return
        whole = np.concatenate(index)
        sink.write(whole.tobytes())
        sink.write(np.array([at, len(whole), start], "<u8").tobytes() + MAGIC)
        sink.close()
        ids = whole["doc_id"][whole["known"] == 1]
        least, most = (int(ids[0]), int(ids[-1])) if len(ids) else (None, None)
        columns = [[path], [number], [len(whole)], [start], [least], [most]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], ["path", "file", "documents", "tokens", "least", "most"])

    return write


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, file_bytes: int = FILE_BYTES) -> str:
    """Write the ids of every whole text of `docs` (doc_id, text) as token files; gives the folder.

    Every row is a document of its own, repeated rows and equal ids included; a null text
    counts as empty, and a document ends with its end id. Order: null ids first, then
    ascending doc_id; equal ids by number of ids and checksum. Special strings in a text
    become their ids, as the tokenizer does by default. Other columns are left aside. An
    empty table gives an empty data set. `tokenizer` is the path of a tokenizer file that
    every executor can open; `path` a new folder, by default below the shared one.

    Texts are encoded where they lie; only compressed frames are dealt to files by ranges
    of doc_id, whose last key is unique, so that no id can fill a file.
    """
    spark = docs.sparkSession
    home = qualify(spark, path or work_path(spark, "tokens"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dictionary, (_, width) = train_dictionary(docs, tokenizer), _tokenizer(tokenizer)
    frames = persist_reliably(docs.mapInArrow(_encoder(tokenizer, dictionary), _FRAMES))
    total = frames.agg(F.coalesce(F.sum(F.octet_length("frame")), F.lit(0)).alias("b")).first().b
    files = max(1, -(-int(total) // file_bytes), min(spark.sparkContext.defaultParallelism, int(total) // (file_bytes // 16)))
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("digest"), F.col("row")]
    dealt = frames.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
    manifest = dealt.mapInArrow(_file_writer(home, width, hashlib.sha256(dictionary).digest()), MANIFEST)
    manifest.write.parquet(f"{home}/manifest")
    # One row of bounded size.
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").write.parquet(f"{home}/dictionary")
    return home


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with `base`, the ids of all documents in earlier files, and `rank`, the number of earlier files with ids."""
    listed = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest").withColumn("named", F.col("least").isNotNull().cast("long"))
    return running_totals(listed, ["file"], {"base": "tokens", "rank": "named"})


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path.rstrip('/')}/dictionary").first().dictionary)


def _opened(path: str, wanted_hash: bytes) -> tuple[fs.FileSystem, str, np.ndarray, int]:
    """Store, place, index and bytes per id of a token file whose dictionary must be the one at hand."""
    store, place = open_store(path)
    with store.open_input_file(place) as source:
        head = source.read_at(HEAD, 0)
        tail = source.read_at(TAIL, source.size() - TAIL)
        if head[:8] != MAGIC or tail[24:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        if head[8:40] != wanted_hash:
            raise ValueError(f"{path} was written with another dictionary")
        at, n, _ = np.frombuffer(tail[:24], "<u8").tolist()
        index = np.frombuffer(source.read_at(n * INDEX.itemsize, at), INDEX)
    return store, place, index, int(np.frombuffer(head[40:44], "<u4")[0])


def _rows(index: np.ndarray, ids: list[bytes], base: int) -> pa.RecordBatch:
    doc = pa.array(index["doc_id"].astype(np.int64), mask=index["known"] == 0)
    start, n = pa.array((index["start"] + np.uint64(base)).astype(np.int64)), pa.array(index["n_tokens"].astype(np.int64))
    return pa.RecordBatch.from_arrays([doc, start, n, pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def _widened(frame: bytes | memoryview, decompressor: zstandard.ZstdDecompressor, width: int) -> bytes:
    return np.frombuffer(decompressor.decompress(frame), f"<u{width}").astype("<u4").tobytes()


def _cuts(index: np.ndarray) -> list[int]:
    """Ends of runs of documents with about BATCH_BYTES of ids."""
    run = np.cumsum(4 * index["n_tokens"].astype(np.int64)) // BATCH_BYTES
    return [*(np.flatnonzero(np.diff(run)) + 1).tolist(), len(index)]


def _reader(dictionary: bytes) -> Callable:
    wanted_hash = hashlib.sha256(dictionary).digest()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = _decompressor(dictionary)
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                store, place, index, width = _opened(path, wanted_hash)
                with store.open_input_file(place) as source:
                    first = 0
                    for end in _cuts(index):
                        part = index[first:end]
                        at, whole = int(part["at"][0]), memoryview(source.read_at(int(part["size"].sum()), int(part["at"][0])))
                        frames = [whole[a : a + n] for a, n in zip((part["at"] - np.uint64(at)).tolist(), part["size"].tolist())]
                        yield _rows(part, [_widened(f, decompressor, width) for f in frames], base)
                        first = end

    return read


def _picker(dictionary: bytes) -> Callable:
    wanted_hash = hashlib.sha256(dictionary).digest()

    def pick(key: tuple, wanted: pa.Table) -> pa.Table:
        path, base = key[0].as_py(), key[1].as_py()
        decompressor = _decompressor(dictionary)
        store, place, index, width = _opened(path, wanted_hash)
        ids = np.unique(wanted["doc_id"].to_numpy())
        known = index[index["known"] == 1]
        # Ids ascend, so the documents of one id lie side by side.
        low, high = np.searchsorted(known["doc_id"], ids, "left"), np.searchsorted(known["doc_id"], ids, "right")
        part = np.concatenate([known[a:b] for a, b in zip(low.tolist(), high.tolist())]) if len(ids) else known[:0]
        with store.open_input_file(place) as source:
            found = [_widened(source.read_at(int(n), int(at)), decompressor, width) for at, n in zip(part["at"], part["size"])]
        return pa.Table.from_batches([_rows(part, found, base)])

    return pick


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a data set: doc_id, start (ids of all documents before it), n_tokens and ids.

    ids are little-endian unsigned 32-bit numbers with the end id. Files are read in
    parallel, documents of a file in turn. A file whose dictionary hash differs from the
    data set's dictionary raises.
    """
    files = _manifest(spark, path).select("path", "base")
    tasks = max(1, min(files.count(), 8 * spark.sparkContext.defaultParallelism))
    return files.repartition(tasks).mapInArrow(_reader(_dictionary(spark, path)), DOCUMENTS)


def read_documents(path: str, wanted: DataFrame) -> DataFrame:
    """The documents named in `wanted` (doc_id), in the columns of `read_tokens`.

    Only files whose range holds a wanted id are opened, and of those only the index and
    the wanted frames are read. Repeated ids in `wanted` count once, nulls and unknown
    ids give nothing; all documents of an id come back.
    """
    spark = wanted.sparkSession
    files = persist_reliably(_manifest(spark, path).filter("named = 1").select("path", "base", "rank", "least", "most"))
    ids = wanted.select(F.col("doc_id").cast("long").alias("place")).filter("place is not null").distinct()
    # Files lie in the order of their ids: those that can hold an id are the ones that
    # neither end before it nor start after it, so two running counts find them.
    marks = [ids.select("place", F.lit(1).alias("kind"), F.lit(0).alias("number"))]
    marks += [files.select(F.col(c).alias("place"), F.lit(kind).alias("kind"), F.col("rank").alias("number")) for c, kind in (("least", 0), ("most", 2))]
    started, ended = (F.col("kind") == 0).cast("long"), (F.col("kind") == 2).cast("long")
    counted = running_totals(
        marks[0].unionByName(marks[1]).unionByName(marks[2]).withColumns({"started": started, "ended": ended}),
        ["place", "kind", "number"],
        {"high": "started", "low": "ended"},
    )
    dealt = counted.filter("kind = 1 and low < high").select(F.col("place").alias("doc_id"), F.explode(F.sequence("low", F.col("high") - 1)).alias("rank"))
    return dealt.join(files, "rank").groupBy("path", "base").applyInArrow(_picker(_dictionary(spark, path)), DOCUMENTS)
