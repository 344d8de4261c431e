import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from furrow.llm import token_files
from furrow.llm.cached_tokens import ByteTokens
from furrow.llm.token_files import read_documents, read_tokens, train_dictionary, write_tokens
from furrow.session import work_path
from tests.llm.cases import SCHEMA, document_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    """(doc_id, start, n_tokens, crc) in the order of the files."""
    whole = Tokenizer.from_file(PATH)
    found = []
    for r in rows:
        raw = np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2])
        found.append((r[0] is not None, r[0] or 0, len(raw), zlib.crc32(raw.astype("<u2").tobytes()), raw.astype("<u4").tobytes()))
    out, start = [], 0
    for known, doc, n, _, raw in sorted(found):
        out.append((doc if known else None, start, n, raw))
        start += n
    return out


@pytest.fixture(scope="module")
def written(spark):
    rows = document_rows(7) + [(5000, "a<|endoftext|>b <|ENDOFTEXT|>", None, None, None, None), (-4, "negative id", None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, write_tokens(docs, PATH, work_path(spark, "tokens"), file_bytes=8_000)


def test_files_give_back_every_document_in_order(spark, written):
    rows, place = written
    got = read_tokens(spark, place).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got), key=lambda r: r[1]) == expected(rows)
    manifest = sorted(spark.read.parquet(f"{place}/manifest").collect(), key=lambda r: r.file)
    assert len(manifest) > 3 and sum(r.documents for r in manifest) == len(rows)


def test_single_documents_are_read_by_index(spark, written):
    rows, place = written
    want = [3, 3, 5000, -4, 77, 123456, None]
    got = read_documents(place, spark.createDataFrame([(w, "x") for w in want], "doc_id long, ids string")).collect()
    held = {w for w in want if w is not None}
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got), key=lambda r: r[1]) == [e for e in expected(rows) if e[0] in held]
    assert read_documents(place, spark.createDataFrame([], "doc_id long")).count() == 0


def test_one_id_in_many_files(spark):
    rng = random.Random(2)
    rows = [(9, " ".join(str(rng.random()) for _ in range(40)), "", "", 0, "") for _ in range(90)] + [(i, "w", "", "", 0, "") for i in range(20)]
    place = write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, file_bytes=4_000)
    assert spark.read.parquet(f"{place}/manifest").filter("least <= 9 and most >= 9").count() > 3
    got = read_documents(place, spark.createDataFrame([(9,), (0,)], "doc_id long")).collect()
    assert sorted((r.start, bytes(r.ids)) for r in got) == [(s, raw) for d, s, _, raw in expected(rows) if d in (9, 0)]


def test_an_empty_table_and_a_foreign_dictionary(spark, written):
    place = write_tokens(spark.createDataFrame([], SCHEMA), PATH)
    assert read_tokens(spark, place).count() == 0 and read_documents(place, spark.createDataFrame([(1,)], "doc_id long")).count() == 0
    path = spark.read.parquet(f"{written[1]}/manifest").first().path
    with pytest.raises(ValueError, match="another dictionary"):
        token_files._opened(path, b"\x00" * 32)


def test_the_shared_dictionary_pays_off_for_short_documents(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(50)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(30)), "", "", 0, "") for i in range(600)], SCHEMA)
    dictionary = train_dictionary(docs, PATH)
    assert dictionary and dictionary == train_dictionary(docs.repartition(7), PATH)
    texts = [r.text for r in docs.limit(200).collect()]
    raw = list(token_files._serialized(token_files._tokenizer(PATH)[0], pa.array(texts), 2))
    alone, shared = (sum(len(token_files._compressor(d).compress(r)) for r in raw) for d in (b"", dictionary))
    assert shared < 0.8 * alone
    assert [token_files._decompressor(dictionary).decompress(token_files._compressor(dictionary).compress(r)) for r in raw[:5]] == raw[:5]
    assert train_dictionary(docs.limit(1), PATH) == b"" and pa.array(raw).null_count == 0


def test_cached_ids_equal_the_tokenizer():
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = ["", "It's we'll 'tis o'clock's 're''s 12'm don'T", "a<|endoftext|>b", "İstanbul ǅ éè́ ñ\x85x\xa0y", "½² ...''s  's\n's", None, "x" * 5000, " ", "\n\n", " a", "a  b\n\n c \t", "中文 字"]
    texts += ["".join(rng.choice("abÉß'stmdrevl .,12\n\t\xa0²_é") for _ in range(rng.randrange(80))) for _ in range(1500)]
    got = list(ByteTokens(PATH).encode(pa.array(texts, pa.string())))
    assert [ids.tolist() for ids in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
