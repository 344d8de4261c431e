import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from furrow.llm.packing import Windows, pack, powers_of_two
from furrow.llm.word_tokens import WordTokens
from tests.llm.cases import SCHEMA, document_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_tokens_equal_the_tokenizer():
    whole = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = ["", "It's we'll 'tis o'clock's 're''s 12'm don'T", "a<|endoftext|>b <|EndOfText|>", "İstanbul ǅ éè́ ñ\x85x\xa0y", "Straße 3½² ...''s", None, "x" * 5000]
    texts += ["".join(rng.choice("abÉßñ'stm .,12\n İ中-_é") for _ in range(rng.randrange(80))) for _ in range(400)]
    got = list(WordTokens(PATH).encode(pa.array(texts, pa.string())))
    for text, ids in zip(texts, got):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, text


def test_every_id_lies_in_one_piece(spark):
    rows = document_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pieces = pack(docs, PATH, length=256, open_windows=4).collect()
    whole = Tokenizer.from_file(PATH)
    want = sorted(np.array([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in rows)
    sequences: dict[int, list] = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        sequences.setdefault(p.sequence_id, []).append(p)
    padding = 0
    for held in sequences.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding <= 0.03 * sum(p.length for p in pieces)
    # Documents with one id are told apart by their contents.
    found = []
    by_doc: dict = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    counts = {}
    for r in rows:
        key = (r[0], len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1)
        counts[key] = counts.get(key, 0) + 1
    for key, held in by_doc.items():
        assert sum(p.length for p in held) == key[1] * counts[key]
        if counts[key] == 1:
            found.append(b"".join(p.ids for p in sorted(held, key=lambda p: p.start)))
    assert set(found) <= set(want) and len(found) == sum(c == 1 for c in counts.values())
    assert zlib.crc32(found[0]) >= 0


def test_windows_take_the_best_fit_and_empty_tables_give_nothing(spark):
    windows = Windows(10, 2, 2)
    ids = np.arange(10, dtype=np.uint32)
    assert not list(windows.add((1, 0, 6, ids[:6]))) and not list(windows.add((2, 0, 7, ids[:7])))
    assert [p[0] for p in list(windows.add((3, 0, 3, ids[:3])))[0]] == [2, 3]
    assert [len(p[3]) for part in powers_of_two([(1, 0, 7, ids[:7])]) for p in part] == [4, 2, 1]
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_a_full_table_keeps_the_words_of_several_blocks(monkeypatch):
    monkeypatch.setattr("furrow.llm.cached_tokens.CACHE_WORDS", 300)
    whole, found = Tokenizer.from_file(PATH), WordTokens(PATH)
    often = "these words come again and again"
    for turn in range(8):
        texts = [often, " ".join(f"x{chr(97 + i // 26)}{chr(97 + i % 26)}q{chr(97 + turn)}" for i in range(200))]
        for text, ids in zip(texts, found.encode(pa.array(texts, pa.string()))):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
        # Beyond the limit there are one block's words at most.
        assert found.table.words <= 300 + 205
    # The common words were never dropped.
    assert found.table.trimmed(150).words == len(set(often.split()))
    assert found.table.trimmed(2).words == 0
