"""Ids and decoded texts against the tokenizers library, over whole tables and odd texts."""

import hashlib
import random
import struct

import pytest

from tests.conftest import SF_SMALL

tokenizers = pytest.importorskip("tokenizers")
from tiermill.llm import bpe_lexicon, queries  # noqa: E402

PARTS = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "B", "1", "²", "é", "ß", "中", "!", "?",
         "<|endoftext|>", "<|endof", "🙂", "́", "٣", "Ⅷ", "'S", "\r\n", "\x85", "‍", "　", "\x1c"]


def odd_texts():
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    return texts + [None, "", "a" * 5000, "ab " * 3000, " " * 400 + "x", "<|endoftext|>", "x" * 47 + "y" * 3, "'s'"]


def expected(texts):
    t = tokenizers.Tokenizer.from_file(queries.bpe_path())
    out = []
    for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False):
        back = t.decode(e.ids, skip_special_tokens=False)
        out.append((len(e.ids), hashlib.sha256(struct.pack(f"<{len(e.ids)}I", *e.ids)).hexdigest(),
                    hashlib.sha256(back.encode()).hexdigest()))
    return out


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_odd_texts_as_the_library(spark):
    texts = odd_texts()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in bpe_lexicon.round_trip(docs_of(spark, texts), queries.bpe_path(), lexicon_size=50).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts)


def test_query_over_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = {r.doc_id: e for r, e in zip(rows, expected([r.text for r in rows]))}
    got = queries.QUERIES["op3_bpe_lexicon"](spark, SF_SMALL).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(rows)


def test_empty_table_repeated_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_lexicon.round_trip(empty, queries.bpe_path()).collect() == []
    d = spark.createDataFrame([(1, "so so", 3, "x"), (1, "so so", 3, "x"), (None, "so", 4, "y")],
                              "doc_id long, text string, n_tokens int, word string")
    got = bpe_lexicon.round_trip(d, queries.bpe_path()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 2), (1, 2)]


def test_encode_then_decode_through_tables(spark):
    texts = odd_texts()
    d = docs_of(spark, texts)
    uri = bpe_lexicon.build_lexicon(d, queries.bpe_path(), lexicon_size=200)
    ids = bpe_lexicon.encode_texts(d, queries.bpe_path(), uri)
    back = {r.doc_id: r.text for r in bpe_lexicon.decode_ids(ids, queries.bpe_path()).collect()}
    assert [back[i] for i in range(len(texts))] == [x or "" for x in texts]


def test_automaton_numbers_its_words_in_order():
    import numpy as np
    words = sorted({b"tion", b"nation", b"station", b"on", b"a", b"stat"})
    lex = bpe_lexicon.Lexicon.compile(words, lambda w: list(w))
    probe = [*words, b"statio", b"x", b"ons", b"nationn"]
    buf = np.frombuffer(b"".join(probe), np.uint8)
    begins = np.cumsum([0, *map(len, probe)])
    assert lex.numbers(buf, begins).tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert lex.table.shape[0] < sum(map(len, words))  # suffixes are shared


def test_memo_numbers_words_exactly(monkeypatch):
    import numpy as np
    rng = random.Random(3)
    monkeypatch.setattr(bpe_lexicon.WordMemo, "BITS", 6)  # far too few places: many words find none
    memo, known = bpe_lexicon.WordMemo(), []
    for _ in range(20):
        words = [bytes(rng.choice(b"ab\0") for _ in range(rng.choice([0, 1, 2, 3, 7, 8, 9, 16, 17, 31, 32, 33, 70]))) for _ in range(200)]
        begins = np.cumsum([0, *map(len, words)])
        got, new = memo.number_all(np.frombuffer(b"".join(words), np.uint8), begins[:-1], begins[1:])
        known += new
        assert len(known) == memo.words and [known[i] for i in got] == words


def test_a_full_memo_keeps_what_it_has(monkeypatch):
    import numpy as np
    monkeypatch.setattr(bpe_lexicon, "MEMO_WORDS", 30)
    bpe = bpe_lexicon.load_bpe(queries.bpe_path())
    enc, rng = bpe_lexicon.Encoder(bpe, None), random.Random(6)
    tok = tokenizers.Tokenizer.from_file(queries.bpe_path())
    full = 0
    for k in range(30):
        letters = "abcdefg" if k < 20 else "nopqrst"  # other words from here on: the memo starts anew
        texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 2, 3, 40]))) for _ in range(60)) for _ in range(3)]
        raw = [t.encode() for t in texts]
        off = np.cumsum([0, *map(len, raw)])
        ids, upto = enc.encode(np.frombuffer(b"".join(raw), np.uint8), off)
        assert [ids[i:j].tolist() for i, j in zip(upto, upto[1:])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        full += enc.memo.words >= 30
        assert enc.ids.rows == enc.base + enc.memo.words
    assert full > 5


def test_long_words_as_the_library(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdef") for _ in range(100_000)), "中文字" * 20_000, "ab" * 60_000 + " ab", "x " * 50_000]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in bpe_lexicon.round_trip(docs_of(spark, texts), queries.bpe_path()).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts)
