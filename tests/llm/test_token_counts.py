"""Counts against the tokenizers library; the cutter and the counter against plainer forms of the same rules."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF_SMALL
from tests.llm.test_bpe_lexicon import odd_texts

tokenizers = pytest.importorskip("tokenizers")
from tiermill.llm import queries, token_counts as C  # noqa: E402
from tiermill.llm.bpe_lexicon import load_bpe  # noqa: E402
from tiermill.llm.bpe_text import arrow_bytes  # noqa: E402


def library(texts):
    t = tokenizers.Tokenizer.from_file(queries.bpe_path())
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("chunk,max_states", [(1, 40), (3, 100_000), (1024, 3000)])
def test_odd_texts_as_the_library(chunk, max_states):
    texts = odd_texts() + ["x'r", "x'l", "'v", "it'll've", "''s", " 's"]
    counter = C.Counter(load_bpe(queries.bpe_path()), max_states)
    buf, off = arrow_bytes(pa.array(texts, pa.string()))
    assert C.count_batch(counter, buf, off, chunk).tolist() == library(texts)
    assert len(counter.states) <= max_states


def test_scan_composes_maps():
    rng = np.random.default_rng(1)
    maps = rng.integers(0, C.STATES, (40, C.STATES)).astype(np.uint8)
    first = np.repeat([0, 1, 20], [1, 19, 20])
    got = C.scan(maps, first)
    for i in range(40):
        state = np.arange(C.STATES)
        for j in range(first[i], i + 1):
            state = maps[j][state]
        assert got[i].tolist() == state.tolist()


def test_counter_equals_merging_every_prefix():
    bpe = load_bpe(queries.bpe_path())
    counter = C.Counter(bpe, 10_000)
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "tion", "er", "é", "x", "ing", "'", "9"]) for _ in range(rng.randint(1, 9))).encode()
             for _ in range(400)]
    words += [w[:k] for w in words for k in range(1, len(w))]
    buf = np.frombuffer(b"".join(words), np.uint8)
    begins = np.cumsum([0, *map(len, words)])
    assert counter.counts(buf, begins).tolist() == [len(bpe.merge(w)) for w in words]


def test_query_over_the_whole_table(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    n = library([r.text for r in rows])
    want = {(r.doc_id, len(r.text.encode()), k, k > 512) for r, k in zip(rows, n)}
    got = [tuple(r) for r in queries.QUERIES["op8_token_counts"](spark, SF_SMALL).collect()]
    assert set(got) == want and len(got) == len(rows)


def test_empty_null_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert C.token_counts(empty, queries.bpe_path()).collect() == []
    d = spark.createDataFrame([(1, None, 7), (1, None, 7), (None, "é", 8), (2, "a " * 600, 9)],
                              "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, C.token_counts(d, queries.bpe_path()).collect()), key=str)
    assert got.count((1, 0, 0, False)) == 2 and (None, 2, 1, False) in got and (2, 1200, 601, True) in got


def test_long_words_are_quick_and_exact():
    """One word of a megabyte, text without spaces, encoded data."""
    import time
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(1_000_000)), "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(100_000)),
             "".join(rng.choice("0123456789abcdef") for _ in range(200_000)), "a" * 300_000]
    buf, off = arrow_bytes(pa.array(texts, pa.string()))
    counter = C.Counter(load_bpe(queries.bpe_path()), 40_000)
    began = time.thread_time()
    got = C.count_batch(counter, buf, off).tolist()
    assert time.thread_time() - began < 30
    assert got == library(texts)
