"""Exact round trips of the coder and the files, and the query against the tokenizers library."""

import struct
import zlib

import numpy as np
import pytest

from tests.conftest import SF_SMALL

tokenizers = pytest.importorskip("tokenizers")
from tiermill.llm import queries, rans_store as R  # noqa: E402


@pytest.mark.parametrize("n", [1, 3, 4, 5, 2047, 2048, 2049, 8192])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, size=3 * n), 5000).astype(np.int32)
    t = R.Table(R.scaled(np.bincount(ids, minlength=5001)))
    blocks = R.encode_blocks(t, ids, np.array([0, n, n + 1]), np.array([n, 1, 2 * n - 1 if 2 * n - 1 <= R.BLOCK else 7]))
    raw = b"".join(blocks)
    places = np.cumsum([0] + [len(b) for b in blocks])[:-1].tolist()
    out, off = R.decode_blocks(t, raw, places)
    m = 2 * n - 1 if 2 * n - 1 <= R.BLOCK else 7
    assert out.tolist() == [*ids[:n], ids[n], *ids[n + 1:n + 1 + m]] and off.tolist() == [0, n, n + 1, n + 1 + m]
    if n > 3:
        bad = bytearray(raw)
        bad[-1] ^= 1
        with pytest.raises(ValueError):
            R.decode_blocks(t, bytes(bad), places)


def test_scaled_keeps_every_id():
    c = np.array([10**9, 1, 0, 5, 1])
    f = R.scaled(c)
    assert f.sum() == 1 << R.BITS and (f[c > 0] >= 1).all() and f[2] == 0
    one = R.scaled(np.array([0, 7]))
    assert one.tolist() == [0, 1 << R.BITS]


def expected(rows):
    t = tokenizers.Tokenizer.from_file(queries.bpe_path())
    start, out = 0, []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_query_over_the_whole_table(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    got = sorted(map(tuple, queries.QUERIES["op10_rans_ids"](spark, SF_SMALL).collect()))
    assert got == expected(rows)


def test_odd_rows_over_many_files(spark):
    texts = ["", None, "one two", "x " * 9000, "a<|endoftext|>b", "é" * 300] * 3
    rows = [(i * 7 % 18, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, part string").repartition(5)
    folder = R.write_ids(d, queries.bpe_path(), ids_per_file=4000)
    assert spark.read.parquet(folder + "/manifest").count() > 2
    got = R.read_ids(spark, folder, with_ids=True).collect()
    assert sorted(tuple(r)[:4] for r in got) == expected(sorted(rows, key=lambda r: r[0]))
    t = tokenizers.Tokenizer.from_file(queries.bpe_path())
    assert {r.doc_id: t.decode(r.ids[:-1], skip_special_tokens=False) for r in got} == {i: x or "" for i, x in rows}


def test_empty_table_and_null_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.read_ids(spark, R.write_ids(empty, queries.bpe_path())).collect() == []
    d = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (None, None)], "doc_id long, text string")
    got = R.read_ids(spark, R.write_ids(d, queries.bpe_path())).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 3, 3] and [r.start for r in got][0] == 0
    assert sum(r.n_tokens for r in got) == 7
