"""Codes against a brute-force form of the contract; the memo never loses a nearest entry."""

import hashlib
import math

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tiermill.llm import grid_codes as G
from tiermill.llm import queries


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{(id, vector): (code, error)} and the digest of the books; ``rows`` are (id, vector, label) that count."""
    v = [(i, [math.floor(scale * float(x)) for x in vec]) for i, vec, _ in rows]
    w = len(v[0][1]) // parts
    cut = lambda vec: [vec[p * w:(p + 1) * w] for p in range(parts)]
    books = [[cut(vec)[p] for _, vec in sorted((i, vec) for i, vec in v if i is not None)[:entries]] for p in range(parts)]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, vec in v:
                x = cut(vec)[p]
                own.setdefault(near(books[p], x)[1], []).append(x)
            for k, xs in own.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, vec in v:
        found = [near(books[p], x) for p, x in enumerate(cut(vec))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    want, sha = brute(rows)
    got = queries.QUERIES["op11_grid_codes"](spark, SF_SMALL).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(want)
    assert {r.codebooks_sha256 for r in got} == {sha}
    by = {}
    for r in got:
        by[r.vec_id] = r
    total = {}
    for i, _, label in rows:
        total[label] = total.get(label, 0) + by[i].error
    assert all(by[i].label_error == total[label] for i, _, label in rows)


def test_candidates_hold_every_nearest_entry():
    rng = np.random.default_rng(3)
    for cell in (1, 7, 64, 1000):
        book = rng.integers(-300, 300, (16, 4))
        book[5] = book[2]  # a tie in every cell
        x = rng.integers(-900, 900, (500, 4))
        c = G.Cells(book, cell)
        d = ((x[:, None] - book) ** 2).sum(2)
        for _ in range(2):  # computed, then remembered
            best, dist = c.nearest(x)
            assert (best == d.argmin(1)).all() and (dist == d.min(1)).all()
    assert G.Cells(book, 7).candidates(x // 7).mean() < 0.5


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(G, "MEMO", 20)
    rng = np.random.default_rng(4)
    c = G.Cells(rng.integers(-50, 50, (8, 2)), 3)
    for _ in range(30):
        x = rng.integers(-100, 100, (15, 2))
        assert (c.nearest(x)[0] == ((x[:, None] - c.book) ** 2).sum(2).argmin(1)).all()
        assert len(c.known) <= 20


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 16).tolist(), i % 3 if i % 4 else None) for i in range(60)]
    rows += [rows[7], rows[7], (7, rows[9][1], 1), (None, rows[3][1], 2), (100, [0.0] * 16, 0), (101, [-1e-9] * 16, 0)]
    bad = [(-5, None, 1), (-4, [0.1] * 15 + [None], 1), (-3, [float("nan")] * 16, 1), (-2, [0.1] * 15 + [float("inf")], 0),
           (-1, [0.1] * 12, 0), (-6, [], 0), (200, [0.1] * 24, 0)]
    d = spark.createDataFrame([(i, v, k, "c", 1) for i, v, k in rows + bad],
                              "vec_id long, embedding array<double>, label int, code string, vec int").repartition(5)
    want, sha = brute(rows, parts=4, entries=5, rounds=3)
    codes, books = G.compress(d, parts=4, entries=5, rounds=3, scale=4096, cell=100)
    got = G.label_errors(codes).collect()
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=key) == sorted(want, key=key)
    assert G.digest(books) == sha
    total = {}
    for (_, _, e), (_, _, k) in zip(want, rows):
        total[k] = total.get(k, 0) + e
    assert {r.label: r.label_error for r in got} == total
    few, _ = G.compress(d.where("vec_id in (1, 2)"), parts=4)
    assert sorted((r.vec_id, r.error) for r in few.collect()) == [(1, 0), (2, 0)]
    none, _ = G.compress(d.where("vec_id < 0"))
    assert none.columns == ["vec_id", "label", "code", "error"] and none.collect() == []
    assert G.label_errors(none).collect() == []
    with pytest.raises(Exception, match="2\\^27"):
        G.compress(spark.createDataFrame([(1, [1e9] * 8, 0)], "vec_id long, embedding array<double>, label int"))
