"""Clusters against a brute-force form of the contract; heaps hold back what can't have changed."""

import hashlib
import math

import numpy as np

from tests.conftest import SF_SMALL
from tiermill.llm import heap_clusters as H
from tiermill.llm import queries


def brute(rows, k=16, rounds=3, scale=64):
    v = [(i, [math.floor(scale * float(x)) for x in vec]) for i, vec in rows]
    sha = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    cents = [vec for _, vec in sorted((sha(i), vec) for i, vec in v if i is not None)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(c, x)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = {}
        for _, x in v:
            own.setdefault(near(x)[1], []).append(x)
        for n, xs in own.items():
            cents[n] = [sum(c) // len(xs) for c in zip(*xs)]
    return [(i, near(x)[1], near(x)[0]) for i, x in v], [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    want, names = brute(rows)
    got = queries.QUERIES["op13_heap_clusters"](spark, SF_SMALL).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == sorted(want)
    per = {}
    for _, c, d in want:
        per[c] = per.get(c, 0) + d
    assert all(r.cluster_inertia == per[r.cluster] and r.inertia == sum(per.values()) and r.centroid_sha256 == names[r.cluster] for r in got)


def clouds(n, k, dim, spread, seed):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 3, (k, dim))
    return [(i, (at[i % k] + rng.normal(0, spread, dim)).tolist()) for i in range(n)]


def test_unexpired_vectors_are_not_rescanned(spark, monkeypatch):
    rows = clouds(600, 5, 8, 0.3, 1)
    monkeypatch.setattr(H, "BLOCK", 100)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found, model, scanned = H.cluster(d, k=5, rounds=6, dim=8)
    want, names = brute(rows, k=5, rounds=6)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == sorted(want)
    assert H.digests(model) == names
    assert scanned[0] == 600 and len(scanned) == 7 and scanned[-1] < 300


def test_heaps():
    h = H.Heaps.empty(2)
    h.push(0, np.array([3.0, 1.0, 2.0]), np.array([0, 1, 2], np.int32))
    h.push(1, np.array([5.0]), np.array([3], np.int32))
    back = H.Heaps(*h.flat())
    assert back.keys[0] == 1.0 and back.expired(np.array([0.5, 4.9])) == ([], []) and not back.open
    assert back.expired(np.array([2.0, 5.0])) == ([1, 2, 3], [0, 0, 1])
    assert [x.tolist() for x in back.flat()] == [[3.0], [0], [0, 1, 1]]


def test_rounds_on_random_blocks():
    """Bounds over many rounds: every vector stays with its nearest centroid, equal distances with the smaller number."""
    rng = np.random.default_rng(2)
    for trial in range(20):
        vecs = rng.integers(-4, 5, (200, 3))
        cents = vecs[:6].copy()
        model = H.Model(cents, np.zeros(6), [[0] * 3 for _ in range(6)], [0] * 6)
        heaps = H.Heaps.empty(6)
        n, total = H.rescan(heaps, vecs, np.arange(200, dtype=np.int32), np.full(200, -1), cents, np.zeros(6))
        for _ in range(8):
            row = lambda c, i: type("R", (), {"cluster": c, "i": i, "n": int(n[c]), "t": int(total[c, i])})
            model.update([row(c, i) for c in range(6) for i in range(3)])
            heaps = H.Heaps(*heaps.flat())
            places, old = heaps.expired(model.drift)
            n, total = H.rescan(heaps, vecs, np.array(places, np.int32), np.array(old, np.int64), model.centroids, model.drift)
            _, at, ends = heaps.flat()
            cluster = np.empty(200, int)
            cluster[at] = np.repeat(np.arange(6), np.diff(ends))
            want = ((vecs[:, None] - model.centroids) ** 2).sum(2).argmin(1)
            assert (cluster == want).all()
            sums = np.array([vecs[want == c].sum(0) for c in range(6)])
            assert (np.array(model.sums) + total == sums).all()


def test_odd_rows(spark):
    rows = clouds(40, 3, 4, 1.0, 3)
    rows += [rows[7], rows[7], (7, rows[9][1]), (None, rows[3][1]), (100, [0.0] * 4), (101, [-1e-9] * 4)]
    bad = [(-5, None), (-4, [0.1, 0.2, 0.3, None]), (-3, [float("nan")] * 4), (-2, [0.1, 0.1, 0.1, float("-inf")]), (-1, [0.1] * 3), (-6, [])]
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, cluster int, vec string")
    for k in (1, 7, 46, 60):
        want, names = brute(rows, k=k)
        found, model, _ = H.cluster(d, k=k, dim=4)
        key = lambda t: (t[0] is None, t[0] or 0, t[1:])
        assert sorted(((r.vec_id, r.cluster, r.distance) for r in found.collect()), key=key) == sorted(want, key=key)
        assert H.digests(model) == names
        x = H.with_inertia(found, model).collect()
        assert {r.inertia for r in x} == {sum(t[2] for t in want)}
    found, model, _ = H.cluster(d.where("vec_id < 0"), dim=4)
    assert H.with_inertia(found, model).collect() == []
    assert H.with_inertia(found, model).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
