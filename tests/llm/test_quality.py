"""Held-out accuracy on the table, and the pieces of the learner."""

import zlib

import numpy as np

from tests.conftest import SF_MID
from tiermill.llm import quality as Q
from tiermill.llm import queries


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op9_pu_quality"](spark, SF_MID).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [(r.score, r.predicted, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    good, bad = [s for s, _, q in test if q], [s for s, _, q in test if not q]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.97 and np.mean([p == q for _, p, q in test]) > 0.95
    assert np.mean([p for _, p, q in test if q]) > 0.98


def test_prior_and_risk_on_two_clouds():
    rng = np.random.default_rng(0)
    one = lambda n, at: np.column_stack([np.ones(n), rng.normal(at, 1, (n, 2))])
    p, u = one(2000, 2), np.concatenate([one(1400, 2), one(600, -2)])
    w = Q.tell_apart(p, u)
    cuts, of_positives = Q.cut_scores(p, w)
    prior = Q.prior_of(np.array([(u @ w >= c).mean() for c in cuts]), of_positives)
    assert abs(prior - 0.7) < 0.06
    w = Q.fit_nnpu(p, u, prior)
    assert ((u[:1400] @ w) > 0).mean() > 0.95 and ((u[1400:] @ w) < 0).mean() > 0.95


def test_weights_have_the_least_risk():
    """The risk written out row by row is no smaller a step away from the weights found."""
    rng = np.random.default_rng(1)
    p = np.column_stack([np.ones(300), rng.normal(1, 1, (300, 2))])
    u = np.column_stack([np.ones(500), rng.normal(0, 2, (500, 2))])
    prior, decay = 0.4, 1e-2
    loss = lambda z, y: np.log1p(np.exp(-y * z))

    def risk(w):
        zp, zu = [float(r @ w) for r in p], [float(r @ w) for r in u]
        negative = sum(loss(z, -1) for z in zu) / len(zu) - prior * sum(loss(z, -1) for z in zp) / len(zp)
        return prior * sum(loss(z, 1) for z in zp) / len(zp) + max(0.0, negative) + decay * float(w @ w) / 2

    w = Q.fit_nnpu(p, u, prior, decay)
    least = risk(w)
    assert all(risk(w + 0.05 * d) > least for d in rng.normal(size=(40, 3)))


def brute_features(text):
    """The shares of character classes and the word counts, one character at a time."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    shares = [sum(chr(b) in chars for b in raw) / n for chars in Q.CLASSES]
    shares.append(1 - sum(shares) if raw else 0.0)
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in (text or "")).split(" ") if w]
    low = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
    some = max(1, len(words))
    same = sum(a == b for a, b in zip(low, low[1:])) / some
    two = sum(a == b for a, b in zip(low, low[2:])) / some
    shout = sum(sum("A" <= c <= "Z" for c in w) >= 2 for w in words) / some
    spare = max(0, 1 - len(set(low)) / max(1, some ** 0.85))
    x = [*shares, same, two, shout, spare, sum(len(w.encode()) for w in words) / some / 20, np.log1p(len(words)) / 10]
    return [*x, *np.sqrt(x)]


def test_features_against_brute_force():
    import pyarrow as pa
    from tiermill.llm.bpe_text import arrow_bytes
    texts = [None, "", "a", "The the THE cat!! 12 é", " \n", "ab cd ab cd\tAB", "<b>x</b> | # $", "ßß Ω Ω"]
    got = Q.features(*arrow_bytes(pa.array(texts, pa.string())))
    assert np.allclose(got, [brute_features(t) for t in texts])


def test_moments_cover_every_row_and_any_partitioning(spark):
    rows = [(i, ("word " * (i % 50) + "x!" * (i % 7)) if i % 11 else None) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = [Q.moments(Q.featured(d.repartition(n), ["doc_id"], "text")) for n in (1, 5)]
    import pyarrow as pa
    from tiermill.llm.bpe_text import arrow_bytes
    f = Q.features(*arrow_bytes(pa.array([t for _, t in rows], pa.string())))
    assert all((a == b).all() for a, b in zip(*found))
    assert np.allclose(found[0][0], f.mean(0), atol=1e-6) and np.allclose(found[0][1], f.std(0) + 1e-3, atol=1e-4)


def test_scores_do_not_depend_on_the_partitioning(spark):
    """More positives than the sample takes, ids that repeat: five partitionings give one model."""
    rows = [(i % 1900, "a line of words " * (1 + i % 9) if i % 3 else "$$$ %% " * (1 + i % 5)) for i in range(2400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1900) if i % 3], "doc_id long, quality int")
    seen = set()
    for n in (1, 3, 8):
        got = Q.quality_scores(d.repartition(n), labels.repartition(n), sample=200)
        seen.add(tuple(sorted((r.doc_id, r.score) for r in got.collect())))
    assert len(seen) == 1


def test_odd_rows(spark):
    texts = [None, "", " \n", "x", "é" * 9, "word " * 30000, "a b c"] * 2
    d = spark.createDataFrame([(i % 7, t, 0.5, "r") for i, t in enumerate(texts)] + [(None, "a", 0.5, "r")],
                              "doc_id long, text string, score double, row string")
    labels = spark.createDataFrame([(5, 0), (6, 1), (6, 1), (3, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    got = Q.quality_scores(d, labels).collect()
    assert len(got) == 15 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values()) and by[0] == by[1]
    kept = Q.keep_good(d, labels)
    assert kept.columns == d.columns
    none = Q.quality_scores(d, labels.where("doc_id < 0")).collect()
    assert {r.predicted for r in none} == {1}
    assert Q.quality_scores(d.where("false"), labels).collect() == []
