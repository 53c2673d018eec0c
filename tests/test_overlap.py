"""Counts of grams inside rows, against counting by hand."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiermill.operators import ngrams as NG
from tiermill.operators import overlap as OV


def grams(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def by_hand(hyp, ref):
    out = {}
    for n in range(1, 5):
        h, r = grams(hyp, n), grams(ref or [], n)
        out |= {f"m{n}": sum(min(c, r[g]) for g, c in h.items()), f"t{n}": sum(h.values()),
                f"mm{n}": sum(c for g, c in r.items() if g in h), f"mt{n}": sum(r.values())}
    return out


def rows_of(n, seed=3):
    rng = np.random.default_rng(seed)
    some = lambda: [f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 12))]
    return [(i, some(), None if i % 11 == 5 else some()) for i in range(n)] + [(n, ["a"] * 700, ["a"] * 650), (n + 1, [], []), (n + 2, ["a", None, "a"], ["a", None])]


def test_rows_count_their_own_grams(spark):
    rows = rows_of(600)  # more than a slice
    df = spark.createDataFrame(rows, "k long, h array<string>, r array<string>").repartition(3)
    st = OV.row_stats(df.select("k", OV.hashes("h").alias("h"), OV.hashes("r").alias("r")), ["k"], "h", "r", 4, unigrams=True)
    got = {x.k: x.asDict() for x in st.collect()}
    assert len(got) == len(rows)
    for k, h, r in rows:
        assert {c: got[k][c] for c in by_hand(h, r)} == by_hand(h, r), k
        assert (got[k]["hl"], got[k]["rl"], got[k]["nref"]) == (len(h), len(r or []), int(r is not None))
        both = grams(h, 1), grams(r or [], 1)
        assert sorted((u["b"], u["c"]) for u in got[k]["uni"] or []) == sorted((min(c, both[0][g]), c) for g, c in both[1].items())


def test_slices_cover_all_rows():
    sizes = np.array([3, 5, 900, 1, 1, 1, 2000, 7])
    for most, room in ((2, 10), (16, 1), (256, 1000)):
        got = list(OV.slices(sizes, most, room))
        assert [i for a, z in got for i in range(a, z)] == list(range(len(sizes)))
        assert all(z - a <= most and (z - a == 1 or sizes[a:z].sum() <= room) for a, z in got)


def test_repeated_and_null_keys_count_together(spark):
    rows = [(1, "x", ["a", "b"], ["a"]), (1, "x", ["b"], ["b", "b"]), (None, "x", ["a"], ["a"]), (None, "x", ["a"], ["c"]), (2, "x", ["a", "b"], ["b", "a"]),
            (3, None, ["a"], ["a"])]
    df = spark.createDataFrame(rows, "k long, lang string, hyp_tokens array<string>, r array<string>").withColumn("refs", F.array("r"))
    kw = spark.createDataFrame([("x", "b")], "kw_group string, token string")
    got = {x.k: x for x in NG.ngram_stats(df, ["k"], keywords=kw, kw_col="lang").collect()}
    assert (got[1].hl, got[1].rl, got[1].m1, got[1].d1) == (3, 3, 3, 3) and got[1].wn1 == pytest.approx(0.2 + 2.0)
    assert (got[None].hl, got[None].m1, got[None].mt1) == (2, 1, 2)
    assert (got[2].m1, got[2].m2, got[2].wn1) == (2, 0, pytest.approx(1.2)) and got[3].wn1 == pytest.approx(0.2)


def test_no_gram_becomes_a_row(spark):
    """Grams as rows are what filled the disk: texts of different keys must not be exploded."""
    df = spark.createDataFrame([(1, ["a"], ["a"])], "k long, hyp_tokens array<string>, r array<string>").withColumn("refs", F.array("r"))
    plan = NG.ngram_stats(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "MapInArrow" in plan


def test_references_in_parts_equal_pooled_grams(spark):
    """Keys with none, few and many references (several parts), null texts, a key without hypothesis, repeated and null keys."""
    rng = np.random.default_rng(5)
    text = lambda: [f"w{x}" for x in rng.integers(0, 8, rng.integers(0, 20))]
    n_refs = {0: 0, 1: 1, 2: 5, 3: 15, 4: 16, 5: 90, 6: 31, 7: 2}
    hyps = [(k, "xy"[k % 2] if k != 6 else None, text()) for k in n_refs] + [(7, "y", text()), (8, "x", None), (None, "x", text())]
    refs = [(k, i, text() if (k + i) % 9 else None) for k, n in n_refs.items() for i in range(n)] + [(8, 0, text()), (9, 0, text()), (2, 1, text()), (None, 1, text())]
    kw = spark.createDataFrame([("x", "w1"), ("y", "w2"), ("y", "w3")], "kw_group string, token string")
    h = spark.createDataFrame(hyps, "k long, lang string, tokens array<string>").repartition(3)
    r = spark.createDataFrame(refs, "k long, i long, tokens array<string>").repartition(4)
    for keywords, kw_col in ((kw, "lang"), (None, None)):
        carry = [c for c in ("k", kw_col) if c]
        got = NG.reference_stats(h, r, "k", "i", keywords=keywords, kw_col=kw_col).collect()
        want = NG._pooled_references(h, r, "k", "i", "tokens", keywords, kw_col, 4).collect()
        order = lambda rows: sorted((tuple(str(x[c]) for c in carry), *[round(v, 9) for v in x[len(carry):]]) for x in rows)  # noqa: B023, E731
        assert order(got) == order(want) and len(got) == len(hyps)


def test_references_leave_their_grams_in_the_part(spark):
    h = spark.createDataFrame([(1, ["a"])], "k long, tokens array<string>")
    r = spark.createDataFrame([(1, 1, ["a"]), (1, 2, ["b"])], "k long, i long, tokens array<string>")
    plan = NG.reference_stats(h, r, "k", "i")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "MapInArrow" in plan


def test_membership_in_rows(spark):
    from tiermill.operators import trees as TR
    rows = [(1, ["a", "b", "a", "b"], ["a", "b"]), (2, ["a"], []), (3, ["a", "b"], None), (4, None, ["a", "b", "c"]), (5, ["a", "b"], ["b"]),
            (5, ["c"], ["a", "b"]), (None, ["a", "b"], ["a", "b"]), (None, ["x", "y"], ["a", "z"])]
    df = spark.createDataFrame(rows, "k long, r array<string>, h array<string>")
    got = {x.k: (x.matched, x.total, x.ratio) for x in TR.membership_in_rows(df, ["k"], TR.adjacent_pairs("r"), TR.adjacent_pairs("h")).collect()}
    assert got == {1: (2, 3, 2 / 3), 3: (0, 1, 0.0), 4: (0, 0, None), 5: (1, 1, 1.0), None: (1, 2, 0.5)}
    plan = TR.membership_in_rows(df.where("k < 5"), ["k"], TR.adjacent_pairs("r"), TR.adjacent_pairs("h"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan
