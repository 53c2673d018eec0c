"""Keyed permutations, references in any number, rewards called from SQL."""

import random

import pytest
from pyspark.sql import functions as F

from tiermill.operators import ngrams as NG
from tiermill.operators import report as RP
from tiermill.operators import rewards as RW


def test_every_epoch_is_a_bijection(spark):
    for n in (0, 1, 2, 3, 5, 17, 100, 1000):
        d = spark.range(n).select((F.col("id") * 7 - 3).alias("k"))
        got = RP.epoch_order(d, "k", 3, seed=n).collect()
        orders = [[r.k for r in sorted(got, key=lambda r: r.position) if r.epoch == e] for e in range(3)]
        for e in range(3):
            assert sorted(r.position for r in got if r.epoch == e) == list(range(n))
        if n >= 100:
            assert len({tuple(o) for o in orders}) == 3 and all(o != sorted(o) for o in orders)
    far = spark.range(1).select(RP.permuted(F.lit(10**12 - 1), F.lit(10**12), F.lit("s")).alias("p")).first().p
    assert 0 <= far < 10**12


def test_positions_are_spread(spark):
    """Neighbours in number aren't neighbours in position: mean distance as in a random order, a third of n."""
    n = 3000
    at = [r.p for r in spark.range(n).select("id", RP.permuted(F.col("id"), F.lit(n), F.lit("7|0")).alias("p")).orderBy("id").collect()]
    mean = sum(abs(a - b) for a, b in zip(at, at[1:])) / (n - 1)
    assert 0.8 * n / 3 < mean < 1.2 * n / 3


def test_references_as_rows_equal_one_reference_in_a_row(spark):
    rng = random.Random(1)
    words = "a b c d e".split()
    rows = [(i, "en", [rng.choice(words) for _ in range(rng.randrange(0, 12))], [rng.choice(words) for _ in range(rng.randrange(0, 12))]) for i in range(40)]
    kw = spark.createDataFrame([("en", "a"), ("en", "c")], "kw_group string, token string")
    one = NG.ngram_stats(spark.createDataFrame([(i, k, h, [r]) for i, k, h, r in rows], "k long, lang string, hyp_tokens array<string>, refs array<array<string>>"),
                         ["k"], keywords=kw, kw_col="lang")
    many = NG.reference_stats(spark.createDataFrame([(i, k, h) for i, k, h, _ in rows], "k long, lang string, tokens array<string>"),
                              spark.createDataFrame([(i, 0, r) for i, _, _, r in rows], "k long, ref int, tokens array<string>"), "k", "ref",
                              keywords=kw, kw_col="lang")
    assert one.columns == many.select(one.columns).columns
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(one.columns).collect())
    assert rounded(one) == rounded(many)


def test_five_hundred_references(spark):
    refs = [(1, i, ["x", "y", "z", f"w{i}"]) for i in range(500)] + [(1, 500, None), (3, 0, ["q"])]
    hyps = [(1, ["x", "y", "z", "w7"]), (2, ["x"]), (3, [])]
    st = NG.reference_stats(spark.createDataFrame(hyps, "k long, tokens array<string>"),
                            spark.createDataFrame(refs, "k long, ref int, tokens array<string>"), "k", "ref")
    got = {r.k: r for r in st.withColumn("bleu", NG.bleu_col()).collect()}
    assert got[1].bleu == pytest.approx(1.0) and got[1].m4 == 1 and got[1].mt1 == 2000 and got[1].rl == 4
    assert got[1].wd2 == 1500 and got[2].m1 == 0 and got[2].bleu == 0 and got[3].hl == 0 and got[3].rl == 1


def test_rewards_by_name(spark):
    class Best:
        """Reward: is the row better than all before it in its group?  State: one number."""

        def __init__(self):
            self.top = None

        def score(self, row):
            better = self.top is None or row["v"] > self.top
            self.top = row["v"] if better else self.top
            return 1.0 if better else None

    RW.register_reward(spark, "best_so_far", Best, "g string, i bigint")
    rows = [("a", 0, 3), ("a", 1, 2), ("b", 0, 1), ("a", 2, 5), ("b", 1, 2), (None, 0, 9), (None, 1, 1)]
    t = spark.createDataFrame(rows, "g string, i bigint, v bigint").repartition(3)
    out = spark.sql("SELECT * FROM best_so_far(TABLE(SELECT * FROM {t}) PARTITION BY g ORDER BY i)", t=t)
    assert {(r.g, r.i): r.reward for r in out.collect()} == {("a", 0): 1.0, ("a", 1): None, ("a", 2): 1.0, ("b", 0): 1.0, ("b", 1): 1.0,
                                                             (None, 0): 1.0, (None, 1): None}


def test_a_long_group_streams_through(spark):
    """One group of 200,000 rows: the scorer sees them in order and holds a counter only."""
    class Nth:
        def __init__(self):
            self.n = 0

        def score(self, row):
            assert row["i"] == self.n
            self.n += 1
            return float(self.n)

    RW.register_reward(spark, "nth", Nth, "i bigint")
    t = spark.range(200_000).select(F.col("id").alias("i"), F.lit(1).alias("g")).repartition(5)
    out = spark.sql("SELECT * FROM nth(TABLE(SELECT * FROM {t}) PARTITION BY g ORDER BY i)", t=t)
    assert out.agg(F.sum(F.when(F.col("reward") == F.col("i") + 1, 1).otherwise(0))).first()[0] == 200_000
