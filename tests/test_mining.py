"""Tiering, rewards and pair mining."""

from pyspark.sql import functions as F

from tiermill.operators import pairs as P
from tiermill.operators import tiers as T


def test_tier_policies_differ_on_failed_gt(spark):
    cands = spark.createDataFrame([(1, 0, True, "5"), (1, 1, False, ""), (1, 2, True, "GT_FAILED_PLACEHOLDER"),
                                   (2, 0, True, " 7\n"), (2, 1, True, "8"), (2, 2, False, "7")],
                                  "s long, cand_idx int, run_ok boolean, stdout string")
    gt = spark.createDataFrame([(1, False, ""), (2, True, "7")], "s long, run_ok boolean, stdout string")
    j = T.join_gt(cands, gt, ["s"])
    pairs = {(r["s"], r["cand_idx"]): r["tier"] for r in T.tier(j, "pairs").collect()}
    rew = {(r["s"], r["cand_idx"]): (r["tier"], r["reward"]) for r in T.tier(j, "reward").collect()}
    assert pairs == {(1, 0): "sync", (1, 1): "failed", (1, 2): "perfect",
                     (2, 0): "perfect", (2, 1): "sync", (2, 2): "failed"}
    assert rew[(1, 0)] == ("failed", 0.0) and rew[(1, 2)] == ("failed", 0.0)
    assert rew[(2, 0)] == ("perfect", 1.0) and rew[(2, 1)] == ("sync", 0.5) and rew[(2, 2)] == ("failed", 0.1)


def cands(spark, rows):
    return spark.createDataFrame(rows, "s long, cand_idx long, code string, tier string")


def test_strategy_c_only_without_sync(spark):
    df = cands(spark, [(1, 1, "p1", "perfect"), (1, 2, "f1", "failed"), (1, 3, "f2", "failed"),
                       (2, 1, "p", "perfect"), (2, 2, "s", "sync"), (2, 3, "f", "failed")])
    arr = P.tier_pair_arrays(P.cap_tiers(P.dedupe_tiers(df, ["s"]), ["s"]), ["s"])
    got = sorted((r["s"], r["p"]["strategy"], r["p"]["chosen_id"], r["p"]["rejected_id"])
                 for r in arr.select("s", F.explode("pairs").alias("p")).collect())
    assert got == [(1, "C", 1, 2), (1, "C", 1, 3), (2, "A", 1, 2), (2, "B", 2, 3)]


def test_equal_pairs_do_not_use_up_the_cap(spark):
    # the same text in perfect and sync gives an equal pair; it is skipped
    # before the cap, so the cap still fills with distinct pairs
    rows = [(1, 1, "x", "perfect"), (1, 2, "y", "perfect"), (1, 3, "x", "sync"), (1, 4, "z", "sync"),
            (1, 5, "w", "sync")]
    out = P.mine_pairs(cands(spark, rows), ["s"], max_pairs=4).collect()
    assert len(out) == 4
    assert all(r["chosen"] != r["rejected"] for r in out)
    assert sorted(r["pair_rank"] for r in out) == [1, 2, 3, 4]


def test_pairs_bounded_and_ordered(spark):
    rows = [(g, i, f"t{g}-{i % 9}", ["perfect", "sync", "failed"][i % 3]) for g in range(5) for i in range(40)]
    out = P.mine_pairs(cands(spark, rows), ["s"], max_pairs=4)
    per = {r["s"]: r["n"] for r in out.groupBy("s").count().withColumnRenamed("count", "n").collect()}
    assert per and max(per.values()) <= 4
    better = {"A": ("perfect", "sync"), "B": ("sync", "failed"), "C": ("perfect", "failed")}
    tiers = {(r["s"], r["cand_idx"]): r["tier"] for r in cands(spark, rows).collect()}
    for r in out.collect():
        assert (tiers[(r["s"], r["chosen_id"])], tiers[(r["s"], r["rejected_id"])]) == better[r["strategy"]]


def test_mining_independent_of_partitioning(spark):
    rows = [(g, i, f"c{(g * i) % 11}", ["perfect", "sync", "failed"][(g + i) % 3]) for g in range(8) for i in range(30)]
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        df = cands(spark, rows).repartition(n)
        return sorted(tuple(r) for r in P.mine_pairs(df, ["s"]).select("s", "chosen_id", "rejected_id", "pair_rank").collect())
    a, b = run(3), run(13)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b and a


def test_tier_samples_first_by_order(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["sync"] * 5 + ["perfect"] * 2)],
                               "s long, cand_idx long, tier string")
    r = T.tier_samples(df, ["s"], "cand_idx", "cand_idx").first()
    assert r["perfect_samples"] == [5] and r["sync_samples"] == [0, 1, 2] and r["failed_samples"] == []


def test_group_reward_keeps_groups_whole_across_batches(spark):
    import pandas as pd

    def sizes(pdf):
        n = pdf.groupby("g")["i"].transform("size")
        return pd.DataFrame({"g": pdf["g"], "i": pdf["i"], "n": n.astype("int64")})

    df = spark.createDataFrame([(g, i) for g in range(50) for i in range(7)], "g long, i long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = T.group_reward(df, "g", "i", sizes, "g long, i long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 350 and all(r["n"] == 7 for r in got)


def test_exec_rates_count_missing_outputs(spark):
    rows = [("a", True, "1", True, "1", None), ("a", True, "1", None, None, None), ("a", True, "1", False, "1", 3.0), ("a", None, None, True, "1", 5.0)]
    r, = T.exec_rates(spark.createDataFrame(rows, "l string, run_ok boolean, stdout string, gt_ok boolean, gt_stdout string, err_pos double"), ["l"]).collect()
    assert (r["n"], r["run_rate"], r["equiv_rate"], r["mean_err_pos"]) == (4, 0.75, 0.25, 4.0)


def test_group_reward_keeps_a_null_group_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = spark.createDataFrame([(None if i < 12 else 1, i) for i in range(20)], "g long, i long")
        size = lambda pdf: pdf.assign(n=pdf.groupby("g", dropna=False)["i"].transform("size")).astype({"g": "Int64"})
        got = T.group_reward(df, "g", "i", size, "g long, i long, n long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["g"], r["n"]) for r in got} == {(None, 12), (1, 8)}


def test_mine_runs_uses_the_ground_truth_when_all_candidates_failed(spark):
    c = spark.createDataFrame([(1, 1, "bad", False, ""), (1, 2, "worse", False, ""), (2, 1, "bad", False, ""), (2, 2, "long " * 20, False, "")],
                              "s long, cand_idx long, code string, run_ok boolean, stdout string")
    gt = spark.createDataFrame([(1, 9, "good", True, "7"), (2, 9, "good", False, "")], "s long, cand_idx long, code string, run_ok boolean, stdout string")
    got = P.mine_runs(c, gt, ["s"], F.lit("two words"), max_tokens=5).collect()
    assert sorted((r["s"], r["strategy"], r["chosen_id"], r["rejected_id"]) for r in got) == [(1, "C", 9, 1), (1, "C", 9, 2), (2, "C", 9, 1)]
    assert P.mine_runs(c, gt, ["s"], F.lit("w " * 5), max_tokens=5).count() == 0  # prompt and answer count together


def test_group_advantage_and_weighted_sample(spark):
    d = spark.createDataFrame([("g", i, float(r)) for i, r in enumerate([1, 0, 0.5])] + [("h", 7, 1.0), ("i", 8, 0.2), ("i", 9, 0.2)],
                              "g string, id long, reward double")
    a = {r["id"]: round(r["advantage"], 6) for r in T.group_advantage(d, ["g"]).collect()}
    assert a == {0: 1.0, 1: -1.0, 2: 0.0, 7: 0.0, 8: 0.0, 9: 0.0}
    w = spark.range(2000).select(F.lit("x").alias("c"), "id", F.when(F.col("id") < 1000, 9.0).when(F.col("id") < 1990, 1.0).otherwise(0.0).alias("w"))
    s = [r["id"] for r in T.weighted_sample(w, ["c"], "w", "id", 200).collect()]
    assert len(set(s)) == 200 and 160 < sum(i < 1000 for i in s) < 198 and max(s) < 1990


def test_category_report_loss_and_rollup_level(spark):
    from tiermill.operators.score import category_report
    d = spark.createDataFrame([("a", "u", 0.5, 0.5, 2.0), (None, "u", 1.0, 0.0, 4.0)], "category string, source string, codebleu double, p_score double, loss double")
    assert {(r["category"], r["avg_loss"]) for r in category_report(d).collect()} == {("a", 2.0), (None, 4.0)}
    levels = [(r["category"], r["level"], r["avg_loss"]) for r in category_report(d, ["category"], rollup=True).collect()]
    assert sorted(levels, key=str) == sorted([("a", 0, 2.0), (None, 0, 4.0), (None, 1, 3.0)], key=str)
