"""Tiering and rewards.

Inputs are tables, not program runs:
  exec_results (keys..., cand_idx, run_ok, stdout)  one row per candidate
  gt_results   (keys..., run_ok, stdout)            one row per sample
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermill.functions.ints import floor_div
from tiermill.functions.text import FENCE, GT_FAILED, py_strip

PERFECT, SYNC, FAILED = "perfect", "sync", "failed"
# Rewards of the group-reward policy, and the format reward.
REWARD_PERFECT, REWARD_SYNC, REWARD_FAILED, REWARD_GT_FAILED = 1.0, 0.5, 0.1, 0.0
FORMAT_REWARD = 0.1


def join_gt(cands: DataFrame, gt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate result <- ground-truth result of its sample (n:1, left).

    Shuffle join on the sample key; a hot sample is split by AQE skew-join
    (the gt side has one row per key).
    """
    g = gt.select(*keys, F.col("run_ok").alias("gt_ok"), F.col("stdout").alias("gt_stdout"))
    return cands.join(g, list(keys), "left")


def tier(df: DataFrame, policy: str = "pairs") -> DataFrame:
    """Add ``tier`` (and ``reward`` for policy "reward") to joined results.

    policy "pairs": a failed ground truth is compared through a placeholder,
    so runs become sync.  policy "reward": a failed ground truth makes every
    candidate failed with reward 0.0.
    """
    ok = F.coalesce(F.col("run_ok"), F.lit(False))
    gt_ok = F.coalesce(F.col("gt_ok"), F.lit(False))
    if policy == "pairs":
        gt_out = F.when(gt_ok, F.col("gt_stdout")).otherwise(F.lit(GT_FAILED))
        equal = py_strip(F.coalesce(F.col("stdout"), F.lit(""))) == py_strip(F.coalesce(gt_out, F.lit("")))
        t = F.when(ok & equal, PERFECT).when(ok, SYNC).otherwise(FAILED)
        return df.withColumn("tier", t)
    if policy == "reward":
        equal = py_strip(F.coalesce(F.col("stdout"), F.lit(""))) == py_strip(F.coalesce(F.col("gt_stdout"), F.lit("")))
        t = F.when(~gt_ok, FAILED).when(ok & equal, PERFECT).when(ok, SYNC).otherwise(FAILED)
        r = (F.when(~gt_ok, REWARD_GT_FAILED).when(ok & equal, REWARD_PERFECT)
              .when(ok, REWARD_SYNC).otherwise(REWARD_FAILED))
        return df.withColumn("tier", t).withColumn("reward", r)
    raise ValueError(f"unknown policy {policy!r}")


def tier_counts(tiered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-sample counts of each tier (before any dedupe); partial aggregation."""
    return tiered.groupBy(*keys).agg(
        F.count_if(F.col("tier") == PERFECT).alias("n_perfect"),
        F.count_if(F.col("tier") == SYNC).alias("n_sync"),
        F.count_if(F.col("tier") == FAILED).alias("n_failed"),
    )


def tier_samples(tiered: DataFrame, keys: Sequence[str], order: str, value: str,
                 caps: dict[str, int] | None = None) -> DataFrame:
    """First ``caps[tier]`` values per tier by candidate order, as arrays.

    The row_number filter runs before the collect, so a group never gathers
    more than ``max(caps)`` rows per tier (Spark inserts a partial
    WindowGroupLimit before the exchange).
    """
    caps = caps or {PERFECT: 1, SYNC: 3, FAILED: 3}
    top = max(caps.values())
    cap = F.lit(0)
    for t, n in caps.items():
        cap = F.when(F.col("tier") == t, F.lit(n)).otherwise(cap)
    w = Window.partitionBy(*keys, "tier").orderBy(order)
    kept = (tiered.withColumn("_rn", F.row_number().over(w))
            .filter((F.col("_rn") <= top) & (F.col("_rn") <= cap)))
    aggs = []
    for t in caps:
        aggs.append(F.transform(
            F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))),
            lambda s: s["v"]).alias(f"{t}_samples"))
    return kept.groupBy(*keys).agg(*aggs)


def format_reward(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit("")).contains(FENCE), F.lit(FORMAT_REWARD)).otherwise(F.lit(0.0))


def total_reward(df: DataFrame, registry: dict[str, Column], out: str = "total_reward") -> DataFrame:
    """Add one column per reward function and their sum."""
    for name, col in registry.items():
        df = df.withColumn(name, col)
    total = None
    for name in registry:
        total = F.col(name) if total is None else total + F.col(name)
    return df.withColumn(out, total if total is not None else F.lit(0.0))


def group_of_k(df: DataFrame, pos: str, k: int, carry: Sequence[str]) -> DataFrame:
    """Groups of ``k`` consecutive rows by ``pos``; the first row's ``carry``
    columns apply to the whole group.  Each window partition holds at most k
    rows by construction."""
    g = floor_div(pos, k)
    w = Window.partitionBy("group_id").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("group_id", g)
    for c in carry:
        out = out.withColumn(f"group_{c}", F.first(c).over(w))
    return out


def exec_rates(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Run rate, runtime-equivalence rate and mean first-error position.  A candidate without an equal output of
    a ground truth that ran counts as not equivalent (nulls included), so both rates are over all ``n`` rows."""
    ok = F.coalesce(F.col("run_ok"), F.lit(False))
    same = F.coalesce(ok & F.col("gt_ok") & (py_strip("stdout") == py_strip("gt_stdout")), F.lit(False))
    return results.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(ok.cast("double")).alias("run_rate"),
        F.avg(same.cast("double")).alias("equiv_rate"),
        F.avg("err_pos").alias("mean_err_pos"),
    )


def group_reward(df: DataFrame, group: str, order: str, fn, schema: str) -> DataFrame:
    """User reward function over whole groups of completions, batched.

    ``fn`` gets a pandas frame holding complete groups (any number of them)
    sorted by (group, order) and returns one row per completion; like a
    trainer's reward callback it sees many groups per call, so it should
    use group-wise pandas operations.  Rows are hash-partitioned by group
    and sorted, then passed through ``mapInPandas`` in Arrow batches; a
    group cut by a batch boundary is held back and joined to the next
    batch.  A group is the k completions of one prompt (bounded)."""
    import pandas as pd

    def run(batches):
        held, name = [], None  # the frames of the last group so far, put together once
        for pdf in batches:
            if not len(pdf):
                continue
            last = pdf[group].iloc[-1]
            tail = pdf[group].isna() if pd.isna(last) else pdf[group] == last
            if held and tail.all() and (pd.isna(last) and pd.isna(name) or last == name):
                held.append(pdf)
                continue
            done = pd.concat([*held, pdf[~tail]], ignore_index=True)
            held, name = [pdf[tail]], last
            if len(done):
                yield fn(done)
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, schema)


def group_advantage(df: DataFrame, group: Sequence[str], reward: str = "reward", out: str = "advantage") -> DataFrame:
    """(reward - mean of the group) / sample standard deviation of the group;
    0 where the group has no spread.  The two statistics come from one
    aggregation with partial sums and are joined back, so a hot group is not
    sorted in one task."""
    stats = df.groupBy(*group).agg(F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_sd"))
    a = F.when(F.col("_sd") > 1e-9, (F.col(reward) - F.col("_mean")) / F.col("_sd")).otherwise(F.lit(0.0))
    return df.join(stats, list(group)).withColumn(out, a).drop("_mean", "_sd")


def weighted_sample(df: DataFrame, by: Sequence[str], weight: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows per group, drawn without replacement with chances in
    proportion to ``weight``: the n smallest of -ln(u) / weight, where u in
    (0, 1) comes from an md5 of seed and key (reproducible).  Rows without a
    positive weight are never drawn.  The row_number filter gets a partial
    limit before the exchange."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") + 0.5) / float(16 ** 12)
    w = Window.partitionBy(*by).orderBy("draw", key)
    return (df.where(F.col(weight) > 0).withColumn("draw", -F.log(u) / F.col(weight))
              .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))
