"""Preference metrics and batch padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiermill.functions.arrays import neg_log_sigmoid, pad_to


def pref_metrics(logps: DataFrame, by: Sequence[str], beta: float = 0.1) -> DataFrame:
    """From (pair_id, role, policy_logp, ref_logp) rows, per group ``by``:
    mean chosen/rejected reward, accuracy (strict >), margin, mean chosen /
    rejected policy log-prob and loss = mean -log sigmoid(margin).
    Two partial aggregations.  Pairs without exactly one row per side enter no
    mean; ``n_incomplete`` counts them."""
    by = list(by)
    ch, rj = F.col("role") == "chosen", F.col("role") == "rejected"
    per_pair = (logps.groupBy(*by, "pair_id").agg(
        F.max(F.when(ch, F.col("policy_logp"))).alias("pc"), F.max(F.when(ch, F.col("ref_logp"))).alias("rc"),
        F.max(F.when(rj, F.col("policy_logp"))).alias("pr"), F.max(F.when(rj, F.col("ref_logp"))).alias("rr"),
        F.count_if(ch).alias("nc"), F.count_if(rj).alias("nr")))
    ok = (F.col("nc") == 1) & (F.col("nr") == 1)
    per_pair = per_pair.select(*by, ok.alias("ok"), *[F.when(ok, F.col(c)).alias(c) for c in ("pc", "rc", "pr", "rr")])
    b = F.lit(beta)
    x = (per_pair.withColumn("cr", b * (F.col("pc") - F.col("rc")))
                 .withColumn("rr_", b * (F.col("pr") - F.col("rr")))
                 .withColumn("margin", F.col("cr") - F.col("rr_")))
    return x.groupBy(*by).agg(
        F.count_if("ok").alias("n_pairs"), F.count_if(~F.col("ok")).alias("n_incomplete"),
        F.avg("cr").alias("rewards_chosen"), F.avg("rr_").alias("rewards_rejected"),
        F.avg((F.col("cr") > F.col("rr_")).cast("double")).alias("accuracy"),
        F.avg("margin").alias("margin"), F.avg("pc").alias("logps_chosen"), F.avg("pr").alias("logps_rejected"),
        F.avg(neg_log_sigmoid(F.col("margin"))).alias("loss"))


def pad_batch(df: DataFrame, batch: str, cols: dict[str, object]) -> DataFrame:
    """Right-pad each array column to the longest in its batch.
    ``cols`` maps column -> pad value (ids: pad id, mask: 0, labels: -100).
    A batch is a small, fixed-size group, so the window stays small."""
    w = Window.partitionBy(batch)
    first = next(iter(cols))
    out = df.withColumn("_maxlen", F.max(F.size(first)).over(w))
    for c, v in cols.items():
        out = out.withColumn(c, pad_to(c, F.col("_maxlen"), v))
    return out.drop("_maxlen")

