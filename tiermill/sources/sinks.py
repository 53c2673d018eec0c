"""Sinks (K1-K7).  All writers are distributed DataFrame writes."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.operators.tiers import FAILED, PERFECT, SYNC, tier_samples

# The record fields that readers look for.
DATA_FIELDS = ("id", "loss", "p_score", "codebleu", "gt_code", "rollout", "instruction", "input")


def scored_records(df: DataFrame, fields: Sequence[str] = DATA_FIELDS, category: str = "category") -> DataFrame:
    """Nested record: category + struct ``data`` of the present fields."""
    present = [f for f in fields if f in df.columns]
    return df.select(F.col(category).alias("category"), F.struct(*present).alias("data"))


def write_scored(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line (UTF-8 kept as is)."""
    scored_records(df).write.mode(mode).json(path)


def report_line(id_col: str, score_col: str, loss_col: str) -> F.Column:
    """One-line text report with five decimals."""
    return F.format_string("ID: %s\tCodeBLEU: %.5f\tLoss: %.5f", F.col(id_col), F.col(score_col), F.col(loss_col))


# The head of a whole report, the rule under it and the titles of its texts.
REPORT_HEAD = "ID: %s\nCodeBLEU: %.5f\nLoss: %.5f\n"
RULE = "-" * 30
REF_TITLE, ROLLOUT_TITLE = "GT:", "Rollout:"


def report_body(id_col: str, score_col: str, loss_col: str, ref_col: str, rollout_col: str) -> F.Column:
    """The whole report of a sample: score and loss with five decimals, a rule, then the reference and the rollout in full."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.format_string(REPORT_HEAD, F.col(id_col), F.col(score_col), F.col(loss_col))
    return F.concat(head, F.lit(f"{RULE}\n{REF_TITLE}\n"), text(ref_col), F.lit(f"\n\n{ROLLOUT_TITLE}\n"), text(rollout_col))


def write_report_bodies(df: DataFrame, path: str, report: F.Column, by: str = "category", mode: str = "errorifexists") -> None:
    """Whole reports in one folder per category, many in a file, each closed by a record separator (ASCII 30) and a line break: a
    file per sample would be as many files as samples.  :func:`read_report_bodies` reads them back."""
    df.select(F.col(by), F.concat(report, F.lit("\x1e")).alias("value")).write.mode(mode).partitionBy(by).text(path)


def read_report_bodies(spark: SparkSession, path: str, by: str = "category") -> DataFrame:
    """``by, report``."""
    x = spark.read.option("lineSep", "\x1e\n").schema(f"value string, `{by}` string").text(path)
    return x.where(F.length("value") > 0).select(by, F.col("value").alias("report"))


def write_reports(df: DataFrame, path: str, report: F.Column, by: str = "category", mode: str = "errorifexists") -> None:
    """Text reports in one folder per category (not one file per row)."""
    df.select(F.col(by), report.alias("value")).write.mode(mode).partitionBy(by).text(path)


def in_line_order(df: DataFrame, order: str = "line_no") -> DataFrame:
    """Range-partitioned and sorted within partitions, so that part files concatenate in order."""
    return df.repartitionByRange(order).sortWithinPartitions(order)


def write_lines(df: DataFrame, path: str, value: str = "value", order: str = "line_no", mode: str = "errorifexists", ordered: bool = False) -> None:
    """One output line per row in ``order``.  ``ordered``: the rows come from :func:`in_line_order`, so that the lines, which are often
    larger than what they are made of, need not be sampled and shuffled."""
    x = df if ordered else in_line_order(df, order)
    x.select(F.col(value).cast("string").alias("value")).write.mode(mode).text(path)


def write_keywords(keywords: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """``kw_group, token`` as keyword files, a keyword per line in a sub-folder per group; :func:`readers.read_keywords` reads
    them, as it reads plain files ``<group>.txt``."""
    keywords.select("kw_group", F.col("token").alias("value")).write.mode(mode).partitionBy("kw_group").text(folder)


def write_array(df: DataFrame, path: str, order: str, fields: Sequence[str], mode: str = "errorifexists") -> None:
    """Rows as JSON arrays in ``order``, one array per part file, an element per line."""
    def lines(batches):
        begun = False
        for b in batches:
            text = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([("," if begun or i else "[") + t for i, t in enumerate(text)])], ["value"])
            begun = begun or bool(text)
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"])], ["value"])

    x = df.repartitionByRange(order).sortWithinPartitions(order)
    x.select(F.to_json(F.struct(*fields)).alias("value")).mapInArrow(lines, "value string").write.mode(mode).text(path)


def rollout_records(df: DataFrame, epoch: F.Column, rank: F.Column, sample: Sequence[str], stats: Sequence[str],
                    samples: dict[str, str]) -> DataFrame:
    """Full log record: epoch, rank, the sample's own fields, a struct of its
    tier counts and a struct of its kept texts per tier (arrays)."""
    return df.select(epoch.alias("epoch"), rank.alias("rank"), *sample, F.struct(*stats).alias("stats"),
                     F.struct(*[F.col(c).alias(t) for t, c in samples.items()]).alias("samples"))


def append_rollouts(df: DataFrame, path: str, by: Sequence[str] = ("epoch",)) -> None:
    """Append-only JSON-lines log, one folder per epoch (and rank)."""
    df.write.mode("append").partitionBy(*by).json(path)


def every(df: DataFrame, step: str, n: int) -> DataFrame:
    return df.filter(F.pmod(F.col(step), F.lit(n)) == 0)


def reward_records(rewarded: DataFrame, keys: Sequence[str], order: str, text: str, step: F.Column, epoch: F.Column, rank: F.Column,
                   instruction: F.Column, lang: F.Column, caps: dict[str, int] | None = None) -> DataFrame:
    """The reward form of the log, a record per sample: step, epoch, rank, instruction and target language, the rewards in the
    candidates' order, the tiers' counts and the first ``caps[tier]`` texts of each (one perfect, two of the others)."""
    caps = caps or {PERFECT: 1, SYNC: 2, FAILED: 2}
    rewards = F.transform(F.array_sort(F.collect_list(F.struct(order, "reward"))), lambda x: x["reward"])
    per = rewarded.groupBy(*keys).agg(rewards.alias("rewards"), *[F.count_if(F.col("tier") == t).alias(t) for t in caps])
    samples = tier_samples(rewarded, keys, order, text, caps)
    x = per.join(samples, list(keys))
    return x.select(*keys, step.alias("global_step"), epoch.alias("epoch"), rank.alias("rank"), instruction.alias("instruction"),
                    lang.alias("target_lang"), "rewards", F.struct(*caps).alias("stats"),
                    F.struct(*[F.col(f"{t}_samples").alias(t) for t in caps]).alias("samples"))


def append_metrics(df: DataFrame, path: str, step: str, n: int) -> None:
    """Keep every n-th step and append it to a metrics table."""
    every(df, step, n).write.mode("append").parquet(path)


def preview(df: DataFrame, key: str, text_cols: Sequence[str], n_chars: int = 200) -> DataFrame:
    """The first row by ``key`` with its text columns cut to ``n_chars``."""
    return df.orderBy(key).limit(1).select(
        key, *[F.substring(F.col(c), 1, n_chars).alias(c) for c in text_cols])
