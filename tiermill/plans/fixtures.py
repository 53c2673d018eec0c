"""Stand-in inputs built from the driver tables (FIXTURES.md part C).

Each builder is a plain DataFrame plan over the given tables, so its work
grows with them.  The matching SQL lives in ``tiermill.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.functions.text import tokens
from tiermill.operators.joins import neighbours_in_group
from tiermill.operators.report import dense_index
from tiermill.operators.tiers import FAILED, PERFECT, SYNC
from tiermill.session import table
from tiermill.sources.sinks import in_line_order

SAMPLE_KEYS = ["user_id", "day"]
GROUP_KEYS = ["lang", "source"]


def tiered_documents(spark: SparkSession, sf: str) -> DataFrame:
    """labels JOIN documents; group (lang, source); toxic -> failed, quality -> perfect, else sync."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf, "labels")
    t = (F.when(F.col("toxic") == 1, F.lit(FAILED))
          .when(F.col("quality") == 1, F.lit(PERFECT)).otherwise(F.lit(SYNC)))
    return d.join(lab, "doc_id").select("lang", "source", "doc_id", "text", t.alias("tier"))


def events_runs(spark: SparkSession, sf: str) -> DataFrame:
    """events as program runs: sample = (user_id, day); run_ok = not error; stdout = props."""
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts",
        (F.col("event_type") != "error").alias("run_ok"), F.col("props").alias("stdout"),
        "event_type", "value")


def exec_stand_in(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(exec_results, gt_results): the earliest event (ts, event_id) of a
    sample is its ground truth, the other events are its candidates."""
    runs = events_runs(spark, sf)
    gt = (runs.groupBy(*SAMPLE_KEYS)
              .agg(F.min(F.struct("ts", "event_id", "run_ok", "stdout")).alias("g"))
              .select(*SAMPLE_KEYS, F.col("g.event_id").alias("gt_event_id"),
                      F.col("g.run_ok").alias("run_ok"), F.col("g.stdout").alias("stdout")))
    cands = (runs.join(gt.select(*SAMPLE_KEYS, "gt_event_id"), SAMPLE_KEYS)
                 .filter(F.col("event_id") != F.col("gt_event_id"))
                 .drop("gt_event_id")
                 .withColumnRenamed("event_id", "cand_idx"))
    return cands, gt


def fenced_pages(spark: SparkSession, sf: str) -> DataFrame:
    """reference = a page in a fence; hypothesis = the next page of its language, bare or as the first of two fences."""
    p = table(spark, sf, "pages").select("page_id", "html", F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"))
    nb = neighbours_in_group(p.select("page_id", "lang"), ["lang"], "page_id").select("page_id", "next_page_id", "prev_page_id")
    x = p.join(nb, "page_id")
    hyp = F.when(F.pmod("prev_page_id", F.lit(3)) == 0, F.col("html")).otherwise(
        F.concat(F.lit("Here it is:\n```html\n"), "html", F.lit("\n```\nOr this:\n```\n<p>none</p>\n```\n")))
    ref = F.concat(F.lit("The page:\n```html\n"), "html", F.lit("\n```\nDone."))
    # a page is the reference of its own pair and the hypothesis of the one before
    roles = F.array(F.struct(F.when(F.col("next_page_id").isNotNull(), F.col("page_id")).alias("pair_id"), F.lit(True).alias("is_ref")),
                    F.struct(F.col("prev_page_id").alias("pair_id"), F.lit(False).alias("is_ref")))
    x = x.select("lang", "html", "prev_page_id", F.explode(roles).alias("r")).where("r.pair_id IS NOT NULL")
    return x.select(F.col("r.pair_id").alias("page_id"), "lang", "r.is_ref", F.when(F.col("r.is_ref"), ref).otherwise(hyp).alias("text"))


def hyp_ref_documents(spark: SparkSession, sf: str) -> DataFrame:
    """reference = text tokens; hypothesis = same tokens with every 7th dropped.  Texts are dealt out by id before they become
    tokens: they are smaller then, and what is joined on the id later finds them there."""
    return hyp_ref(table(spark, sf, "documents").select("doc_id", "lang", "source", "text").repartition("doc_id")).select(
        "doc_id", "lang", "source", "hyp_tokens", "refs")


def hyp_ref(texts: DataFrame) -> DataFrame:
    """``texts`` with the tokens of :func:`hyp_ref_documents` in place of ``text``."""
    d = texts.withColumn("ref_tokens", tokens("text")).drop("text")
    return d.select(*[c for c in d.columns if c != "ref_tokens"], F.filter("ref_tokens", lambda x, i: (i + 1) % 7 != 0).alias("hyp_tokens"),
                    F.array("ref_tokens").alias("refs"))


def line_texts(spark: SparkSession, sf: str) -> DataFrame:
    """``line_no, doc_id, text`` in the order of the lines, a line per document: ids are numbered, texts joined, and what is
    derived from a text is computed after this shuffle, whose sample reads only what is here."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return in_line_order(dense_index(d.select("doc_id"), ["doc_id"], out="line_no").join(d, "doc_id").select("line_no", "doc_id", "text"))
