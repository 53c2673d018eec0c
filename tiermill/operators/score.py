"""Composite scoring.

composite = sum(w_i * part_i) / sum(w_i over present parts): a part that is
null (for example no tree for the language) drops out and the weights of
the others are renormalised.  Per-language weights come from a literal map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermill.functions.lang import map_literal
from tiermill.functions.prompts import hardness
from tiermill.functions.text import blank, first_fence, tokens
from tiermill.operators import ngrams as NG
from tiermill.operators import trees as TR

PARTS = ("ngram", "weighted", "syntax", "dataflow")
# Default weights, and the C++ weights (no data-flow part).
DEFAULT_WEIGHTS = (0.25, 0.25, 0.25, 0.25)
LANG_WEIGHTS = {"cpp": (0.3333, 0.3333, 0.3333, 0.0)}


def weight_cols(lang: Column | None, default=DEFAULT_WEIGHTS, by_lang=None) -> list[Column]:
    by_lang = LANG_WEIGHTS if by_lang is None else by_lang
    out = []
    for i in range(len(PARTS)):
        w = F.lit(float(default[i]))
        if lang is not None and by_lang:
            m = map_literal({k: str(v[i]) for k, v in by_lang.items()})
            w = F.coalesce(F.try_element_at(m, lang).cast("double"), w)
        out.append(w)
    return out


def composite(parts: Sequence[Column], weights: Sequence[Column]) -> Column:
    num = None
    den = None
    for p, w in zip(parts, weights):
        term = F.when(p.isNotNull(), w * p).otherwise(F.lit(0.0))
        wt = F.when(p.isNotNull(), w).otherwise(F.lit(0.0))
        num = term if num is None else num + term
        den = wt if den is None else den + wt
    return F.when(den > 0, num / den)


def score_clean(df: DataFrame, hyp_text, ref_text, score: Column) -> DataFrame:
    """Blank-side guard: 0.0 when either side is blank; hardness alongside.
    ``hyp_text`` / ``ref_text`` are text columns, or ready boolean "blank"
    columns (for example ``hl == 0`` when only token counts are at hand)."""
    hb = blank(hyp_text) if isinstance(hyp_text, str) else hyp_text
    rb = blank(ref_text) if isinstance(ref_text, str) else ref_text
    cb = F.when(hb | rb, F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0)))
    return df.withColumn("codebleu", cb).withColumn("p_score", hardness(F.col("codebleu")))


def pair_scores(sides: DataFrame, key: str, lang: str, is_ref: str, text: str, tags: Sequence[str] | None = None,
                top_k: int = 50) -> DataFrame:
    """Scores of text pairs (X1, X2), given as a row per side: the first fenced block of either side is what counts, and all
    four parts enter: n-gram, keyword-weighted (the ``top_k`` tokens of the references of a ``lang``), tree (share of the
    reference's subtrees that the hypothesis has) and edge part.  ``key, lang, ngram, weighted, syntax, dataflow, codebleu,
    p_score``, a row per pair; a part is null where the reference has none, and the others are renormalised.

    Every part reads the one column that the sides are gathered into, so that all share its exchange."""
    row = F.struct(F.col(is_ref).alias("is_ref"), F.col(lang).alias("lang"), first_fence(text).alias("code"))
    both = sides.select(key, row.alias("side")).groupBy(key).agg(F.collect_list("side").alias("sides"))
    at = lambda ref: F.get(F.filter("sides", lambda s: s["is_ref"] == F.lit(ref)), F.lit(0))
    code = lambda ref: F.coalesce(at(ref)["code"], F.lit(""))
    x = both.select(key, F.get("sides", F.lit(0))["lang"].alias(lang), code(False).alias("hyp"), code(True).alias("ref"))
    side = x.select(key, lang, tokens("hyp").alias("hyp_tokens"), tokens("ref").alias("ref_tokens"))
    kw = NG.top_tokens(side, lang, "ref_tokens", top_k)
    st = NG.ngram_stats(side.withColumn("refs", F.array("ref_tokens")), [key], keywords=kw, kw_col=lang, distinct=True)
    trees = [TR.tree_digests(x, [key], c, tags).select(key, "h") for c in ("ref", "hyp")]
    tree = TR.membership_ratio(*trees, [key], ["h"]).select(key, F.col("ratio").alias("syntax"))
    st = (st.join(tree, key, "left").withColumn("ngram", NG.bleu_col()).withColumn("weighted", NG.weighted_col())
            .withColumn("dataflow", NG.membership_col(2)))
    out = score_clean(st, F.col("hl") == 0, F.col("rl") == 0, composite([F.col(p) for p in PARTS], weight_cols(F.col(lang))))
    return out.select(key, lang, *PARTS, "codebleu", "p_score")


def category_report(df: DataFrame, by: Sequence[str] = ("category",), rollup: bool = False) -> DataFrame:
    """Samples and mean scores per group, with the mean loss where the input has
    one.  A rollup's rows carry ``level``, the grouping id (0: all of ``by``),
    which tells a total from a group whose key is null."""
    g = df.rollup(*by) if rollup else df.groupBy(*by)
    aggs = [F.count("*").alias("n_samples"), F.avg("codebleu").alias("avg_codebleu"), F.avg("p_score").alias("avg_p_score")]
    if "loss" in df.columns:
        aggs.append(F.avg("loss").alias("avg_loss"))
    if rollup:
        aggs.append(F.grouping_id().cast("bigint").alias("level"))
    return g.agg(*aggs)
