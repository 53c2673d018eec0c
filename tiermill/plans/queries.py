"""

Each takes (spark, sf_dir) and returns a DataFrame whose columns carry the
same names as the matching SQL in ``tiermill.plans.oracle``.  Integers are
BIGINT, fractions DOUBLE rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.operators import pairs as P
from tiermill.operators import tiers as T
from tiermill.plans import fixtures as X
from tiermill.functions import arrays as AR
from tiermill.functions import lang as L
from tiermill.functions import prompts as PR
from tiermill.functions import text as TX
from tiermill.functions.ints import floor_div
from tiermill.functions.text import tokens as _tokens
from tiermill.operators import diffs as DF
from tiermill.operators import layout as LY
from tiermill.operators import ngrams as NG
from tiermill.operators import prefs as PF
from tiermill.operators import report as RP
from tiermill.operators import score as SC
from tiermill.operators import trees as TR
from tiermill.operators.joins import neighbours_in_group
from tiermill.session import shared_dir
from tiermill.session import table
from tiermill.sources import readers as RD
from tiermill.sources import sinks as SK
from tiermill.streaming import streams as STM

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# ---------------------------------------------------------------- phase 1: tiers


@query("tier_counts")
def q_tier_counts(spark, sf):
    cands, gt = X.exec_stand_in(spark, sf)
    tiered = T.tier(T.join_gt(cands, gt, X.SAMPLE_KEYS), policy="pairs")
    return T.tier_counts(tiered, X.SAMPLE_KEYS)


@query("tier_rewards")
def q_tier_rewards(spark, sf):
    cands, gt = X.exec_stand_in(spark, sf)
    tiered = T.tier(T.join_gt(cands, gt, X.SAMPLE_KEYS), policy="reward")
    return tiered.select(*X.SAMPLE_KEYS, "cand_idx", "tier", r6("reward").alias("reward"))


@query("group_first_gt")
def q_group_first_gt(spark, sf):
    runs = X.events_runs(spark, sf)
    g = T.group_of_k(runs, "event_id", 4, ["event_id", "stdout"])
    return g.select("event_id", "group_id", F.col("group_event_id").alias("gt_event_id"),
                    F.col("group_stdout").alias("gt_stdout"))


@query("rollout_log")
def q_rollout_log(spark, sf):
    cands, gt = X.exec_stand_in(spark, sf)
    tiered = T.tier(T.join_gt(cands, gt, X.SAMPLE_KEYS), policy="pairs")
    counts = T.tier_counts(tiered, X.SAMPLE_KEYS)
    samples = T.tier_samples(tiered, X.SAMPLE_KEYS, "cand_idx", "cand_idx")
    out = counts.join(samples, X.SAMPLE_KEYS, "left")
    return out.select(*X.SAMPLE_KEYS, "n_perfect", "n_sync", "n_failed",
                      *[F.array_join(F.coalesce(F.col(f"{t}_samples"), F.array().cast("array<bigint>")), ",").alias(f"{t}_samples")
                        for t in (T.PERFECT, T.SYNC, T.FAILED)])


# ---------------------------------------------------------------- phase 1: pairs


@query("tier_dedupe")
def q_tier_dedupe(spark, sf):
    d = P.dedupe_tiers(X.tiered_documents(spark, sf), X.GROUP_KEYS, "doc_id", "text")
    return d.select(*X.GROUP_KEYS, "tier", "doc_id", big("n_copies").alias("n_copies"))


@query("tier_sample")
def q_tier_sample(spark, sf):
    d = P.dedupe_tiers(X.tiered_documents(spark, sf), X.GROUP_KEYS, "doc_id", "text")
    c = P.cap_tiers(d, X.GROUP_KEYS, "doc_id", seed=42)
    return c.select(*X.GROUP_KEYS, "tier", "doc_id", big("tier_rank").alias("tier_rank"))


@query("pairs_all")
def q_pairs_all(spark, sf):
    d = P.dedupe_tiers(X.tiered_documents(spark, sf), X.GROUP_KEYS, "doc_id", "text")
    c = P.cap_tiers(d, X.GROUP_KEYS, "doc_id", seed=42)
    p = P.tier_pairs(c, X.GROUP_KEYS, "doc_id", "text", seed=42)
    return p.select(*X.GROUP_KEYS, "strategy", "chosen_id", "rejected_id",
                    (F.col("chosen") == F.col("rejected")).cast("bigint").alias("same_text"))


def _mined(spark, sf):
    return P.mine_pairs(X.tiered_documents(spark, sf), X.GROUP_KEYS, "doc_id", "text",
                        max_pairs=4, seed=42, max_tokens=2048)


@query("mine_pairs")
def q_mine_pairs(spark, sf):
    return _mined(spark, sf).select(*X.GROUP_KEYS, "strategy", "chosen_id", "rejected_id", "pair_rank")


def run_code(runs):
    """The stand-in for a run's program text: its output."""
    return runs.withColumn("code", F.col("stdout"))


@query("mine_runs")
def q_mine_runs(spark, sf):
    """Run results and ground truth to pairs; prompts of user_id % 12 words, prompt plus answer at most 10 tokens."""
    cands, gt = X.exec_stand_in(spark, sf)
    prompt = F.array_join(F.array_repeat(F.lit("w"), F.pmod("user_id", F.lit(12)).cast("int")), " ")
    m = P.mine_runs(run_code(cands), run_code(gt.withColumnRenamed("gt_event_id", "cand_idx")), X.SAMPLE_KEYS, prompt, max_tokens=10)
    return m.select(*X.SAMPLE_KEYS, "strategy", "chosen_id", "rejected_id", "pair_rank")


@query("group_advantage")
def q_group_advantage(spark, sf):
    cands, gt = X.exec_stand_in(spark, sf)
    r = T.tier(T.join_gt(cands, gt, X.SAMPLE_KEYS), policy="reward").select("user_id", "day", "cand_idx", "reward")
    return T.group_advantage(r, ["user_id"]).select("user_id", "cand_idx", r6("advantage").alias("advantage"))


@query("weighted_sample")
def q_weighted_sample(spark, sf):
    """20 documents per language, drawn with chances in proportion to their length."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("weight"))
    return T.weighted_sample(d, ["lang"], "weight", "doc_id", 20).select("lang", "doc_id", big("rank").alias("rank"))


@query("pair_strategy_counts")
def q_pair_strategy_counts(spark, sf):
    m = _mined(spark, sf)
    return m.groupBy("strategy").agg(
        F.count("*").alias("n_pairs"),
        F.countDistinct(*X.GROUP_KEYS).alias("n_groups"))


# ---------------------------------------------------------------- phase 2: text
# Documents hold no fences, markers or comments, so each query wraps the whole
# text inside the plan (the oracle wraps it the same way).


FENCE_TAGS = ["python", "c++", "java", "c#", "cpp", ""]
LANG_SPELLINGS = ["C++", "cpp", "Python", "Java", "C#", "csharp", "Go", "PHP", "JavaScript"]
ENDINGS = [".", " ", "\n", ". "]
GT_TAGS = ["cpp", "c++", "python", "java", "javascript"]


def pick(options: list[str], idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(idx, F.lit(len(options))) + 1).cast("int"))


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def instruction_col() -> F.Column:
    d = F.col("doc_id")
    return F.when(F.pmod(d, F.lit(4)) == 3, F.col("text")).otherwise(F.concat(
        F.lit("Translate the program from "), pick(LANG_SPELLINGS, d), F.lit(" to "),
        pick(LANG_SPELLINGS, d * 7 + 3), pick(ENDINGS, d), F.col("text")))


@query("fence_extract")
def q_fence_extract(spark, sf):
    d = F.col("doc_id")
    w = (F.when(F.pmod(d, F.lit(3)) == 0, F.concat(F.lit("Sure, here it is:\n```"), pick(FENCE_TAGS, d), F.lit("\n"),
                                                   F.col("text"), F.lit("\n```\nDone.")))
          .when(F.pmod(d, F.lit(3)) == 1, F.concat(F.lit("```"), F.col("text"), F.lit("```")))
          .otherwise(F.col("text")))
    return docs(spark, sf).select("doc_id", TX.first_fence(w).alias("code"))


@query("fence_strip")
def q_fence_strip(spark, sf):
    w = F.concat(F.lit("```"), pick(FENCE_TAGS, F.col("doc_id")), F.lit("\n"), F.col("text"), F.lit("\n```"))
    return docs(spark, sf).select("doc_id", TX.strip_fences(w).alias("code"))


def marked_text() -> F.Column:
    d = F.pmod(F.col("doc_id"), F.lit(4))
    t = F.col("text")
    return (F.when(d == 0, F.concat(F.lit("<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user\nPort it.<|im_end|>\n"
                                          "<|im_start|>assistant\n```python\n"), t, F.lit("\n```<|im_end|>")))
             .when(d == 1, F.concat(F.lit("@@ Instruction\nPort it.\n@@ Response\n"), t, F.lit("<|endoftext|>\n@@ Response\ntail")))
             .when(d == 2, F.concat(F.lit("### Instruction:\nPort it.\n### Response:\n```java\n"), t, F.lit("\n```")))
             .otherwise(t))


@query("answer_after_marker")
def q_answer_after_marker(spark, sf):
    return docs(spark, sf).select("doc_id", TX.clean_answer(marked_text()).alias("code"))


@query("strip_end_tokens")
def q_strip_end_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", TX.strip_tokens(marked_text()).alias("code"))


def pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", "html")


@query("comment_strip")
def q_comment_strip(spark, sf):
    w = F.concat(F.col("url"), F.lit("\n"), F.col("html"), F.lit("\n/* generated\n at build */ x = 1; // end"))
    return pages(spark, sf).select("page_id", TX.strip_comments(w).alias("text"))


@query("one_line")
def q_one_line(spark, sf):
    return pages(spark, sf).select("page_id", TX.one_line(F.col("html")).alias("text"))


@query("line_format")
def q_line_format(spark, sf):
    w = F.concat(F.lit("Here you go:\n```Java\n"), F.col("text"), F.lit(" // note\n/* block\n */\n```\nBye"))
    return docs(spark, sf).select("doc_id", TX.to_line_format(w).alias("code"))


@query("class_name")
def q_class_name(spark, sf):
    w = F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0,
               F.concat(F.lit("public class "), F.col("source"), F.lit(" {\n"), F.col("text"), F.lit("\n}"))).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", TX.class_name(w).alias("class_name"))


@query("direction_parse")
def q_direction_parse(spark, sf):
    p = L.parse_direction(instruction_col())
    return docs(spark, sf).select("doc_id", p["category"].alias("category"), p["lang"].alias("target_lang"))


@query("detect_language")
def q_detect_language(spark, sf):
    d = F.col("doc_id")
    gt = F.when(F.pmod(d, F.lit(5)) < 3, F.concat(F.lit("```"), pick(GT_TAGS, d), F.lit("\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", L.detect_language(instruction_col(), gt).alias("lang"))


@query("pair_target")
def q_pair_target(spark, sf):
    d = F.col("doc_id")
    pair = F.when(F.pmod(d, F.lit(3)) == 0, F.col("lang")).otherwise(F.concat(F.col("lang"), F.lit("-"), pick(LANG_SPELLINGS, d)))
    return docs(spark, sf).select("doc_id", L.pair_target(pair).alias("target"))


# ---------------------------------------------------------------- phase 2: prompts

WITH_INPUT = "### Task\n{instruction}\n### Context\n{input}\n### Answer\n"
WITHOUT_INPUT = "### Task\n{instruction}\n### Answer\n"
SYS_TEMPLATE = "Target: {name}.{extra} Fence: ```{name_lower}."
SYS_EXTRA = {"python": " Indent: 4."}
TARGET_KEYS = ["cpp", "C++", "java", "Python", "go", "rust", "JavaScript"]
CHAT_SYSTEM = "Task 7: summarise the tagged part."


def conv_samples(spark, sf):
    """user turn t with the assistant turn t+1 of the same conversation; the
    input is the turn before (blank when that turn is a system turn).  Equi
    joins on (conv_id, turn) spread even a huge conversation over tasks."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"),
                    F.when(F.col("role") == "system", F.lit(" ")).otherwise(F.col("text")).alias("input"))
    return u.join(a, ["conv_id", "turn"]).join(prev, ["conv_id", "turn"], "left")


@query("prompt_build")
def q_prompt_build(spark, sf):
    s = conv_samples(spark, sf)
    return s.select("conv_id", "turn",
                    PR.build_prompt("instruction", "input", WITH_INPUT, WITHOUT_INPUT, rule="strip").alias("prompt_strip"),
                    PR.build_prompt("instruction", "input", WITH_INPUT, WITHOUT_INPUT, rule="empty").alias("prompt_empty"))


@query("prompt_wrap_idempotent")
def q_prompt_wrap(spark, sf):
    c = table(spark, sf, "conversations")
    p = F.when(F.pmod(F.col("turn"), F.lit(2)) == 0, F.concat(F.col("text"), F.lit("\n### Response:\n"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", PR.wrap_prompt(p, "You help with code.\n### Instruction:\n", "\n\n### Response:\n").alias("prompt"))


@query("system_prompt_by_lang")
def q_system_prompt(spark, sf):
    k = pick(TARGET_KEYS, F.col("doc_id"))
    return docs(spark, sf).select("doc_id", PR.system_prompt_by_lang(k, SYS_TEMPLATE, L.LANG_NAMES, SYS_EXTRA).alias("system_prompt"))


@query("chat_render")
def q_chat_render(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    user = PR.tag_wrap(F.col("text"), "Code")
    msgs = F.array(F.struct(F.lit("system").alias("role"), F.lit(CHAT_SYSTEM).alias("content")),
                   F.struct(F.lit("user").alias("role"), user.alias("content")))
    return c.select("conv_id", "turn",
                    PR.render_chat(msgs, "<|{role}|>\n{content}\n", "<|assistant|>\n").alias("chat"),
                    PR.inst_chat(F.lit(CHAT_SYSTEM), user).alias("inst"))


@query("format_reward")
def q_format_reward(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    comp = F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) == 0,
                  F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.format_reward(comp).alias("format_reward"))


@query("reward_total")
def q_reward_total(spark, sf):
    cands, gt = X.exec_stand_in(spark, sf)
    r = T.tier(T.join_gt(cands, gt, X.SAMPLE_KEYS), policy="reward")
    comp = F.when(F.col("value") > 50, F.concat(F.lit("```\n"), F.col("stdout"), F.lit("\n```"))).otherwise(F.col("stdout"))
    out = T.total_reward(r, {"correctness": F.col("reward"), "format": T.format_reward(comp)})
    return out.select(*X.SAMPLE_KEYS, "cand_idx", r6("correctness").alias("correctness"),
                      r6("format").alias("format"), r6("total_reward").alias("total_reward"))


# ---------------------------------------------------------------- phase 3: scores


def doc_keywords(spark, sf):
    d = docs(spark, sf).select("lang", _tokens("text").alias("toks"))
    return NG.top_tokens(d, "lang", "toks", 50)


def doc_stats(spark, sf, weighted: bool = True):
    """``weighted=False`` leaves the keyword table out where no weighted score is read."""
    hr = X.hyp_ref_documents(spark, sf)
    return NG.ngram_stats(hr, ["doc_id"], keywords=doc_keywords(spark, sf) if weighted else None, kw_col="lang")


@query("keywords_top")
def q_keywords(spark, sf):
    return doc_keywords(spark, sf).select(F.col("kw_group").alias("lang"), "token")


@query("ngram_counts")
def q_ngram_counts(spark, sf):
    s = doc_stats(spark, sf, weighted=False)
    return s.select("doc_id", "hl", "rl", *[f"m{k}" for k in range(1, 5)], *[f"d{k}" for k in range(1, 5)])


@query("bleu_sample")
def q_bleu_sample(spark, sf):
    return doc_stats(spark, sf, weighted=False).select("doc_id", r6(NG.bleu_col()).alias("bleu"))


@query("bleu_corpus")
def q_bleu_corpus(spark, sf):
    c = NG.corpus_stats(doc_stats(spark, sf), ["lang"])
    return c.select("lang", r6(NG.bleu_col()).alias("bleu"), r6(NG.weighted_col()).alias("weighted"))


@query("weighted_ngram")
def q_weighted_ngram(spark, sf):
    return doc_stats(spark, sf).select("doc_id", r6(NG.weighted_col()).alias("weighted"))


def doc_edges(spark, sf):
    hr = X.hyp_ref_documents(spark, sf).select("doc_id", "hyp_tokens", F.col("refs")[0].alias("ref_tokens"))
    return TR.membership_in_rows(hr, ["doc_id"], TR.adjacent_pairs("ref_tokens"), TR.adjacent_pairs("hyp_tokens"))


@query("edge_match")
def q_edge_match(spark, sf):
    return doc_edges(spark, sf).select("doc_id", "matched", "total", r6("ratio").alias("ratio"))


def page_langs(spark, sf):
    return pages(spark, sf).select("page_id", "html", F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang"))


@query("tree_shapes")
def q_tree_shapes(spark, sf):
    s = TR.tree_shapes(pages(spark, sf), "page_id", "html", TR.HTML_TAGS)
    return s.select("page_id", "pos", "depth", "size", F.md5("shape").alias("shape_md5"))


@query("tree_shapes_all")
def q_tree_shapes_all(spark, sf):
    s = TR.tree_shapes(pages(spark, sf), "page_id", "html")
    return s.select("page_id", "pos", "depth", "size", F.md5("shape").alias("shape_md5"))


def page_matches(spark, sf, tags):
    """``page_id, lang, cand_page_id, matched, total, ratio`` of every page and the next of its language."""
    p = page_langs(spark, sf)
    nb = neighbours_in_group(p.select("page_id", "lang"), ["lang"], "page_id")
    sh = TR.tree_digests(p, ["page_id"], "html", tags).select("page_id", "h")
    sh = sh.join(nb.select("page_id", "lang", "next_page_id", "prev_page_id"), "page_id")
    # a page's shapes are built once and take part as reference of its own pair and as candidate of the one before
    role = lambda pair, cand, r: F.struct(F.col(pair).alias("pair_id"), F.col(cand).alias("cand_page_id"),
                                          F.lit(r).alias("_r"), F.lit(1 - r).alias("_c"))
    both = sh.select("lang", "h", F.explode(F.array(role("page_id", "next_page_id", 1), role("prev_page_id", "page_id", 0))).alias("x")).select("lang", "h", "x.*")
    both = both.where("pair_id IS NOT NULL AND cand_page_id IS NOT NULL")
    m = TR.membership_counts(both, ["pair_id", "cand_page_id", "lang"], ["h"]).where("total > 0")
    return m.withColumnRenamed("pair_id", "page_id")


@query("tree_match")
def q_tree_match(spark, sf):
    return page_matches(spark, sf, TR.HTML_TAGS).select("page_id", "cand_page_id", "matched", "total", r6("ratio").alias("ratio"))


@query("tree_match_all")
def q_tree_match_all(spark, sf):
    return page_matches(spark, sf, None).select("page_id", "cand_page_id", "matched", "total", r6("ratio").alias("ratio"))


@query("tree_match_corpus")
def q_tree_match_corpus(spark, sf):
    m = page_matches(spark, sf, None).rollup("lang").agg(
        F.sum("matched").alias("matched"), F.sum("total").alias("total"), F.count("*").alias("n_pairs"), F.grouping_id().cast("bigint").alias("level"))
    return m.where("n_pairs > 0").select("lang", "level", "n_pairs", "matched", "total", r6(F.col("matched") / F.col("total")).alias("ratio"))


def doc_scores(spark, sf):
    # one pass: n-gram, weighted and edge parts (edges = adjacent token pairs
    # = bigram membership); a side is blank exactly when it has no tokens
    hr = X.hyp_ref_documents(spark, sf)
    st = NG.ngram_stats(hr, ["doc_id", "source"], keywords=doc_keywords(spark, sf), kw_col="lang")
    parts = [NG.bleu_col(), NG.weighted_col(), F.lit(None).cast("double"), NG.membership_col(2)]
    cb = SC.composite(parts, SC.weight_cols(F.col("lang")))
    return SC.score_clean(st, F.col("hl") == 0, F.col("rl") == 0, cb)


@query("composite_score")
def q_composite(spark, sf):
    return doc_scores(spark, sf).select("doc_id", r6("codebleu").alias("codebleu"))


@query("hardness")
def q_hardness(spark, sf):
    return doc_scores(spark, sf).select("doc_id", r6("p_score").alias("p_score"))


@query("category_report")
def q_category_report(spark, sf):
    r = SC.category_report(doc_scores(spark, sf).withColumnRenamed("lang", "category"))
    return r.select("category", "n_samples", r6("avg_codebleu").alias("avg_codebleu"), r6("avg_p_score").alias("avg_p_score"))


@query("category_rollup")
def q_category_rollup(spark, sf):
    r = SC.category_report(doc_scores(spark, sf), by=["lang", "source"], rollup=True)
    return r.select("lang", "source", "level", "n_samples", r6("avg_codebleu").alias("avg_codebleu"), r6("avg_p_score").alias("avg_p_score"))


def page_scores(spark, sf):
    return SC.pair_scores(X.fenced_pages(spark, sf), "page_id", "lang", "is_ref", "text")


@query("composite_fenced")
def q_composite_fenced(spark, sf):
    return page_scores(spark, sf).select("page_id", *[r6(c).alias(c) for c in (*SC.PARTS, "codebleu", "p_score")])


@query("category_fenced")
def q_category_fenced(spark, sf):
    r = SC.category_report(page_scores(spark, sf).withColumnRenamed("lang", "category"))
    return r.select("category", "n_samples", r6("avg_codebleu").alias("avg_codebleu"), r6("avg_p_score").alias("avg_p_score"))


# ---------------------------------------------------------------- phase 4: arrays
# embeddings as log-prob rows: values below -0.4 stand for padding (-1e5),
# others give -8|x|; even / odd vec_id = chosen / rejected of pair vec_id/2;
# the first / second half of a row = policy / reference.


def emb(spark, sf):
    e = table(spark, sf, "embeddings")
    lp = F.transform("embedding", lambda x: F.when(x.cast("double") < -0.4, F.lit(-1e5)).otherwise(-F.abs(x.cast("double")) * 8))
    labels = F.transform("embedding", lambda x, i: F.when(x > 0, i).otherwise(F.lit(-100)))
    ids = F.transform(F.filter("embedding", lambda x: x > 0), lambda x: F.floor(x.cast("double") * 1000).cast("int"))
    return e.select("vec_id", "label", lp.alias("logps"), labels.alias("labels"), ids.alias("ids"))


def half(c: str, second: int) -> F.Column:
    """The first or second half of an array, the middle element of an odd one in the second."""
    n = F.call_function("div", F.size(c), F.lit(2)).cast("int")
    return F.slice(c, n + 1, F.size(c) - n) if second else F.slice(c, F.lit(1), n)


def ints(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("masked_mean")
def q_masked_mean(spark, sf):
    return emb(spark, sf).select("vec_id", r6(AR.masked_mean("logps")).alias("mean_logp"))


@query("tail_nll")
def q_tail_nll(spark, sf):
    p = F.col("label") * 7
    return emb(spark, sf).select("vec_id", r6(AR.tail_nll("logps", p)).alias("nll"),
                                 r6(AR.norm_loglik("logps", p)).alias("confidence"))


@query("pref_metrics")
def q_pref_metrics(spark, sf):
    e = emb(spark, sf)
    rows = e.select(
        floor_div("vec_id", 2).alias("pair_id"),
        F.when(F.pmod("vec_id", F.lit(2)) == 0, F.lit("chosen")).otherwise(F.lit("rejected")).alias("role"),
        AR.masked_sum(half("logps", 0), half("labels", 0)).alias("policy_logp"),
        AR.masked_sum(half("logps", 1), half("labels", 1)).alias("ref_logp"))
    rows = rows.withColumn("batch", floor_div("pair_id", 8))
    m = PF.pref_metrics(rows, ["batch"], beta=0.1)
    return m.select("batch", "n_pairs", "n_incomplete", *[r6(c).alias(c) for c in (
        "rewards_chosen", "rewards_rejected", "accuracy", "margin", "logps_chosen", "logps_rejected", "loss")])


@query("pad_batch")
def q_pad_batch(spark, sf):
    e = emb(spark, sf).select("vec_id", floor_div("vec_id", 8).alias("batch"), "ids",
                              F.array_repeat(F.lit(1), F.size("ids")).alias("mask"),
                              AR.prompt_mask("ids", F.col("label")).alias("labels"))
    p = PF.pad_batch(e, "batch", {"ids": 0, "mask": 0, "labels": -100})
    return p.select("vec_id", "batch", ints("ids").alias("ids"), ints("mask").alias("mask"),
                    ints("labels").alias("labels"), F.size("ids").cast("bigint").alias("n"))


@query("prompt_mask")
def q_prompt_mask(spark, sf):
    e = emb(spark, sf)
    return e.select("vec_id", ints(AR.prompt_mask("ids", F.col("label"))).alias("labels"))


# ---------------------------------------------------------------- phase 4: diffs
# rejected = chosen with every 6th line (index 5, 11, ...) dropped and every
# 4th line (index 1, 5, 9, ...) extended by " !".


def perturbed(c: str = "text") -> F.Column:
    t = F.transform(F.split(F.col(c), "\n"), lambda l, i: F.when(F.pmod(i, F.lit(6)) == 5, F.lit(None).cast("string"))
                    .when(F.pmod(i, F.lit(4)) == 1, F.concat(l, F.lit(" !"))).otherwise(l))
    return F.array_join(t, "\n")


def diff_pairs(spark, sf):
    return docs(spark, sf).select("doc_id", "lang", F.col("text").alias("chosen"), perturbed().alias("rejected"))


def line_diff(spark, sf):
    p = diff_pairs(spark, sf)
    a = DF.line_offsets(p, "doc_id", "chosen")
    b = DF.line_offsets(p, "doc_id", "rejected")
    return DF.line_multiset_diff(a, b, "doc_id")


@query("line_offsets")
def q_line_offsets(spark, sf):
    return DF.line_offsets(docs(spark, sf), "doc_id", "text").select("doc_id", "line_no", "start", "end")


@query("line_multiset_diff")
def q_line_multiset_diff(spark, sf):
    return line_diff(spark, sf)


@query("focus_tokens")
def q_focus_tokens(spark, sf):
    p = diff_pairs(spark, sf).withColumn("prompt", F.concat(F.lit("Fix the text for "), F.col("lang"), F.lit(":\n")))
    p = p.withColumn("full", F.concat("prompt", "chosen")).withColumn("plen", F.length("prompt"))
    ranges = (line_diff(spark, sf).filter(F.col("side") == "chosen")
              .select("doc_id", F.col("start").alias("fs"), F.col("end").alias("fe")))
    f = DF.focus_tokens(p, "doc_id", "full", ranges, "plen", F.col("tok_idx") * 7 + F.length("token"))
    return f.select("doc_id", "tok_idx", "label")


# ---------------------------------------------------------------- phase 5: layout
# Markers are placed after token i by (7 i + doc_id) mod 11; some rows start
# with INDENT or NEW_LINE.


MARKER_AFTER = {0: " NEW_LINE", 3: " NEW_LINE INDENT", 5: " NEW_LINE DEDENT", 8: " DEDENT", 9: " INDENT",
                10: " NEW_LINE NEW_LINE"}


def marked_line() -> F.Column:
    d = F.col("doc_id")

    def after(t, i):
        r = F.pmod(i * 7 + d, F.lit(11))
        m = F.lit("")
        for k, v in sorted(MARKER_AFTER.items(), reverse=True):
            m = F.when(r == k, F.lit(v)).otherwise(m)
        return F.concat(t, m)
    body = F.array_join(F.transform(_tokens("text"), after), " ")
    lead = F.when(F.pmod(d, F.lit(5)) == 0, F.lit("INDENT ")).when(F.pmod(d, F.lit(5)) == 1, F.lit("NEW_LINE ")).otherwise(F.lit(""))
    return F.concat(lead, body)


@query("layout_lines")
def q_layout_lines(spark, sf):
    d = docs(spark, sf).select("doc_id", "text").repartition("doc_id").select("doc_id", marked_line().alias("line"))
    return LY.layout_lines(d, "doc_id", "line")


# ---------------------------------------------------------------- phase 5: reports


RUN_LANGS = ["python", "java", "cpp"]


@query("exec_rates")
def q_exec_rates(spark, sf):
    cands, gt = X.exec_stand_in(spark, sf)
    j = T.join_gt(cands, gt, X.SAMPLE_KEYS).withColumn("lang", pick(RUN_LANGS, F.col("user_id")))
    j = j.withColumn("err_pos", F.when(~F.col("run_ok"), F.floor("value")))
    r = T.exec_rates(j, ["lang"])
    return r.select("lang", "n", r6("run_rate").alias("run_rate"), r6("equiv_rate").alias("equiv_rate"),
                    r6("mean_err_pos").alias("mean_err_pos"))


@query("shard_ids")
def q_shard_ids(spark, sf):
    s = RP.shard_ids(docs(spark, sf).select("doc_id"), ["doc_id"], 8)
    return s.select("doc_id", "idx", "shard")


@query("preview")
def q_preview(spark, sf):
    return SK.preview(docs(spark, sf), "doc_id", ["text", "lang"], 200)


# ---------------------------------------------------------------- phase 6: I/O
# Each query writes into a fresh folder of the shared checkpoint folder and
# reads its own output back.


@query("jsonl_roundtrip")
def q_jsonl_roundtrip(spark, sf):
    s = conv_samples(spark, sf)
    rec = s.select(
        F.lit("conv").alias("category"),
        PR.sample_key(F.lit("conv"), F.concat_ws("_", "conv_id", "turn")).alias("id"),
        "instruction", F.when(F.pmod(F.col("turn"), F.lit(4)) == 0, F.lit(None).cast("string")).otherwise(F.col("input")).alias("input"),
        F.col("output").alias("gt_code"), F.lit(999.0).alias("loss"))
    path = shared_dir(spark, "jsonl")
    SK.write_scored(rec, path)
    schema = "category string, data struct<id:string, loss:double, gt_code:string, instruction:string, input:string>"
    back = RD.with_defaults(RD.flatten_record(RD.read_samples(spark, path, layout="lines", schema=schema)), {"input": ""})
    return back.select("category", F.col("data_id").alias("id"), "instruction", "input", "gt_code",
                       F.col("data_loss").alias("loss"))


@query("aligned_lines")
def q_aligned_lines(spark, sf):
    base = X.hyp_ref(X.line_texts(spark, sf))
    root = shared_dir(spark, "aligned")
    SK.write_lines(base.select("line_no", TX.one_line(F.array_join("hyp_tokens", " ")).alias("value")), f"{root}/pred", ordered=True)
    SK.write_lines(base.select("line_no", TX.one_line(F.array_join(F.col("refs")[0], " ")).alias("value")), f"{root}/ref", ordered=True)
    SK.write_lines(base.select("line_no", F.col("doc_id").alias("value")), f"{root}/ids", ordered=True)
    j = RD.align_lines(RD.read_lines(spark, f"{root}/pred"), RD.read_lines(spark, f"{root}/ref"),
                       RD.read_lines(spark, f"{root}/ids"))
    return j.select("line_no", F.col("id").cast("bigint").alias("doc_id"), "pred", "ref")


@query("partitioned_report")
def q_partitioned_report(spark, sf):
    e = emb(spark, sf).select("vec_id", F.when(F.col("label") < 5, F.lit("low")).otherwise(F.lit("high")).alias("category"),
                              AR.masked_mean("logps").alias("score"), AR.tail_nll("logps", F.col("label") * 7).alias("loss"))
    path = shared_dir(spark, "reports")
    SK.write_reports(e, path, SK.report_line("vec_id", "score", "loss"), by="category")
    return spark.read.text(path).select("category", F.col("value").alias("report"))


@query("append_metrics")
def q_append_metrics(spark, sf):
    e = emb(spark, sf)
    rows = e.select(floor_div("vec_id", 2).alias("pair_id"),
                    F.when(F.pmod("vec_id", F.lit(2)) == 0, F.lit("chosen")).otherwise(F.lit("rejected")).alias("role"),
                    AR.masked_sum(half("logps", 0), half("labels", 0)).alias("policy_logp"),
                    AR.masked_sum(half("logps", 1), half("labels", 1)).alias("ref_logp"))
    m = PF.pref_metrics(rows.withColumn("step", floor_div("pair_id", 8)), ["step"])
    path = shared_dir(spark, "metrics")
    SK.append_metrics(m.where("n_pairs > 0").select("step", "n_pairs", "loss", "accuracy"), path, "step", 3)
    back = spark.read.parquet(path)
    return back.select("step", "n_pairs", r6("loss").alias("loss"), r6("accuracy").alias("accuracy"))


# ---------------------------------------------------------------- phase 7: streams
# The events table is copied into the shared folder (ts made a TIMESTAMP)
# and read back as a file stream with the availableNow trigger.


def _event_stream(spark, sf):
    src = shared_dir(spark, "events-src")
    (table(spark, sf, "events")
     .select("event_id", STM.utc_instant("ts").alias("ts"), "user_id", "event_type", "value", "props")
     .write.parquet(src))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(src)


@query("stream_tier_windows")
def q_stream_tier_windows(spark, sf):
    s = _event_stream(spark, sf)
    agg = STM.stream_tier_windows(s, "ts", ["event_type"], "value", width="1 day", lateness="1 day")
    out = agg.select(F.col("window.start").alias("ws"), "event_type", "n", "avg_value")
    sink, ck = shared_dir(spark, "win-out"), shared_dir(spark, "win-ck")
    STM.run_available_now(out, sink, ck, mode="append")
    back = STM.read_sink(spark, sink, "ws timestamp, event_type string, n long, avg_value double")
    return back.select(STM.utc_text(F.col("ws")).alias("window_start"), "event_type", "n", r6("avg_value").alias("avg_value"))


@query("stream_reward_windows")
def q_stream_reward_windows(spark, sf):
    """Tier counts and mean reward per closed window, 1 day tumbling and 2 days sliding by 1; ground truths are a static side."""
    _, gt = X.exec_stand_in(spark, sf)
    outs = []
    for kind, width, slide in (("tumbling", "1 day", None), ("sliding", "2 days", "1 day")):
        s = _event_stream(spark, sf).withWatermark("ts", "1 day")
        day = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd")
        runs = s.select("ts", "user_id", "event_id", day.alias("day"), (F.col("event_type") != "error").alias("run_ok"), F.col("props").alias("stdout"))
        j = T.join_gt(runs, gt, X.SAMPLE_KEYS)
        first = gt.select(F.col("gt_event_id").alias("event_id"), F.lit(True).alias("is_gt"))
        j = j.join(first, "event_id", "left").where("is_gt IS NULL")
        out = STM.stream_reward_windows(T.tier(j, policy="reward"), "ts", width, slide)
        sink, ck = shared_dir(spark, f"{kind}-out"), shared_dir(spark, f"{kind}-ck")
        STM.run_available_now(out.select(F.col("window.start").alias("ws"), "n", "n_perfect", "n_sync", "n_failed", "mean_reward"), sink, ck)
        back = STM.read_sink(spark, sink, "ws timestamp, n long, n_perfect long, n_sync long, n_failed long, mean_reward double")
        outs.append(back.withColumn("kind", F.lit(kind)))
    both = outs[0].unionByName(outs[1])
    return both.select("kind", STM.utc_text(F.col("ws")).alias("window_start"), "n", "n_perfect", "n_sync", "n_failed",
                       r6("mean_reward").alias("mean_reward"))


@query("stream_dedupe")
def q_stream_dedupe(spark, sf):
    s = _event_stream(spark, sf).withColumn("day", F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"),
                                                                                    F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd"))
    d = STM.stream_dedupe(s, "ts", ["user_id", "day", "event_type", "props"], lateness="1 day")
    sink, ck = shared_dir(spark, "dedupe-out"), shared_dir(spark, "dedupe-ck")
    STM.run_available_now(d.select("user_id", "day", "event_type", "props"), sink, ck)
    return STM.read_sink(spark, sink, "user_id long, day string, event_type string, props string")


@query("stream_mine_pairs")
def q_stream_mine_pairs(spark, sf):
    """Mining over micro-batches that cut through the groups: 4 files, one per batch."""
    src = shared_dir(spark, "cands-src")
    X.tiered_documents(spark, sf).repartition(4, "doc_id").write.parquet(src)
    s = (spark.readStream.schema("lang string, source string, doc_id long, text string, tier string")
         .option("maxFilesPerTrigger", 1).parquet(src))
    sink, store, ck = (shared_dir(spark, f"pairs-{x}") for x in ("out", "candidates", "ck"))
    STM.run_available_now(s, sink, ck, foreach=STM.mine_batch(sink, store, X.GROUP_KEYS, "doc_id", "text", max_pairs=4,
                                                              seed=42, max_tokens=2048))
    back = STM.read_mined(spark, sink, store, X.GROUP_KEYS)
    return back.select(*X.GROUP_KEYS, "strategy", "chosen_id", "rejected_id", "pair_rank")


# ---------------------------------------------------------------- coverage: S4, J2, K6, P3/P6, O1, V2/V3


@query("hypotheses_jsonl")
def q_hypotheses_jsonl(spark, sf):
    base = X.hyp_ref(X.line_texts(spark, sf))
    rec = F.to_json(F.struct(F.array_join("hyp_tokens", " ").alias("prediction"),
                             F.array_join(F.col("refs")[0], " ").alias("target")))
    path = shared_dir(spark, "hyp-jsonl")
    SK.write_lines(base.select("line_no", rec.alias("value")), path, ordered=True)
    return RD.read_hypotheses(spark, path, "prediction").select("line_no", "hyp", "target")


@query("multi_ref_scores")
def q_multi_ref_scores(spark, sf):
    d = docs(spark, sf).select("doc_id", "lang", _tokens("text").alias("t"))
    refs = (d.select("doc_id", F.lit(1).alias("ref_id"), F.col("t").alias("tokens"))
             .unionByName(d.select("doc_id", F.lit(2).alias("ref_id"),
                                   F.filter("t", lambda x, i: (i + 1) % 5 != 0).alias("tokens"))))
    hyps = d.select("doc_id", "lang", F.filter("t", lambda x, i: (i + 1) % 7 != 0).alias("tokens"))
    st = NG.reference_stats(hyps, refs, "doc_id", "ref_id", keywords=doc_keywords(spark, sf), kw_col="lang")
    return st.select("doc_id", r6(NG.bleu_col()).alias("bleu"), r6(NG.weighted_col()).alias("weighted"))


@query("rollout_append")
def q_rollout_append(spark, sf):
    log = q_rollout_log(spark, sf)
    for t in (T.PERFECT, T.SYNC, T.FAILED):
        log = log.withColumn(f"{t}_samples", F.array_remove(F.split(f"{t}_samples", ","), ""))
    rec = SK.rollout_records(log, floor_div(F.dayofmonth(F.to_date("day")), 10).cast("int"), F.pmod("user_id", F.lit(4)).cast("int"),
                             X.SAMPLE_KEYS, ["n_perfect", "n_sync", "n_failed"], {t: f"{t}_samples" for t in (T.PERFECT, T.SYNC, T.FAILED)})
    path = shared_dir(spark, "rollouts")
    SK.append_rollouts(rec, path, ["epoch", "rank"])
    back = spark.read.schema("user_id long, day string, stats struct<n_perfect:long,n_sync:long,n_failed:long>, "
                             "samples struct<perfect:array<string>,sync:array<string>,failed:array<string>>, epoch int, rank int").json(path)
    return back.select("user_id", "day", big("epoch").alias("epoch"), big("rank").alias("rank"), "stats.*",
                       *[F.array_join(f"samples.{t}", ",").alias(f"{t}_samples") for t in (T.PERFECT, T.SYNC, T.FAILED)])


SYS_WITH_INPUT = "<<system>>\n{system_prompt}\n<<user>>\n{instruction}\n\n{input}\n<<assistant>>\n"
SYS_WITHOUT_INPUT = "<<system>>\n{system_prompt}\n<<user>>\n{instruction}\n<<assistant>>\n"
DEFAULT_SYSTEM = "You are a careful programmer."
OUTLINE_SUFFIX = "\nGive an outline first."


@query("prompt_system")
def q_prompt_system(spark, sf):
    s = conv_samples(spark, sf)
    c = table(spark, sf, "conversations")
    sysp = (c.filter(F.col("role") == "system").groupBy("conv_id")
             .agg(F.min_by("text", "turn").alias("sys_text")))
    j = s.join(sysp, "conv_id", "left")
    sp = F.coalesce(F.col("sys_text"), F.lit(DEFAULT_SYSTEM))
    p = PR.build_prompt(PR.add_suffix("instruction", OUTLINE_SUFFIX), "input", SYS_WITH_INPUT, SYS_WITHOUT_INPUT,
                        rule="strip", system_prompt=sp)
    return j.select("conv_id", "turn", p.alias("prompt"))


@query("epoch_shuffle")
def q_epoch_shuffle(spark, sf):
    d = docs(spark, sf).select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
    d = d.withColumn("h", P.hash_rank(42, "epoch", "doc_id"))
    idx = RP.dense_index(d, ["epoch", "h", "doc_id"])
    first = idx.groupBy("epoch").agg(F.min("idx").alias("_first"))
    return (idx.join(first, "epoch").select(F.col("epoch").cast("bigint").alias("epoch"), "doc_id",
                                           (F.col("idx") - F.col("_first")).alias("position")))


def _group_correctness(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per group (rows sorted by event_id): the first completion is the
    reference run; equal stdout -> 1.0, other successful runs 0.5, failed
    runs 0.1.  Vectorised over all groups of the batch."""
    ref = pdf.groupby("group_id", sort=False)["stdout"].transform("first").str.strip()
    ok = pdf["run_ok"].astype(bool)
    same = pdf["stdout"].str.strip() == ref
    reward = (ok & same) * 1.0 + (ok & ~same) * 0.5 + (~ok) * 0.1
    return pd.DataFrame({"group_id": pdf["group_id"], "event_id": pdf["event_id"], "reward": reward.astype(float)})


@query("group_reward_pandas")
def q_group_reward_pandas(spark, sf):
    runs = X.events_runs(spark, sf).select("event_id", "run_ok", "stdout",
                                          floor_div("event_id", 4).alias("group_id"))
    out = T.group_reward(runs, "group_id", "event_id", _group_correctness, "group_id long, event_id long, reward double")
    return out.select("group_id", "event_id", r6("reward").alias("reward"))


from tiermill.plans import extended  # noqa: E402,F401  (adds its queries and their SQL)
