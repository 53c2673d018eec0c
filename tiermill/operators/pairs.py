"""Preference-pair mining.

Plan shape (checked with explain):
  dedupe   groupBy(keys, tier, text)      partial agg, spread by text hash
  cap      row_number() <= cap            partial WindowGroupLimit before the
                                          exchange, so a hot group ships at most
                                          `cap` rows per map partition
  pairs    groupBy(keys) collect <= 8     bounded arrays, pairs built by HOFs
  cap      array_sort + slice <= max      in-row, no further exchange
No self-join and no cross join: at most 2*3 + 3*3 = 15 pairs per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermill.functions.text import n_tokens
from tiermill.operators.tiers import FAILED, PERFECT, SYNC, join_gt, tier

# Per-tier sample caps and pairs per prompt.
DEFAULT_CAPS = {PERFECT: 2, SYNC: 3, FAILED: 3}
DEFAULT_MAX_PAIRS = 4


def hash_rank(seed: int | str, *cols) -> Column:
    """Reproducible shuffle key: md5 of 'seed|c1|c2...' (same hex in DuckDB)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def dedupe_tiers(df: DataFrame, keys: Sequence[str], id_col: str = "cand_idx",
                 text_col: str = "code", gt: DataFrame | None = None) -> DataFrame:
    """Distinct texts per (sample, tier), keeping the lowest id; the ground
    truth (if given, columns keys + id + text) joins the perfect tier."""
    if gt is not None:
        df = df.select(*keys, id_col, text_col, "tier").unionByName(
            gt.select(*keys, id_col, text_col).withColumn("tier", F.lit(PERFECT)))
    return (df.groupBy(*keys, "tier", text_col)
              .agg(F.min(id_col).alias(id_col), F.count("*").alias("n_copies")))


def text_rank(seed: int | str, text_col: str) -> Column:
    """Shuffle key that depends on the text alone: copies that come later, with a smaller id, don't move it."""
    return hash_rank(seed, F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def cap_tiers(df: DataFrame, keys: Sequence[str], id_col: str = "cand_idx",
              caps: dict[str, int] | None = None, seed: int = 42, rank: Column | None = None) -> DataFrame:
    """At most ``caps[tier]`` rows per (sample, tier), uniform by md5 rank (of the id, or ``rank``)."""
    caps = caps or DEFAULT_CAPS
    cap = F.lit(0)
    for t, n in caps.items():
        cap = F.when(F.col("tier") == t, F.lit(n)).otherwise(cap)
    w = Window.partitionBy(*keys, "tier").orderBy(rank if rank is not None else hash_rank(seed, id_col), F.col(id_col))
    return (df.withColumn("tier_rank", F.row_number().over(w))
              .filter((F.col("tier_rank") <= max(caps.values())) & (F.col("tier_rank") <= cap)))


def _side(tier_name: str, id_col: str, text_col: str, extra: Sequence[str]) -> Column:
    fields = [F.col("tier_rank").alias("r"), F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    fields += [F.col(e).alias(e) for e in extra]
    return F.array_sort(F.collect_list(F.when(F.col("tier") == tier_name, F.struct(*fields))))


def _cross(a: Column, b: Column, strategy: str, seed: int, extra: Sequence[str]) -> Column:
    def mk(x, y):
        fields = [
            F.md5(F.concat_ws("|", F.lit(str(seed)), x["id"].cast("string"), y["id"].cast("string"))).alias("h"),
            x["id"].alias("chosen_id"), y["id"].alias("rejected_id"), F.lit(strategy).alias("strategy"),
            x["text"].alias("chosen"), y["text"].alias("rejected"),
        ]
        fields += [x[e].alias(f"chosen_{e}") for e in extra] + [y[e].alias(f"rejected_{e}") for e in extra]
        return F.struct(*fields)
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: mk(x, y))))


def tier_pair_arrays(capped: DataFrame, keys: Sequence[str], id_col: str = "cand_idx",
                     text_col: str = "code", seed: int = 42, extra: Sequence[str] = ()) -> DataFrame:
    """One row per sample with the array of all strategy pairs:
    A = perfect x sync, B = sync x failed, C = perfect x failed only when
    there is no sync."""
    g = capped.groupBy(*keys).agg(
        _side(PERFECT, id_col, text_col, extra).alias("_tier_p"),
        _side(SYNC, id_col, text_col, extra).alias("_tier_s"),
        _side(FAILED, id_col, text_col, extra).alias("_tier_f"),
    )
    return pair_arrays(g, keys, F.col("_tier_p"), F.col("_tier_s"), F.col("_tier_f"), seed, extra)


def pair_arrays(g: DataFrame, keys: Sequence[str], p: Column, s: Column, f: Column, seed: int = 42,
                extra: Sequence[str] = ()) -> DataFrame:
    """:func:`tier_pair_arrays` of rows that hold a sample's capped tiers as arrays of (r, id, text, extra)."""
    a = _cross(p, s, "A", seed, extra)
    b = _cross(s, f, "B", seed, extra)
    c = F.filter(_cross(p, f, "C", seed, extra), lambda _: F.size(s) == 0)
    return g.select(*keys, F.concat(a, b, c).alias("pairs"))


def tier_pairs(capped: DataFrame, keys: Sequence[str], id_col: str = "cand_idx",
               text_col: str = "code", seed: int = 42) -> DataFrame:
    """All pairs before the per-prompt cap, one row each."""
    arr = tier_pair_arrays(capped, keys, id_col, text_col, seed)
    return (arr.select(*keys, F.explode("pairs").alias("p"))
               .select(*keys, "p.strategy", "p.chosen_id", "p.rejected_id", "p.chosen", "p.rejected"))


def cap_pairs(arr: DataFrame, keys: Sequence[str], max_pairs: int = DEFAULT_MAX_PAIRS,
              max_tokens: int | None = None) -> DataFrame:
    """Drop equal pairs and over-long pairs first (they do not use up the
    cap), then keep the first ``max_pairs`` by hash order.  In-row on the
    bounded pair array."""
    keep = lambda p: p["chosen"] != p["rejected"]
    if max_tokens is not None:
        keep = lambda p: (p["chosen"] != p["rejected"]) & (p["chosen_ntok"] <= max_tokens) & (p["rejected_ntok"] <= max_tokens)
    chosen = F.slice(F.array_sort(F.filter(F.col("pairs"), keep)), 1, max_pairs)
    return (arr.select(*keys, F.posexplode(chosen).alias("pos", "p"))
               .select(*keys, "p.strategy", "p.chosen_id", "p.rejected_id", "p.chosen", "p.rejected",
                       (F.col("pos") + 1).cast("bigint").alias("pair_rank")))


def mine_pairs(cands: DataFrame, keys: Sequence[str], id_col: str = "cand_idx",
               text_col: str = "code", gt: DataFrame | None = None,
               caps: dict[str, int] | None = None, max_pairs: int = DEFAULT_MAX_PAIRS,
               seed: int = 42, max_tokens: int | None = None, prompt: Column | None = None, by_text: bool = False) -> DataFrame:
    """End-to-end mining from tiered candidates (columns keys, id, text, tier).
    ``max_tokens`` bounds prompt plus answer; ``prompt`` is an expression over the keys.  ``by_text`` caps a tier by
    a rank of the texts instead of the ids, as the stream does."""
    deduped = dedupe_tiers(cands, keys, id_col, text_col, gt)
    capped = cap_tiers(deduped, keys, id_col, caps, seed, text_rank(seed, text_col) if by_text else None)
    extra: list[str] = []
    if max_tokens is not None:
        capped = capped.withColumn("ntok", n_tokens(F.col(text_col)) + (n_tokens(prompt) if prompt is not None else F.lit(0)))
        extra = ["ntok"]
    arr = tier_pair_arrays(capped, keys, id_col, text_col, seed, extra)
    return cap_pairs(arr, keys, max_pairs, max_tokens)


def mine_runs(cands: DataFrame, gt: DataFrame, keys: Sequence[str], prompt: Column, id_col: str = "cand_idx",
              text_col: str = "code", **how) -> DataFrame:
    """From run results to preference pairs.

    ``cands``: keys, id, text, run_ok, stdout; ``gt``: the same columns, one row
    per sample.  Candidates are tiered against the ground truth's output; the
    ground truth itself is always perfect, even where it did not run, so a
    sample whose candidates all failed still gives pairs."""
    tiered = tier(join_gt(cands, gt, keys), policy="pairs")
    return mine_pairs(tiered, keys, id_col, text_col, gt=gt, prompt=prompt, **how)
