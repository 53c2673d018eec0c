"""N-gram overlap scores.

Definitions (ours, from the BLEU and CodeBLEU papers; see SURVEY 2.12):
  BLEU-4   match_n = sum_g min(c_hyp, max_ref c_ref); denominator
           max(1, sum c_hyp) per hypothesis; a zero match becomes 0.1 /
           denominator; no unigram match -> 0; brevity penalty against the
           closest reference length (ties to the shorter); corpus form sums
           numerators, denominators and lengths before dividing.
  weighted recall over reference n-grams, per reference: unigrams weighted
           1 (keyword) / 0.2 (other token), n >= 2 unweighted; denominator
           max(1, weighted reference count) per reference; same smoothing
           and brevity penalty.

Plan: input rows hold (keys, hyp tokens, refs = array of one token array), or
hypotheses and references are two tables (:func:`reference_stats`).
Tokens are hashed to 64 bits and a row's grams are counted inside the row
(:mod:`tiermill.operators.overlap`); no gram is shuffled, unless its key stands
in several rows: those grams are exploded from zipped shifted slices
(no lambdas, whole-stage codegen) and counted by aggregations.  A keyword
list is joined as a size-checked broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermill.operators import overlap as OV
from tiermill.operators.joins import bounded_broadcast

MAX_N = 4
EPSILON = 0.1  # smoothing for zero matches
KEYWORD_WEIGHT, OTHER_WEIGHT = 1.0, 0.2

def _shifted(t: Column, k: int) -> Column:
    """t[k:] (1-based) or empty."""
    return F.slice(t, k, F.greatest(F.size(t) - k + 1, F.lit(0)))


def gram_id(n: int, *token_hashes) -> Column:
    """64-bit id of an n-gram from its tokens' ``xxhash64``; ids are only compared within a row's key."""
    return F.xxhash64(F.lit(n), *token_hashes)


def gram_rows(df: DataFrame, carry: Sequence[str], toks: str = "toks", max_n: int = MAX_N) -> DataFrame:
    """One row per n-gram occurrence: carry + (n, g), g the gram's id.  Tokens
    are hashed once per row (the explode of one array keeps the optimizer
    from repeating that in every slice); the grams come from arrays_zip of
    shifted slices and two explodes, so no string is copied per gram."""
    h = df.select(*carry, F.explode(F.array(F.transform(toks, lambda t: F.xxhash64(t)))).alias("h"))
    z = F.arrays_zip(*[_shifted(F.col("h"), k).alias(f"t{k}") for k in range(1, max_n + 1)])
    pos = h.select(*carry, F.inline(z).alias(*[f"t{k}" for k in range(1, max_n + 1)]))
    opts = [F.when(F.col(f"t{n}").isNotNull(), F.struct(F.lit(n).alias("n"), gram_id(n, *[f"t{k}" for k in range(1, n + 1)]).alias("g")))
            for n in range(1, max_n + 1)]
    g = pos.select(*carry, F.explode(F.array(*opts)).alias("x")).filter(F.col("x").isNotNull())
    return g.select(*carry, "x.n", "x.g")


def ngram_stats(df: DataFrame, keys: Sequence[str], hyp: str = "hyp_tokens", refs: str = "refs",
                keywords: DataFrame | None = None, kw_col: str | None = None,
                max_n: int = MAX_N, distinct: bool = False) -> DataFrame:
    """Per-row statistics: m1..mN (clipped matches), d1..dN (max(1, hyp count)),
    wn1..wnN / wd1..wdN (weighted recall parts), hl (hyp length), rl (closest
    reference length).  ``keywords`` has columns (kw_group, token) matched on
    ``kw_col`` of the input (for example lang).  A row carries one reference or
    none in the array ``refs``; with more a row raises: :func:`reference_stats`
    takes any number, as rows.

    A row's grams are counted inside the row (:func:`tiermill.operators.overlap.row_stats`), so that neither texts nor grams
    are shuffled; only the distinct reference unigrams leave it, to meet the keywords in a join.  Rows of keys that stand in
    several rows count together, as gram rows (``distinct``: there are none, which is then not looked up).  Weighted
    denominators: for n >= 2 a reference has max(0, len - n + 1) n-grams of weight 1; for n = 1 its weight is 0.2 * len +
    0.8 * (keyword tokens)."""
    keys = list(keys)
    carry = keys + ([kw_col] if kw_col and kw_col not in keys else [])
    one = F.when(F.size(refs) > 1, F.raise_error(F.lit("several references in a row: use reference_stats")).cast("array<string>")).otherwise(
        F.get(refs, F.lit(0)))
    x = df.select(*carry, F.coalesce(hyp, F.array()).alias("_hyp"), one.alias("_ref"))
    x, again = (x, None) if distinct else OV.by_repeats(x, carry)
    kw = None
    if keywords is not None and kw_col:
        kw = bounded_broadcast(keywords.select(F.col("kw_group").alias("_kwg"), OV.unigram_id("token").alias("_kwu"),
                                               gram_id(1, F.xxhash64("token")).alias("_kwt")).distinct())
    span = range(1, max_n + 1)
    numbers = ["hl", "rl", "nref", *[f"{c}{k}" for c in ("m", "t", "mm", "mt") for k in span]]
    st = OV.row_stats(x.select(*carry, OV.hashes("_hyp").alias("_hyp"), OV.hashes("_ref").alias("_ref")), carry, "_hyp", "_ref", max_n, kw is not None)
    if kw is not None:
        u = st.select(*carry, *numbers, F.posexplode_outer("uni").alias("_i", "_u"))
        u = u.join(kw.select("_kwg", "_kwu").distinct(), (F.col(kw_col) == F.col("_kwg")) & (F.col("_u.g") == F.col("_kwu")), "left")
        found = lambda c: F.sum(F.when(F.col("_kwu").isNotNull(), F.col(c)).otherwise(0))
        st = u.groupBy(*carry).agg(*[F.sum(F.when(F.coalesce("_i", F.lit(0)) == 0, F.col(c)).otherwise(0)).alias(c) for c in numbers],
                                   found("_u.b").alias("km"), found("_u.c").alias("kr"))
    else:
        st = st.select(*carry, *numbers, F.lit(0).cast("bigint").alias("km"), F.lit(0).cast("bigint").alias("kr"))
    if again is not None:
        st = st.unionByName(_pooled_stats(again, carry, kw, kw_col, max_n))
    first = F.greatest(F.lit(1.0), F.col("mt1") * OTHER_WEIGHT + F.col("kr") * (KEYWORD_WEIGHT - OTHER_WEIGHT))
    wd = [first if k == 1 else F.greatest(F.lit(1.0), (F.col("rl") - k + 1).cast("double")) for k in span]
    wn = [F.col("m1") * OTHER_WEIGHT + F.col("km") * (KEYWORD_WEIGHT - OTHER_WEIGHT) if k == 1 else F.col(f"m{k}").cast("double") for k in span]
    return st.select(*carry, "hl", "rl", *[f"m{k}" for k in span], *[F.greatest(F.lit(1), f"t{k}").cast("bigint").alias(f"d{k}") for k in span],
                     *[w.alias(f"wn{k}") for k, w in zip(span, wn)],
                     *[F.when(F.col("nref") > 0, d).otherwise(F.lit(0.0)).alias(f"wd{k}") for k, d in zip(span, wd)],
                     *[f"mm{k}" for k in span], *[f"mt{k}" for k in span])


def _pooled_stats(x: DataFrame, carry: Sequence[str], kw: DataFrame | None, kw_col: str | None, max_n: int) -> DataFrame:
    """The numbers of :func:`tiermill.operators.overlap.row_stats` with ``km`` and ``kr``, the keywords among them, for keys that
    stand in several rows (``carry, _hyp, _ref``): all their rows count together, as gram rows in plain aggregations, so that a
    key with very many rows is spread."""
    carry = list(carry)
    sides = F.array(F.struct(F.lit(1).alias("hyp"), F.col("_hyp").alias("toks")), F.struct(F.lit(0).alias("hyp"), F.col("_ref").alias("toks")))
    per_side = x.select(*carry, F.explode(sides).alias("s")).select(*carry, "s.hyp", "s.toks")
    c = gram_rows(per_side, [*carry, "hyp"], "toks", max_n).groupBy(*carry, "n", "g").agg(F.sum("hyp").alias("ch"), F.count("*").alias("_all"))
    is_kw = F.lit(0)
    if kw is not None:
        c = c.join(kw.select("_kwg", "_kwt").distinct().withColumn("_kw", F.lit(1)),
                   (F.col(kw_col) == F.col("_kwg")) & (F.col("g") == F.col("_kwt")) & (F.col("n") == 1), "left")
        is_kw = F.coalesce(F.col("_kw"), F.lit(0))
    ch, cr = F.col("ch"), F.col("_all") - F.col("ch")
    low = F.least(ch, cr)
    of = {"m": low, "t": ch, "mm": F.when(ch > 0, cr).otherwise(F.lit(0)), "mt": cr}
    zero = F.lit(0).cast("bigint")
    grams = c.select(*carry, zero.alias("hl"), zero.alias("rl"), zero.alias("nref"),
                     *[F.when(F.col("n") == k, v).otherwise(zero).alias(f"{name}{k}") for name, v in of.items() for k in range(1, max_n + 1)],
                     (low * is_kw).alias("km"), (cr * is_kw).alias("kr"))
    has = F.col("_ref").isNotNull()
    known = x.select(*carry, F.size("_hyp").cast("bigint").alias("hl"), F.when(has, F.size("_ref")).otherwise(0).cast("bigint").alias("rl"),
                     has.cast("bigint").alias("nref"), *[zero.alias(n) for n in grams.columns[len(carry) + 3:]])
    return grams.unionByName(known).groupBy(*carry).agg(*[F.sum(n).cast("bigint").alias(n) for n in grams.columns[len(carry):]])


MANY_REFS = 15  # references beside a hypothesis in one row


def reference_stats(hyps: DataFrame, refs: DataFrame, key: str, ref_id: str, toks: str = "tokens", keywords: DataFrame | None = None,
                    kw_col: str | None = None, max_n: int = MAX_N) -> DataFrame:
    """:func:`ngram_stats` for any number of references: ``hyps`` has a row per key (key, kw_col, tokens), ``refs`` a row per
    reference (key, ref_id, tokens; a null text is no reference).

    Texts meet their hypothesis by (key, part) as arrays of hashes, about MANY_REFS references in a part, and are counted there
    (:func:`tiermill.operators.overlap.reference_stats`).  A key with more references has several parts in as many tasks; of these alone
    the hypothesis' grams leave the row, for the largest count over all parts.  Keys without a row of their own
    (null, or several rows of a hypothesis or reference) are counted as gram rows."""
    carry = [key] + ([kw_col] if kw_col else [])
    span = range(1, max_n + 1)
    h_rows = hyps.groupBy(key).agg(F.count("*").alias("_n"))
    per_ref = refs.groupBy(key, ref_id).agg(F.count("*").alias("_n"))
    r_rows = per_ref.groupBy(key).agg(F.count("*").alias("_n"), F.max("_n").alias("_most"), F.max(F.col(ref_id).isNull()).alias("_null"))
    odd = h_rows.where(F.col(key).isNull() | (F.col("_n") > 1)).select(key).unionByName(
        r_rows.where(F.col(key).isNotNull() & ((F.col("_most") > 1) | F.col("_null"))).select(key)).distinct().withColumnRenamed(key, "_odd")
    odd = bounded_broadcast(odd)
    pooled = None
    if not odd.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_odd"))
        pooled = _pooled_references(hyps.join(odd, same, "left_semi"), refs.join(odd, same, "left_semi"), key, ref_id, toks, keywords, kw_col, max_n)
        hyps, refs = hyps.join(odd, same, "left_anti"), refs.join(odd, same, "left_anti")
    refs = refs.where(F.col(key).isNotNull())
    many = bounded_broadcast(r_rows.where(F.col("_n") > MANY_REFS).select(
        F.col(key).alias("_many"), F.ceil(F.col("_n") / MANY_REFS).cast("int").alias("_parts")))
    none = many.isEmpty()
    parted = lambda d: d.withColumn("_parts", F.lit(1)) if none else d.join(many, F.col(key) == F.col("_many"), "left").withColumn(
        "_parts", F.coalesce("_parts", F.lit(1)))
    split = (F.col("_parts") > 1).alias("split")
    no_group = F.lit(None).cast(hyps.schema[kw_col].dataType if kw_col else "string")
    sides = parted(hyps).select(key, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), split, F.lit(True).alias("hyp"),
                                (F.col(kw_col) if kw_col else no_group).alias("kwg"), OV.hashes(F.coalesce(toks, F.array())).alias("v")).unionByName(
        parted(refs).select(key, F.pmod(F.xxhash64(ref_id), F.col("_parts")).cast("int").alias("part"), split, F.lit(False).alias("hyp"),
                            no_group.alias("kwg"), OV.hashes(toks).alias("v")))
    st = OV.reference_stats(sides, key, max_n, unigrams=keywords is not None and kw_col is not None)
    # a row per reference and one (side 0) per part
    own = ["hl", "len", *[f"{c}{k}" for c in ("m", "t", "wn", "mm", "mt") for k in span]]
    by = [key, "part", "side"]
    if keywords is not None and kw_col:
        kw = bounded_broadcast(keywords.select(F.col("kw_group").alias("_kwg"), OV.unigram_id("token").alias("_kwu")).distinct())
        u = st.select(*by, "split", "kwg", *own, F.posexplode_outer("uni").alias("_i", "_u"))
        u = u.join(kw, (F.col("kwg") == F.col("_kwg")) & (F.col("_u.g") == F.col("_kwu")), "left")
        found = lambda c: F.sum(F.when(F.col("_kwu").isNotNull(), F.col(c)).otherwise(0))
        x = u.groupBy(*by).agg(F.first("split").alias("split"), F.first("kwg").alias("kwg"), *[F.max(c).alias(c) for c in own],
                               found("_u.b").alias("km"), found("_u.c").alias("kr"))
    else:
        x = st.select(*by, "split", "kwg", *own, F.lit(0).alias("km"), F.lit(0).alias("kr"))
    ref = F.col("side") > 0
    of_ref = lambda v: F.coalesce(F.sum(F.when(ref, v)), F.lit(0))
    of_hyp = lambda v: F.coalesce(F.max(F.when(~ref, v)), F.lit(0))
    more = KEYWORD_WEIGHT - OTHER_WEIGHT
    one = F.greatest(F.lit(1.0), F.col("len") * OTHER_WEIGHT + F.col("kr") * more)
    close = F.min(F.when(ref, F.struct(F.abs(F.col("len") - F.col("hl")).alias("d"), F.col("len").alias("l"))))
    aggs = [F.max("kwg").alias(kw_col)] if kw_col else []
    aggs += [F.max("hl").alias("hl"), close.alias("_close"), of_ref(one).cast("double").alias("wd1"), F.max("split").alias("_split")]
    for k in span:
        wn = F.col("wn1") * OTHER_WEIGHT + F.col("km") * more if k == 1 else F.col(f"wn{k}").cast("double")
        aggs += [of_hyp(F.col(f"m{k}")).alias(f"m{k}"), F.greatest(F.lit(1), of_hyp(F.col(f"t{k}"))).cast("bigint").alias(f"d{k}"),
                 of_ref(wn).cast("double").alias(f"wn{k}"), of_ref(F.col(f"mm{k}")).cast("bigint").alias(f"mm{k}"),
                 of_ref(F.col(f"mt{k}")).cast("bigint").alias(f"mt{k}")]
        if k > 1:
            aggs.append(of_ref(F.greatest(F.lit(1.0), (F.col("len") - k + 1).cast("double"))).cast("double").alias(f"wd{k}"))
    out = x.groupBy(key).agg(*aggs)
    if not none:  # matches over several parts: the largest count of each gram, then their sum
        best = st.where("split AND side = 0").select(key, F.inline("best")).groupBy(key, "n", "g").agg(F.max("b").alias("b"))
        best = best.groupBy(key).agg(*[F.sum(F.when(F.col("n") == k, F.col("b")).otherwise(0)).alias(f"_b{k}") for k in span])
        out = out.join(best, key, "left").withColumns({f"m{k}": F.when(F.col("_split"), F.coalesce(f"_b{k}", F.lit(0))).otherwise(F.col(f"m{k}")) for k in span})
    out = out.select(*carry, "hl", F.coalesce(F.col("_close.l"), F.lit(0)).cast("bigint").alias("rl"), *[f"{c}{k}" for c in ("m", "d", "wn", "wd", "mm", "mt") for k in span])
    return out if pooled is None else out.unionByName(pooled)


def _pooled_references(hyps: DataFrame, refs: DataFrame, key: str, ref_id: str, toks: str, keywords: DataFrame | None,
                       kw_col: str | None, max_n: int) -> DataFrame:
    """:func:`reference_stats` of keys or references that stand in several rows, as gram rows: counts by (key, n, gram, side), the
    hypothesis' count and the largest of a reference beside each by a window over (key, n, gram), then sums by key."""
    carry = [key] + ([kw_col] if kw_col else [])
    hyps, refs = hyps.select(*carry, F.coalesce(toks, F.array()).alias("toks")), refs.where(F.col(toks).isNotNull())
    group = hyps.select(*carry)
    texts = hyps.select(key, F.lit(None).cast(refs.schema[ref_id].dataType).alias("_ref"), F.lit(True).alias("_hyp"), "toks").unionByName(
        refs.select(key, F.col(ref_id).alias("_ref"), F.lit(False).alias("_hyp"), F.col(toks).alias("toks")))
    counts = gram_rows(texts, [key, "_ref", "_hyp"], "toks", max_n).groupBy(key, "_ref", "_hyp", "n", "g").agg(F.count("*").alias("c"))
    same = Window.partitionBy(key, "n", "g")
    counts = counts.withColumn("ch", F.coalesce(F.max(F.when(F.col("_hyp"), F.col("c"))).over(same), F.lit(0)))
    counts = counts.withColumn("cr", F.coalesce(F.max(F.when(~F.col("_hyp"), F.col("c"))).over(same), F.lit(0)))
    counts = counts.join(group, key)
    if keywords is not None and kw_col:
        kw = bounded_broadcast(keywords.select(F.col("kw_group").alias("_kwg"), gram_id(1, F.xxhash64("token")).alias("_kwt"))
                               .distinct().withColumn("_kw", F.lit(1)))
        counts = counts.join(kw, (F.col(kw_col) == F.col("_kwg")) & (F.col("g") == F.col("_kwt")) & (F.col("n") == 1), "left")
    else:
        counts = counts.withColumn("_kw", F.lit(None).cast("int"))
    is_kw = F.coalesce(F.col("_kw"), F.lit(0))
    w = F.when(F.col("n") == 1, F.when(is_kw == 1, F.lit(KEYWORD_WEIGHT)).otherwise(F.lit(OTHER_WEIGHT))).otherwise(F.lit(1.0))
    hyp, ref = F.col("_hyp"), ~F.col("_hyp")
    aggs = []
    for k in range(1, max_n + 1):
        at = F.col("n") == k
        total = lambda cond, v: F.coalesce(F.sum(F.when(at & cond, v)), F.lit(0))  # noqa: B023, E731
        aggs += [total(hyp, F.least("c", "cr")).cast("bigint").alias(f"m{k}"),
                 F.greatest(F.lit(1), total(hyp, F.col("c"))).cast("bigint").alias(f"d{k}"),
                 total(ref, F.least("c", "ch") * w).cast("double").alias(f"wn{k}"),
                 total(ref & (F.col("ch") > 0), F.col("c")).cast("bigint").alias(f"mm{k}"), total(ref, F.col("c")).cast("bigint").alias(f"mt{k}")]
    sums = counts.groupBy(key).agg(*aggs)
    # what each reference adds to the denominators, and the closest length
    ref_kw = counts.where(ref & (F.col("n") == 1)).groupBy(key, "_ref").agg(F.sum(F.col("c") * is_kw).alias("_k"))
    lens = refs.select(key, F.col(ref_id).alias("_ref"), F.size(toks).alias("_len")).join(ref_kw, [key, "_ref"], "left").join(
        hyps.select(key, F.size("toks").alias("_hl")), key)
    one = F.greatest(F.lit(1.0), F.col("_len") * OTHER_WEIGHT + F.coalesce(F.col("_k"), F.lit(0)) * (KEYWORD_WEIGHT - OTHER_WEIGHT))
    per = lens.groupBy(key).agg(
        F.min(F.struct(F.abs(F.col("_len") - F.col("_hl")).alias("d"), F.col("_len").alias("l"))).alias("_close"), F.sum(one).alias("wd1"),
        *[F.sum(F.greatest(F.lit(1.0), (F.col("_len") - k + 1).cast("double"))).alias(f"wd{k}") for k in range(2, max_n + 1)])
    out = hyps.select(*carry, F.size("toks").cast("bigint").alias("hl")).join(sums, key, "left").join(per, key, "left")
    span = range(1, max_n + 1)
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return out.select(*carry, "hl", F.coalesce(F.col("_close.l"), F.lit(0)).cast("bigint").alias("rl"),
                      *[zero(f"m{k}", "bigint") for k in span], *[F.coalesce(F.col(f"d{k}"), F.lit(1)).cast("bigint").alias(f"d{k}") for k in span],
                      *[zero(f"wn{k}", "double") for k in span], *[zero(f"wd{k}", "double") for k in span],
                      *[zero(f"mm{k}", "bigint") for k in span], *[zero(f"mt{k}", "bigint") for k in span])


def membership_col(n: int = 2, prefix: str = "") -> Column:
    """Share of reference n-grams (with multiplicity) that occur in the
    hypothesis; for n = 2 this is the edge ratio over adjacent token pairs.
    Null without reference n-grams."""
    m, t = F.col(f"{prefix}mm{n}"), F.col(f"{prefix}mt{n}")
    return F.when(t > 0, m / t)


def _score(num: list[Column], den: list[Column], hl: Column, rl: Column) -> Column:
    logs = [F.log(F.when(n > 0, n / d).otherwise(F.lit(EPSILON) / d)) for n, d in zip(num, den)]
    bp = (F.when(hl > rl, F.lit(1.0)).when(hl == 0, F.lit(0.0))
           .otherwise(F.exp(F.lit(1.0) - rl.cast("double") / hl.cast("double"))))
    geo = F.exp(sum(logs[1:], logs[0]) / F.lit(float(len(logs))))
    return F.when(num[0] == 0, F.lit(0.0)).otherwise(bp * geo)


def bleu_col(max_n: int = MAX_N, prefix: str = "") -> Column:
    """BLEU from the stats columns of one row (sample or summed corpus)."""
    p = prefix
    return _score([F.col(f"{p}m{k}") for k in range(1, max_n + 1)], [F.col(f"{p}d{k}") for k in range(1, max_n + 1)],
                  F.col(f"{p}hl"), F.col(f"{p}rl"))


def weighted_col(max_n: int = MAX_N, prefix: str = "") -> Column:
    p = prefix
    return _score([F.col(f"{p}wn{k}") for k in range(1, max_n + 1)], [F.col(f"{p}wd{k}") for k in range(1, max_n + 1)],
                  F.col(f"{p}hl"), F.col(f"{p}rl"))


def corpus_stats(stats: DataFrame, by: Sequence[str], max_n: int = MAX_N) -> DataFrame:
    """Sum numerators, denominators and lengths before dividing."""
    cols = ["hl", "rl"] + [f"{x}{k}" for x in ("m", "d", "wn", "wd") for k in range(1, max_n + 1)]
    return stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])


def top_tokens(df: DataFrame, group: str, tokens_col: str, k: int = 50) -> DataFrame:
    """The k most frequent tokens per group, ties by token: (kw_group, token).
    Counting is a partial aggregation; the top-k window gets a partial
    WindowGroupLimit, so a hot group never sorts its whole vocabulary in
    one task."""
    c = (df.select(F.col(group).alias("kw_group"), F.explode(tokens_col).alias("token"))
           .groupBy("kw_group", "token").count())
    w = Window.partitionBy("kw_group").orderBy(F.desc("count"), F.asc("token"))
    return c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("kw_group", "token")
