"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

1. Texts become token arrays: A-Z lower-cased, ASCII punctuation deleted, cut at ``[\\x20\\x09-\\x0D]``.
2. Fixed masks read five of eight consecutive tokens and ignore the other three.  The hash of each mask at each position
   of the training texts is joined with those of the benchmark; a hit gives a document, an item and a diagonal
   (training position less item position).  Hits are summed per document, item and diagonal before any shuffle.
3. For each such diagonal the item and the document are laid side by side and the best window of ``window`` tokens found.
   A document is contaminated when at least ``threshold`` percent of a window's tokens are equal.

Any window of 12 or 13 tokens with at most two substitutions holds a hit of either mask.  Items of 8 to 11 tokens, which are
compared as a whole, have too few places for them and get a third, shorter mask, so with the defaults (13 tokens, 80 percent:
11 equal) nothing that counts is missed; tests go through every set of substitutions at every length.  The third mask is read
only when the benchmark has such items.

The benchmark side has one row per different seed, and it is broadcast only after a count and size check; beyond the bound
the same join is shuffled.  Texts are read again only for documents with hits.

Defined cases: null texts and texts of under eight tokens never match; items under eight tokens are too short to tell and
never match; an item repeated under several ids is reported under each; repeated rows are reported alike; item ids are of any
type, since the joins use a row number of the stored items; a null id is kept as such (``flagged`` marks its documents, but
lists known ids only); empty tables on either side give no match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import ASCII_SPACE, UPPER, stored, whole
from tiermill.operators.joins import bounded_broadcast

#: Token positions that the masks read, of SPAN consecutive ones: 11010011 and its mirror image.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
SPAN = 8
#: Read as well for items of under FULL tokens: 111011, which fits where substitutions leave six or seven tokens.
SHORT = (0, 1, 2, 4, 5)
FULL = 12
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: Column) -> Column:
    """Token array of a text; ``translate`` lower-cases, maps white space to the blank and deletes punctuation in one go."""
    gaps = ASCII_SPACE.replace(" ", "")
    flat = F.translate(whole(text), UPPER + gaps + PUNCTUATION, UPPER.lower() + " " * len(gaps))
    return F.array_remove(F.split(flat, " "), "")


def seeds(rows: DataFrame, keys: list[str], masks: tuple = MASKS) -> DataFrame:
    """``keys, pos, h`` of each mask at each position of ``rows.words``."""
    used = sorted({p for m in masks for p in m})
    last = min(m[-1] for m in masks)
    # tokens are hashed once; the explode of one array keeps the optimizer from repeating that work in every slice below
    x = rows.select(*keys, F.explode(F.array(F.transform("words", lambda w: F.xxhash64(w)))).alias("w"))
    n = F.size("w") - last
    shifted = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("pos"), *[F.slice("w", p + 1, n).alias(f"w{p}") for p in used])
    x = x.where(F.size("w") >= SPAN).select(*keys, F.inline(shifted).alias("pos", *[f"w{p}" for p in used]))
    marks = []
    for m in masks:
        h = F.xxhash64(F.lit(sum(1 << p for p in m)), *[F.col(f"w{p}") for p in m])
        marks.append(h if m[-1] == last else F.when(F.col(f"w{m[-1]}").isNotNull(), h))  # null: the mask goes past the end
    x = x.select(*keys, "pos", F.explode(F.array(*marks)).alias("h"))
    return x if all(m[-1] == last for m in masks) else x.where("h IS NOT NULL")


def _best(window: int) -> Column:
    """The most equal tokens in a window of the item (array ``item``) against ``words`` on the diagonal ``diag``."""
    n, m = F.size("words"), F.size("item")
    same = F.transform(F.sequence(F.lit(0), m - 1), lambda q: F.when(
        (q + F.col("diag") >= 0) & (q + F.col("diag") < n) & (F.get("item", q) == F.get("words", (q + F.col("diag")).cast("int"))), 1).otherwise(0))
    size = F.least(F.lit(window), m)
    return F.array_max(F.transform(F.sequence(F.lit(1), m - size + 1), lambda s: F.aggregate(
        F.slice(same, s, size), F.lit(0), lambda a, x: a + x)))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, threshold: int = 80, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id, tag, item_id, n_equal, n_window`` of every document and item that overlap; ``tag`` tells rows of one id apart."""
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("item")).where(F.size("item") >= SPAN)
    # numbered once, in files: the number stands for an item, whatever its id, in everything below
    items = stored(items.distinct().withColumn("row_id", F.monotonically_increasing_id()), "benchmark-items")
    lines = items.select("row_id", F.col("item").alias("words"))
    few = lines.where(F.size("words") < FULL)
    masks, places = MASKS, seeds(lines, ["row_id"])
    if not few.isEmpty():
        masks, places = (*MASKS, SHORT), places.unionByName(seeds(few, ["row_id"], (SHORT,)))
    table = places.groupBy("h").agg(F.collect_set(F.struct("row_id", F.col("pos").alias("q"))).alias("at"))
    table = table.select("h", F.to_json("at").alias("at"))  # one row per seed; a plain type, so that its size can be measured
    words = d.select("id", "tag", tokens(F.col("text")).alias("words"))
    hits = seeds(words, ["id", "tag"], masks).join(bounded_broadcast(table), "h")
    at = F.from_json("at", "array<struct<row_id: bigint, q: int>>")
    hits = hits.select("id", "tag", "pos", F.inline(at))
    diagonals = stored(hits.select("id", "tag", "row_id", (F.col("pos") - F.col("q")).alias("diag"))
                           .groupBy("id", "tag", "row_id", "diag").agg(F.count("*").alias("n_hits")), "benchmark-hits")
    again = bounded_broadcast(diagonals.select(F.col("id").alias("hit_id"), F.col("tag").alias("hit_tag")).distinct())
    texts = (d.join(again, F.col("id").eqNullSafe(F.col("hit_id")) & F.col("tag").eqNullSafe(F.col("hit_tag")))
              .select("hit_id", "hit_tag", tokens(F.col("text")).alias("words")).dropDuplicates(["hit_id", "hit_tag"]))
    x = diagonals.join(texts, F.col("id").eqNullSafe(F.col("hit_id")) & F.col("tag").eqNullSafe(F.col("hit_tag")))
    x = x.join(items, "row_id").select("id", "tag", "item_id", _best(window).alias("n_equal"),
                                        F.least(F.lit(window), F.size("item")).alias("n_window"))
    x = x.where(100 * F.col("n_equal") >= threshold * F.col("n_window"))
    return x.groupBy("id", "tag", "item_id").agg(F.max(F.struct("n_equal", "n_window")).alias("m")).select(
        "id", "tag", "item_id", "m.n_equal", "m.n_window")


def flagged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, best_equal`` per row of ``docs``."""
    found = (contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **how).groupBy("id", "tag")
             .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("n_equal").alias("best_equal")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("doc_tag"))
    x = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("doc_tag") == F.col("tag")), "left")
    return x.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"),
                    F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce("item_ids", F.array().cast(found.schema["item_ids"].dataType)).alias("item_ids"),
                    F.coalesce("best_equal", F.lit(0)).cast("long").alias("best_equal"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without overlap with the benchmark, with all their columns."""
    found = (contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **how)
             .select(F.col("id").alias("_id"), F.col("tag").alias("_tag")).distinct())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.col(f"row.`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"row.`{text_col}`")) == F.col("_tag"))
    return row.join(found, key, "left_anti").select("row.*")
