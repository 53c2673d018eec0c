"""Line deduplication, in DataFrame functions only.

Lines are exploded and normalised, hashed to 128 bits, the distinct documents of each hash counted, lines over the
threshold dropped and the documents put together again by position.  The explode ships (hash, id, position) without
text; the two-step count (by hash and document, then by hash with map-side partial sums) spreads a line that stands in a
third of all documents over all tasks.  Text moves once, in the last join.

Defined cases: a null or empty text is one empty line; lines of fewer than ``min_chars`` code points never go; a
document that holds a line several times counts once; a null id counts as no document but its lines follow the same
rule; repeated rows are treated alike and all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import ASCII_SPACE, ascii_lower, stored, whole


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``id, tag, pos, h``: every line whose key has at least ``min_chars`` code points; ``tag`` tells rows of one
    id with different texts apart."""
    x = docs.select("id", "tag", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    x = x.select("id", "tag", "pos", line_key(F.col("line")).alias("key"))
    return x.where(F.char_length("key") >= min_chars).select("id", "tag", "pos", F.unhex(F.md5("key")).alias("h"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` per row: lines found in at least ``min_docs`` documents stay only in
    the largest id that holds them."""
    text = whole(F.col(text_col))
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    lines = line_hashes(d, min_chars)
    common = (lines.where(F.col("id").isNotNull()).groupBy("h", "id").agg(F.lit(1).alias("one"))
                   .groupBy("h").agg(F.count("*").alias("n_docs"), F.max("id").alias("last_id"))
                   .where(F.col("n_docs") >= min_docs).select("h", "last_id"))
    common = stored(common, "common-lines")  # of two plain sides adaptive execution can split a hot line
    gone = (lines.join(common, "h").where(~F.col("id").eqNullSafe(F.col("last_id")))
                 .groupBy("id", "tag").agg(F.collect_set("pos").alias("gone")))
    a, g = d.alias("a"), gone.alias("g")
    x = a.join(g, F.col("a.id").eqNullSafe(F.col("g.id")) & (F.col("a.tag") == F.col("g.tag")), "left")
    # only texts that lose lines are split; the bound variable keeps them from being split for each line
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    rest = lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n")
    joined = F.get(F.transform(F.array(F.split("text", "\n")), rest), F.lit(0))
    return x.select(F.col("a.id").alias("doc_id"), n_lines.cast("long").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                    F.when(F.col("gone").isNull(), F.col("text")).otherwise(joined).alias("text"))
