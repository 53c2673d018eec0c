"""Files that hold one JSON array of objects, read by several tasks each.

Spark's text reader splits a file at any byte and moves each cut to the next ``}``; so a task sees a range of the file as pieces
that end with a ``}``.  What a range can't know is what came before: is its begin inside a string, and how deep?  So each
piece, and by composition each range, carries a map of the state before to the state after:

    inside a string?   the state flips with an odd number of quotes (escaped ones left out)
    depth              grows by a number that depends on whether the begin was inside a string: two numbers a piece

The maps of a range's pieces are summed up in the range's own window; the ranges' maps are composed by a prefix scan over
a table with one row per range.  Then every piece knows its depth, a record ends where the depth comes back to that of the array,
and records get consecutive numbers.  Records inside a range are put together there; only those that a cut goes through are
gathered from several ranges.

Defined cases: white space, brackets, quotes and escapes inside strings don't matter; an empty array gives no rows; a file
with a single object gives that row; fields that are missing are null, as with Spark's own reader.  A file must be valid JSON
in UTF-8 and every element an object; compressed files are read by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESCAPED = r"\\."
STRING = r'"[^"]*("|\z)'
#: The rest of a string whose begin lies before the piece.
HEAD = r'\A[^"]*("|\z)'


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def piece_maps(piece: Column) -> dict[str, Column]:
    """``odd``: does the piece flip "inside a string"?  ``d0``, ``d1``: by how much the depth grows when it begins outside, inside."""
    plain = F.regexp_replace(piece, ESCAPED, "")
    odd = _count(plain, '"') % 2

    def grows(src: Column, out_at_end: Column) -> Column:
        code = F.regexp_replace(src, STRING, "")
        level = _count(code, "{") + _count(code, "[") - _count(code, "]")
        return level - F.when(out_at_end, 1).otherwise(0)  # the piece's own closing brace, if it isn't text

    return {"odd": odd.cast("int"), "d0": grows(plain, odd == 0).cast("long"),
            "d1": grows(F.regexp_replace(plain, HEAD, ""), odd == 1).cast("long")}


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, range, nth, piece`` and the piece's map."""
    x = spark.read.option("lineSep", "}").text(path)
    x = x.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
                 F.monotonically_increasing_id().alias("nth"), F.col("value").alias("piece"))
    return x.withColumns(piece_maps(F.col("piece")))


def states(x: DataFrame) -> DataFrame:
    """``x`` with ``inside`` (after the piece: inside a string?) and ``depth`` (after it), from the begin of the file."""
    here = Window.partitionBy("file", "range").orderBy("nth")
    upto = here.rowsBetween(Window.unboundedPreceding, -1)
    # inside the range, for both states at its begin: flip says whether the state at a piece's begin differs from that
    x = x.withColumn("flip", F.coalesce(F.sum("odd").over(upto), F.lit(0)) % 2)
    x = x.withColumn("g0", F.when(F.col("flip") == 0, F.col("d0")).otherwise(F.col("d1")))
    x = x.withColumn("g1", F.when(F.col("flip") == 0, F.col("d1")).otherwise(F.col("d0")))
    x = x.withColumn("s0", F.sum("g0").over(here)).withColumn("s1", F.sum("g1").over(here))
    ranges = x.groupBy("file", "range").agg((F.sum("odd") % 2).alias("odd"), F.sum("g0").alias("t0"), F.sum("g1").alias("t1"),
                                            F.min_by(F.substring(F.regexp_replace("piece", r"\A[\s\uFEFF]+", ""), 1, 1), "nth").alias("head"))
    # the scan over ranges: first the state at each begin, then the depth, and the depth of a file's records
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("at", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    ranges = ranges.withColumn("t", F.when(F.col("at") == 0, F.col("t0")).otherwise(F.col("t1")))
    ranges = ranges.withColumn("deep", F.coalesce(F.sum("t").over(before), F.lit(0)))
    ranges = ranges.withColumn("base", F.when(F.first("head").over(Window.partitionBy("file").orderBy("range")).startswith("["), 1).otherwise(0))
    x = x.join(ranges.select("file", "range", "at", "deep", "base"), ["file", "range"])
    depth = F.col("deep") + F.when(F.col("at") == 0, F.col("s0")).otherwise(F.col("s1"))
    return x.withColumn("inside", (F.col("at") + F.col("flip") + F.col("odd")) % 2).withColumn("depth", depth)


def records(x: DataFrame) -> DataFrame:
    """``file, range, nth, text``: the text of each element of :func:`pieces`; ``range, nth`` order the records of a file."""
    x = states(x).select("file", "range", "nth", "piece", ((F.col("inside") == 0) & (F.col("depth") == F.col("base"))).alias("ends"))
    here = Window.partitionBy("file", "range").orderBy("nth")
    x = x.withColumn("rec", F.coalesce(F.sum(F.col("ends").cast("int")).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "piece"))), lambda p: F.concat(p["piece"], F.lit("}"))), "")
    part = x.groupBy("file", "range", "rec").agg(text.alias("text"), F.max("ends").alias("ends"), F.min("nth").alias("nth"))
    # a record that no cut goes through is neither the first of its range nor without an end
    whole = part.where((F.col("rec") > 0) & F.col("ends")).select("file", "range", "nth", "text")
    # the others: the open end of a range, ranges inside one record, the first end of a range; few, at most two a range
    edge = part.where((F.col("rec") == 0) | ~F.col("ends"))
    order = Window.partitionBy("file").orderBy("range", "rec")
    edge = edge.withColumn("cut", F.coalesce(F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "rec", "text"))), lambda p: p["text"]), "")
    edge = edge.groupBy("file", "cut").agg(F.max("ends").alias("ends"), F.min(F.struct("range", "nth")).alias("at"), joined.alias("text"))
    edge = edge.where("ends").select("file", F.col("at.range").alias("range"), F.col("at.nth").alias("nth"), "text")
    return whole.unionByName(edge).withColumn("text", F.regexp_replace("text", r"\A[^{]*", ""))


def read_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The elements of all arrays under ``path`` as rows of ``schema``."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return records(pieces(spark, path)).select(F.from_json("text", kind).alias("r")).select("r.*")
