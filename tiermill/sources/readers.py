"""Readers (S1-S8, J1, J2).

Rows get explicit keys: file order becomes a dense ``line_no`` computed
from per-block counts (a table with one row per file split), never from a
single-partition window over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiermill.functions.text import py_strip
from tiermill.sources.json_arrays import read_array

SAMPLE_SCHEMA = T.StructType([
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])


def read_samples(spark: SparkSession, path: str, layout: str,
                 schema: T.StructType | str | None = None) -> DataFrame:
    """Samples from JSON files.  ``layout`` is "lines" (an object per line)
    or "array" (one array per file); the caller knows it, and a folder holds
    one kind.  With a schema both are split into many tasks; without one,
    array files are inferred and read a task per file."""
    if layout not in ("lines", "array"):
        raise ValueError(f"unknown layout {layout!r}")
    if layout == "array" and schema is not None:
        return read_array(spark, path, schema)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.option("multiLine", layout == "array").json(path)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns are added and nulls replaced with the default."""
    for c, v in defaults.items():
        if c in df.columns:
            df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
        else:
            df = df.withColumn(c, F.lit(v))
    return df


def flatten_record(df: DataFrame, col: str = "data",
                   bare: Sequence[str] = ("instruction", "input", "gt_code")) -> DataFrame:
    """If ``col`` is a struct column: lift its fields; ``bare`` fields keep
    their own name, the others are prefixed ``<col>_``."""
    if col not in df.columns:
        return df
    fields = df.schema[col].dataType.fieldNames()
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *[F.col(f"{col}.{f}").alias(f if f in bare else f"{col}_{f}") for f in fields])


def numbered(df: DataFrame, out: str = "line_no") -> DataFrame:
    """Dense 0-based row numbers in file order for a file scan.

    Rows of one file split are contiguous in one partition, so the number
    within a split is ``monotonically_increasing_id - min of the split``;
    the split offsets come from a prefix sum over a table with one row per
    split, joined back (broadcast by AQE when small).  Files are in order of
    the number in ``part-<number>`` names, then of their path: names sort
    wrongly as text from part 100000 on."""
    x = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                  F.monotonically_increasing_id().alias("_m"))
    blocks = x.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))
    part = F.regexp_extract("_f", r"part-(\d+)[^/]*$", 1)
    blocks = blocks.withColumn("_p", F.when(part != "", part.cast("bigint")).otherwise(-1))
    w = Window.orderBy("_p", "_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (x.join(blocks.select("_f", "_b", "_m0", "_off"), ["_f", "_b"])
             .withColumn(out, (F.col("_off") + F.col("_m") - F.col("_m0")).cast("bigint"))
             .drop("_f", "_b", "_m", "_m0", "_off"))


def read_lines(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """(line_no, value) for line-aligned text files, each line stripped."""
    df = numbered(spark.read.text(path))
    if strip:
        df = df.withColumn("value", py_strip("value"))
    return df.select("line_no", "value")


def align_lines(pred: DataFrame, ref: DataFrame, ids: DataFrame | None = None, check: bool = True) -> DataFrame:
    """1:1 alignment on ``line_no``; the job fails when the files differ in length (checked in the same pass).  One union
    and one aggregation by line instead of a join per file."""
    sides = {"pred": pred, "ref": ref} | ({"id": ids} if ids is not None else {})
    x = None
    for i, (_, df) in enumerate(sides.items()):
        one = df.select("line_no", F.lit(i).alias("_side"), "value")
        x = one if x is None else x.unionByName(one)
    here = lambda i: F.max(F.when(F.col("_side") == i, F.col("value")))
    j = x.groupBy("line_no").agg(*[here(i).alias(name) for i, name in enumerate(sides)], F.count("*").alias("_n"))
    if check:
        fail = F.raise_error(F.lit("aligned files differ in length")).cast("bigint")
        j = j.withColumn("line_no", F.when(F.col("_n") != len(sides), fail).otherwise(F.col("line_no")))
    return j.drop("_n")


def read_hypotheses(spark: SparkSession, path: str, hyp_field: str = "prediction") -> DataFrame:
    """(line_no, hyp, target) from a JSON-lines file of predictions."""
    schema = T.StructType([T.StructField(hyp_field, T.StringType()), T.StructField("target", T.StringType())])
    df = numbered(spark.read.schema(schema).json(path))
    return df.select("line_no", F.col(hyp_field).alias("hyp"), "target")


def read_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """All keyword files (one keyword per line) in one read -> (kw_group,
    token), without repeats.  A group's file is ``<folder>/<group>.txt``, or any in ``<folder>/kw_group=<group>``."""
    at = F.col("_metadata.file_path")
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    in_folder = plain(plain(F.regexp_extract(at, r"/kw_group=([^/]*)/[^/]*$", 1)))  # once for the path, once for the folder's name
    group = F.when(at.contains("/kw_group="), in_folder).otherwise(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt", 1))
    return (spark.read.option("recursiveFileLookup", "true").text(folder, pathGlobFilter="*.txt").select(group.alias("kw_group"), py_strip("value").alias("token"))
            .filter(F.col("token") != "").distinct())
