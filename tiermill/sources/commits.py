"""Logs that can be appended again, and folders of shards that are merged.

A log keeps its rows under ``data/attempt=<id>``, a new attempt for every write, and one marker per partition (for example
epoch and rank, or a block of steps) under ``commits``, which names the attempt that counts.  Markers are written last, by dynamic
partition overwrite: writing the same partitions again replaces their markers, so a rerun leaves each row once; a writer that
dies before its markers leaves rows that no reader sees.

A folder of shards has a sub-folder per rank, with a manifest row of its own (rank, number of ranks, rows, columns).
:func:`merge_shards` reads them as one table only if every rank is there once and complete.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def commit(df: DataFrame, path: str, by: Sequence[str], fmt: str = "json") -> str:
    """Write ``df`` as the content of the partitions ``by`` that it has rows for; returns the attempt's id."""
    attempt, spark, by = uuid.uuid4().hex, df.sparkSession, list(by)
    df.write.partitionBy(*by).format(fmt).save(f"{path}/data/attempt={attempt}")
    mark(spark, path, by, attempt, df.schema, fmt)
    return attempt


def _rows(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def mark(spark: SparkSession, path: str, by: Sequence[str], attempt: str, schema: T.StructType, fmt: str) -> None:
    """Make an attempt's rows those that count: a marker row per partition, with the number of its rows."""
    x = _rows(spark, f"{path}/data/attempt={attempt}", schema, fmt)
    marks = x.groupBy(*by).agg(F.count("*").alias("n_rows")).withColumn("attempt", F.lit(attempt))
    (marks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/commits"))


def read_committed(spark: SparkSession, path: str, by: Sequence[str], schema: T.StructType | str, fmt: str = "json") -> DataFrame:
    """The rows of each partition's last committed attempt.  ``schema`` has the partition columns too."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    keys = T.StructType([kind[c] for c in by])
    marks = spark.read.schema(T.StructType([T.StructField("attempt", T.StringType()), *keys])).parquet(f"{path}/commits")
    data = _rows(spark, f"{path}/data", T.StructType([*kind, T.StructField("attempt", T.StringType())]), fmt)
    same = reduce(lambda a, b: a & b, [data[c].eqNullSafe(marks[c]) for c in by], data["attempt"] == marks["attempt"])
    return data.join(marks, same, "left_semi").select(*kind.fieldNames())


# ---------------------------------------------------------------------------------------------------------- shards

_MANIFEST = "rank int, world int, n_rows long, columns string"


def write_shard(df: DataFrame, folder: str, rank: int, world: int) -> None:
    """One rank's rows, and its manifest row when they are there.  Writing a rank again replaces it."""
    spark = df.sparkSession
    df.write.mode("overwrite").json(f"{folder}/shards/rank={rank}")
    n = _rows(spark, f"{folder}/shards/rank={rank}", df.schema, "json").count()
    spark.createDataFrame([(rank, world, n, df.schema.json())], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{rank}")


def _wider(a: T.DataType, b: T.DataType, name: str) -> T.DataType:
    """A type that holds the values of both."""
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in order and type(b) in order:
        top = max(order.index(type(a)), order.index(type(b)))
        return T.DoubleType() if order[top] is T.FloatType else order[top]()  # a float wouldn't hold every integer
    raise ValueError(f"column {name!r} is {a.simpleString()} in one shard and {b.simpleString()} in another")


def merge_shards(spark: SparkSession, folder: str, world: int | None = None) -> DataFrame:
    """All shards of a folder as one table with a column ``rank``.

    Columns are matched by name: one that a shard lacks is null there, numbers take the widest type met.  A rank that is
    missing or there twice, ranks that disagree about their number, and a shard with other rows than its manifest says raise;
    the driver reads one manifest row per rank."""
    found = spark.read.schema(_MANIFEST).option("recursiveFileLookup", "true").parquet(f"{folder}/manifest").collect()
    worlds = {r.world for r in found} | ({world} if world is not None else set())
    if len(worlds) != 1:
        raise ValueError(f"shards disagree about the number of ranks: {sorted(worlds)}")
    ranks = [r.rank for r in found]
    missing, twice = sorted(set(range(worlds.pop())) - set(ranks)), sorted({r for r in ranks if ranks.count(r) > 1})
    if missing or twice:
        raise ValueError(f"missing ranks {missing}, ranks that are there more than once {twice}")
    kinds: dict[str, T.DataType] = {}
    for r in found:
        for f in T.StructType.fromJson(json.loads(r.columns)):
            kinds[f.name] = _wider(kinds[f.name], f.dataType, f.name) if f.name in kinds else f.dataType
    schema = T.StructType([T.StructField(n, t) for n, t in kinds.items()])
    x = spark.read.schema(T.StructType([*schema, T.StructField("rank", T.IntegerType())])).json(f"{folder}/shards")
    counts = {r.rank: r.n for r in x.groupBy("rank").agg(F.count("*").alias("n")).collect()}
    wrong = {r.rank: (r.n_rows, counts.get(r.rank, 0)) for r in found if counts.get(r.rank, 0) != r.n_rows}
    if wrong:
        raise ValueError(f"rows by manifest and rows found differ: {wrong}")
    return x
