"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermill.session import shared_dir

#: Fixed value: the characters of ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would also touch other alphabets)."""
    return F.translate(c, UPPER, UPPER.lower())


def whole(c: Column) -> Column:
    """A text with null read as the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, so that tasks of one worker share parsed
    vocabularies.  Worker functions are pickled by value, so a module global would be rebuilt in each task."""
    name = "_tiermill_llm_worker_cache"
    mod = sys.modules.get(name)
    if mod is None:
        mod = sys.modules[name] = types.ModuleType(name)
        mod.cache = {}
    return mod.cache


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors, and later plans see
    the files' real size (a checkpoint would keep the statistics and constraints of the plan before, which grow from round to
    round in a loop)."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
