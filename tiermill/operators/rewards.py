"""Reward functions reachable from SQL by name (V3).

A reward is a factory of scorers; a scorer sees the rows of one group in order, one at a time, and keeps whatever bounded state
it needs.  Registered, it is a table function: Spark partitions the table argument by the group, sorts it and streams the
rows through, so that a group of any size takes constant memory.

    register_reward(spark, "first_run", FirstRun, "group_id bigint, event_id bigint")
    SELECT * FROM first_run(TABLE(runs) PARTITION BY group_id ORDER BY event_id)
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf


class Scorer(Protocol):
    def score(self, row: Row) -> float | None:
        """The reward of the group's next row."""


def register_reward(spark: SparkSession, name: str, factory: Callable[[], Scorer], keep: str) -> None:
    """Make ``factory`` callable in SQL as the table function ``name``, which returns the columns ``keep`` (a schema) of each row
    of its table and ``reward``.  Without PARTITION BY a table function would be one scorer per task; so it must be given, and
    ORDER BY with it where the order counts."""
    columns = T.StructType.fromDDL(keep).fieldNames()

    class Reward:
        def __init__(self):
            self.scorer = factory()

        def eval(self, row: Row):
            value = self.scorer.score(row)
            yield (*(row[c] for c in columns), None if value is None else float(value))

    spark.udtf.register(name, udtf(Reward, returnType=f"{keep}, reward double"))


class FirstRun:
    """The first row of a group is its reference: an equal output of a run that worked earns 1, another run that worked 0.5, one
    that failed 0.1.  State: the reference's output."""

    def __init__(self):
        self.begun, self.wanted = False, None

    def score(self, row: Row) -> float:
        out = None if row["stdout"] is None else row["stdout"].strip()
        if not self.begun:
            self.begun, self.wanted = True, out
        if not row["run_ok"]:
            return 0.1
        return 1.0 if out is not None and out == self.wanted else 0.5
