"""Integer column arithmetic that stays in BIGINT.

``/`` divides as DOUBLE, which merges neighbouring ids above 2^53.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(c, k: int) -> Column:
    """``floor(c / k)`` of an integer column and a positive constant, exact for every BIGINT."""
    c = (F.col(c) if isinstance(c, str) else c).cast("bigint")
    return F.call_function("div", c, F.lit(k)) - F.when((c < 0) & (c % k != 0), 1).otherwise(0)
