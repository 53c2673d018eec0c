"""Join helpers: size-checked broadcast and skew-safe neighbour lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiermill.session import cut_lineage

DEFAULT_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows
    and about ``max_bytes`` of data (string/binary lengths plus 8 bytes per
    other value).

    The side is checkpointed into the shared folder first (so it is computed
    once and the measuring pass is cheap); above either bound it is returned
    as is and the join falls back to a shuffle join (AQE may still convert
    it at run time).
    """
    small = cut_lineage(df)
    var = [f.name for f in small.schema.fields if f.dataType.typeName() in ("string", "binary")]
    fixed = len(small.schema.fields) - len(var)
    size = F.lit(8 * fixed)
    for c in var:
        size = size + F.coalesce(F.octet_length(F.col(c)), F.lit(0))
    m = small.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    if m["n"] <= max_rows and m["b"] <= max_bytes:
        return F.broadcast(small)
    return small


def neighbours_in_group(df: DataFrame, group: Sequence[str], order: str,
                        block: int = 4096) -> DataFrame:
    """Add ``next_<order>`` / ``prev_<order>``: the next and previous value of
    ``order`` within ``group`` (values unique per group).

    A window over ``group`` alone would put a hot group in one task.  Rows
    are cut into blocks of ``block`` consecutive ``order`` values: neighbours
    inside a block come from a window over (group, block); the first/last
    row of a block look up the neighbouring non-empty block in a table with
    one row per block.
    """
    blk = F.floor(F.col(order) / F.lit(block)).cast("bigint")
    x = df.withColumn("_blk", blk)
    w = Window.partitionBy(*group, "_blk").orderBy(order)
    x = (x.withColumn(f"next_{order}", F.lead(order).over(w))
          .withColumn(f"prev_{order}", F.lag(order).over(w)))
    blocks = x.groupBy(*group, "_blk").agg(F.min(order).alias("_bmin"), F.max(order).alias("_bmax"))
    wb = Window.partitionBy(*group).orderBy("_blk")
    blocks = (blocks.withColumn("_after", F.lead("_bmin").over(wb))
                    .withColumn("_before", F.lag("_bmax").over(wb))
                    .select(*group, "_blk", "_after", "_before"))
    x = x.join(blocks, [*group, "_blk"], "left")
    return (x.withColumn(f"next_{order}", F.coalesce(F.col(f"next_{order}"), F.col("_after")))
             .withColumn(f"prev_{order}", F.coalesce(F.col(f"prev_{order}"), F.col("_before")))
             .drop("_blk", "_after", "_before"))
