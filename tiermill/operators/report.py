"""Shards and dense indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermill.session import cut_lineage


def dense_index(df: DataFrame, order: Sequence[str], out: str = "idx", total: str | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (a unique key), without a
    global single-partition window over the data: range-partition and sort,
    number rows inside each partition with ``monotonically_increasing_id``,
    and add the prefix sum of partition sizes from a table with one row per
    partition.  ``total`` optionally adds the row count.

    The sorted frame is checkpointed into the shared folder first: partition
    ids are read in two branches of the plan, and only a materialised frame
    guarantees both see the same partitions (AQE may coalesce a shuffle read
    differently per branch)."""
    order = list(order)
    x = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    x = x.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = x.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))
    ws = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (sizes.withColumn("_off", F.coalesce(F.sum("_n").over(ws), F.lit(0)))
                  .withColumn("_total", F.sum("_n").over(Window.partitionBy())))
    res = (x.join(sizes.select("_p", "_m0", "_off", "_total"), "_p")
             .withColumn(out, (F.col("_off") + F.col("_m") - F.col("_m0")).cast("bigint")))
    if total:
        res = res.withColumn(total, F.col("_total").cast("bigint"))
    return res.drop("_p", "_m", "_m0", "_off", "_total")


def shard_ids(df: DataFrame, order: Sequence[str], workers: int) -> DataFrame:
    """Contiguous shards of size ceil(n / workers) in ``order``; the last
    shard may be short or empty (unlike ntile)."""
    x = dense_index(df, order, total="_n")
    chunk = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(workers)))
    return x.withColumn("shard", F.floor(F.col("idx") / chunk).cast("bigint")).drop("_n")


ROUNDS, WALK = 4, 64


def permuted(idx: Column, n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """Position of ``idx`` in a permutation of 0 .. n - 1 chosen by ``seed``; no sort and no shuffle.

    A Feistel network over pairs (l, r) with l below a = ceil(sqrt(n)) and r below b = ceil(n / a): each round adds a hash
    of one half to the other, modulo a or b, which can be undone, so it permutes the a * b pairs.  Of these less than a
    lie at n or above; a value that lands there goes through the network again (cycle walking), which keeps the permutation
    of the rest.  WALK rounds always do for n up to 4,096, and beyond the chance to need more is below n ** -32; it would raise."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    b = F.ceil(n.cast("double") / a).cast("bigint")
    word = lambda k, x: F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), k.cast("string"), x.cast("string"))), 1, 12), 16, 10).cast("bigint")

    def step(h, k):
        left = F.pmod(h["l"] + word(k, h["r"]), a)
        # rounds take turns: even ones move l, odd ones r
        return F.when(k % 2 == 0, F.struct(left.alias("l"), h["r"].alias("r"))).otherwise(
            F.struct(h["l"].alias("l"), F.pmod(h["r"] + word(k, h["l"]), b).alias("r")))

    def once(x):
        start = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, b).alias("r"))
        return F.aggregate(F.array(*[F.lit(k) for k in range(rounds)]), start, step, lambda h: h["l"] * b + h["r"])

    out = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(idx.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("the walk is too long")).cast("bigint"))


def epoch_order(df: DataFrame, key: str, epochs: int, seed: int | str = 42) -> DataFrame:
    """A row per row of ``df`` (``key`` is unique) and epoch, with its ``position`` in the epoch's order, a permutation of
    0 .. n - 1.  The rows are numbered once; each epoch's order is then an expression of number, count and seed."""
    x = dense_index(df, [key], out="_idx", total="_n")
    x = x.withColumn("epoch", F.explode(F.array(*[F.lit(e).cast("bigint") for e in range(epochs)])))
    at = permuted(F.col("_idx"), F.col("_n"), F.concat_ws("|", F.lit(str(seed)), F.col("epoch").cast("string")))
    return x.withColumn("position", at).drop("_idx", "_n")
