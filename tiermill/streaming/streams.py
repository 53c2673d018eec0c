"""Structured Streaming operators.

All sinks are files in the shared folder with a checkpoint next to them, so
a restarted query resumes where it stopped.  ``run_available_now`` drives a
query over everything that is there and returns the sink as a batch
DataFrame (used by the registered queries and the tests).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiermill.operators import pairs as P
from tiermill.operators.tiers import FAILED, PERFECT, SYNC


def utc_instant(col: str) -> F.Column:
    """TIMESTAMP_NTZ (a UTC wall clock) -> TIMESTAMP, whatever the session
    time zone; watermarks refuse TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(col)).cast("timestamp")


def utc_text(c: F.Column) -> F.Column:
    """TIMESTAMP -> 'yyyy-MM-dd HH:mm:ss' in UTC, whatever the session time zone."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz")),
                         "yyyy-MM-dd HH:mm:ss")


def stream_tier_windows(stream: DataFrame, ts: str, by: Sequence[str], value: str,
                        width: str = "1 day", slide: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Counts and mean value per event-time window (tumbling, or sliding
    when ``slide`` is given) and ``by``; rows later than ``lateness`` behind
    the newest event are dropped, and a window is emitted once closed."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (stream.withWatermark(ts, lateness)
                  .groupBy(win.alias("window"), *by)
                  .agg(F.count("*").alias("n"), F.avg(value).alias("avg_value")))


def stream_reward_windows(tiered: DataFrame, ts: str, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Rollout monitor: tier counts and mean reward per event-time window
    (tumbling, or sliding when ``slide`` is given) of a stream with ``tier``
    and ``reward`` whose watermark on ``ts`` is set."""
    win = F.window(ts, width, slide) if slide else F.window(ts, width)
    return tiered.groupBy(win.alias("window")).agg(
        F.count("*").alias("n"), F.count_if(F.col("tier") == PERFECT).alias("n_perfect"),
        F.count_if(F.col("tier") == SYNC).alias("n_sync"), F.count_if(F.col("tier") == FAILED).alias("n_failed"),
        F.avg("reward").alias("mean_reward"))


def stream_dedupe(stream: DataFrame, ts: str, keys: Sequence[str], lateness: str = "1 day") -> DataFrame:
    """Drop rows whose keys were already seen within ``lateness``."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(list(keys))


def mine_batch(sink: str, store: str, keys: Sequence[str], id_col: str, text_col: str, **kw) -> Callable[[DataFrame, int], None]:
    """foreachBatch body for groups that may span micro-batches.

    A batch's candidates are kept in ``store/batch_id=<n>``; the groups that
    it touches are mined from all their candidates so far into
    ``sink/batch_id=<n>``.  Both are overwritten, so a replayed batch is
    idempotent.  :func:`read_mined` gives each group's latest pairs."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")
        seen = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("batch_id", T.LongType())])).parquet(store).where(F.col("batch_id") <= batch_id)
        touched = seen.where(F.col("batch_id") == batch_id).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
        rows = seen.join(touched, same, "left_semi").drop("batch_id")
        P.mine_pairs(rows, keys, id_col, text_col, **kw).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
    return run


def read_mined(spark: SparkSession, sink: str, store: str, keys: Sequence[str]) -> DataFrame:
    """The pairs of every group as of the last batch that touched it."""
    last = spark.read.parquet(store).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("batch_id").alias("_last"))
    pairs = spark.read.parquet(sink)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return pairs.join(last, same & (F.col("batch_id") == F.col("_last"))).select(*[c for c in pairs.columns if c != "batch_id"])


def run_available_now(sdf: DataFrame, sink: str, checkpoint: str, mode: str = "append",
                      foreach: Callable[[DataFrame, int], None] | None = None) -> None:
    w = sdf.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if foreach is not None:
        q = w.foreachBatch(foreach).start()
    else:
        q = w.outputMode(mode).format("parquet").option("path", sink).start()
    q.awaitTermination()


def read_sink(spark: SparkSession, sink: str, schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(sink)
