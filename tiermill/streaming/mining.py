"""Pair mining on a stream with keyed state.

An open group's state is what its pairs can still come from: the ``caps[tier]`` best texts of each tier, ranked by a digest of
seed and text, each with the smallest id seen.  That is all a group ever keeps, however many candidates it gets: a text
that is among the best of all candidates is among the best of those seen so far at any time, so it never leaves the state and
misses no smaller id.  A group closes when the watermark passes its closing time; an event-time timer then emits its tiers,
the state goes, and the pairs are built in-row by the same expressions as in batch mining (``mine_pairs(by_text=True)``).

Groups that close at the same time are kept together, ``buckets`` keys of state a closing time, as each call for state or timers is a round
trip to the JVM: the calls grow with closing times and buckets, not with groups.  A micro-batch reads and writes the buckets that it touches, so
``buckets`` should grow with the groups that are open at a time.

Rows of a common group are cut to its best texts inside each Arrow batch before the shuffle, so a group that holds a third of
a batch sends a few rows per Arrow batch to its task.

Defined cases: candidates of another tier than the three are left out; a null text counts as the empty one; null keys are a
key like any other; rows that come after their group has closed are late and dropped by Spark; a group that the watermark
has not reached stays in the state and emits nothing.
"""

from __future__ import annotations

import contextlib
import hashlib
import pickle
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tiermill.functions.text import n_tokens
from tiermill.operators import pairs as P
from tiermill.operators.tiers import FAILED, PERFECT, SYNC

TIERS = (PERFECT, SYNC, FAILED)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 256
_NAN = float("nan")  # one object for all, so that keys with it are equal


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_rank(seed: int | str, text: str) -> str:
    """:func:`tiermill.operators.pairs.text_rank` of one text."""
    return hashlib.md5(f"{seed}|{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()


def merge(best: dict[tuple[str, str], tuple[str, int]], rows, caps: dict[str, int], seed: int | str) -> None:
    """Add (tier, id, text) rows to ``best``, {(tier, text): (rank, smallest id)}, keeping ``caps`` texts of a tier."""
    count = {t: sum(k[0] == t for k in best) for t in caps}
    for tier, i, text in rows:
        if tier not in caps:
            continue
        key = (tier, text)
        had = best.get(key)
        if had is not None:
            best[key] = had[0], min(had[1], i)
            continue
        best[key] = text_rank(seed, text), i
        count[tier] += 1
        if count[tier] > caps[tier]:
            worst = max((r, k) for k, (r, _) in best.items() if k[0] == tier)[1]
            del best[worst]
            count[tier] -= 1


def group_key(values) -> tuple:
    """A group's keys as a dictionary's key."""
    return tuple(_NAN if v != v else v for v in values)


class OpenGroups(StatefulProcessor):
    """State of the groups of a bucket, {group's keys: its best texts}, and a timer at their closing time."""

    def __init__(self, caps: dict[str, int], seed: int | str, keys: Sequence[str]):
        self.caps, self.seed, self.keys = caps, seed, list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.groups = handle.getValueState("groups", "best binary")

    def kept(self) -> dict[tuple, dict[tuple[str, str], tuple[str, int]]]:
        had = self.groups.get()
        return {group_key(k): best for k, best in pickle.loads(bytes(had[0])).items()} if had is not None else {}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept, new = self.kept(), {}
        if not kept:
            self.handle.registerTimer(int(key[0]))
        for r in rows:
            new.setdefault(group_key(r[k] for k in self.keys), []).append((r["tier"], r["_id"], r["_text"]))
        for group, found in new.items():
            merge(kept.setdefault(group, {}), found, self.caps, self.seed)
        self.groups.update((pickle.dumps(kept, 4),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.kept()
        self.groups.clear()
        for group, best in kept.items():
            tiers = {t: [] for t in TIERS}
            for (tier, text), (_, i) in sorted(best.items(), key=lambda x: (x[1], x[0])):
                tiers[tier].append(Row(r=len(tiers[tier]) + 1, id=i, text=text))
            yield Row(**dict(zip(self.keys, group)), **{f"_{t}": rows for t, rows in tiers.items()})

    def close(self) -> None:
        pass


def best_of_batches(rows: DataFrame, keys: Sequence[str], caps: dict[str, int], seed: int | str) -> DataFrame:
    """``keys, tier, _id, _text, _ts, _closes`` rows cut to each group's best texts within every Arrow batch; ``_ts`` becomes
    the latest of the batch's rows of the group, so that the watermark moves as without the cut."""
    keys = list(keys)

    def cut(batches):
        for x in batches:
            x = x[x["tier"].isin(list(caps))]
            if not len(x):
                continue
            last = x.groupby(keys, dropna=False)["_ts"].transform("max")
            x = x.assign(_ts=last).sort_values("_id", kind="stable").drop_duplicates([*keys, "tier", "_text"])
            x = x.assign(_rank=[text_rank(seed, t) for t in x["_text"]]).sort_values(["_rank", "_id"], kind="stable")
            place = x.groupby([*keys, "tier"], dropna=False).cumcount()
            yield x[place < x["tier"].map(caps)].drop(columns="_rank")

    return rows.mapInPandas(cut, rows.schema)


def stream_mine_state(stream: DataFrame, keys: Sequence[str], ts: str, closes: Column, id_col: str = "cand_idx",
                      text_col: str = "code", caps: dict[str, int] | None = None, max_pairs: int = P.DEFAULT_MAX_PAIRS,
                      seed: int = 42, max_tokens: int | None = None, prompt: Column | None = None,
                      lateness: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Pairs of every group of a stream of tiered candidates (keys, id, text, tier, ``ts``), emitted once its group has closed.

    ``closes`` is the group's closing time, a timestamp that all its rows agree on and none is after.  The session's state
    store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``), which transformWithState needs."""
    caps, keys = caps or P.DEFAULT_CAPS, list(keys)
    rows = stream.select(*keys, "tier", F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                         F.col(ts).alias("_ts"), F.unix_millis(closes).alias("_closes"))
    rows = best_of_batches(rows, keys, caps, seed).withWatermark("_ts", lateness)
    entry = T.ArrayType(T.StructType([T.StructField("r", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("text", T.StringType())]))
    out = T.StructType([rows.schema[k] for k in keys] + [T.StructField(f"_{t}", entry) for t in TIERS])
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    closed = rows.withColumn("_bucket", bucket).groupBy("_closes", "_bucket").transformWithState(OpenGroups(caps, seed, keys), out, "Append", "EventTime")
    extra: list[str] = []
    sides = [F.col(f"_{t}") for t in TIERS]
    if max_tokens is not None:
        extra = ["ntok"]
        asked = n_tokens(prompt) if prompt is not None else F.lit(0)
        sides = [F.transform(c, lambda x: x.withField("ntok", n_tokens(x["text"]) + asked)) for c in sides]
    return P.cap_pairs(P.pair_arrays(closed, keys, *sides, seed, extra), keys, max_pairs, max_tokens)
