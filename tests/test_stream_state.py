"""Groups as keyed state: bounded, equal to batch mining, closed by the watermark."""

import datetime as dt
import random
import tempfile
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from tiermill.operators import pairs as P
from tiermill.session import shared_dir
from tiermill.streaming import mining as M
from tiermill.streaming import streams as STM

SCHEMA = "g string, cand_idx long, code string, tier string, ts timestamp, closes timestamp"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def row(g, i, code, tier, day, hour=1):
    return (g, i, code, tier, at(day, hour), at(day + 1))


def mined(spark, batches, **how):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    src = tempfile.mkdtemp(prefix="tiermill-stream-")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{src}/b{i}")
        time.sleep(1.2)  # file stream order = modification time
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    sink, ck = shared_dir(spark, "t-pairs"), shared_dir(spark, "t-ck")
    with M.rocksdb_state(spark):
        STM.run_available_now(M.stream_mine_state(stream, ["g"], "ts", F.col("closes"), **how), sink, ck)
    return STM.read_sink(spark, sink, "g string, strategy string, chosen_id long, rejected_id long, chosen string, rejected string, pair_rank long")


def test_equals_batch_mining_and_drops_what_is_late(spark):
    rng = random.Random(1)
    texts = [f"text {i}" for i in range(9)]
    one = [[row(g, 100 * k + i, rng.choice(texts), rng.choice(["perfect", "sync", "failed", "other"]), 1, 1 + k) for i in range(40) for g in ("a", "b", None)]
           for k in range(3)]  # copies of a text come back with other ids, smaller ones too
    one[2] += [row("a", -5, texts[3], "perfect", 1, 9), row("c", 1, "x", "perfect", 1), row("c", 2, None, "failed", 1)]
    late = [row("a", 1000, "too late", "perfect", 1, 20)]
    got = mined(spark, [*one, [row("d", 1, "p", "perfect", 9), row("d", 2, "f", "failed", 9)], late], max_tokens=2)
    want = P.mine_pairs(spark.createDataFrame([r for b in one for r in b], SCHEMA).na.fill("", ["code"]), ["g"], "cand_idx", "code",
                        max_tokens=2, by_text=True)
    rows = lambda df: sorted((str(r.g), r.strategy, r.chosen_id, r.rejected_id, r.pair_rank) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) > 6
    assert {r[0] for r in rows(got)} == {"a", "b", "c", "None"}  # d is still open


def test_state_holds_the_caps_only():
    """Merging in any order and any batches gives the best texts of all rows with their smallest ids."""
    rng = random.Random(2)
    caps = {"perfect": 2, "sync": 3}
    rows = [(rng.choice(["perfect", "sync", "failed"]), rng.randrange(1000), f"t{rng.randrange(30)}") for _ in range(400)]
    least = {}
    for t, i, x in rows:
        if t in caps:
            least[t, x] = min(least.get((t, x), 10**9), i)
    want = {}
    for t, n in caps.items():
        for rank, x in sorted((M.text_rank(7, x), x) for u, x in least if u == t)[:n]:
            want[t, x] = (rank, least[t, x])
    for _ in range(5):
        rng.shuffle(rows)
        best, a = {}, 0
        while a < len(rows):
            n = rng.randrange(1, 60)
            M.merge(best, rows[a:a + n], caps, 7)
            assert len(best) <= 5
            a += n
        assert best == want


def test_ranks_agree_with_the_batch_expression(spark):
    texts = ["", "a", "é\n", "x" * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(P.text_rank(42, "t").alias("r")).collect()
    assert [r.r for r in got] == [M.text_rank(42, t) for t in texts]


class Handle:
    """Counts the calls that a processor makes for its state."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None


def test_calls_for_state_do_not_grow_with_groups():
    handle, p = Handle(), M.OpenGroups(P.DEFAULT_CAPS, 42, ["g", "x"])
    p.init(handle)
    rows = lambda a: iter([Row(g=i % 200 or None, x=float("nan") if i % 2 else 1.0, tier="sync", _id=i, _text=f"t{i // 200}") for i in range(a, a + 800)])
    for a in (0, 800):
        assert not list(p.handleInputRows((77, 1), rows(a), None))
    assert handle.timers == [77] and handle.calls == 5
    out = list(p.handleExpiredTimer((77, 1), None, None))
    assert handle.calls == 7 and handle.value is None
    assert len(out) == 200 and all(len(r["_sync"]) == P.DEFAULT_CAPS["sync"] and not r["_failed"] for r in out)
    best = sorted((M.text_rank(42, f"t{k}"), k) for k in range(8))[:P.DEFAULT_CAPS["sync"]]
    assert [(x.r, x.id, x.text) for x in next(r for r in out if r.g == 6)["_sync"]] == [(n, 200 * k + 6, f"t{k}") for n, (_, k) in enumerate(best, 1)]


def test_any_number_of_buckets_gives_the_same_pairs(spark):
    rng = random.Random(3)
    rows = [row(rng.choice([None, *(f"g{k}" for k in range(40))]), i, f"t{rng.randrange(6)}", rng.choice(["perfect", "sync", "failed"]), rng.randrange(1, 4)) for i in range(600)]
    rows.sort(key=lambda r: r[4])
    by_day = [[(f"{r[0]}-{r[4].day}" if r[0] else None, *r[1:]) for r in rows if r[4].day == d and (r[0] or d == 1)] for d in (1, 2, 3)]
    flat = lambda df: sorted((str(r.g), r.strategy, r.chosen_id, r.rejected_id, r.pair_rank) for r in df.collect())
    want = flat(P.mine_pairs(spark.createDataFrame([r for b in by_day for r in b], SCHEMA), ["g"], "cand_idx", "code", by_text=True))
    for n in (1, 7):
        assert flat(mined(spark, [*by_day, [row("z", 10**6, "p", "perfect", 9)]], buckets=n)) == want
    assert len(want) > 100
