"""Running values by blocks: any cut gives the values of one window; huge keys are spread."""

import random

from pyspark.sql import functions as F

from tiermill.operators import diffs as DF
from tiermill.operators import layout as LY
from tiermill.operators import scans as S
from tests.test_layout import fold


def test_any_blocks_give_the_sequential_values(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.randrange(-3, 4), rng.choice([None, rng.randrange(50)])) for k in ("a", "b", None) for p in range(120)]
    want = {}
    for k in ("a", "b", None):
        s = low = 0
        top = None
        for _, p, v, t in [r for r in rows if r[0] == k]:
            s += v
            low = min(low, s)
            top = t if top is None else top if t is None else max(top, t)
            want[k, p] = (s, low, top)
    d = spark.createDataFrame(rows, "k string, pos long, v int, t int")
    for size in (1, 7, 50, 1000):
        x = S.running(d.withColumn("b", F.floor(F.col("pos") / size)), ["k"], "b", ["pos"], sums={"s": F.col("v")}, lows={"low": "s"}, tops={"top": F.col("t")})
        assert {(r.k, r.pos): (r.s, r.low, r.top) for r in x.collect()} == want


def test_cut_array(spark):
    d = spark.createDataFrame([(1, list(range(10))), (2, []), (3, None), (4, [7])], "k long, a array<int>")
    got = sorted((r.k, r.b, r.pos, r.value) for r in S.cut_array(d, ["k"], F.col("a"), 4, "b").collect())
    assert got == [(1, i // 4, i, i) for i in range(10)] + [(4, 0, 0, 7)]


def test_one_huge_document_is_spread_and_right(spark):
    line = "some words here \t and there\n"
    n = 20_000
    d = spark.createDataFrame([(1, line * n)], "k long, t string")
    spans = DF.token_spans(d, "k", "t", block=4096)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")  # these few MB would come together again
    try:
        assert spans.groupBy(F.spark_partition_id()).count().count() > 2
    finally:
        spark.conf.set(name, old)
    tail = spans.orderBy(F.desc("tok_idx")).first()
    assert (tail.tok_idx, tail.s, tail.e, tail.token) == (5 * n - 1, len(line) * n - 6, len(line) * n - 1, "there")
    lines = DF.line_offsets(d, "k", "t", block=1000)
    assert lines.where(F.col("start") != F.col("line_no") * len(line)).count() == 0 and lines.count() == n


def test_line_offsets_ends(spark):
    d = spark.createDataFrame([(1, "a\n\nbc"), (2, "x\n"), (3, ""), (4, None), (5, "\n")], "k long, t string")
    for block in (1, 2, 100):
        got = sorted((r.k, r.line_no, r.line, r.start, r.end) for r in DF.line_offsets(d, "k", "t", block).collect())
        assert got == [(1, 0, "a", 0, 2), (1, 1, "", 2, 3), (1, 2, "bc", 3, 5), (2, 0, "x", 0, 2), (5, 0, "", 0, 1)]


def test_sweep_against_all_pairs(spark):
    rng = random.Random(2)
    spans, ranges = [], []
    for k in range(6):
        at = 0
        for i in range(60):
            n = rng.randrange(0, 6)
            spans.append((k, i, at, at + n))
            at += n + rng.randrange(0, 3)
        for _ in range([0, 1, 5, 10, 20, 3][k]):
            a = rng.randrange(-5, at)
            ranges.append((k, a, a + rng.randrange(0, 40)))
    sp = spark.createDataFrame(spans, "k long, tok_idx long, s long, e long")
    rg = spark.createDataFrame(ranges, "k long, fs long, fe long")
    want = {(k, i): any(q == k and a < z and max(a, s - 2) < min(z, e - 2) for q, a, z in ranges) for k, i, s, e in spans}
    for bucket in (1, 13, 10_000):
        got = DF.overlap_flags(sp, rg, ["k"], shift=F.lit(2), bucket=bucket)
        assert got.columns == ["k", "tok_idx", "s", "e", "hit"]
        assert {(r.k, r.tok_idx): r.hit for r in got.collect()} == want


def test_layout_cut_into_blocks(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choice(["a", "b", "NEW_LINE", "INDENT", "DEDENT", "INDENT", "it's"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    lines += [None, "NEW_LINE " * 40, "INDENT " * 30 + "x " + "DEDENT " * 40 + "y"]
    d = spark.createDataFrame(list(enumerate(lines)), "k long, t string")
    for size in (1, 3, 10, 1000):
        got = {r.k: r.code for r in LY.layout_lines(d, "k", "t", size=size).collect()}
        assert [got[i] for i in range(len(lines))] == [fold(s or "") for s in lines]
