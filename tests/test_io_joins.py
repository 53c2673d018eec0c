"""Readers, neighbour lookup, size-checked broadcast and a hot group."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tiermill.operators import pairs as P
from tiermill.operators.joins import bounded_broadcast, neighbours_in_group
from tiermill.sources import readers as RD


def test_read_samples_both_layouts(spark):
    d = tempfile.mkdtemp(prefix="tiermill-test-")
    rows = [{"instruction": "a", "output": "x"}, {"instruction": "b", "input": "ctx", "output": "y"}]
    with open(os.path.join(d, "arr.json"), "w") as f:
        json.dump(rows, f, indent=2)
    with open(os.path.join(d, "lines.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    for name, layout in (("arr.json", "array"), ("lines.jsonl", "lines")):
        df = RD.with_defaults(RD.read_samples(spark, os.path.join(d, name), layout, schema=RD.SAMPLE_SCHEMA), {"input": ""})
        assert sorted(tuple(r) for r in df.select("instruction", "input", "output").collect()) == [
            ("a", "", "x"), ("b", "ctx", "y")]


def test_read_lines_keeps_file_order(spark):
    d = tempfile.mkdtemp(prefix="tiermill-test-")
    with open(os.path.join(d, "f.txt"), "w") as f:
        f.write("\n".join(f"  line {i}  " for i in range(5000)) + "\n")
    got = RD.read_lines(spark, os.path.join(d, "f.txt")).orderBy("line_no").collect()
    assert [r["value"] for r in got] == [f"line {i}" for i in range(5000)]
    assert [r["line_no"] for r in got] == list(range(5000))


def test_neighbours_cross_blocks(spark):
    ids = [1, 2, 5, 9, 4100, 4101, 9000, 20000]
    df = spark.createDataFrame([("g", i) for i in ids] + [("h", 3)], "grp string, id long")
    got = {(r["grp"], r["id"]): (r["prev_id"], r["next_id"]) for r in neighbours_in_group(df, ["grp"], "id", block=4096).collect()}
    for a, b in zip(ids, ids[1:]):
        assert got[("g", a)][1] == b and got[("g", b)][0] == a
    assert got[("g", 1)][0] is None and got[("g", 20000)][1] is None and got[("h", 3)] == (None, None)


def test_bounded_broadcast_falls_back(spark):
    small = spark.range(10)
    big = spark.range(100)
    assert "ResolvedHint" in small.hint("broadcast")._jdf.queryExecution().analyzed().toString()
    b = bounded_broadcast(big, max_rows=50)
    plan = spark.range(5).join(b, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan.lower()
    b2 = bounded_broadcast(small, max_rows=50)
    plan2 = spark.range(5).join(b2, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan2.lower()


def test_hot_group_matches_uniform_result(spark):
    # one group holds most rows; results equal mining each group alone
    rows = [(0, i, f"t{i % 50}", ["perfect", "sync", "failed"][i % 3]) for i in range(3000)]
    rows += [(g, i, f"u{g}-{i}", ["perfect", "sync", "failed"][i % 3]) for g in range(1, 20) for i in range(9)]
    df = spark.createDataFrame(rows, "s long, cand_idx long, code string, tier string").repartition(8)
    all_ = sorted(tuple(r) for r in P.mine_pairs(df, ["s"]).select("s", "chosen_id", "rejected_id").collect())
    alone = sorted(tuple(r) for r in P.mine_pairs(df.filter(F.col("s") == 0), ["s"]).select("s", "chosen_id", "rejected_id").collect())
    assert [r for r in all_ if r[0] == 0] == alone and len(alone) == 4


def test_bounded_broadcast_checks_bytes(spark):
    wide = spark.range(20).selectExpr("id", "repeat('x', 1000) AS s")
    b = bounded_broadcast(wide, max_rows=100, max_bytes=5_000)
    plan = spark.range(5).join(b, "id")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in plan.lower()


def test_part_files_are_in_numeric_order(spark):
    d = tempfile.mkdtemp(prefix="tiermill-test-")
    for n in (99999, 100000, 9999, 10001):
        with open(os.path.join(d, f"part-{n:05d}.txt"), "w") as f:
            f.write(f"{n}a\n{n}b\n")
    got = RD.read_lines(spark, d).orderBy("line_no").collect()
    assert [r["value"] for r in got] == [f"{n}{x}" for n in (9999, 10001, 99999, 100000) for x in "ab"]


def test_alignment_of_unequal_files_fails(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "line_no long, value string")
    assert RD.align_lines(a, a).count() == 2
    with pytest.raises(Exception, match="differ in length"):
        RD.align_lines(a, a.limit(1)).collect()


def test_keyword_files_of_a_folder(spark):
    d = tempfile.mkdtemp(prefix="tiermill-test-")
    for name, words in (("java", "class\n for \n\nfor\n"), ("c++", "int\n")):
        with open(os.path.join(d, name + ".txt"), "w") as f:
            f.write(words)
    assert sorted(map(tuple, RD.read_keywords(spark, d).collect())) == [("c++", "int"), ("java", "class"), ("java", "for")]


def test_floor_div_is_exact_for_large_and_negative_ids(spark):
    from tiermill.functions.ints import floor_div
    xs = [0, 3, 4, -1, -4, -5, 2**60 + 3, 2**60 + 4, -2**60 - 1]
    got = {r["x"]: r["q"] for r in spark.createDataFrame([(x,) for x in xs], "x long").select("x", floor_div("x", 4).alias("q")).collect()}
    assert got == {x: x // 4 for x in xs}


def test_no_shared_folder_on_a_cluster_raises():
    from types import SimpleNamespace as N

    from tiermill.session import checkpoint_dir
    conf = N(get=lambda k, d=None: d)
    sc = N(master="spark://host:7077", getConf=lambda: conf, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        checkpoint_dir(N(sparkContext=sc))


def test_lines_are_made_after_the_texts_are_in_order(spark, tmp_path):
    from tiermill.sources import readers as RD
    from tiermill.sources import sinks as SK
    df = spark.createDataFrame([(i, f"t{i} x") for i in range(500)], "line_no long, text string").repartition(7)
    lines = SK.in_line_order(df).select("line_no", F.upper("text").alias("value"))
    SK.write_lines(lines, str(tmp_path / "a"), ordered=True)
    assert sorted((r.line_no, r.value) for r in RD.read_lines(spark, str(tmp_path / "a")).collect()) == [(i, f"T{i} X") for i in range(500)]


def test_line_texts_shuffle_texts_not_tokens(spark):
    from tiermill.plans import fixtures as X
    from tests.conftest import SF_SMALL
    plan = X.hyp_ref(X.line_texts(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "split" in plan and "split" not in plan[plan.index("RepartitionByExpression"):]
