"""Logs written twice, writers that die, shards that are missing, doubled or cut short; report bodies and keyword files."""

import pytest
from pyspark.sql import functions as F

from tiermill.session import shared_dir
from tiermill.sources import commits as C
from tiermill.sources import readers as RD
from tiermill.sources import sinks as SK

SCHEMA = "k long, v string, epoch int, rank int"


def rows_of(df):
    return sorted((r.k, r.v, r.epoch, r.rank) for r in df.collect())


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([(i, f"v{i}", i % 2, i % 3) for i in range(12)], SCHEMA)


def test_written_twice_is_there_once(spark, log):
    path, by = shared_dir(spark, "log"), ["epoch", "rank"]
    C.commit(log, path, by)
    C.commit(log, path, by)
    assert rows_of(C.read_committed(spark, path, by, SCHEMA)) == rows_of(log)
    C.commit(log.where("rank = 1 AND epoch = 0").limit(1).withColumn("v", F.lit("new")), path, by)
    C.commit(spark.createDataFrame([(99, "x", 7, None)], SCHEMA), path, by)
    got = C.read_committed(spark, path, by, SCHEMA)
    assert got.where("rank = 1 AND epoch = 0").count() == 1 and got.where("v = 'new'").count() == 1
    assert got.where("rank IS NULL").count() == 1 and got.count() == 12


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_dead_writer_leaves_nothing(spark, log, monkeypatch, fmt):
    path, by = shared_dir(spark, "log"), ["epoch", "rank"]
    C.commit(log.where("k < 6"), path, by, fmt)
    before = rows_of(C.read_committed(spark, path, by, SCHEMA, fmt))
    with monkeypatch.context() as m:
        m.setattr(C, "mark", lambda *a: (_ for _ in ()).throw(RuntimeError("killed between data and marker")))
        with pytest.raises(RuntimeError):
            C.commit(log, path, by, fmt)
    assert rows_of(C.read_committed(spark, path, by, SCHEMA, fmt)) == before
    C.commit(log, path, by, fmt)
    assert rows_of(C.read_committed(spark, path, by, SCHEMA, fmt)) == rows_of(log)


def shards(spark, world=8):
    folder = shared_dir(spark, "shards")
    for r in range(world):
        d = spark.createDataFrame([(r * 10 + i, float(i) if r % 2 else None) for i in range(r % 3)], "k int, x double")
        d = d.withColumn("k", F.col("k").cast("long")) if r == 5 else d.withColumn("extra", F.lit(f"e{r}")) if r == 2 else d
        C.write_shard(d, folder, r, world)
    return folder


def test_shards_become_one_table(spark):
    folder = shards(spark)
    got = C.merge_shards(spark, folder, 8)
    assert dict(got.dtypes) == {"k": "bigint", "x": "double", "extra": "string", "rank": "int"}
    assert sorted((r.rank, r.k, r.x, r.extra) for r in got.collect()) == sorted(
        ((r, r * 10 + i, float(i) if r % 2 else None, "e2" if r == 2 else None) for r in range(8) for i in range(r % 3)), key=lambda t: t[:2])
    C.write_shard(spark.createDataFrame([(1, 2.0)], "k int, x double"), folder, 0, 8)  # written again: replaced
    assert C.merge_shards(spark, folder).where("rank = 0").count() == 1


def test_bad_shards_raise(spark):
    folder = shards(spark, 3)
    with pytest.raises(ValueError, match="number of ranks"):
        C.merge_shards(spark, folder, 4)
    C.write_shard(spark.createDataFrame([(1,)], "k int"), folder, 7, 3)
    C.merge_shards(spark, folder)  # a rank beyond the number is no gap
    spark.createDataFrame([(1, 3, 1, '{"type":"struct","fields":[]}')], C._MANIFEST).write.parquet(f"{folder}/manifest/again")
    with pytest.raises(ValueError, match="more than once \\[1\\]"):
        C.merge_shards(spark, folder)
    two = shards(spark, 3)
    spark.createDataFrame([(5, 1.0)], "k int, x double").write.mode("append").json(f"{two}/shards/rank=1")
    with pytest.raises(ValueError, match="rows by manifest"):
        C.merge_shards(spark, two)
    three = shared_dir(spark, "shards")
    C.write_shard(spark.createDataFrame([(5,)], "k int"), three, 1, 2)
    with pytest.raises(ValueError, match="missing ranks \\[0\\]"):
        C.merge_shards(spark, three)
    C.write_shard(spark.createDataFrame([("a",)], "k string"), three, 0, 2)
    with pytest.raises(ValueError, match="'k'"):
        C.merge_shards(spark, three)


def test_report_bodies_come_back_whole(spark):
    rows = [("a", "1", 0.5, 1.25, "x\n\ny", "r\n"), ("b", "2", 0.0, 2.0, None, ""), ("a", "3", 1.0, 0.0, "", "z")]
    d = spark.createDataFrame(rows, "category string, id string, score double, loss double, gt string, out string")
    path = shared_dir(spark, "bodies")
    SK.write_report_bodies(d, path, SK.report_body("id", "score", "loss", "gt", "out"))
    got = {r.report for r in SK.read_report_bodies(spark, path).where("category = 'a'").collect()}
    assert got == {f"ID: {i}\nCodeBLEU: {s:.5f}\nLoss: {n:.5f}\n{'-' * 30}\nGT:\n{g}\n\nRollout:\n{o}" for c, i, s, n, g, o in rows if c == "a"}


def test_keyword_files(spark, tmp_path):
    for name, text in (("en.txt", "for\n while \n\nfor\n"), ("fr.txt", "si\n")):
        (tmp_path / name).write_text(text)
    assert sorted(map(tuple, RD.read_keywords(spark, str(tmp_path)).collect())) == [("en", "for"), ("en", "while"), ("fr", "si")]
    folder = shared_dir(spark, "kw")
    SK.write_keywords(spark.createDataFrame([("c++ 11", "int"), ("c++ 11", "a b")], "kw_group string, token string"), folder)
    assert sorted(map(tuple, RD.read_keywords(spark, folder).collect())) == [("c++ 11", "a b"), ("c++ 11", "int")]
