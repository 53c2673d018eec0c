"""Line and exact deduplication against SQL on the table, and on small cases."""

import hashlib
import os
import random

import duckdb
import pytest

from scripts.check_oracle import TABLES, rows_of
from tests.conftest import SF_SMALL
from tiermill.llm import exact_dedup as X
from tiermill.llm import line_dedup as L
from tiermill.llm import queries


def same_as_sql(spark, name, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    df = queries.QUERIES[name](spark, sf_dir)
    res = con.execute(queries.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


@pytest.mark.parametrize("name", ["op2_line_dedup", "op4_exact_dedup"])
def test_queries_match_sql(spark, name):
    same_as_sql(spark, name, SF_SMALL)


LONG = "A line that is long enough to be counted by the rule, " * 2


def test_lines(spark):
    rows = [(i, f"head {i}\n  {LONG.upper()}\t\n{LONG}\ntail") for i in range(5)] + [(9, None), (10, ""), (11, "\n"), (12, LONG)]
    rows += [(20 + i, "short\nshort") for i in range(9)] + [(40 + i, "x" * 39 + "\n" + "é" * 40) for i in range(5)]
    d = spark.createDataFrame([(i, t, "q", "w") for i, t in rows], "doc_id long, text string, h string, lines string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in L.dedup_lines(d).collect()}
    assert got[0] == (4, 2, "head 0\ntail") and got[12] == (1, 0, LONG)
    assert got[9] == got[10] == (1, 0, "") and got[11] == (2, 0, "\n")
    assert got[20] == (2, 0, "short\nshort") and got[40] == (2, 1, "x" * 39) and got[44][1] == 0


def test_lines_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(7, LONG)] * 6 + [(None, LONG)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dropped for r in L.dedup_lines(d).collect()} == {0}  # one document holds the line, however often
    d = spark.createDataFrame(rows + [(i, LONG) for i in range(5)], "doc_id long, text string")
    got = L.dedup_lines(d).collect()
    assert len(got) == 14 and sorted((r.doc_id, r.n_dropped) for r in got if r.doc_id is not None)[-1] == (7, 0)
    assert sum(r.n_dropped for r in got) == 8
    assert L.dedup_lines(d.where("false")).collect() == []


def test_exact_groups(spark):
    rows = [(5, "a b"), (3, "ab"), (4, "a  b"), (2, "a\t\nb"), (8, None), (9, ""), (1, " "), (6, "é"), (7, "x " * 9000), (10, "x" * 9000)]
    d = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, digest string, n_chars int")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in X.exact_groups(d).collect()}
    assert got[2] == (2, 4, True) and got[4] == (2, 4, False) and got[3][0] == 2
    assert got[1] == (1, 3, True) and got[8] == (1, 3, False) and got[7] == (7, 2, True) and got[6] == (6, 1, True)
    sha = {r.doc_id: r.text_sha256 for r in X.exact_groups(d).collect()}
    assert sha[5] == hashlib.sha256(b"ab").hexdigest()
    kept = X.dedup_exact(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 7]


def test_exact_repeated_rows_null_ids_and_empty_table(spark):
    d = spark.createDataFrame([(3, "t")] * 3 + [(None, "t"), (None, "u"), (None, "u")], "doc_id long, text string")
    got = X.exact_groups(d).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 2 and X.dedup_exact(d).count() == 2
    assert {r.keep_id for r in got} == {3, None}
    assert X.exact_groups(d.where("false")).collect() == [] and X.dedup_exact(d.where("false")).collect() == []


def test_cuckoo_index_inserts_deletes_and_resizes():
    rng = random.Random(1)
    index, live = X.CuckooIndex(lambda a, b: a + b, n_buckets=2), {}
    for _ in range(6000):
        key = hashlib.sha256(b"%d" % rng.randrange(2500)).digest()
        if rng.random() < 0.6:
            index.upsert(key, 1)
            live[key] = live.get(key, 0) + 1
        else:
            assert index.delete(key) == (live.pop(key, None) is not None)
    assert dict(index.items()) == live and index.size == len(live) and index.resizes > 3
    assert all(index.get(k) == n for k, n in live.items()) and index.get(b"\1" * 32) is None
    same = [b"\7\7" + b"\1" * 6 + bytes([i, j]) + b"\0" * 22 for i in range(8) for j in range(8)]
    crowd = X.CuckooIndex(lambda a, b: a + b)
    few = same[:8]  # as many as two buckets seat
    for k in few:
        crowd.upsert(k, 1)
    assert {k for k, _ in crowd.items()} == set(few)


def test_index_table_takes_insertions_and_deletions(spark):
    key = lambda i: bytearray(hashlib.sha256(b"%d" % i).digest())
    make = lambda rows: spark.createDataFrame([(op, key(i), 1, i) for op, i in rows], "op string, digest binary, n_chars long, id long")
    one = X.update_index(None, make([("+", i % 40) for i in range(60)]), buckets=4)
    assert one.count() == 40
    two = X.update_index(one, make([("-", 0), ("-", 39), ("-", 77), ("+", 99)]), buckets=4)
    copies = {r.id: r.copies for r in two.collect()}
    assert copies[0] == 1 and 39 not in copies and copies[99] == 1 and len(copies) == 40


def test_deleting_the_kept_row_promotes_the_next(spark):
    make = lambda rows: spark.createDataFrame([(op, bytearray(d), n, i) for op, d, n, i in rows],
                                              "op string, digest binary, n_chars long, id long")
    a, b = hashlib.sha256(b"a").digest(), hashlib.sha256(b"b").digest()
    one = X.update_index(None, make([("+", a, 9, 1), ("+", a, 5, 2), ("+", a, 5, 2), ("+", a, 9, None), ("+", b, 1, 7)]))
    keep = lambda index: {bytes(r.digest): (r.keep_chars, r.keep_id, r.group_size) for r in X.keepers(index).collect()}
    assert keep(one) == {a: (9, 1, 4), b: (1, 7, 1)}
    two = X.update_index(one, make([("-", a, 9, 1), ("-", b, 1, 7), ("-", b, 1, 7), ("-", a, 8, 2)]))
    assert keep(two) == {a: (9, None, 3)}
    three = X.update_index(two, make([("-", a, 9, None), ("-", a, 5, 2)]))
    assert keep(three) == {a: (5, 2, 1)}


def test_hot_digest_join_can_be_split(spark):
    """With low thresholds adaptive execution splits the rows of a digest that half of all rows have."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        d = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(4000)], "doc_id long, text string").repartition(6)
        x = X.exact_groups(d)
        assert sum(r.kept for r in x.collect()) == 2001
        assert "skew=true" in x._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
