"""Overlaps against brute force, on the table and on planted passages; the masks' guarantee; no Python in the plan."""

import random
from itertools import combinations

from tests.conftest import SF_SMALL
from tests.llm.brute import bench_tokens, overlaps
from tests.llm.test_line_exact import same_as_sql
from tiermill.llm import decontaminate as D
from tiermill.llm import queries


def test_every_two_substitutions_leave_a_seed():
    for mask in D.MASKS:
        for gone in combinations(range(13), 2):
            assert any(all(s + p not in gone for p in mask) for s in range(13 - D.SPAN + 1))


def test_every_allowed_substitution_at_every_item_length(spark):
    bench = [(n, " ".join(f"i{n}x{q}" for q in range(n))) for n in range(1, 14)]
    docs, expect = [], {}
    for n, text in bench:
        words = text.split()
        for k in range(n - -(-80 * n // 100) + 1):
            for gone in combinations(range(n), k):
                copy = ["other%d" % q if q in gone else w for q, w in enumerate(words)]
                cut = [w for w in copy if not w.startswith("other")] if gone in {(0,), (0, 1), (n - 1,), (n - 2, n - 1)} else copy
                around = ["pad%d" % q for q in range(9)]
                # inside a text, alone, and hanging over either end of a text
                for t in (around + copy + around, copy, cut + around if 0 in gone else around + cut):
                    docs.append((len(docs), " ".join(t)))
                    expect[docs[-1][0]] = ([n], n - k) if n >= 8 and len(t) >= 8 else ([], 0)
    assert want(docs, bench) == expect
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {r.doc_id: (r.item_ids, r.best_equal) for r in D.flagged(d, b).collect()} == expect


def want(docs, bench):
    items = {i: bench_tokens(t) for i, t in bench}
    out = {}
    for i, t in docs:
        w = bench_tokens(t)
        found = {k: n for k, v in items.items() if (n := overlaps(w, v)) is not None}
        out[i] = (sorted(found), max(found.values(), default=0))
    return out


def test_query_over_the_whole_table(spark):
    read = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/{t}.parquet").select(k, "text").collect()]
    docs, bench = read("documents", "doc_id"), read("benchmark", "item_id")
    got = queries.QUERIES["op5_decontaminate"](spark, SF_SMALL)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
    rows = got.collect()
    assert {r.doc_id: (r.item_ids, r.best_equal) for r in rows} == want(docs, bench) and len(rows) == len(docs)
    assert any(r.contaminated for r in rows) and not all(r.contaminated for r in rows)


def test_query_matches_sql(spark):
    same_as_sql(spark, "op5_decontaminate", SF_SMALL)


def test_planted_passages(spark):
    rng = random.Random(4)
    word = lambda: "v%d" % rng.randrange(3000)
    bench = [(k, " ".join(word() for _ in range(rng.randint(9, 60)))) for k in range(30)] + [(30, None), (31, "too short"), (32, "x " * 20)]
    bench.append((33, bench[0][1]))
    docs = [(0, None), (1, ""), (2, "x x x x"), (3, "x " * 500)]
    for i in range(4, 200):
        item = bench_tokens(bench[rng.randrange(30)][1])
        a = rng.randrange(max(1, len(item) - 13))
        piece = item[a:a + rng.randint(5, 30)]
        for _ in range(rng.randint(0, 5)):
            piece[rng.randrange(len(piece))] = word()
        t = [word() for _ in range(rng.randint(0, 60))] + piece + [word() for _ in range(rng.randint(0, 60))]
        docs.append((i, (", " if i % 2 else "\n").join(w.upper() if i % 3 else w for w in t)))
    d = spark.createDataFrame([(i, t, "e", 1) for i, t in docs], "doc_id long, text string, item_id string, h int")
    b = spark.createDataFrame([(i, t, "e") for i, t in bench], "item_id long, text string, doc_id string")
    w = want(docs, bench)
    got = {r.doc_id: (r.item_ids, r.best_equal) for r in D.flagged(d, b).collect()}
    assert got == w and 20 < sum(bool(x) for x, _ in w.values()) < 190
    kept = D.clean(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, (x, _) in w.items() if not x}


def test_empty_tables_null_ids_and_repeated_rows(spark):
    t = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(None, t), (None, "other"), (7, t), (7, t), (7, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(1, t), (1, t), (None, t)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.contaminated) for r in D.flagged(d, b).collect()))
    assert got == [(0, False), (0, True), (7, False), (7, True), (7, True)]
    assert sorted((r.text for r in D.clean(d, b).collect())) == ["clean", "other"]
    assert {r.contaminated for r in D.flagged(d, b.where("false")).collect()} == {False}
    assert D.flagged(d.where("false"), b).collect() == []


def test_items_with_a_null_id_or_text_ids_count(spark):
    t = "one two three four five six seven eight nine ten"
    u = "red green blue white black brown pink grey"
    d = spark.createDataFrame([(1, t), (2, u), (3, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(None, t), (5, u)], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids, r.best_equal) for r in D.flagged(d, b).collect()}
    assert got == {1: (True, [], 10), 2: (True, [5], 8), 3: (False, [], 0)}
    assert [tuple(r) for r in D.contaminated(d, b).where("item_id IS NULL").select("id", "n_equal").collect()] == [(1, 10)]
    assert [r.text for r in D.clean(d, b).collect()] == ["clean"]
    b = spark.createDataFrame([("a", t), ("12", u), ("b", u), (None, u)], "item_id string, text string")
    got = {r.doc_id: (r.contaminated, r.item_ids, r.best_equal) for r in D.flagged(d, b).collect()}
    assert got == {1: (True, ["a"], 10), 2: (True, ["12", "b"], 8), 3: (False, [], 0)}
    assert [r.text for r in D.clean(d, b).collect()] == ["clean"]
