"""Components against every pair compared, on the table and on planted groups."""

import random

import numpy as np
import pytest

from tests.conftest import SF_MID, SF_SMALL
from tests.llm.brute import near_components
from tests.llm.test_line_exact import same_as_sql
from tiermill.llm import minhash as M
from tiermill.llm import queries


def check(rows, got, size, threshold):
    want = near_components(rows, size, threshold)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op1_minhash_dedup"](spark, SF_MID).collect()
    assert len(got) == len(rows)
    check(rows, got, 3, 85)


def test_query_matches_sql(spark):
    same_as_sql(spark, "op1_minhash_dedup", SF_SMALL)


@pytest.mark.parametrize("size,threshold", [(3, 85), (5, 80)])
def test_planted_groups_chains_and_short_texts(spark, size, threshold):
    rng = random.Random(size)
    word = lambda: "w%d" % rng.randrange(4000)
    texts = [None, "", " \n", "one", "One", "one two", "ONE  two", "a b c", "a b c d", "c b a"]
    base = [word() for _ in range(120)]
    for _ in range(150):  # copies near to the base, often not to one another
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    chain = [word() for _ in range(80)]
    for _ in range(25):  # each near to the one before only
        chain = chain[2:] + [word(), word()]
        texts.append("\t".join(chain).upper())
    texts += [" ".join(base)] * 40 + [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, keys int")
    check(rows, M.near_groups(d, size, threshold).collect(), size, threshold)
    kept = M.dedup_near(d, size, threshold)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, (_, c) in near_components(rows, size, threshold).items() if k == c}


def test_empty_table_null_ids_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_groups(empty).collect() == []
    assert M.dedup_near(empty).collect() == []
    t = "the same words again and again in a row"
    d = spark.createDataFrame([(None, t), (4, t), (4, t), (None, "quite other words than those before it"), (9, None)],
                              "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in M.near_groups(d).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (None, None, True), (9, 9, True)], key=str)
    assert sorted((r.doc_id for r in M.dedup_near(d).collect()), key=str) == sorted([4, 4, None, 9], key=str)


def test_signature_collisions_follow_the_similarity():
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    few = a[:6]
    s = M.signatures([a, b, few, few[:0]], 4096)
    same = (s[0] == s[1]).mean()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same - true) < 0.06
    assert (s[2] != M.EMPTY).all() and (s[3] == M.EMPTY).all()
