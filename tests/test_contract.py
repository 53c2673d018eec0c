"""Driver contract, plan shape and the SQL oracle on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_entry_has_rows(spark):
    df = E.entry(spark)
    assert df.columns == ["lang", "source", "strategy", "chosen_id", "rejected_id", "pair_rank"]
    assert df.count() > 0


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["mine_pairs", "bleu_sample", "tree_match", "layout_lines", "focus_tokens"])
def test_no_cartesian_no_python(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


#: Queries of the library proper whose plans hold a Python node, and which.
PYTHON = {"tree_shapes": "MapInArrow", "tree_shapes_all": "MapInArrow", "tree_match": "MapInArrow", "tree_match_all": "MapInArrow",
          "tree_match_corpus": "MapInArrow", "tree_comments": "MapInArrow", "composite_fenced": "MapInArrow", "category_fenced": "MapInArrow",
          "layout_lines": "MapInArrow", "group_reward_pandas": "MapInPandas", "reward_sql": "UDTF"}


#: These end in a scan of the files that they wrote, as the queries on streams do.
ROUND_TRIPS = {"samples_array", "reward_log", "shard_merge", "report_bodies", "weighted_files", "jsonl_roundtrip", "aligned_lines", "rollout_append",
               "append_metrics", "hypotheses_jsonl", "partitioned_report"}


def test_plans_of_all_queries(spark):
    """No cross join anywhere, Python only where it is named."""
    from tiermill.plans.queries import QUERIES
    found = {}
    for name, f in QUERIES.items():
        if name.startswith("stream_") or name in ROUND_TRIPS:
            continue
        p = plan(f(spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        assert not re.search(r"BatchEvalPython(?!UDTF)|ArrowEvalPython(?!UDTF)", p), name
        nodes = {k for k in ("MapInArrow", "MapInPandas", "PythonMapInArrow", "UDTF") if k in p}
        if nodes:
            found[name] = nodes
    assert set(found) == set(PYTHON) and all(PYTHON[k] in n for k, n in found.items())


def test_keywords_are_broadcast(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.queries()["weighted_ngram"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin" in p


FAST = ["tier_counts", "mine_pairs", "fence_extract", "direction_parse", "prompt_build", "bleu_sample",
        "tree_match", "pref_metrics", "line_multiset_diff", "layout_lines", "stream_tier_windows", "aligned_lines", "focus_tokens",
        "samples_array", "epoch_order", "reward_sql", "tree_comments"]


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle_small(spark, name):
    from scripts.check_oracle import TABLES, rows_of
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(ocols, res.fetchall())
