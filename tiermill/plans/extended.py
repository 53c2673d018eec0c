"""Registered queries with their SQL side by side: keyed state on streams, splittable arrays, digests of subtrees, scans over
blocks, sweep joins, keyed permutations, any number of references, logs and shards, reward functions by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tiermill.functions.ints import floor_div
from tiermill.functions.text import WS, tokens
from tiermill.operators import ngrams as NG
from tiermill.operators import report as RP
from tiermill.operators import rewards as RW
from tiermill.operators import tiers as T
from tiermill.operators import trees as TR
from tiermill.plans import fixtures as X
from tiermill.plans.oracle import CANDS, GT, ORACLE, RUNS, TIER_PAIRS, TIER_REWARD, score_sql, strip
from tiermill.plans.queries import QUERIES, doc_keywords, docs, pages, r6
from tiermill.sources import commits as CM
from tiermill.sources import readers as RD
from tiermill.sources import sinks as SK
from tiermill.session import cut_lineage, shared_dir, table
from tiermill.streaming import mining as MN
from tiermill.streaming import streams as STM


def query(name: str, sql: str) -> Callable:
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f
    return add


# ------------------------------------------------------------------------------------------------- G2, keyed state

@query("stream_mine_state", f"""WITH {RUNS}, {GT}, {CANDS}, {TIER_PAIRS},
timed AS (SELECT t.*, r.ts FROM tiered t JOIN runs r ON r.event_id = t.cand_idx),
closed AS (SELECT * FROM timed WHERE strptime(day, '%Y-%m-%d') + INTERVAL 1 DAY < (SELECT max(ts) FROM timed) - INTERVAL 1 DAY),
dedup AS (SELECT user_id, day, tier, coalesce(stdout, '') AS code, min(cand_idx) AS id FROM closed GROUP BY ALL),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day, tier ORDER BY md5('42|' || md5(code)), id) AS tier_rank FROM dedup)
           WHERE tier_rank <= CASE tier WHEN 'perfect' THEN 2 ELSE 3 END),
p AS (SELECT a.user_id, a.day, CASE WHEN a.tier = 'sync' THEN 'B' WHEN b.tier = 'sync' THEN 'A' ELSE 'C' END AS strategy,
             a.id AS chosen_id, b.id AS rejected_id, a.code AS chosen, b.code AS rejected
      FROM capped a JOIN capped b ON a.user_id = b.user_id AND a.day = b.day
      WHERE (a.tier = 'perfect' AND b.tier = 'sync') OR (a.tier = 'sync' AND b.tier = 'failed')
         OR (a.tier = 'perfect' AND b.tier = 'failed' AND NOT EXISTS (
               SELECT 1 FROM capped c WHERE c.user_id = a.user_id AND c.day = a.day AND c.tier = 'sync'))),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY md5('42|' || chosen_id || '|' || rejected_id), chosen_id, rejected_id) AS pair_rank
      FROM p WHERE chosen <> rejected)
SELECT user_id, day, strategy, chosen_id, rejected_id, pair_rank FROM k WHERE pair_rank <= 4""")
def q_stream_mine_state(spark, sf):
    """Pairs of every closed (user, day) of a stream of run results, groups as keyed state: one quarter of the rows per micro-batch, in
    the order of event time.  The query stops after each quarter and goes on from its checkpoint with the next."""
    cands, gt = X.exec_stand_in(spark, sf)
    rows = T.tier(T.join_gt(cands, gt, X.SAMPLE_KEYS), policy="pairs").select(
        *X.SAMPLE_KEYS, "cand_idx", F.col("stdout").alias("code"), "tier", STM.utc_instant("ts").alias("ts"))
    rows = cut_lineage(rows)
    quarter = rows.select(F.percentile_approx(F.unix_millis("ts"), [0.25, 0.5, 0.75]).alias("q")).first().q or []
    part = sum((F.when(F.unix_millis("ts") > q, 1).otherwise(0) for q in quarter), F.lit(0))
    src, sink, ck = shared_dir(spark, "runs-src"), shared_dir(spark, "state-out"), shared_dir(spark, "state-ck")
    closes = STM.utc_instant("day_end")
    with MN.rocksdb_state(spark):
        for i in range(4):
            rows.where(part == i).write.mode("append").parquet(src)
            stream = spark.readStream.schema(rows.schema).parquet(src)
            stream = stream.withColumn("day_end", F.to_timestamp_ntz(F.col("day"), F.lit("yyyy-MM-dd")) + F.expr("INTERVAL 1 DAY"))
            pairs = MN.stream_mine_state(stream, X.SAMPLE_KEYS, "ts", closes)
            STM.run_available_now(pairs.select(*X.SAMPLE_KEYS, "strategy", "chosen_id", "rejected_id", "pair_rank"), sink, ck)
    return STM.read_sink(spark, sink, "user_id long, day string, strategy string, chosen_id long, rejected_id long, pair_rank long")


# ------------------------------------------------------------------------------------------------- S1/S3, array files

@query("samples_array", """SELECT doc_id, 'say "' || coalesce(text, '') || '"' AS instruction, '{"[' || chr(92) || '}' || source AS input, lang AS output
FROM documents""")
def q_samples_array(spark, sf):
    """Samples written as JSON arrays and read back by ranges; texts with brackets, quotes and backslashes."""
    rows = docs(spark, sf).select(
        "doc_id", F.concat(F.lit('say "'), F.coalesce("text", F.lit("")), F.lit('"')).alias("instruction"),
        F.concat(F.lit('{"[' + chr(92) + "}"), "source").alias("input"), F.col("lang").alias("output"))
    path = shared_dir(spark, "samples-array")
    SK.write_array(rows, path, "doc_id", ["doc_id", "instruction", "input", "output"])
    return RD.read_samples(spark, path, "array", "doc_id bigint, instruction string, input string, output string")


# ------------------------------------------------------------------------------------------------- O1, keyed permutation

def _permuted_sql(name: str, source: str, x: str) -> str:
    """CTEs that send column ``x`` of ``source`` (with n, epoch) through the network once: ``name`` has its columns and ``y``."""
    word = lambda k, c: f"CAST('0x' || substr(md5('42|' || epoch || '|{k}|' || {c}), 1, 12) AS BIGINT)"
    out = f"SELECT *, {x} // b AS l, {x} % b AS r FROM {source}"
    for k in range(RP.ROUNDS):
        half, other, mod = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        out = f"SELECT * REPLACE (({half} + {word(k, other)}) % {mod} AS {half}) FROM ({out})"
    return f"{name} AS (SELECT * EXCLUDE (l, r), l * b + r AS y FROM ({out}))"


def _epoch_sql(epochs: int) -> str:
    steps = [f"""i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS n FROM documents),
d AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM i, (SELECT unnest(range({epochs})) AS epoch) e)""",
             _permuted_sql("p0", "d", "x")]
    for k in range(1, 9):  # a value walks on with a chance of about 1 / sqrt(n)
        steps.append(_permuted_sql(f"p{k}", f"(SELECT doc_id, epoch, n, a, b, y AS x FROM p{k - 1} WHERE y >= n)", "x"))
    done = " UNION ALL ".join(f"SELECT epoch, doc_id, y AS position FROM p{k} WHERE y < n" for k in range(9))
    return "WITH " + ",\n".join(steps) + f"\nSELECT epoch::BIGINT AS epoch, doc_id, position::BIGINT AS position FROM ({done})"


@query("epoch_order", _epoch_sql(3))
def q_epoch_order(spark, sf):
    """Three epochs' orders of all documents, from one numbering and a keyed permutation."""
    return RP.epoch_order(docs(spark, sf).select("doc_id"), "doc_id", 3).select("epoch", "doc_id", "position")


# ------------------------------------------------------------------------------------------------- J2/A3, many references

N_REFS = 5


def _refs_sql() -> str:
    tok = f"list_filter(string_split_regex(text, '{WS}+'), lambda t: t <> '')"
    grams = " UNION ALL ".join(
        f"SELECT doc_id, side, {n} AS n, list_slice(t, i, i + {n - 1}) AS g FROM texts, unnest(range(1, len(t) - {n - 2})) u(i)" for n in range(1, 5))
    span = range(1, 5)
    return f"""WITH d AS (SELECT doc_id, lang, {tok} AS t FROM documents),
hyp AS (SELECT doc_id, lang, list_filter(t, lambda x, i: i % 7 <> 0) AS t FROM d),
refs AS (SELECT doc_id, k, list_filter(t, lambda x, i: i % (k + 2) <> 0) AS t FROM d, (SELECT unnest(range(1, {N_REFS + 1})) AS k) r WHERE k <= 1 + doc_id % {N_REFS}),
texts AS (SELECT doc_id, 0 AS side, t FROM hyp UNION ALL SELECT doc_id, k, t FROM refs),
kw AS (SELECT lang, token FROM (SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, token) AS rk
       FROM (SELECT lang, unnest(t) AS token FROM d) GROUP BY lang, token) WHERE rk <= 50),
c AS (SELECT doc_id, side, n, g, count(*) AS c FROM ({grams}) GROUP BY ALL),
h AS (SELECT doc_id, n, g, c AS ch FROM c WHERE side = 0),
r AS (SELECT c.doc_id, side, c.n, c.g, c.c, coalesce(h.ch, 0) AS ch, kw.token IS NOT NULL AS is_kw
      FROM c LEFT JOIN h USING (doc_id, n, g) JOIN hyp USING (doc_id)
      LEFT JOIN kw ON c.n = 1 AND kw.lang = hyp.lang AND kw.token = c.g[1] WHERE side > 0),
top AS (SELECT doc_id, n, g, max(c) AS cr FROM r GROUP BY ALL),
hs AS (SELECT h.doc_id, {", ".join(f"coalesce(sum(least(ch, coalesce(cr, 0))) FILTER (WHERE n = {k}), 0) AS m{k}, greatest(1, coalesce(sum(ch) FILTER (WHERE n = {k}), 0)) AS d{k}" for k in span)}
       FROM h LEFT JOIN top USING (doc_id, n, g) GROUP BY h.doc_id),
rs AS (SELECT doc_id, {", ".join(f"coalesce(sum(least(c, ch) * CASE WHEN n = 1 AND NOT is_kw THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END) FILTER (WHERE n = {k}), 0) AS wn{k}" for k in span)}
       FROM r GROUP BY doc_id),
one AS (SELECT doc_id, side, len(t) AS len, coalesce((SELECT sum(c) FROM r WHERE r.doc_id = x.doc_id AND r.side = x.side AND r.n = 1 AND is_kw), 0) AS k
        FROM texts x WHERE side > 0),
ds AS (SELECT o.doc_id, sum(greatest(1.0, 0.2::DOUBLE * len + 0.8::DOUBLE * k)) AS wd1, {", ".join(f"sum(greatest(1.0, len - {n - 1})) AS wd{n}" for n in range(2, 5))},
              arg_min(len, (abs(len - len(hyp.t)), len)) AS rl
       FROM one o JOIN hyp ON hyp.doc_id = o.doc_id GROUP BY o.doc_id),
stats AS (SELECT hyp.doc_id, len(hyp.t) AS hl, rl, {", ".join(f"coalesce(m{k}, 0) AS m{k}, coalesce(d{k}, 1) AS d{k}, coalesce(wn{k}, 0) AS wn{k}, wd{k}" for k in span)}
          FROM hyp LEFT JOIN hs USING (doc_id) LEFT JOIN rs USING (doc_id) JOIN ds USING (doc_id))
SELECT doc_id, round({score_sql('m', 'd')}, 6) AS bleu, round({score_sql('wn', 'wd')}, 6) AS weighted FROM stats"""


@query("reference_scores", _refs_sql())
def q_reference_scores(spark, sf):
    """Scores against one to five references a document, each reference a row."""
    d = docs(spark, sf).select("doc_id", "lang", tokens("text").alias("t"))
    hyps = d.select("doc_id", "lang", F.filter("t", lambda x, i: (i + 1) % 7 != 0).alias("tokens"))
    refs = d.select("doc_id", "t", F.explode(F.sequence(F.lit(1), (1 + F.pmod("doc_id", F.lit(N_REFS))).cast("int"))).alias("k"))
    refs = refs.select("doc_id", "k", F.filter("t", lambda x, i: (i + 1) % (F.col("k") + 2) != 0).alias("tokens"))
    st = NG.reference_stats(hyps, refs, "doc_id", "k", keywords=doc_keywords(spark, sf), kw_col="lang")
    return st.select("doc_id", r6(NG.bleu_col()).alias("bleu"), r6(NG.weighted_col()).alias("weighted"))


# ------------------------------------------------------------------------------------------------- K3/K6/K7/U3, logs and shards

@query("reward_log", f"""WITH {RUNS}, {GT}, {CANDS}, {TIER_REWARD},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, tier ORDER BY cand_idx) AS rn FROM rewarded)
SELECT user_id, day, (CAST(substr(day, 9, 2) AS INTEGER) // 10)::BIGINT AS epoch, (user_id % 4)::BIGINT AS rank, user_id * 31 AS global_step,
       'Translate run ' || user_id AS instruction, 'lang' || (user_id % 3) AS target_lang,
       string_agg(CAST(CAST(reward AS DECIMAL(3, 1)) AS VARCHAR), ',' ORDER BY cand_idx) AS rewards,
       count(*) FILTER (WHERE tier = 'perfect') AS n_perfect, count(*) FILTER (WHERE tier = 'sync') AS n_sync, count(*) FILTER (WHERE tier = 'failed') AS n_failed,
       coalesce(string_agg(stdout, ',' ORDER BY cand_idx) FILTER (WHERE tier = 'perfect' AND rn <= 1), '') AS perfect_samples,
       coalesce(string_agg(stdout, ',' ORDER BY cand_idx) FILTER (WHERE tier = 'sync' AND rn <= 2), '') AS sync_samples,
       coalesce(string_agg(stdout, ',' ORDER BY cand_idx) FILTER (WHERE tier = 'failed' AND rn <= 2), '') AS failed_samples
FROM ranked GROUP BY user_id, day""")
def q_reward_log(spark, sf):
    """The reward form of the rollout log, committed by epoch and rank, two of the ranks written again."""
    cands, gt = X.exec_stand_in(spark, sf)
    rewarded = T.tier(T.join_gt(cands, gt, X.SAMPLE_KEYS), policy="reward")
    rec = SK.reward_records(rewarded, X.SAMPLE_KEYS, "cand_idx", "stdout", F.col("user_id") * 31,
                            floor_div(F.dayofmonth(F.to_date("day")), 10).cast("int"), F.pmod("user_id", F.lit(4)).cast("int"),
                            F.concat(F.lit("Translate run "), F.col("user_id").cast("string")),
                            F.concat(F.lit("lang"), F.pmod("user_id", F.lit(3)).cast("string")))
    path, by = shared_dir(spark, "reward-log"), ["epoch", "rank"]
    CM.commit(rec, path, by)
    CM.commit(rec.where("rank < 2"), path, by)
    back = CM.read_committed(spark, path, by, rec.schema)
    return back.select("user_id", "day", F.col("epoch").cast("bigint").alias("epoch"), F.col("rank").cast("bigint").alias("rank"), "global_step",
                       "instruction", "target_lang", F.array_join(F.transform("rewards", lambda r: F.format_string("%.1f", r)), ",").alias("rewards"),
                       *[F.col(f"stats.{t}").alias(f"n_{t}") for t in (T.PERFECT, T.SYNC, T.FAILED)],
                       *[F.array_join(f"samples.{t}", ",").alias(f"{t}_samples") for t in (T.PERFECT, T.SYNC, T.FAILED)])


WORLD = 4


@query("shard_merge", f"""WITH i AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents),
s AS (SELECT *, idx // CAST(greatest(1, ceil(n / {WORLD}::DOUBLE)) AS BIGINT) AS rank FROM i)
SELECT rank::BIGINT AS rank, lang AS category, doc_id, CAST(n_chars / 2.0 AS DOUBLE) AS loss, CASE WHEN rank % 2 = 1 THEN source END AS note FROM s
WHERE rank < {WORLD}""")
def q_shard_merge(spark, sf):
    """Four ranks' shards, whose columns differ, as one table."""
    x = cut_lineage(RP.shard_ids(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), ["doc_id"], WORLD))
    folder = shared_dir(spark, "shards")
    for rank in range(WORLD):
        part = x.where(F.col("shard") == rank).select(F.col("lang").alias("category"), "doc_id", (F.col("n_chars") / 2).alias("loss"),
                                                      F.col("source").alias("note"))
        CM.write_shard(part if rank % 2 else part.drop("note"), folder, rank, WORLD)
    m = CM.merge_shards(spark, folder, WORLD)
    return m.select(F.col("rank").cast("bigint").alias("rank"), "category", "doc_id", "loss", "note")


@query("report_bodies", f"""WITH {RUNS}, {GT}, {CANDS}
SELECT 'day ' || day AS category, 'ID: ' || cand_idx || chr(10) || 'CodeBLEU: ' || printf('%.5f', (cand_idx % 100) / 100.0) || chr(10) || 'Loss: ' ||
       printf('%.5f', user_id / 8.0) || chr(10) || repeat('-', 30) || chr(10) || 'GT:' || chr(10) || coalesce(gt_stdout, '') || chr(10) || chr(10) ||
       'Rollout:' || chr(10) || coalesce(stdout, '') AS report
FROM cands""")
def q_report_bodies(spark, sf):
    """Whole reports with reference and rollout, by category, written and read back."""
    cands, gt = X.exec_stand_in(spark, sf)
    x = T.join_gt(cands, gt, X.SAMPLE_KEYS).select(
        F.concat(F.lit("day "), F.col("day")).alias("category"), F.col("cand_idx").cast("string").alias("id"),
        (F.pmod("cand_idx", F.lit(100)) / 100.0).alias("score"), (F.col("user_id") / 8.0).alias("loss"), "gt_stdout", "stdout")
    path = shared_dir(spark, "report-bodies")
    SK.write_report_bodies(x, path, SK.report_body("id", "score", "loss", "gt_stdout", "stdout"))
    return SK.read_report_bodies(spark, path)


# ------------------------------------------------------------------------------------------------- V3, rewards by name

@query("reward_sql", f"""WITH {RUNS},
g AS (SELECT event_id // 4 AS group_id, event_id, run_ok, stdout, first_value(stdout) OVER (PARTITION BY event_id // 4 ORDER BY event_id) AS ref FROM runs)
SELECT group_id, event_id,
       round(CASE WHEN run_ok AND {strip('stdout')} = {strip('ref')} THEN 1.0 WHEN run_ok THEN 0.5 ELSE 0.1 END::DOUBLE, 6) AS reward
FROM g""")
def q_reward_sql(spark, sf):
    """A registered reward called from SQL over groups of four consecutive runs."""
    RW.register_reward(spark, "first_run", RW.FirstRun, "group_id bigint, event_id bigint")
    runs = X.events_runs(spark, sf).select("event_id", "run_ok", "stdout", floor_div("event_id", 4).alias("group_id"))
    out = spark.sql("SELECT * FROM first_run(TABLE(SELECT * FROM {runs}) PARTITION BY group_id ORDER BY event_id)", runs=runs)
    return out.select("group_id", "event_id", r6("reward").alias("reward"))


# ------------------------------------------------------------------------------------------------- S7, T2

@query("weighted_files", ORACLE["weighted_ngram"])
def q_weighted_files(spark, sf):
    """Keyword-weighted scores whose keywords come from files, one per language, a keyword per line."""
    folder = shared_dir(spark, "keywords")
    SK.write_keywords(doc_keywords(spark, sf), folder)
    st = NG.ngram_stats(X.hyp_ref_documents(spark, sf), ["doc_id"], keywords=RD.read_keywords(spark, folder), kw_col="lang")
    return st.select("doc_id", r6(NG.weighted_col()).alias("weighted"))


@query("tree_comments", ORACLE["tree_shapes_all"].replace("md5(shape) AS shape_md5", "1 AS one").replace(", 1 AS one", ""))
def q_tree_comments(spark, sf):
    """Subtrees of pages between comments that hold markers, which are stripped first (pages have no // of their own but in
    addresses, which are written with other signs here)."""
    html = F.concat(F.lit("/* <ul><li> */"), F.replace("html", F.lit("//"), F.lit("||")), F.lit("\n// <b></b>"))
    d = TR.tree_digests(pages(spark, sf).select("page_id", html.alias("html")), ["page_id"], "html", strip_comments=True)
    return d.select("page_id", "pos", "depth", "size")
