"""DuckDB SQL oracles, one per registered query (same column names).

Written independently of the Spark code: plain joins, windows and
aggregates over the pre-registered views.  RE2 has no ``(?d)`` flag; its '.'
already stops only at '\\n'.
"""

from __future__ import annotations

from tiermill.functions.text import WS

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def toks(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda t: t <> '')"


# ---------------------------------------------------------------- stand-ins

RUNS = """runs AS (
  SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, ts,
         event_type <> 'error' AS run_ok, props AS stdout, event_type, value
  FROM events)"""

GT = """gt AS (
  SELECT user_id, day, arg_min(event_id, (ts, event_id)) AS gt_event_id,
         arg_min(run_ok, (ts, event_id)) AS gt_ok, arg_min(stdout, (ts, event_id)) AS gt_stdout
  FROM runs GROUP BY user_id, day)"""

CANDS = """cands AS (
  SELECT r.user_id, r.day, r.event_id AS cand_idx, r.run_ok, r.stdout, r.event_type, r.value,
         g.gt_ok, g.gt_stdout
  FROM runs r JOIN gt g USING (user_id, day)
  WHERE r.event_id <> g.gt_event_id)"""

TIER_PAIRS = f"""tiered AS (
  SELECT *, CASE WHEN run_ok AND {strip('stdout')} = {strip("CASE WHEN gt_ok THEN gt_stdout ELSE 'GT_FAILED_PLACEHOLDER' END")} THEN 'perfect'
                 WHEN run_ok THEN 'sync' ELSE 'failed' END AS tier
  FROM cands)"""

TIER_REWARD = f"""rewarded AS (
  SELECT *, CASE WHEN NOT gt_ok THEN 'failed'
                 WHEN run_ok AND {strip('stdout')} = {strip('gt_stdout')} THEN 'perfect'
                 WHEN run_ok THEN 'sync' ELSE 'failed' END AS tier,
            CASE WHEN NOT gt_ok THEN 0.0
                 WHEN run_ok AND {strip('stdout')} = {strip('gt_stdout')} THEN 1.0
                 WHEN run_ok THEN 0.5 ELSE 0.1 END AS reward
  FROM cands)"""

DOC_TIERS = """cand AS (
  SELECT d.lang, d.source, d.doc_id, d.text,
         CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'perfect' ELSE 'sync' END AS tier
  FROM documents d JOIN labels l USING (doc_id)),
dedup AS (
  SELECT lang, source, tier, text, min(doc_id) AS doc_id, count(*) AS n_copies
  FROM cand GROUP BY lang, source, tier, text),
capped AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, tier
                                 ORDER BY md5('42|' || doc_id), doc_id) AS tier_rank
    FROM dedup)
  WHERE tier_rank <= CASE tier WHEN 'perfect' THEN 2 ELSE 3 END),
nsync AS (
  SELECT lang, source, count(*) FILTER (WHERE tier = 'sync') AS ns FROM capped GROUP BY lang, source),
pairs AS (
  SELECT a.lang, a.source, 'A' AS strategy, a.doc_id AS chosen_id, b.doc_id AS rejected_id,
         a.text AS chosen, b.text AS rejected
  FROM capped a JOIN capped b ON a.lang = b.lang AND a.source = b.source
  WHERE a.tier = 'perfect' AND b.tier = 'sync'
  UNION ALL
  SELECT a.lang, a.source, 'B', a.doc_id, b.doc_id, a.text, b.text
  FROM capped a JOIN capped b ON a.lang = b.lang AND a.source = b.source
  WHERE a.tier = 'sync' AND b.tier = 'failed'
  UNION ALL
  SELECT a.lang, a.source, 'C', a.doc_id, b.doc_id, a.text, b.text
  FROM capped a JOIN capped b ON a.lang = b.lang AND a.source = b.source
  JOIN nsync n ON n.lang = a.lang AND n.source = a.source
  WHERE a.tier = 'perfect' AND b.tier = 'failed' AND n.ns = 0)"""

MINED = f"""{DOC_TIERS},
mined AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source
               ORDER BY md5('42|' || chosen_id || '|' || rejected_id), chosen_id, rejected_id) AS pair_rank
    FROM pairs
    WHERE chosen <> rejected
      AND len({toks('chosen')}) <= 2048 AND len({toks('rejected')}) <= 2048)
  WHERE pair_rank <= 4)"""

# ---------------------------------------------------------------- phase 1

oracle("tier_counts", f"""WITH {RUNS}, {GT}, {CANDS}, {TIER_PAIRS}
SELECT user_id, day,
       count(*) FILTER (WHERE tier = 'perfect') AS n_perfect,
       count(*) FILTER (WHERE tier = 'sync') AS n_sync,
       count(*) FILTER (WHERE tier = 'failed') AS n_failed
FROM tiered GROUP BY user_id, day""")

oracle("tier_rewards", f"""WITH {RUNS}, {GT}, {CANDS}, {TIER_REWARD}
SELECT user_id, day, cand_idx, tier, round(CAST(reward AS DOUBLE), 6) AS reward FROM rewarded""")

oracle("group_first_gt", f"""WITH {RUNS}
SELECT event_id, (event_id // 4) AS group_id,
       first_value(event_id) OVER w AS gt_event_id,
       first_value(stdout) OVER w AS gt_stdout
FROM runs
WINDOW w AS (PARTITION BY (event_id // 4) ORDER BY event_id)""")

oracle("rollout_log", f"""WITH {RUNS}, {GT}, {CANDS}, {TIER_PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, tier ORDER BY cand_idx) AS rn FROM tiered)
SELECT user_id, day,
       count(*) FILTER (WHERE tier = 'perfect') AS n_perfect,
       count(*) FILTER (WHERE tier = 'sync') AS n_sync,
       count(*) FILTER (WHERE tier = 'failed') AS n_failed,
       coalesce(string_agg(CAST(cand_idx AS VARCHAR), ',' ORDER BY cand_idx) FILTER (WHERE tier = 'perfect' AND rn <= 1), '') AS perfect_samples,
       coalesce(string_agg(CAST(cand_idx AS VARCHAR), ',' ORDER BY cand_idx) FILTER (WHERE tier = 'sync' AND rn <= 3), '') AS sync_samples,
       coalesce(string_agg(CAST(cand_idx AS VARCHAR), ',' ORDER BY cand_idx) FILTER (WHERE tier = 'failed' AND rn <= 3), '') AS failed_samples
FROM ranked GROUP BY user_id, day""")

oracle("tier_dedupe", f"""WITH {DOC_TIERS}
SELECT lang, source, tier, doc_id, n_copies FROM dedup""")

oracle("tier_sample", f"""WITH {DOC_TIERS}
SELECT lang, source, tier, doc_id, tier_rank FROM capped""")

oracle("pairs_all", f"""WITH {DOC_TIERS}
SELECT lang, source, strategy, chosen_id, rejected_id, CAST(chosen = rejected AS BIGINT) AS same_text FROM pairs""")

oracle("mine_pairs", f"""WITH {MINED}
SELECT lang, source, strategy, chosen_id, rejected_id, pair_rank FROM mined""")

oracle("mine_runs", f"""WITH {RUNS}, {GT}, {CANDS}, {TIER_PAIRS},
every AS (SELECT user_id, day, cand_idx, stdout AS code, tier FROM tiered
          UNION ALL SELECT user_id, day, gt_event_id, gt_stdout, 'perfect' FROM gt
          WHERE (user_id, day) IN (SELECT (user_id, day) FROM gt)),
dedup AS (SELECT user_id, day, tier, code, min(cand_idx) AS id FROM every GROUP BY user_id, day, tier, code),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day, tier ORDER BY md5('42|' || id), id) AS tier_rank FROM dedup)
           WHERE tier_rank <= CASE tier WHEN 'perfect' THEN 2 ELSE 3 END),
p AS (SELECT a.user_id, a.day, CASE WHEN a.tier = 'sync' THEN 'B' WHEN b.tier = 'sync' THEN 'A' ELSE 'C' END AS strategy,
             a.id AS chosen_id, b.id AS rejected_id, a.code AS chosen, b.code AS rejected
      FROM capped a JOIN capped b ON a.user_id = b.user_id AND a.day = b.day
      WHERE (a.tier = 'perfect' AND b.tier = 'sync') OR (a.tier = 'sync' AND b.tier = 'failed')
         OR (a.tier = 'perfect' AND b.tier = 'failed' AND NOT EXISTS (
               SELECT 1 FROM capped c WHERE c.user_id = a.user_id AND c.day = a.day AND c.tier = 'sync'))),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY md5('42|' || chosen_id || '|' || rejected_id), chosen_id, rejected_id) AS pair_rank
      FROM p WHERE chosen <> rejected AND user_id % 12 + len({toks('chosen')}) <= 10 AND user_id % 12 + len({toks('rejected')}) <= 10)
SELECT user_id, day, strategy, chosen_id, rejected_id, pair_rank FROM k WHERE pair_rank <= 4""")

oracle("group_advantage", f"""WITH {RUNS}, {GT}, {CANDS}, {TIER_REWARD},
s AS (SELECT user_id, cand_idx, CAST(reward AS DOUBLE) AS r, avg(CAST(reward AS DOUBLE)) OVER (PARTITION BY user_id) AS m,
             stddev_samp(CAST(reward AS DOUBLE)) OVER (PARTITION BY user_id) AS sd FROM rewarded)
SELECT user_id, cand_idx, round(CASE WHEN sd > 1e-9 THEN (r - m) / sd ELSE 0.0 END, 6) AS advantage FROM s""")

oracle("weighted_sample", """WITH d AS (
  SELECT doc_id, lang, -ln((CAST('0x' || substr(md5('42|' || doc_id), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / CAST(n_chars AS DOUBLE) AS draw
  FROM documents WHERE n_chars > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY draw, doc_id) AS rank FROM d)
SELECT lang, doc_id, rank FROM k WHERE rank <= 20""")

oracle("pair_strategy_counts", f"""WITH {MINED}
SELECT strategy, count(*) AS n_pairs, count(DISTINCT (lang, source)) AS n_groups FROM mined GROUP BY strategy""")


# ---------------------------------------------------------------- phase 2: text

FIRST_FENCE_RE = "(?s)```(?:[\\p{L}\\p{N}_+\\-]+)?" + WS + "*(.*?)```"
JAVA_FENCE_RE = "(?si)```(?:java)?" + WS + "*(.*?)" + WS + "*```"
DIRECTION_RE = "from" + WS + "+(.*?)" + WS + "+to" + WS + "+(.*?)(?:" + WS + "|\\z|\\.)"


def lst(options) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for o in options) + "]"


def pick(options, idx: str) -> str:
    return f"{lst(options)}[(({idx}) % {len(options)}) + 1]"


def nl(s: str) -> str:
    """SQL string literal with real newlines."""
    return "'" + s.replace("'", "''") + "'"


def first_fence(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN '' WHEN regexp_matches({x}, '{FIRST_FENCE_RE}') "
            f"THEN {strip(f'regexp_extract({x}, {nl(FIRST_FENCE_RE)}, 1)')} ELSE {strip(x)} END")


def strip_fences(x: str) -> str:
    return strip(f"replace(regexp_replace({x}, '```[a-zA-Z]*', '', 'g'), '```', '')")


def strip_tokens(x: str) -> str:
    return f"replace(replace({x}, '<|im_end|>', ''), '<|endoftext|>', '')"


def after_marker(x: str) -> str:
    return (f"CASE WHEN contains({x}, '<|im_start|>assistant') THEN string_split({x}, '<|im_start|>assistant')[-1] "
            f"WHEN contains({x}, '@@ Response') THEN split_part({x}, '@@ Response', 2) "
            f"WHEN contains({x}, '### Response:') THEN split_part({x}, '### Response:', 2) ELSE {x} END")


def strip_comments(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '//.*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g')"


def one_line(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def alias_sql(x: str) -> str:
    return (f"CASE {x} WHEN 'c++' THEN 'cpp' WHEN 'cpp' THEN 'cpp' WHEN 'python' THEN 'python' "
            f"WHEN 'java' THEN 'java' WHEN 'c#' THEN 'c_sharp' WHEN 'csharp' THEN 'c_sharp' "
            f"WHEN 'go' THEN 'go' WHEN 'php' THEN 'php' WHEN 'javascript' THEN 'javascript' ELSE {x} END")


FENCE_TAGS = ["python", "c++", "java", "c#", "cpp", ""]
LANG_SPELLINGS = ["C++", "cpp", "Python", "Java", "C#", "csharp", "Go", "PHP", "JavaScript"]
ENDINGS = [".", " ", "\n", ". "]
GT_TAGS = ["cpp", "c++", "python", "java", "javascript"]

INSTRUCTION = (f"CASE WHEN doc_id % 4 = 3 THEN text ELSE 'Translate the program from ' || {pick(LANG_SPELLINGS, 'doc_id')} "
               f"|| ' to ' || {pick(LANG_SPELLINGS, 'doc_id * 7 + 3')} || {pick(ENDINGS, 'doc_id')} || text END")

MARKED = ("CASE doc_id % 4 "
          f"WHEN 0 THEN {nl('<|im_start|>system' + chr(10) + 'Be brief.<|im_end|>' + chr(10) + '<|im_start|>user' + chr(10) + 'Port it.<|im_end|>' + chr(10) + '<|im_start|>assistant' + chr(10) + '```python' + chr(10))} || text || {nl(chr(10) + '```<|im_end|>')} "
          f"WHEN 1 THEN {nl('@@ Instruction' + chr(10) + 'Port it.' + chr(10) + '@@ Response' + chr(10))} || text || {nl('<|endoftext|>' + chr(10) + '@@ Response' + chr(10) + 'tail')} "
          f"WHEN 2 THEN {nl('### Instruction:' + chr(10) + 'Port it.' + chr(10) + '### Response:' + chr(10) + '```java' + chr(10))} || text || {nl(chr(10) + '```')} "
          "ELSE text END")

oracle("fence_extract", f"""WITH w AS (
  SELECT doc_id, CASE doc_id % 3
    WHEN 0 THEN {nl('Sure, here it is:' + chr(10) + '```')} || {pick(FENCE_TAGS, 'doc_id')} || chr(10) || text || {nl(chr(10) + '```' + chr(10) + 'Done.')}
    WHEN 1 THEN '```' || text || '```'
    ELSE text END AS w FROM documents)
SELECT doc_id, {first_fence('w')} AS code FROM w""")

oracle("fence_strip", f"""SELECT doc_id, {strip_fences("'```' || " + pick(FENCE_TAGS, 'doc_id') + " || chr(10) || text || chr(10) || '```'")} AS code FROM documents""")

oracle("answer_after_marker", f"""WITH w AS (SELECT doc_id, {MARKED} AS w FROM documents)
SELECT doc_id, {strip_fences(strip_tokens(after_marker('w')))} AS code FROM w""")

oracle("strip_end_tokens", f"""WITH w AS (SELECT doc_id, {MARKED} AS w FROM documents)
SELECT doc_id, {strip_tokens('w')} AS code FROM w""")

oracle("comment_strip", f"""SELECT page_id, {strip_comments("url || chr(10) || html || " + nl(chr(10) + '/* generated' + chr(10) + ' at build */ x = 1; // end'))} AS text FROM pages""")

oracle("one_line", f"""SELECT page_id, {one_line('html')} AS text FROM pages""")

oracle("line_format", f"""WITH w AS (
  SELECT doc_id, {nl('Here you go:' + chr(10) + '```Java' + chr(10))} || text || {nl(' // note' + chr(10) + '/* block' + chr(10) + ' */' + chr(10) + '```' + chr(10) + 'Bye')} AS w FROM documents),
f AS (SELECT doc_id, CASE WHEN contains(w, '```') AND regexp_matches(w, '{JAVA_FENCE_RE}') THEN regexp_extract(w, '{JAVA_FENCE_RE}', 1) ELSE w END AS f FROM w)
SELECT doc_id, {one_line(strip_comments('f'))} AS code FROM f""")

oracle("class_name", """WITH w AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'public class ' || source || ' {' || chr(10) || text || chr(10) || '}' ELSE text END AS w FROM documents)
SELECT doc_id, coalesce(nullif(regexp_extract(w, 'class""" + WS + """+([\\p{L}\\p{N}_]+)', 1), ''), 'Main') AS class_name FROM w""")

oracle("direction_parse", f"""WITH w AS (SELECT doc_id, lower({INSTRUCTION}) AS low FROM documents),
m AS (SELECT doc_id, regexp_matches(low, '{DIRECTION_RE}') AS hit,
             {alias_sql(strip(f"regexp_extract(low, {nl(DIRECTION_RE)}, 1)"))} AS src,
             {alias_sql("regexp_replace(" + strip(f"regexp_extract(low, {nl(DIRECTION_RE)}, 2)") + ", '\\.+\\z', '')")} AS tgt
      FROM w)
SELECT doc_id, CASE WHEN hit THEN src || '2' || tgt ELSE 'unknown' END AS category,
       CASE WHEN hit THEN tgt ELSE 'python' END AS target_lang FROM m""")

oracle("detect_language", f"""WITH w AS (
  SELECT doc_id, lower({INSTRUCTION}) AS low,
         CASE WHEN doc_id % 5 < 3 THEN '```' || {pick(GT_TAGS, 'doc_id')} || chr(10) || text || chr(10) || '```' ELSE text END AS gt
  FROM documents)
SELECT doc_id, CASE
  WHEN contains(gt, '```cpp') OR contains(gt, '```c++') THEN 'cpp'
  WHEN contains(gt, '```python') THEN 'python'
  WHEN contains(gt, '```java') THEN 'java'
  WHEN contains(low, ' to cpp') OR contains(low, ' to c++') THEN 'cpp'
  WHEN contains(low, ' to java') THEN 'java'
  WHEN contains(low, ' to python') THEN 'python'
  ELSE 'cpp' END AS lang FROM w""")

oracle("pair_target", f"""SELECT doc_id, nullif(split_part(CASE WHEN doc_id % 3 = 0 THEN lang ELSE lang || '-' || {pick(LANG_SPELLINGS, 'doc_id')} END, '-', 2), '') AS target FROM documents""")

# ---------------------------------------------------------------- phase 2: prompts

TARGET_KEYS = ["cpp", "C++", "java", "Python", "go", "rust", "JavaScript"]
CHAT_SYSTEM = "Task 7: summarise the tagged part."

CONV_SAMPLES = """samples AS (
  SELECT u.conv_id, u.turn, u.text AS instruction,
         CASE WHEN p.role = 'system' THEN ' ' ELSE p.text END AS input
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations p ON p.conv_id = u.conv_id AND p.turn = u.turn - 1
  WHERE u.role = 'user')"""


def prompt_sql(has: str) -> str:
    return (f"CASE WHEN {has} THEN '### Task' || chr(10) || instruction || chr(10) || '### Context' || chr(10) || input || chr(10) || '### Answer' || chr(10) "
            f"ELSE '### Task' || chr(10) || instruction || chr(10) || '### Answer' || chr(10) END")


oracle("prompt_build", f"""WITH {CONV_SAMPLES}
SELECT conv_id, turn,
       {prompt_sql(f"input IS NOT NULL AND NOT regexp_matches(input, '^{WS}*\\z')")} AS prompt_strip,
       {prompt_sql("input IS NOT NULL AND input <> ''")} AS prompt_empty
FROM samples""")

oracle("prompt_wrap_idempotent", """WITH p AS (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || chr(10) || '### Response:' || chr(10) ELSE text END AS p FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(p, '### Response:') THEN p
       ELSE 'You help with code.' || chr(10) || '### Instruction:' || chr(10) || p || chr(10) || chr(10) || '### Response:' || chr(10) END AS prompt
FROM p""")

oracle("system_prompt_by_lang", f"""WITH k AS (SELECT doc_id, {pick(TARGET_KEYS, 'doc_id')} AS k FROM documents),
n AS (SELECT doc_id, k, CASE lower(k) WHEN 'cpp' THEN 'C++' WHEN 'c++' THEN 'C++' WHEN 'java' THEN 'Java'
                       WHEN 'python' THEN 'Python' WHEN 'go' THEN 'Go' ELSE k END AS name FROM k)
SELECT doc_id, 'Target: ' || name || '.' || CASE WHEN lower(k) = 'python' THEN ' Indent: 4.' ELSE '' END
       || ' Fence: ```' || lower(name) || '.' AS system_prompt
FROM n""")

oracle("chat_render", f"""WITH u AS (
  SELECT conv_id, turn, '<Code>' || chr(10) || text || chr(10) || '</Code>' AS u FROM conversations WHERE role = 'user')
SELECT conv_id, turn,
  '<|system|>' || chr(10) || {nl(CHAT_SYSTEM)} || chr(10) || '<|user|>' || chr(10) || u || chr(10) || '<|assistant|>' || chr(10) AS chat,
  '[INST] <<SYS>>' || chr(10) || {nl(CHAT_SYSTEM)} || chr(10) || '<</SYS>>' || chr(10) || chr(10) || u || ' [/INST]' AS inst
FROM u""")

oracle("format_reward", """SELECT conv_id, turn,
  CASE WHEN contains(CASE WHEN (conv_id + turn) % 3 = 0 THEN '```python' || chr(10) || text || chr(10) || '```' ELSE text END, '```')
       THEN 0.1 ELSE 0.0 END::DOUBLE AS format_reward
FROM conversations WHERE role = 'assistant'""")

oracle("reward_total", f"""WITH {RUNS}, {GT}, {CANDS}, {TIER_REWARD},
f AS (SELECT *, CASE WHEN contains(CASE WHEN value > 50 THEN '```' || chr(10) || stdout || chr(10) || '```' ELSE stdout END, '```')
                     THEN 0.1 ELSE 0.0 END::DOUBLE AS fmt FROM rewarded)
SELECT user_id, day, cand_idx, round(reward::DOUBLE, 6) AS correctness, round(fmt, 6) AS format,
       round(reward::DOUBLE + fmt, 6) AS total_reward FROM f""")


# ---------------------------------------------------------------- phase 3: scores


def grams_sql(src: str, col: str) -> str:
    return (f"SELECT doc_id, n, array_to_string({col}[i:i + n - 1], ' ') AS g FROM ("
            f"SELECT doc_id, {col}, n, unnest(generate_series(1, len({col}) - n + 1)) AS i "
            f"FROM {src}, (SELECT unnest([1, 2, 3, 4]) AS n) ns WHERE len({col}) >= n)")


DOC_STATS = f"""d AS (SELECT doc_id, lang, source, text, {toks('text')} AS r FROM documents),
h AS (SELECT doc_id, lang, source, text, r, list_filter(r, lambda x, i: i % 7 <> 0) AS h FROM d),
hc AS (SELECT doc_id, n, g, count(*) AS ch FROM ({grams_sql('h', 'h')}) GROUP BY doc_id, n, g),
rc AS (SELECT doc_id, n, g, count(*) AS cr FROM ({grams_sql('h', 'r')}) GROUP BY doc_id, n, g),
kw AS (SELECT lang, token FROM (
         SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, token) AS rk
         FROM (SELECT lang, unnest(r) AS token FROM d) GROUP BY lang, token) WHERE rk <= 50),
j AS (SELECT doc_id, n, g, coalesce(ch, 0) AS ch, coalesce(cr, 0) AS cr FROM hc FULL JOIN rc USING (doc_id, n, g)),
jw AS (SELECT j.*, CASE WHEN j.n = 1 THEN CASE WHEN kw.token IS NOT NULL THEN 1.0 ELSE 0.2 END ELSE 1.0 END::DOUBLE AS w
       FROM j JOIN d USING (doc_id) LEFT JOIN kw ON kw.lang = d.lang AND kw.token = j.g AND j.n = 1),
per AS (SELECT doc_id, n, sum(least(ch, cr)) AS m, sum(ch) AS t, sum(least(cr, ch) * w) AS wn, sum(cr * w) AS wd
        FROM jw GROUP BY doc_id, n),
stats AS (
  SELECT h.doc_id, h.lang, h.source, h.text, len(h.h) AS hl, len(h.r) AS rl,
         {", ".join(f"coalesce(max(m) FILTER (WHERE n = {k}), 0)::BIGINT AS m{k}" for k in range(1, 5))},
         {", ".join(f"greatest(1, coalesce(max(t) FILTER (WHERE n = {k}), 0))::BIGINT AS d{k}" for k in range(1, 5))},
         {", ".join(f"coalesce(max(wn) FILTER (WHERE n = {k}), 0.0)::DOUBLE AS wn{k}" for k in range(1, 5))},
         {", ".join(f"greatest(1.0, coalesce(max(wd) FILTER (WHERE n = {k}), 0.0))::DOUBLE AS wd{k}" for k in range(1, 5))}
  FROM h LEFT JOIN per USING (doc_id)
  GROUP BY h.doc_id, h.lang, h.source, h.text, hl, rl)"""


def score_sql(num: str, den: str) -> str:
    logs = " + ".join(f"ln(CASE WHEN {num}{k} > 0 THEN {num}{k} / {den}{k} ELSE 0.1 / {den}{k} END)" for k in range(1, 5))
    return (f"CASE WHEN {num}1 = 0 THEN 0.0 ELSE "
            f"(CASE WHEN hl > rl THEN 1.0 WHEN hl = 0 THEN 0.0 ELSE exp(1.0 - rl::DOUBLE / hl) END) * exp(({logs}) / 4.0) END")


DOC_EDGES = """re AS (SELECT doc_id, r[i] AS src, r[i + 1] AS dst FROM (
        SELECT doc_id, r, unnest(generate_series(1, len(r) - 1)) AS i FROM h WHERE len(r) >= 2)),
ce AS (SELECT DISTINCT doc_id, h[i] AS src, h[i + 1] AS dst FROM (
        SELECT doc_id, h, unnest(generate_series(1, len(h) - 1)) AS i FROM h WHERE len(h) >= 2)),
edges AS (SELECT re.doc_id, count(ce.doc_id) AS matched, count(*) AS total, count(ce.doc_id) / count(*) AS ratio
          FROM re LEFT JOIN ce USING (doc_id, src, dst) GROUP BY re.doc_id)"""

DOC_SCORES = f"""{DOC_STATS}, {DOC_EDGES},
sc AS (
  SELECT s.doc_id, s.lang, s.source, len(h.h) = 0 AS hyp_blank, regexp_matches(s.text, '^{WS}*\\z') AS ref_blank,
         {score_sql('m', 'd')} AS ngram, {score_sql('wn', 'wd')} AS weighted, e.ratio AS dataflow
  FROM stats s JOIN h USING (doc_id) LEFT JOIN edges e USING (doc_id)),
scored AS (
  SELECT doc_id, lang, source,
         CASE WHEN hyp_blank OR ref_blank THEN 0.0
              ELSE coalesce((0.25 * ngram + 0.25 * weighted + coalesce(0.25 * dataflow, 0.0))
                            / (0.5 + CASE WHEN dataflow IS NULL THEN 0.0 ELSE 0.25 END), 0.0) END AS codebleu
  FROM sc),
scored2 AS (SELECT *, 1.0 - codebleu + 0.001 AS p_score FROM scored)"""

oracle("keywords_top", f"""WITH {DOC_STATS} SELECT lang, token FROM kw""")

oracle("ngram_counts", f"""WITH {DOC_STATS}
SELECT doc_id, hl::BIGINT AS hl, rl::BIGINT AS rl, m1, m2, m3, m4, d1, d2, d3, d4 FROM stats""")

oracle("bleu_sample", f"""WITH {DOC_STATS} SELECT doc_id, round({score_sql('m', 'd')}, 6) AS bleu FROM stats""")

oracle("weighted_ngram", f"""WITH {DOC_STATS} SELECT doc_id, round({score_sql('wn', 'wd')}, 6) AS weighted FROM stats""")

oracle("bleu_corpus", f"""WITH {DOC_STATS},
c AS (SELECT lang, sum(hl) AS hl, sum(rl) AS rl,
             {", ".join(f"sum(m{k}) AS m{k}, sum(d{k}) AS d{k}, sum(wn{k}) AS wn{k}, sum(wd{k}) AS wd{k}" for k in range(1, 5))}
      FROM stats GROUP BY lang)
SELECT lang, round({score_sql('m', 'd')}, 6) AS bleu, round({score_sql('wn', 'wd')}, 6) AS weighted FROM c""")

oracle("edge_match", f"""WITH {DOC_STATS}, {DOC_EDGES}
SELECT doc_id, matched, total, round(ratio, 6) AS ratio FROM edges""")

TAG_RE = "<(/?(?:ul|li|a|nav|div|article|footer|title|head|style|script|h1))[\\s>]"

SHAPES = f"""p AS (SELECT page_id, regexp_extract_all(html, '{TAG_RE}', 1) AS m FROM pages),
s AS (SELECT page_id, m, array_to_string(m, ' ') AS s FROM p),
ex AS (SELECT page_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS mk FROM p),
dd AS (SELECT *, sum(CASE WHEN mk NOT LIKE '/%' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY pos) AS depth,
              sum(length(mk) + 1) OVER (PARTITION BY page_id ORDER BY pos) - length(mk) - 1 AS off FROM ex),
lv AS (SELECT *, CASE WHEN mk NOT LIKE '/%' THEN depth ELSE depth + 1 END AS level FROM dd),
el AS (SELECT *, lead(pos) OVER (PARTITION BY page_id, level ORDER BY pos) AS close_pos,
              lead(off + length(mk)) OVER (PARTITION BY page_id, level ORDER BY pos) AS close_end FROM lv),
shapes AS (
  SELECT el.page_id, el.pos::BIGINT AS pos, (el.level + 1)::BIGINT AS depth, (el.close_pos - el.pos + 1)::BIGINT AS size,
         substring(s.s, (el.off + 1)::BIGINT, (el.close_end - el.off)::BIGINT) AS shape
  FROM el JOIN s USING (page_id) WHERE el.mk NOT LIKE '/%' AND el.close_pos > el.pos + 1
  UNION ALL
  SELECT page_id, -1, 1, len(m), s FROM s WHERE len(m) > 0)"""

oracle("tree_shapes", f"""WITH {SHAPES} SELECT page_id, pos, depth, size, md5(shape) AS shape_md5 FROM shapes""")

oracle("tree_match", f"""WITH {SHAPES},
pl AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages),
pairs AS (SELECT page_id AS ref_id, lead(page_id) OVER (PARTITION BY lang ORDER BY page_id) AS cand_id FROM pl),
rs AS (SELECT p.ref_id, p.cand_id, md5(sh.shape) AS h FROM pairs p JOIN shapes sh ON sh.page_id = p.ref_id WHERE p.cand_id IS NOT NULL),
cs AS (SELECT DISTINCT p.ref_id, md5(sh.shape) AS h FROM pairs p JOIN shapes sh ON sh.page_id = p.cand_id)
SELECT rs.ref_id AS page_id, rs.cand_id AS cand_page_id, count(cs.h) AS matched, count(*) AS total,
       round(count(cs.h) / count(*), 6) AS ratio
FROM rs LEFT JOIN cs ON cs.ref_id = rs.ref_id AND cs.h = rs.h GROUP BY rs.ref_id, rs.cand_id""")

# every tag kind, an open and a close matched by the depth of their own kind
SHAPES_ALL = """p AS (SELECT page_id, regexp_extract_all(lower(html), '<(/?[a-z][a-z0-9:-]*)[\\s/>]', 1) AS m FROM pages),
ex AS (SELECT page_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS mk FROM p),
kd AS (SELECT *, ltrim(mk, '/') AS kind, CASE WHEN mk LIKE '/%' THEN -1 ELSE 1 END AS up FROM ex),
lv AS (SELECT *, sum(up) OVER (PARTITION BY page_id, kind ORDER BY pos) + CASE WHEN up < 0 THEN 1 ELSE 0 END AS level FROM kd),
ld AS (SELECT *, lead(pos) OVER (PARTITION BY page_id, kind, level ORDER BY pos) AS close_pos FROM lv),
el AS (SELECT page_id, pos, close_pos FROM ld WHERE up = 1 AND close_pos > pos + 1),
shapes AS (
  SELECT e.page_id, e.pos::BIGINT AS pos,
         (2 + (SELECT count(*) FROM el o WHERE o.page_id = e.page_id AND o.pos < e.pos AND o.close_pos > e.close_pos))::BIGINT AS depth,
         (e.close_pos - e.pos + 1)::BIGINT AS size, array_to_string(p.m[e.pos + 1 : e.close_pos + 1], ' ') AS shape
  FROM el e JOIN p USING (page_id)
  UNION ALL
  SELECT page_id, -1, 1, len(m), array_to_string(m, ' ') FROM p WHERE len(m) > 0)"""

PAGE_PAIRS = """pl AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages),
pairs AS (SELECT page_id AS ref_id, lang, lead(page_id) OVER (PARTITION BY lang ORDER BY page_id) AS cand_id FROM pl),
rs AS (SELECT p.ref_id, p.cand_id, p.lang, md5(sh.shape) AS h FROM pairs p JOIN shapes sh ON sh.page_id = p.ref_id WHERE p.cand_id IS NOT NULL),
cs AS (SELECT DISTINCT p.ref_id, md5(sh.shape) AS h FROM pairs p JOIN shapes sh ON sh.page_id = p.cand_id)"""

oracle("tree_shapes_all", f"""WITH {SHAPES_ALL} SELECT page_id, pos, depth, size, md5(shape) AS shape_md5 FROM shapes""")

oracle("tree_match_all", f"""WITH {SHAPES_ALL}, {PAGE_PAIRS}
SELECT rs.ref_id AS page_id, rs.cand_id AS cand_page_id, count(cs.h) AS matched, count(*) AS total,
       round(count(cs.h) / count(*), 6) AS ratio
FROM rs LEFT JOIN cs ON cs.ref_id = rs.ref_id AND cs.h = rs.h GROUP BY rs.ref_id, rs.cand_id""")

oracle("tree_match_corpus", f"""WITH {SHAPES_ALL}, {PAGE_PAIRS}
SELECT rs.lang, CAST(grouping(rs.lang) AS BIGINT) AS level, count(DISTINCT rs.ref_id) AS n_pairs, count(cs.h) AS matched, count(*) AS total,
       round(count(cs.h) / count(*), 6) AS ratio
FROM rs LEFT JOIN cs ON cs.ref_id = rs.ref_id AND cs.h = rs.h GROUP BY ROLLUP (rs.lang)""")

oracle("composite_score", f"""WITH {DOC_SCORES} SELECT doc_id, round(codebleu, 6) AS codebleu FROM scored2""")

oracle("hardness", f"""WITH {DOC_SCORES} SELECT doc_id, round(p_score, 6) AS p_score FROM scored2""")

oracle("category_report", f"""WITH {DOC_SCORES}
SELECT lang AS category, count(*) AS n_samples, round(avg(codebleu), 6) AS avg_codebleu, round(avg(p_score), 6) AS avg_p_score
FROM scored2 GROUP BY lang""")

oracle("category_rollup", f"""WITH {DOC_SCORES}
SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS level, count(*) AS n_samples, round(avg(codebleu), 6) AS avg_codebleu,
       round(avg(p_score), 6) AS avg_p_score
FROM scored2 GROUP BY ROLLUP (lang, source)""")


# pairs of fenced pages: first fence of either side, four parts; doc_id stands for page_id
FENCED_SCORES = f"""fp AS (
  SELECT page_id, html, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages),
fq AS (SELECT *, lead(page_id) OVER w AS cand_id, lead(html) OVER w AS cand FROM fp WINDOW w AS (PARTITION BY lang ORDER BY page_id)),
ft AS (
  SELECT page_id AS doc_id, lang, cand_id, 'The page:' || chr(10) || '```html' || chr(10) || html || chr(10) || '```' || chr(10) || 'Done.' AS ref,
         CASE WHEN page_id % 3 = 0 THEN cand ELSE 'Here it is:' || chr(10) || '```html' || chr(10) || cand || chr(10) || '```' || chr(10)
              || 'Or this:' || chr(10) || '```' || chr(10) || '<p>none</p>' || chr(10) || '```' || chr(10) END AS hyp
  FROM fq WHERE cand_id IS NOT NULL),
fc AS (SELECT doc_id, lang, cand_id, {first_fence('ref')} AS ref, {first_fence('hyp')} AS hyp FROM ft),
d AS (SELECT doc_id, lang, '' AS source, ref AS text, {toks('ref')} AS r FROM fc),
h AS (SELECT doc_id, lang, '' AS source, ref AS text, {toks('ref')} AS r, {toks('hyp')} AS h FROM fc),
{DOC_STATS[DOC_STATS.index('hc AS'):]}, {DOC_EDGES}, {SHAPES_ALL},
tr AS (
  SELECT fc.doc_id, count(c.shape) / count(*) AS syntax
  FROM fc JOIN shapes s ON s.page_id = fc.doc_id
  LEFT JOIN (SELECT DISTINCT page_id, shape FROM shapes) c ON c.page_id = fc.cand_id AND c.shape = s.shape GROUP BY fc.doc_id),
sc AS (
  SELECT s.doc_id, s.lang, s.hl = 0 OR s.rl = 0 AS blank, {score_sql('m', 'd')} AS ngram, {score_sql('wn', 'wd')} AS weighted,
         tr.syntax, e.ratio AS dataflow
  FROM stats s LEFT JOIN edges e USING (doc_id) LEFT JOIN tr USING (doc_id)),
scored AS (
  SELECT *, CASE WHEN blank THEN 0.0 ELSE (ngram + weighted + coalesce(syntax, 0.0) + coalesce(dataflow, 0.0))
              / (2 + CASE WHEN syntax IS NULL THEN 0 ELSE 1 END + CASE WHEN dataflow IS NULL THEN 0 ELSE 1 END) END AS codebleu
  FROM sc),
scored2 AS (SELECT *, 1.0 - codebleu + 0.001 AS p_score FROM scored)"""

oracle("composite_fenced", f"""WITH {FENCED_SCORES}
SELECT doc_id AS page_id, {", ".join(f"round({c}, 6) AS {c}" for c in ("ngram", "weighted", "syntax", "dataflow", "codebleu", "p_score"))}
FROM scored2""")

oracle("category_fenced", f"""WITH {FENCED_SCORES}
SELECT lang AS category, count(*) AS n_samples, round(avg(codebleu), 6) AS avg_codebleu, round(avg(p_score), 6) AS avg_p_score
FROM scored2 GROUP BY lang""")


# ---------------------------------------------------------------- phase 4: arrays

EMB = """emb AS (
  SELECT vec_id, label,
         list_transform(embedding, lambda x: CASE WHEN x::DOUBLE < -0.4 THEN -1e5 ELSE -abs(x::DOUBLE) * 8 END) AS logps,
         list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i - 1 ELSE -100 END) AS labels,
         list_transform(list_filter(embedding, lambda x: x > 0), lambda x: floor(x::DOUBLE * 1000)::INTEGER) AS ids
  FROM embeddings)"""


def lsum(x: str) -> str:
    return f"coalesce(list_sum({x}), 0.0)"


oracle("masked_mean", f"""WITH {EMB}
SELECT vec_id, round(CASE WHEN len(list_filter(logps, lambda x: x > -65500.0)) > 0
  THEN {lsum('list_filter(logps, lambda x: x > -65500.0)')} / len(list_filter(logps, lambda x: x > -65500.0)) ELSE -999.0 END, 6) AS mean_logp
FROM emb""")

oracle("tail_nll", f"""WITH {EMB},
t AS (SELECT vec_id, logps, label * 7 AS p, len(logps) + 1 AS n FROM emb),
u AS (SELECT vec_id, logps[greatest(1, p):] AS tail1,
             logps[greatest(0, CASE WHEN p >= n THEN n // 2 ELSE p END - 1) + 1:] AS tail2 FROM t)
SELECT vec_id,
  round(CASE WHEN len(tail1) > 0 THEN -({lsum('tail1')} / len(tail1)) ELSE 999.0 END, 6) AS nll,
  round(CASE WHEN len(tail2) > 0 THEN {lsum('tail2')} / len(tail2) ELSE -'inf'::DOUBLE END, 6) AS confidence
FROM u""")

oracle("pref_metrics", f"""WITH {EMB},
r AS (SELECT vec_id // 2 AS pair_id, CASE WHEN vec_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS role,
             (SELECT coalesce(sum(CASE WHEN labels[i + 1] <> -100 THEN logps[i] ELSE 0.0 END), 0.0) FROM range(1, 32) t(i)) AS policy_logp,
             (SELECT coalesce(sum(CASE WHEN labels[32 + i + 1] <> -100 THEN logps[32 + i] ELSE 0.0 END), 0.0) FROM range(1, 32) t(i)) AS ref_logp
      FROM emb),
pp AS (SELECT pair_id, pair_id // 8 AS batch,
              max(policy_logp) FILTER (WHERE role = 'chosen') AS pc, max(ref_logp) FILTER (WHERE role = 'chosen') AS rc,
              max(policy_logp) FILTER (WHERE role = 'rejected') AS pr, max(ref_logp) FILTER (WHERE role = 'rejected') AS rr,
              count(*) FILTER (WHERE role = 'chosen') = 1 AND count(*) FILTER (WHERE role = 'rejected') = 1 AS ok
       FROM r GROUP BY pair_id),
x AS (SELECT *, 0.1 * (pc - rc) AS cr, 0.1 * (pr - rr) AS rj FROM pp)
SELECT batch, count(*) FILTER (WHERE ok) AS n_pairs, count(*) FILTER (WHERE NOT ok) AS n_incomplete, round(avg(cr) FILTER (WHERE ok), 6) AS rewards_chosen, round(avg(rj) FILTER (WHERE ok), 6) AS rewards_rejected,
       round(avg(CASE WHEN cr > rj THEN 1.0 ELSE 0.0 END) FILTER (WHERE ok), 6) AS accuracy, round(avg(cr - rj) FILTER (WHERE ok), 6) AS margin,
       round(avg(pc) FILTER (WHERE ok), 6) AS logps_chosen, round(avg(pr) FILTER (WHERE ok), 6) AS logps_rejected,
       round(avg(ln(1 + exp(-abs(cr - rj))) + greatest(-(cr - rj), 0.0)) FILTER (WHERE ok), 6) AS loss
FROM x GROUP BY batch""")

oracle("pad_batch", f"""WITH {EMB},
m AS (SELECT vec_id, vec_id // 8 AS batch, ids,
             list_transform(ids, lambda x, i: CASE WHEN i - 1 < label THEN -100 ELSE x END) AS labels FROM emb),
w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS ml FROM m)
SELECT vec_id, batch,
  array_to_string(list_concat(ids, list_transform(range(ml - len(ids)), lambda x: 0)), ',') AS ids,
  array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(ml - len(ids)), lambda x: 0)), ',') AS mask,
  array_to_string(list_concat(labels, list_transform(range(ml - len(ids)), lambda x: -100)), ',') AS labels,
  ml::BIGINT AS n
FROM w""")

oracle("prompt_mask", f"""WITH {EMB}
SELECT vec_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i - 1 < label THEN -100 ELSE x END), ',') AS labels FROM emb""")

# ---------------------------------------------------------------- phase 4: diffs

LINES = """pairs AS (
  SELECT doc_id, lang, text AS chosen,
         array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
             CASE WHEN (i - 1) % 6 = 5 THEN NULL WHEN (i - 1) % 4 = 1 THEN l || ' !' ELSE l END), chr(10)) AS rejected
  FROM documents),
sides AS (SELECT doc_id, 'chosen' AS side, chosen AS t FROM pairs UNION ALL SELECT doc_id, 'rejected', rejected FROM pairs),
pieces AS (SELECT doc_id, side, string_split(t, chr(10)) AS p FROM sides),
ex AS (SELECT doc_id, side, len(p) AS np, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS line FROM pieces),
lines AS (
  SELECT doc_id, side, line_no::BIGINT AS line_no, line,
         (coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, side ORDER BY line_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
         CASE WHEN line_no = np - 1 THEN 0 ELSE 1 END AS nl
  FROM ex WHERE NOT (line_no = np - 1 AND line = '')),
lines2 AS (SELECT *, (start + length(line) + nl)::BIGINT AS "end",
                  row_number() OVER (PARTITION BY doc_id, side, line ORDER BY line_no) AS occ FROM lines),
ldiff AS (
  SELECT a.doc_id, a.side, a.line_no, a.start, a."end" FROM lines2 a
  WHERE NOT EXISTS (SELECT 1 FROM lines2 b WHERE b.doc_id = a.doc_id AND b.side <> a.side AND b.line = a.line AND b.occ = a.occ))"""

oracle("line_offsets", f"""WITH {LINES} SELECT doc_id, line_no, start, "end" FROM lines2 WHERE side = 'chosen'""")

oracle("line_multiset_diff", f"""WITH {LINES} SELECT doc_id, side, line_no, start, "end" FROM ldiff""")

TOKEN_PAT = f"[^{WS[1:-1]}]+|{WS}+"

oracle("focus_tokens", f"""WITH {LINES},
f AS (SELECT doc_id, 'Fix the text for ' || lang || ':' || chr(10) AS prompt, chosen FROM pairs),
f2 AS (SELECT doc_id, length(prompt) AS plen, regexp_extract_all(prompt || chosen, '{TOKEN_PAT}') AS pcs FROM f),
tex AS (SELECT doc_id, plen, generate_subscripts(pcs, 1) AS pi, unnest(pcs) AS piece FROM f2),
sp AS (SELECT doc_id, plen, pi, piece,
              coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
       FROM tex),
tk AS (SELECT doc_id, plen, piece, s, s + length(piece) AS e,
              row_number() OVER (PARTITION BY doc_id ORDER BY pi) - 1 AS tok_idx
       FROM sp WHERE NOT regexp_matches(piece, '^{WS}')),
rg AS (SELECT doc_id, start AS fs, "end" AS fe FROM ldiff WHERE side = 'chosen')
SELECT tk.doc_id, tk.tok_idx::BIGINT AS tok_idx,
       CASE WHEN tk.s >= tk.plen AND EXISTS (SELECT 1 FROM rg WHERE rg.doc_id = tk.doc_id AND rg.fe > rg.fs
                 AND greatest(tk.s - tk.plen, rg.fs) < least(tk.e - tk.plen, rg.fe))
            THEN tk.tok_idx * 7 + length(tk.piece) ELSE -100 END::BIGINT AS label
FROM tk""")


# ---------------------------------------------------------------- phase 5: layout

MARKER_AFTER = {0: " NEW_LINE", 3: " NEW_LINE INDENT", 5: " NEW_LINE DEDENT", 8: " DEDENT", 9: " INDENT",
                10: " NEW_LINE NEW_LINE"}
_MARK = "CASE ((i - 1) * 7 + doc_id) % 11 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in MARKER_AFTER.items()) + " ELSE '' END"

oracle("layout_lines", f"""WITH src AS (
  SELECT doc_id,
         CASE doc_id % 5 WHEN 0 THEN 'INDENT ' WHEN 1 THEN 'NEW_LINE ' ELSE '' END
         || array_to_string(list_transform({toks('text')}, lambda t, i: t || {_MARK}), ' ') AS line
  FROM documents),
tt AS (SELECT doc_id, {toks(strip("replace(line, '''', '')"))} AS t FROM src),
ex AS (SELECT doc_id, generate_subscripts(t, 1) AS k, unnest(t) AS tok FROM tt),
e1 AS (SELECT *, CASE tok WHEN 'INDENT' THEN 1 WHEN 'DEDENT' THEN -1 ELSE 0 END AS d,
              CASE WHEN tok IN ('NEW_LINE', 'INDENT', 'DEDENT') THEN 0 ELSE 1 END AS w,
              CASE WHEN tok = 'NEW_LINE' THEN 1 ELSE 0 END AS nl FROM ex),
e2 AS (SELECT *, sum(d) OVER win AS S, sum(w) OVER win - w AS run, sum(nl) OVER win AS N
       FROM e1 WINDOW win AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e3 AS (SELECT *, S - least(0, min(S) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS L FROM e2),
grp AS (SELECT doc_id, run, N, arg_min(nl, k) AS fnl, arg_min(S - d, k) AS sb, arg_min(L, k) AS fL,
               arg_max(S, k) AS sl, arg_max(L, k) AS lL, min(S) AS minS
        FROM e3 WHERE w = 0 GROUP BY doc_id, run, N),
runs AS (SELECT doc_id, run,
                max(CASE WHEN fnl = 0 THEN (sl - sb) - least(0, minS - sb) END) AS e0,
                string_agg(CASE WHEN fnl = 1 THEN chr(10) || repeat('    ', lL::BIGINT) END, '' ORDER BY N) AS nls,
                arg_max(fL, N) FILTER (WHERE fnl = 1) AS lnl,
                count(*) FILTER (WHERE fnl = 1) AS n_nl
         FROM grp GROUP BY doc_id, run),
words AS (SELECT doc_id, run, tok, L AS Lw FROM e3 WHERE w = 1),
j AS (SELECT coalesce(w.doc_id, r.doc_id) AS doc_id, coalesce(w.run, r.run) AS run, w.tok, w.Lw,
             coalesce(r.e0, 0)::BIGINT AS e0, coalesce(r.nls, '') AS nls, coalesce(r.n_nl, 0) AS n_nl, r.lnl
      FROM words w FULL JOIN runs r ON w.doc_id = r.doc_id AND w.run = r.run),
pc AS (SELECT doc_id, run, repeat('    ', e0) || nls ||
              CASE WHEN tok IS NULL THEN '' WHEN n_nl > 0 THEN CASE WHEN Lw = 0 AND lnl = 0 THEN ' ' ELSE '' END
                   WHEN run >= 1 AND e0 = 0 THEN ' ' ELSE '' END || coalesce(tok, '') AS piece FROM j),
o AS (SELECT doc_id, string_agg(piece, '' ORDER BY run) AS code FROM pc GROUP BY doc_id)
SELECT s.doc_id, coalesce(o.code, '') AS code FROM src s LEFT JOIN o USING (doc_id)""")


# ---------------------------------------------------------------- phase 5-7

oracle("exec_rates", f"""WITH {RUNS}, {GT}, {CANDS},
l AS (SELECT *, {pick(['python', 'java', 'cpp'], 'user_id')} AS lang,
             CASE WHEN NOT run_ok THEN floor(value) END AS err_pos FROM cands)
SELECT lang, count(*) AS n, round(avg(CASE WHEN run_ok THEN 1.0 ELSE 0.0 END), 6) AS run_rate,
       round(avg(CASE WHEN run_ok AND gt_ok AND {strip('stdout')} = {strip('gt_stdout')} THEN 1.0 ELSE 0.0 END), 6) AS equiv_rate,
       round(avg(err_pos), 6) AS mean_err_pos
FROM l GROUP BY lang""")

oracle("shard_ids", """WITH i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, count(*) OVER () AS n FROM documents)
SELECT doc_id, idx, floor(idx / greatest(1, ceil(n / 8)))::BIGINT AS shard FROM i""")

oracle("preview", """SELECT doc_id, substring(text, 1, 200) AS text, substring(lang, 1, 200) AS lang FROM documents ORDER BY doc_id LIMIT 1""")

oracle("jsonl_roundtrip", f"""WITH {CONV_SAMPLES}, o AS (
  SELECT u.conv_id, u.turn, a.text AS gt_code FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')
SELECT 'conv' AS category, 'conv_' || s.conv_id || '_' || s.turn AS id, s.instruction,
       CASE WHEN s.turn % 4 = 0 THEN '' ELSE coalesce(s.input, '') END AS input, o.gt_code, 999.0::DOUBLE AS loss
FROM samples s JOIN o USING (conv_id, turn)""")

oracle("aligned_lines", f"""WITH d AS (SELECT doc_id, {toks('text')} AS r FROM documents),
h AS (SELECT doc_id, r, list_filter(r, lambda x, i: i % 7 <> 0) AS h FROM d)
SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS line_no, doc_id,
       {one_line("array_to_string(h, ' ')")} AS pred, {one_line("array_to_string(r, ' ')")} AS ref
FROM h""")

oracle("partitioned_report", f"""WITH {EMB},
s AS (SELECT vec_id, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS category,
             CASE WHEN len(list_filter(logps, lambda x: x > -65500.0)) > 0
                  THEN {lsum('list_filter(logps, lambda x: x > -65500.0)')} / len(list_filter(logps, lambda x: x > -65500.0)) ELSE -999.0 END AS score,
             CASE WHEN len(logps[greatest(1, label * 7):]) > 0 THEN -({lsum('logps[greatest(1, label * 7):]')} / len(logps[greatest(1, label * 7):])) ELSE 999.0 END AS loss
      FROM emb)
SELECT category, printf('ID: %d' || chr(9) || 'CodeBLEU: %.5f' || chr(9) || 'Loss: %.5f', vec_id, score, loss) AS report FROM s""")

oracle("append_metrics", f"""WITH {EMB},
r AS (SELECT vec_id // 2 AS pair_id, CASE WHEN vec_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS role,
             (SELECT coalesce(sum(CASE WHEN labels[i + 1] <> -100 THEN logps[i] ELSE 0.0 END), 0.0) FROM range(1, 32) t(i)) AS policy_logp,
             (SELECT coalesce(sum(CASE WHEN labels[32 + i + 1] <> -100 THEN logps[32 + i] ELSE 0.0 END), 0.0) FROM range(1, 32) t(i)) AS ref_logp
      FROM emb),
pp AS (SELECT pair_id, pair_id // 8 AS step,
              max(policy_logp) FILTER (WHERE role = 'chosen') AS pc, max(ref_logp) FILTER (WHERE role = 'chosen') AS rc,
              max(policy_logp) FILTER (WHERE role = 'rejected') AS pr, max(ref_logp) FILTER (WHERE role = 'rejected') AS rr
       FROM r GROUP BY pair_id
       HAVING count(*) FILTER (WHERE role = 'chosen') = 1 AND count(*) FILTER (WHERE role = 'rejected') = 1),
x AS (SELECT *, 0.1 * (pc - rc) AS cr, 0.1 * (pr - rr) AS rj FROM pp)
SELECT step, count(*) AS n_pairs, round(avg(ln(1 + exp(-abs(cr - rj))) + greatest(-(cr - rj), 0.0)), 6) AS loss,
       round(avg(CASE WHEN cr > rj THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM x GROUP BY step HAVING step % 3 = 0""")

oracle("stream_tier_windows", """WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events),
w AS (SELECT date_trunc('day', ts) AS ws, event_type, value FROM events)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS avg_value
FROM w, m WHERE ws + INTERVAL 1 DAY <= m.wm GROUP BY ws, event_type""")

oracle("stream_reward_windows", f"""WITH {RUNS}, {GT}, {CANDS}, {TIER_REWARD},
m AS (SELECT max(ts) - INTERVAL 1 DAY AS wm FROM events),
r AS (SELECT date_trunc('day', e.ts) AS d, x.tier, x.reward FROM rewarded x JOIN events e ON e.event_id = x.cand_idx),
w AS (SELECT 'tumbling' AS kind, d AS ws, d + INTERVAL 1 DAY AS we, tier, reward FROM r
      UNION ALL SELECT 'sliding', d, d + INTERVAL 2 DAY, tier, reward FROM r
      UNION ALL SELECT 'sliding', d - INTERVAL 1 DAY, d + INTERVAL 1 DAY, tier, reward FROM r)
SELECT kind, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n,
       count(*) FILTER (WHERE tier = 'perfect') AS n_perfect, count(*) FILTER (WHERE tier = 'sync') AS n_sync,
       count(*) FILTER (WHERE tier = 'failed') AS n_failed, round(avg(CAST(reward AS DOUBLE)), 6) AS mean_reward
FROM w, m WHERE we <= m.wm GROUP BY kind, ws""")

oracle("stream_dedupe", """SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, props FROM events""")

oracle("stream_mine_pairs", f"""WITH {MINED}
SELECT lang, source, strategy, chosen_id, rejected_id, pair_rank FROM mined""")


# ---------------------------------------------------------------- coverage

oracle("hypotheses_jsonl", f"""WITH d AS (SELECT doc_id, {toks('text')} AS r FROM documents)
SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS line_no,
       array_to_string(list_filter(r, lambda x, i: i % 7 <> 0), ' ') AS hyp, array_to_string(r, ' ') AS target
FROM d""")

MULTI = f"""d AS (SELECT doc_id, lang, {toks('text')} AS r FROM documents),
h AS (SELECT doc_id, lang, list_filter(r, lambda x, i: i % 7 <> 0) AS h, r AS r1,
             list_filter(r, lambda x, i: i % 5 <> 0) AS r2 FROM d),
kw AS (SELECT lang, token FROM (
         SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, token) AS rk
         FROM (SELECT lang, unnest(r) AS token FROM d) GROUP BY lang, token) WHERE rk <= 50),
g0 AS (SELECT doc_id, n, g, count(*) AS c FROM ({grams_sql('h', 'h')}) GROUP BY doc_id, n, g),
g1 AS (SELECT doc_id, n, g, count(*) AS c FROM ({grams_sql('h', 'r1')}) GROUP BY doc_id, n, g),
g2 AS (SELECT doc_id, n, g, count(*) AS c FROM ({grams_sql('h', 'r2')}) GROUP BY doc_id, n, g),
allg AS (SELECT doc_id, n, g FROM g0 UNION SELECT doc_id, n, g FROM g1 UNION SELECT doc_id, n, g FROM g2),
j AS (SELECT a.doc_id, a.n, a.g, coalesce(g0.c, 0) AS ch, coalesce(g1.c, 0) AS c1, coalesce(g2.c, 0) AS c2
      FROM allg a LEFT JOIN g0 USING (doc_id, n, g) LEFT JOIN g1 USING (doc_id, n, g) LEFT JOIN g2 USING (doc_id, n, g)),
jw AS (SELECT j.*, CASE WHEN kw.token IS NOT NULL THEN 1 ELSE 0 END AS iskw,
              CASE WHEN j.n = 1 THEN CASE WHEN kw.token IS NOT NULL THEN 1.0 ELSE 0.2 END ELSE 1.0 END::DOUBLE AS w
       FROM j JOIN h USING (doc_id) LEFT JOIN kw ON kw.lang = h.lang AND kw.token = j.g AND j.n = 1),
per AS (SELECT doc_id, n, sum(least(ch, greatest(c1, c2))) AS m, sum(ch) AS t,
               sum((least(c1, ch) + least(c2, ch)) * w) AS wn,
               sum(c1 * iskw) AS k1, sum(c2 * iskw) AS k2
        FROM jw GROUP BY doc_id, n),
stats AS (
  SELECT h.doc_id, len(h.h) AS hl,
         CASE WHEN abs(len(h.r1) - len(h.h)) < abs(len(h.r2) - len(h.h)) THEN len(h.r1)
              WHEN abs(len(h.r1) - len(h.h)) > abs(len(h.r2) - len(h.h)) THEN len(h.r2)
              ELSE least(len(h.r1), len(h.r2)) END AS rl,
         {", ".join(f"coalesce(max(m) FILTER (WHERE n = {k}), 0) AS m{k}" for k in range(1, 5))},
         {", ".join(f"greatest(1, coalesce(max(t) FILTER (WHERE n = {k}), 0)) AS d{k}" for k in range(1, 5))},
         {", ".join(f"coalesce(max(wn) FILTER (WHERE n = {k}), 0.0) AS wn{k}" for k in range(1, 5))},
         greatest(1.0, 0.2 * len(h.r1) + 0.8 * coalesce(max(k1) FILTER (WHERE n = 1), 0))
           + greatest(1.0, 0.2 * len(h.r2) + 0.8 * coalesce(max(k2) FILTER (WHERE n = 1), 0)) AS wd1,
         {", ".join(f"greatest(1.0, len(h.r1) - {k} + 1) + greatest(1.0, len(h.r2) - {k} + 1) AS wd{k}" for k in range(2, 5))}
  FROM h LEFT JOIN per USING (doc_id)
  GROUP BY h.doc_id, h.h, h.r1, h.r2)"""

oracle("multi_ref_scores", f"""WITH {MULTI}
SELECT doc_id, round({score_sql('m', 'd')}, 6) AS bleu, round({score_sql('wn', 'wd')}, 6) AS weighted FROM stats""")

oracle("rollout_append", f"""WITH {RUNS}, {GT}, {CANDS}, {TIER_PAIRS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, tier ORDER BY cand_idx) AS rn FROM tiered)
SELECT user_id, day, (CAST(substr(day, 9, 2) AS INTEGER) // 10)::BIGINT AS epoch, (user_id % 4)::BIGINT AS rank,
       coalesce(string_agg(CAST(cand_idx AS VARCHAR), ',' ORDER BY cand_idx) FILTER (WHERE tier = 'perfect' AND rn <= 1), '') AS perfect_samples,
       coalesce(string_agg(CAST(cand_idx AS VARCHAR), ',' ORDER BY cand_idx) FILTER (WHERE tier = 'sync' AND rn <= 3), '') AS sync_samples,
       coalesce(string_agg(CAST(cand_idx AS VARCHAR), ',' ORDER BY cand_idx) FILTER (WHERE tier = 'failed' AND rn <= 3), '') AS failed_samples,
       count(*) FILTER (WHERE tier = 'perfect') AS n_perfect,
       count(*) FILTER (WHERE tier = 'sync') AS n_sync,
       count(*) FILTER (WHERE tier = 'failed') AS n_failed
FROM ranked GROUP BY user_id, day""")

oracle("prompt_system", f"""WITH {CONV_SAMPLES},
sp AS (SELECT conv_id, arg_min(text, turn) AS sys_text FROM conversations WHERE role = 'system' GROUP BY conv_id),
j AS (SELECT s.*, coalesce(sp.sys_text, 'You are a careful programmer.') AS sp,
             s.instruction || chr(10) || 'Give an outline first.' AS ins FROM samples s LEFT JOIN sp USING (conv_id))
SELECT conv_id, turn,
  CASE WHEN input IS NOT NULL AND NOT regexp_matches(input, '^{WS}*\\z')
       THEN '<<system>>' || chr(10) || sp || chr(10) || '<<user>>' || chr(10) || ins || chr(10) || chr(10) || input || chr(10) || '<<assistant>>' || chr(10)
       ELSE '<<system>>' || chr(10) || sp || chr(10) || '<<user>>' || chr(10) || ins || chr(10) || '<<assistant>>' || chr(10) END AS prompt
FROM j""")

oracle("epoch_shuffle", """WITH e AS (SELECT doc_id, epoch FROM documents, (SELECT unnest([0, 1]) AS epoch) x)
SELECT epoch::BIGINT AS epoch, doc_id,
       (row_number() OVER (PARTITION BY epoch ORDER BY md5('42|' || epoch || '|' || doc_id), doc_id) - 1)::BIGINT AS position
FROM e""")

oracle("group_reward_pandas", f"""WITH {RUNS},
g AS (SELECT event_id // 4 AS group_id, event_id, run_ok, stdout,
             first_value(stdout) OVER (PARTITION BY event_id // 4 ORDER BY event_id) AS ref FROM runs)
SELECT group_id, event_id,
       round(CASE WHEN run_ok AND {strip('stdout')} = {strip('ref')} THEN 1.0 WHEN run_ok THEN 0.5 ELSE 0.1 END::DOUBLE, 6) AS reward
FROM g""")
