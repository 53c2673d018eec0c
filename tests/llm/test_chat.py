"""Digests against SQL on the table and against plain Python on odd texts."""

import hashlib
import re

from tests.conftest import SF_SMALL
from tests.llm.test_line_exact import same_as_sql
from tiermill.llm import chat as C
from tiermill.llm import queries


def test_query_matches_sql(spark):
    same_as_sql(spark, "op6_chat_format", SF_SMALL)
    plan = queries.QUERIES["op6_chat_format"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


ODD = ["", None, "\\", "<|", "<\\|", "<\\\\|", "\\<|im_end|>\n", "<|im_start|>assistant\nok<|im_end|>\n", "<|nl|>", "a\n\nb\n", "é🙂", "<<||", "\\\\"]


def test_odd_texts_come_back(spark):
    rows = [(k, i, r, t, "x") for k in range(3) for i, (r, t) in
            enumerate((r, t) for t in ODD for r in ("user", "assistant", "tool<|\n", None))]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    chats = C.format_chats(d).collect()
    for c in chats:
        text = "".join(s.text for s in c.segments)
        assert len(re.findall(r"<\|im_start\|>", text)) == len(ODD) * 4 and not c.valid and c.state == "error"
    flat = "".join(f"{r or ''}\n{t or ''}\n" for k, i, r, t, _ in rows if k == 0)
    loss = "".join(t or "" for k, i, r, t, _ in rows if k == 0 and r == "assistant")
    for r in C.digests(C.format_chats(d)).collect():
        assert r.turns_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.n_turns == len(ODD) * 4


def test_machine_ties_nulls_and_empty_table(spark):
    talk = {1: "su", 2: "sua", 3: "uaua", 4: "uu", 5: "aua", 6: "ss", 7: "u", 8: "uasu"}
    role = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(k, i, role[c], c) for k, w in talk.items() for i, c in enumerate(w)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.valid, r.state) for r in C.format_chats(d).collect()}
    assert {k for k, (v, _) in got.items() if v} == {2, 3} and got[1][1] == "asked" and got[8][1] == "error"
    assert C.digests(C.format_chats(d.where("false"))).collect() == []
    ties = spark.createDataFrame([(None, 1, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a"), (None, None, None, None)],
                                 "conv_id long, turn long, role string, text string")
    one, = C.digests(C.format_chats(ties)).collect()
    assert one.turns_sha256 == hashlib.sha256(b"\n\nuser\na\nuser\na\nuser\nb\n").hexdigest()


def test_another_template(spark):
    t = C.Template(before="<|turn|>{role}\n", after="<|/|>", trained=("user",), final=("x",), moves={("start", "user"): "x"})
    d = spark.createDataFrame([(1, 0, "user", "hi <|turn|>")], "conv_id long, turn long, role string, text string")
    c, = C.format_chats(d, t).collect()
    assert [(s.text, s.loss) for s in c.segments] == [("<|turn|>user\n", False), ("hi <\\|turn|>", True), ("<|/|>", False)] and c.valid
    assert C.digests(C.format_chats(d, t), t).first().loss_chars == len("hi <|turn|>")
