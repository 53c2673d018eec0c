"""Phrase counts against a greedy search for substrings, held-out accuracy, odd rows."""

import zlib

import numpy as np

from tests.conftest import SF_MID
from tiermill.llm import cross_parse as C
from tiermill.llm import queries


def brute_phrases(text: bytes, sample: bytes, block=C.BLOCK) -> int:
    count = 0
    for a in range(0, len(text), block):
        piece, i = text[a:a + block], 0
        while i < len(piece):
            n = 1
            while i + n <= len(piece) and piece[i:i + n] in sample:
                n += 1
            i += max(1, n - 1)
            count += 1
    return count


def parser(samples, n_symbols):
    automata = []
    for s in samples:
        made = C.suffix_automaton(s)
        a, c, z = np.array([(a, c, z) for a, out in enumerate(made) for c, z in out.items()], np.int32).reshape(-1, 3).T
        automata.append((a, c, z, len(made)))
    return C.Parser(np.arange(256, dtype=np.uint8), n_symbols, automata)


def test_phrases_against_greedy_search():
    rng = np.random.default_rng(1)
    samples = [bytes(rng.integers(1, 5, 300).astype(np.uint8)), bytes(rng.integers(2, 7, 200).astype(np.uint8)), b"\x01"]
    p = parser(samples, 9)
    lens = [0, 1, 2, 511, 512, 513, 1024, 3000, 0, 7]
    texts = [bytes(rng.integers(1, 8, n).astype(np.uint8)) for n in lens] + [samples[0], samples[1] + b"\x08", b"\x08" * 5]
    upto = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = p.phrases(np.frombuffer(b"".join(texts), np.uint8), upto)
    assert got.tolist() == [[brute_phrases(t, s) for t in texts] for s in samples]
    assert got[0][10] == 1 and got[0][12] == 5


def test_automaton_holds_all_substrings():
    text = b"abracadabrabcab"
    step = C.suffix_automaton(text)

    def accepts(s):
        at = 0
        for c in s:
            if c not in step[at]:
                return False
            at = step[at][c]
        return True

    assert all(accepts(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1))
    assert not any(accepts(s) for s in (b"aa", b"bb", b"abracab", b"cabr"))


def test_symbols():
    classes = np.zeros(256, np.uint8)
    classes[97:123] = np.arange(1, 27)
    texts = [b"", b"  a--b ", b"!!", b"ab", b" "]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s, upto = C.symbols(np.frombuffer(b"".join(texts), np.uint8), off, classes)
    assert s.tolist() == [1, 0, 2, 0, 1, 2] and upto.tolist() == [0, 0, 4, 4, 6, 6]
    s, upto = C.symbols(np.zeros(0, np.uint8), np.array([0, 0, 0]), classes)
    assert s.tolist() == [] and upto.tolist() == [0, 0, 0]


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op12_cross_parse"](spark, SF_MID).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    for fold in (True, False):
        same = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out == fold]
        assert sum(same) / len(same) > 0.98


def texts(n):
    words = {"aa": "the house and this water over there with many".split(), "bb": "das Haus und jenes Wasser dort über viele mit".split()}
    rng = np.random.default_rng(n)
    return [(i, " ".join(rng.choice(words[k], 30)), k) for i in range(n) for k in ("aa", "bb")]


def test_predictions_do_not_read_labels_and_long_texts(spark):
    rows = texts(60)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pred = {(r.doc_id, i % 2): r.lang_pred for i, r in enumerate(C.predict_languages(d.coalesce(1)).collect())}
    assert pred == {(i, int(k == "bb")): k for i, _, k in rows}
    out = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 0][:3]
    long = [(out[0], "das Wasser und " * 60_000, "aa"), (out[1], "THE HOUSE, " * 60_000, None), (out[2], "ß" * 100_000, "zz")]
    x = d.unionByName(spark.createDataFrame(long, "doc_id long, text string, lang string"))  # held out: wrong labels teach nothing
    got = {r.doc_id: r for r in C.predict_languages(x).where("doc_id >= 1000").collect()}
    assert [got[i].lang_pred for i in out[:2]] == ["bb", "aa"] and got[out[1]].score > 0.1 and got[out[2]].lang_pred in ("aa", "bb")


def test_odd_rows(spark):
    rows = texts(40) + [(900, None, "aa"), (901, "", "bb"), (902, "12 !? \n", "aa"), (903, "Δ", "bb"), (None, "the house", "aa"),
                        (904, "das Haus", None), (904, "das Haus", None), (905, "ª", None)]
    d = spark.createDataFrame([(i, t, k, 0.5, True, "x") for i, t, k in rows],
                              "doc_id long, text string, lang string, score double, held_out boolean, h string").repartition(3)
    got = C.predict_languages(d)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = got.collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert by[900] == by[901] == by[902] == [("und", 0.0)]
    assert by[904][0] == by[904][1] and by[904][0][0] == "bb" and by[None][0][0] == "aa" and by[903][0][0] in ("aa", "bb")
    assert C.predict_languages(d.where("false")).collect() == []
    nothing = C.predict_languages(d.withColumn("lang", d.text.substr(1, 0)).where("text is null or lang is null")).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    one = C.predict_languages(d.where("lang = 'aa'")).where("lang_pred = 'aa'").collect()
    assert {r.score for r in one} == {1.0}
    text_ids = C.predict_languages(d.select(d.doc_id.cast("string").alias("doc_id"), "text", "lang"))
    assert text_ids.schema["doc_id"].dataType.simpleString() == "string" and text_ids.count() == len(rows)
    again = C.predict_languages(d.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
