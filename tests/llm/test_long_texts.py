"""Very long texts, whole, against the plain forms."""

import hashlib
import random

from tests.llm.brute import bench_tokens, near_components, overlaps
from tiermill.llm import chat, decontaminate, line_dedup, minhash


def words(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_near_dedup(spark):
    a = words(1, 60_000)
    b = list(a)
    for i in range(0, len(b), 50):
        b[i] = "other"
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(words(2, 60_000))), (4, "x" * 400_000), (5, "x" * 400_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == near_components(rows, 3, 85) and got[2][1] == 1 and got[5][1] == 4


def test_line_dedup(spark):
    common = "a line that is found in every one of these documents"
    rows = [(k, "\n".join(f"line {k} {i} " + "y" * 40 if i % 3 else common for i in range(8_000))) for k in range(5)] + [(9, "z" * 500_000)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].n_lines == 8_000 and got[k].n_dropped == (0 if k == 4 else 2_667) for k in range(5))
    assert got[9].text == rows[5][1]
    assert got[0].text == "\n".join(x for x in rows[0][1].split("\n") if x != common)


def test_decontamination(spark):
    item = " ".join(f"item{i}" for i in range(20))
    late = " ".join(words(3, 50_000)) + " " + " ".join("swapped" if i in (4, 11) else f"item{i}" for i in range(20))
    docs = [(1, late), (2, " ".join(words(4, 50_000))), (3, "q" * 400_000)]
    got = {r.doc_id: (r.contaminated, r.best_equal) for r in decontaminate.flagged(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (True, overlaps(bench_tokens(late), bench_tokens(item))), 2: (False, 0), 3: (False, 0)}


def test_chat(spark):
    text = "<|im_end|> and \\ more " * 20_000
    d = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    r, = chat.digests(chat.format_chats(d)).collect()
    assert (r.loss_chars, r.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
