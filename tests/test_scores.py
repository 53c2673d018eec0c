"""N-gram, tree and edge scores: golden values and properties."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiermill.operators import ngrams as NG
from tiermill.operators import trees as TR


def bleu_of(spark, pairs):
    df = spark.createDataFrame([(i, h.split(), [r.split()]) for i, (h, r) in enumerate(pairs)],
                               "k long, hyp_tokens array<string>, refs array<array<string>>")
    st_ = NG.ngram_stats(df, ["k"])
    return {r["k"]: (r["b"], r["w"]) for r in st_.select("k", NG.bleu_col().alias("b"), NG.weighted_col().alias("w")).collect()}


def test_bleu_golden(spark):
    got = bleu_of(spark, [("a b c d", "a b c d"), ("", "a b"), ("x y", "a b"), ("a b c", "a b c d")])
    # identical 4 tokens: BLEU 1; weighted unigram recall 0.8 / max(1, 0.8)
    assert math.isclose(got[0][0], 1.0)
    assert math.isclose(got[0][1], math.exp((math.log(0.8) + 0 + 0 + 0) / 4))
    assert got[1] == (0.0, 0.0) and got[2][0] == 0.0
    # 3 of 3 unigrams, 2 of 2 bigrams, 1 of 1 trigram, no 4-gram -> 0.1 / 1; BP exp(1 - 4/3)
    expect = math.exp(1 - 4 / 3) * math.exp((math.log(1) + math.log(1) + math.log(1) + math.log(0.1)) / 4)
    assert math.isclose(got[3][0], expect, rel_tol=1e-12)


# five tokens or more: the weighted unigram denominator 0.2 * len reaches 1
words = st.lists(st.sampled_from(["a", "b", "c", "d", "e"]), min_size=5, max_size=25)


@settings(max_examples=10, deadline=None)
@given(st.lists(words, min_size=1, max_size=5))
def test_identical_pair_scores_one(spark, docs):
    got = bleu_of(spark, [(" ".join(d), " ".join(d)) for d in docs])
    assert all(math.isclose(b, 1.0) and math.isclose(w, 1.0) for b, w in got.values())


def test_tree_shapes_and_ratio(spark):
    html = "<div><ul><li><a href='x'>t</a></li><li>u</li></ul></div><div><h1>x</h1></div>"
    df = spark.createDataFrame([(1, html)], "k long, html string")
    shapes = sorted((r["pos"], r["depth"], r["shape"]) for r in TR.tree_shapes(df, "k", "html").collect())
    assert shapes == [(-1, 1, "div ul li a /a /li li /li /ul /div div h1 /h1 /div"),
                      (0, 2, "div ul li a /a /li li /li /ul /div"), (1, 3, "ul li a /a /li li /li /ul"),
                      (2, 4, "li a /a /li"), (10, 2, "div h1 /h1 /div")]
    sh = TR.tree_shapes(df, "k", "html").select("k", F.md5("shape").alias("h"))
    same = TR.membership_ratio(sh, sh, ["k"], ["h"]).first()
    assert same["ratio"] == 1.0


def test_unclosed_markup_gives_no_false_element(spark):
    html = "<div><ul><li>a<li>b</ul></div><div><h1>x</h1></div>"
    shapes = {r["shape"] for r in TR.tree_shapes(spark.createDataFrame([(1, html)], "k long, html string"), "k", "html").where("pos >= 0").collect()}
    assert shapes <= {"div ul li li /ul /div", "ul li li /ul", "div h1 /h1 /div"} and "div h1 /h1 /div" in shapes


def shapes_of(spark, html):
    return sorted((r["pos"], r["depth"], r["shape"]) for r in TR.tree_shapes(
        spark.createDataFrame([(1, html)], "k long, html string"), "k", "html").where("pos >= 0").collect())


def test_unclosed_markup_keeps_the_elements_around_it(spark):
    assert shapes_of(spark, "<div><ul><li>a<li>b</ul></div><div><h1>x</h1></div>") == [
        (0, 2, "div ul li li /ul /div"), (1, 3, "ul li li /ul"), (6, 2, "div h1 /h1 /div")]
    # the inner li is unclosed; the close after the inner ul ends the outer one; stray closes end nothing
    assert shapes_of(spark, "</p><ul><li>a<ul><li>b</ul></p></li></ul>") == [
        (1, 2, "ul li ul li /ul /p /li /ul"), (2, 3, "li ul li /ul /p /li"), (3, 4, "ul li /ul")]


def test_every_tag_kind_is_read(spark):
    assert shapes_of(spark, "<HTML lang='x'><body><p><b>t</b><br/></p><main-part><p>u</body></html>") == [
        (0, 2, "html body p b /b br /p main-part p /body /html"), (1, 3, "body p b /b br /p main-part p /body"), (2, 4, "p b /b br /p")]


def test_membership_counts_reference_multiplicity(spark):
    ref = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "k long, h string")
    cand = spark.createDataFrame([(1, "x")], "k long, h string")
    r = TR.membership_ratio(ref, cand, ["k"], ["h"]).first()
    assert (r["matched"], r["total"]) == (2, 3)  # membership, not clipped counts


def test_tree_shapes_strip_comments_first(spark):
    html = "<div><ul><li>a</li></ul></div> /* <div><h1>x</h1></div> */"
    df = spark.createDataFrame([(1, html)], "k long, html string")
    plain = TR.tree_shapes(df, "k", "html").count()
    stripped = sorted(r["shape"] for r in TR.tree_shapes(df, "k", "html", strip_comments=True).collect())
    assert plain == 4 and stripped == ["div ul li /li /ul /div", "div ul li /li /ul /div", "ul li /li /ul"]


def test_a_row_without_references_scores_zero(spark):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, ["a", "b"], [["a", "b"]]), (3, ["a"], [])],
                               "k long, hyp_tokens array<string>, refs array<array<string>>")
    got = {r["k"]: r["bleu"] for r in NG.ngram_stats(df, ["k"]).select("k", NG.bleu_col().alias("bleu")).collect()}
    assert got[1] == got[3] == 0.0 and got[2] > 0


def test_incomplete_pairs_are_counted_and_enter_no_mean(spark):
    from tiermill.operators.prefs import pref_metrics
    rows = [(0, 1, "chosen", -1.0, -2.0), (0, 1, "rejected", -3.0, -2.0), (0, 2, "chosen", -9.0, 0.0),
            (1, 3, "chosen", 0.0, 0.0), (1, 3, "chosen", 0.0, 0.0), (1, 3, "rejected", 0.0, 0.0)]
    got = {r["b"]: r for r in pref_metrics(spark.createDataFrame(rows, "b long, pair_id long, role string, policy_logp double, ref_logp double"),
                                           ["b"]).collect()}
    assert (got[0]["n_pairs"], got[0]["n_incomplete"], got[0]["accuracy"], got[0]["logps_chosen"]) == (1, 1, 1.0, -1.0)
    assert (got[1]["n_pairs"], got[1]["n_incomplete"], got[1]["loss"]) == (0, 1, None)


def test_pair_scores_read_the_first_fence_and_the_trees(spark):
    from tiermill.operators.score import pair_scores
    page = "<div> <p> a b c </p> <ul> <li> d </li> </ul> </div>"
    flat = "<div> <p> a b c </p> <li> d </li> </div>"
    rows = [(1, "x", f"so:\n```html\n{page}\n```\nor\n```\nz\n```", page), (2, "x", flat, f"```\n{page}\n```"),
            (3, "x", "``` ```", page), (4, "x", "a b", "a b")]
    sides = [(k, lang, ref, text) for k, lang, *both in rows for ref, text in zip((False, True), both)]
    df = spark.createDataFrame(sides, "k long, lang string, is_ref boolean, text string")
    got = {r["k"]: r for r in pair_scores(df, "k", "lang", "is_ref", "text").collect()}
    assert [got[1][c] for c in ("ngram", "weighted", "syntax", "dataflow", "codebleu")] == [1.0] * 5
    # the reference's subtrees: the root, div and ul; none of them is on the other side
    assert got[2]["syntax"] == 0.0 and math.isclose(got[2]["codebleu"], sum(got[2][c] for c in ("ngram", "weighted", "dataflow")) / 4)
    assert got[3]["codebleu"] == 0.0 and got[4]["syntax"] is None


def test_tree_match_corpus_sums_the_pairs(spark):
    from tests.conftest import SF_SMALL
    from tiermill.plans.queries import QUERIES, page_matches
    pairs = page_matches(spark, SF_SMALL, None).select("lang", "matched", "total").collect()
    got = {(r["level"], r["lang"]): (r["n_pairs"], r["matched"], r["total"], r["ratio"]) for r in QUERIES["tree_match_corpus"](spark, SF_SMALL).collect()}
    groups = {(0, x["lang"]): [p for p in pairs if p["lang"] == x["lang"]] for x in pairs} | {(1, None): pairs}
    sums = {k: (len(v), sum(p["matched"] for p in v), sum(p["total"] for p in v)) for k, v in groups.items()}
    assert pairs and got == {k: (*v, round(v[1] / v[2], 6)) for k, v in sums.items()}


def brute_subtrees(marks):
    """(open, close) by looking back for the latest open of the kind that nothing has ended or swallowed."""
    alive, out = [], []
    for i, m in enumerate(marks):
        if not m.startswith("/"):
            alive.append((i, m))
        elif any(k == m[1:] for _, k in alive):
            at = max(j for j, (_, k) in enumerate(alive) if k == m[1:])
            out.append((alive[at][0], i))
            alive = alive[:at]
    return sorted(p for p in out if p[1] > p[0] + 1)


def test_inventory_against_brute_force():
    import random
    rng = random.Random(3)
    by_digest, by_shape = {}, {}
    for _ in range(1500):
        marks = [rng.choice(["a", "b", "c", "/a", "/b", "/c"]) for _ in range(rng.randrange(1, 14))]
        el, root = TR.inventory(marks)
        spans = brute_subtrees(marks)
        assert [(a, z) for a, z, _, _ in el] == spans
        assert [d for _, _, d, _ in el] == [2 + sum(p < a and z < q for p, q in spans) for a, z in spans]
        shapes = [(tuple(marks[a:z + 1]), h) for a, z, _, h in el] + [(("root", *marks), root)]
        for shape, h in shapes:  # equal digests exactly for equal sequences
            assert by_digest.setdefault(h, shape) == shape and by_shape.setdefault(shape, h) == h


def test_inventory_work_is_linear():
    import time

    def seconds(marks):
        best = 9.0
        for _ in range(3):
            t = time.thread_time()
            TR.inventory(marks)
            best = min(best, time.thread_time() - t)
        return best

    for row in (lambda n: ["ul", *["li", "b", "/b", "/li"] * n, "/ul"], lambda n: ["ul"] * n + ["/ul"] * n, lambda n: ["p"] + ["li"] * n + ["/p"] * n):
        assert seconds(row(80_000)) < 4 * seconds(row(40_000)) + 0.05


def test_digests_say_what_shapes_say(spark):
    rows = [(1, "<ul><li><b>x</b></li><li><b>y</b></li></ul><p>"), (2, "<ul><li><b>x</b></li></ul>"), (3, ""), (4, None), (5, "no markers")]
    df = spark.createDataFrame(rows, "k long, html string")
    shapes = sorted((r.k, r.pos, r.depth, r.size, r.shape) for r in TR.tree_shapes(df, "k", "html").collect())
    digests = sorted((r.k, r.pos, r.depth, r.size, r.h) for r in TR.tree_digests(df, ["k"], "html").collect())
    assert [x[:4] for x in shapes] == [x[:4] for x in digests] and {x[0] for x in shapes} == {1, 2}
    same = {}
    for a, b in zip(shapes, digests):
        if a[1] >= 0:
            assert same.setdefault(a[4], b[4]) == b[4]
    assert len(set(same.values())) == len(same) == 3
