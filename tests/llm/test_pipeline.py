"""Every stage of the pipeline against a brute-force form, on what the stage before kept."""

import re

import corpus_pipeline as P
from tests.conftest import SF_MID
from tests.llm.brute import bench_tokens, near_components, overlaps
from tests.llm.test_bpe_lexicon import expected
from tiermill.session import shared_dir


def test_stages_and_run(spark):
    read = lambda t: spark.read.parquet(f"{SF_MID}/{t}.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    label = {r.doc_id: r.quality for r in read("labels").collect()}
    items = [bench_tokens(r.text) for r in read("benchmark").collect()]
    docs, path = read("documents"), shared_dir(spark, "test-stages")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF_MID).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
        if name == "bpe":
            rows = sorted(before.items())
            got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()}
            assert got == {i: e for (i, _), e in zip(rows, expected([t for _, t in rows]))}
            continue
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert all(before[i] == t for i, t in after.items())
        gone = set(before) - set(after)
        if name == "quality":
            good, bad = {i for i in before if label.get(i) == 1}, {i for i in before if label.get(i) == 0}
            assert len(good & gone) <= 0.01 * len(good) and len(bad & gone) >= 0.95 * len(bad)
        elif name == "exact_dedup":
            best = {}
            for i, t in before.items():
                key = re.sub(r"[\x20\x09-\x0D]", "", t)
                best[key] = min(best.get(key, (0, 1 << 60)), (-len(t), i))
            assert set(after) == {i for _, i in best.values()} and gone
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in near_components(before.items(), 5, 80).items() if i == c} and gone
        else:
            tokens = {i: bench_tokens(t) for i, t in before.items()}
            assert gone == {i for i, w in tokens.items() if any(overlaps(w, v) is not None for v in items)} and gone
    whole = {tuple(r) for r in P.run(spark, SF_MID).collect()}
    assert whole == {tuple(r) for r in docs.collect()}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF_MID).collect() == []


def test_odd_rows(spark):
    """Null and empty texts, null ids, repeated rows, ties and columns named like the operators' own."""
    import random
    rng = random.Random(1)
    words = "the of a house river with many little stones and two tall trees near it".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(60)) + "."
    same, twice = text(), text()
    rows = [(i, text()) for i in range(20)] + [(100, same), (101, same + " "), (102, same + "  "), (200, twice), (200, twice), (None, text()),
                                               (None, text()), (300, None), (301, ""), (302, " \n"), (None, None)]
    extra = ["row", "score", "digest", "id", "kept", "n", "tag", "lang", "source", "n_chars"]
    docs = spark.createDataFrame([(i, t, *range(len(extra))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra))
    kept = {}
    for name, stage in P.STAGES:
        path = shared_dir(spark, "test-odd")
        stage(spark, docs, SF_MID).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()] if name != "bpe" else [r.doc_id for r in docs.collect()]
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", *extra] and {tuple(r)[2:] for r in docs.collect()} <= {tuple(range(len(extra)))}
    first, exact = kept["quality"], kept["exact_dedup"]
    assert all(r in rows for r in first) and sum(t == twice for _, t in exact) == min(1, sum(t == twice for _, t in first))
    long = [i for i, t in first if t and t.strip() == same]
    assert [i for i, t in exact if t and t.strip() == same] == [max(long)] if long else True  # the most code points
    assert sum(not (t or "").strip() for _, t in exact) <= 1
    assert sorted(map(str, kept["bpe"])) == sorted(str(i) for i, _ in kept["decontaminate"])
