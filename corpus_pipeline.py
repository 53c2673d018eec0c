"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

quality classifier -> exact dedup -> MinHash near-dedup -> benchmark decontamination -> BPE round trip.

The first four return rows of ``documents`` with all their columns; the last returns a row per document that is left with
its token count and the digests of its ids and of the text decoded from them.  Stages on word shingles take five words and a
similarity of 0.8.

Defined cases: null, empty and blank texts are scored like any other (what of them the classifier keeps is one group of equal
texts for exact dedup, has no shingles and no tokens, and ends as a row without ids); a null id is an id like any other but
is never learned from; of rows that repeat an id and a text one stays, of equal texts the one with the most code points, then
the smallest id, nulls last; a very long text is worked on whole by every stage; an empty table gives an empty result; extra
columns go through untouched whatever their names.  Ids are integers.  No SQL is given: the classifier's scores can't be expressed in it; tests hold every stage against a
brute-force form.
"""

from __future__ import annotations

from tiermill.llm import bpe_lexicon, decontaminate, exact_dedup, minhash, quality
from tiermill.llm.queries import bpe_path
from tiermill.session import shared_dir, table


def quality_stage(spark, docs, sf_dir):
    """Documents that the positive-unlabelled classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def exact_stage(spark, docs, sf_dir):
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.dedup_exact(docs)


def near_stage(spark, docs, sf_dir):
    """One document of each component of near copies."""
    return minhash.dedup_near(docs, size=5, threshold=80)


def decontaminate_stage(spark, docs, sf_dir):
    """Documents without overlap with the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark, docs, sf_dir):
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document that is left."""
    return bpe_lexicon.round_trip(docs, bpe_path())


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("decontaminate", decontaminate_stage), ("bpe", bpe_stage)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = shared_dir(spark, f"pipeline-{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
