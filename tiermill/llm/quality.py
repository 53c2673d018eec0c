"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1 in the training folds; unlabelled web text are documents of those folds taken by a
hash of their id, whatever their label.  Negatives are never used.  The model is a logistic one over shares of character
classes, repetition and word shape, fitted by minimising the non-negative unbiased risk

    prior * E_P[l(g, +)] + max(0, E_U[l(g, -)] - prior * E_P[l(g, -)])

with the logistic loss l, so that its output is a probability.  The class prior is estimated from the same two samples: a
first model tells positives from unlabelled text; of the positives nearly all lie above a low score, so the share of
unlabelled text above it, divided by theirs, bounds the prior from above, and the least such ratio is taken.

Features are counted over whole texts, vectorised over Arrow batches.  The gradient reads at most ``sample`` rows of either
kind (those of the smallest hashes of the id, ties by id and features, so that any partitioning picks the same rows); what
describes the unlabelled text beyond that covers every training row: mean and spread of the features are exact integer
sums, and the class prior compares the positives with the share of all unlabelled rows above each score.  All rows are
scored.  Neither labels nor lang, source or doc_id enter a score.

Defined cases: null and empty texts have all features 0 and get the score of that point; a null id is not held out and isn't
learned from; ids are integers (an id that can't be cast to long raises); rows that repeat an id count as often as they stand;
a document with several labels counts as positive when all say 1; without any positive every score is 1 (nothing is known
against any text); repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermill.llm.bpe_lexicon import slices
from tiermill.llm.common import stored
from tiermill.llm.minhash import span_hashes, word_spans

#: Character classes whose shares are features.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,", "!", "?;:", "|", "*", "%&$", "#",
           "<>{}[]()=", "-_/\\+", "\"'`~^@", "\t\r\x0b\x0c"]
N_FEATURES = 2 * (len(CLASSES) + 7)


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of features for each text ``buf[off[i]:off[i + 1]]``."""
    n = len(off) - 1
    kinds = len(CLASSES) + 1
    of = np.full(256, kinds - 1, np.int64)  # bytes of other alphabets
    for k, chars in enumerate(CLASSES):
        of[[ord(c) for c in chars]] = k
    size = np.maximum(np.diff(off), 1)[:, None]
    doc = np.repeat(np.arange(n), np.diff(off))
    x = [np.bincount(doc * kinds + of[buf], minlength=n * kinds).reshape(n, kinds) / size]
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    starts, ends = word_spans(low, off)
    h = span_hashes(low, starts, ends)
    wdoc = np.searchsorted(off, starts, "right") - 1
    words = np.bincount(wdoc, minlength=n)
    some = np.maximum(words, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (wdoc[1:] == wdoc[:-1])
    two = np.zeros(len(h), bool)
    two[2:] = (h[2:] == h[:-2]) & (wdoc[2:] == wdoc[:-2])
    shout = np.zeros(len(h), bool)
    if len(h):
        up = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
        shout = (up[ends] - up[starts]) >= 2
    order = np.lexsort((h, wdoc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (wdoc[order][1:] != wdoc[order][:-1])
    per = lambda flag: np.bincount(wdoc, weights=flag, minlength=n) / some
    kinds_of = np.bincount(wdoc[order], weights=new, minlength=n)
    spare = np.maximum(0, 1 - kinds_of / np.maximum(1, some ** 0.85))  # fewer different words than natural text has
    x.append(np.column_stack([per(same), per(two), per(shout), spare, np.bincount(wdoc, weights=ends - starts, minlength=n) / some / 20,
                              np.log1p(words) / 10]))
    x = np.concatenate(x, axis=1)
    return np.concatenate([x, np.sqrt(x)], axis=1)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


# --------------------------------------------------------------------------------------------------------- learning

def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _dot(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` with each row summed alone, so that a row's score doesn't depend on the rows beside it."""
    return (x * w).sum(1)


def _descend(gradient, size: int, steps: int = 800, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


#: The shares of positives below the scores at which the prior is read off.
CUTS = (0.01, 0.02, 0.05, 0.1, 0.2)


def tell_apart(p: np.ndarray, u: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Weights of a model that tells positives from unlabelled rows."""
    def gradient(w):
        a, b = _sigmoid(p @ w) - 1, _sigmoid(u @ w)
        return p.T @ a / len(p) + u.T @ b / len(u) + decay * w

    return _descend(gradient, p.shape[1], 400)


def cut_scores(p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the positives at CUTS, and the share of positives at or above each."""
    s = np.sort(_dot(p, w))
    cuts = s[(np.array(CUTS) * len(s)).astype(int)]
    return cuts, 1 - np.searchsorted(s, cuts) / len(s)


def prior_of(above: np.ndarray, of_positives: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from the shares of both above the cuts."""
    return float(np.clip(min(above / np.maximum(1e-9, of_positives)), 0.05, 0.98))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, decay: float = 1e-4) -> np.ndarray:
    """Weights of the model with the least non-negative unbiased risk."""
    def gradient(w):
        zp, zu = p @ w, u @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        gain = prior * p.T @ (sp - 1) / len(p)  # of prior * E_P[l(g, +)]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        away = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        if negative < 0:  # overfitted there: step back instead, as for the truncated risk
            return -away + decay * w
        return gain + away + decay * w

    return _descend(gradient, p.shape[1])


class Model:
    def __init__(self, mean, scale, weights, prior):
        self.mean, self.scale, self.weights, self.prior = mean, scale, weights, prior

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -6, 6)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_dot(self.matrix(x), self.weights))


UNIT = 1 << 24  # features and their squares are summed in whole units of 1 / UNIT: exact, in any order


def featured(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``keep`` and ``x``, the features of each row as doubles end to end."""
    slim = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"{c} {slim.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            for a, buf, off in slices(b.column(len(keep))):
                f = features(buf, off)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(a, len(f)) for k in range(len(keep))),
                                                  pa.array([r.tobytes() for r in f], pa.binary())], [*keep, "x"])

    return slim.mapInArrow(run, f"{kinds}, x binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, N_FEATURES)


def moments(x: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the features of all rows of ``x``."""
    def run(batches):
        n, one, two = 0, np.zeros(N_FEATURES, np.int64), np.zeros(N_FEATURES, np.int64)
        for b in batches:
            f = _matrix(b.column(0))
            n, one, two = n + len(f), one + np.rint(f * UNIT).astype(np.int64).sum(0), two + np.rint(f * f * UNIT).astype(np.int64).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(N_FEATURES), pa.int32()), pa.array([n] * N_FEATURES, pa.int64()),
                                          pa.array(one), pa.array(two)], ["k", "n", "one", "two"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = x.select("x").mapInArrow(run, "k int, n long, one long, two long").groupBy("k").agg(F.sum("n").alias("n"), wide("one"), wide("two"))
    mean, scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)
    for r in rows.collect():  # a row per feature
        if r.n:
            mean[r.k] = int(r.one) / UNIT / r.n
            scale[r.k] = max(0.0, int(r.two) / UNIT / r.n - mean[r.k] ** 2) ** 0.5 + 1e-3
    return mean, scale


def share_above(x: DataFrame, model: Model, w: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The share of all rows of ``x`` whose score by ``w`` is at or above each cut."""
    mean, scale = model.mean, model.scale

    def run(batches):
        total = np.zeros(len(cuts) + 1, np.int64)
        for b in batches:
            s = _dot(Model(mean, scale, None, None).matrix(_matrix(b.column(0))), w)
            total += [len(s), *((s >= c).sum() for c in cuts)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "n"])

    got = {r.k: r.n for r in x.select("x").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return np.array([got.get(k + 1, 0) for k in range(len(cuts))]) / max(1, got.get(0, 0))


def first_rows(rows: DataFrame, seed: int, sample: int) -> np.ndarray:
    """The features of the ``sample`` rows of the smallest hashes of the id."""
    rank = F.xxhash64("id", F.lit(seed))
    low = F.lit((1 << 63) - 1)
    n = rows.count()
    if n > 2 * sample:  # well over ``sample`` rows pass, so that the order need not look at the rest
        low = F.lit(int(-(1 << 63) + (1 << 64) * min(1.0, 1.5 * sample / n)) - 1)
    x = rows.withColumn("rank", rank)
    got = x.where(F.col("rank") <= low).orderBy("rank", "id", "x").limit(sample).select("x").collect()
    return np.array([np.frombuffer(r.x) for r in got]).reshape(-1, N_FEATURES)


def learn(x: DataFrame, labels: DataFrame, sample: int = 8_000, folds: int = 5) -> Model:
    """Fit on ``id, x`` rows of the training folds; ``labels`` has ``doc_id, quality``."""
    x = x.where(F.col("id").isNotNull() & ~held_out(F.col("id"), folds))
    good = (labels.select(F.col("doc_id").cast("long").alias("id"), "quality").groupBy("id")
                  .agg(F.min("quality").alias("q")).where((F.col("q") == 1) & ~held_out(F.col("id"), folds)).select("id"))
    positive = x.join(good, "id", "left_semi")
    p, u = first_rows(positive, 1, sample), first_rows(x, 2, sample)
    if not len(p) or not len(u):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.array([60.0] + [0.0] * N_FEATURES), 1.0)
    model = Model(*moments(x), None, None)
    a, b = model.matrix(p), model.matrix(u)
    w = tell_apart(a, b)
    cuts, of_positives = cut_scores(a, w)
    model.prior = prior_of(share_above(x, model, w, cuts), of_positives)
    model.weights = fit_nnpu(a, b, model.prior)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 8_000, folds: int = 5, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    """Fit on the training folds of ``docs``; the features go through the shared folder, texts are read once."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"))
    d = d.where(F.col("id").isNotNull() & ~held_out(F.col("id"), folds))
    return learn(stored(featured(d, ["id"], "_t"), "quality-features"), labels, sample, folds)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score``."""
    mean, scale, weights, prior = model.mean, model.scale, model.weights, model.prior
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index(text_col)

    def run(batches):
        model = Model(mean, scale, weights, prior)
        for b in batches:
            text = b.column(0).field(at).cast(pa.string())
            parts = [model.score(features(buf, off)) for _, buf, off in slices(text)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.zeros(0), *parts]))], ["row", "score"])

    return row.mapInArrow(run, row.withColumn("score", F.lit(0.0)).schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 8_000, folds: int = 5,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row.  Texts are read once; learning and scoring read their features."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_t"))
    x = stored(featured(d, ["id"], "_t"), "quality-features")
    model = learn(x, labels, sample, folds)
    parts = model.mean, model.scale, model.weights, model.prior

    def run(batches):
        model = Model(*parts)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], ["doc_id", "score"])

    return x.select("id", "x").mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    return scored(docs, model, text_col).where(F.col("score") >= threshold).select("row.*")
