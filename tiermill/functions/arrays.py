"""Array column functions on token log-probs and label arrays.

All are higher-order functions evaluated in-row (codegen'd, no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Log-prob validity floor, "no valid log-prob" value, ignored
# label, loss sentinel.
LOGP_FLOOR = -65500.0
NO_SCORE = -999.0
IGNORE = -100
LOSS_FAILED = 999.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def masked_mean(arr, floor: float = LOGP_FLOOR, default: float = NO_SCORE) -> Column:
    """Mean of the elements above ``floor`` (``-inf`` is dropped too), else default."""
    v = F.filter(_c(arr), lambda x: x > F.lit(floor))
    return F.when(F.size(v) > 0, _sum(v) / F.size(v)).otherwise(F.lit(default))


def norm_loglik(logps, prompt_len) -> Column:
    """Length-normalised log-likelihood of the answer part.

    ``logps`` holds the log-prob of tokens 1..n-1 of a sequence of n tokens.
    If the prompt is not shorter than the sequence it is taken as n/2; the
    answer starts at max(0, p-1); an empty answer gives -inf."""
    a = _c(logps)
    n = F.size(a) + 1
    p = F.when(_c(prompt_len) >= n, F.floor(n / 2)).otherwise(_c(prompt_len))
    start = F.greatest(F.lit(0), p - 1).cast("int")
    tail = F.slice(a, start + 1, F.greatest(F.lit(0), F.size(a) - start).cast("int"))
    return F.when(F.size(tail) > 0, _sum(tail) / F.size(tail)).otherwise(F.lit(float("-inf")))


def tail_nll(logps, prompt_len, failed: float = LOSS_FAILED) -> Column:
    """Mean negative log-likelihood of the tokens after the prompt (the first
    min(p, n) labels are ignored); no answer token -> ``failed``."""
    a = _c(logps)
    start = F.greatest(F.lit(1), _c(prompt_len)).cast("int")
    tail = F.slice(a, start, F.greatest(F.lit(0), F.size(a) - start + 1).cast("int"))
    return F.when(F.size(tail) > 0, -(_sum(tail) / F.size(tail))).otherwise(F.lit(failed))


def masked_sum(logps, labels) -> Column:
    """Sum of per-position log-probs whose next label is not ignored
    (logps[i] predicts labels[i+1])."""
    a, lab = _c(logps), _c(labels)
    nxt = F.slice(lab, 2, F.greatest(F.lit(0), F.size(lab) - 1).cast("int"))
    pairs = F.arrays_zip(a.alias("lp"), nxt.alias("lb"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, z: acc + F.when(
        z["lb"].isNotNull() & z["lp"].isNotNull() & (z["lb"] != IGNORE), z["lp"].cast("double")).otherwise(F.lit(0.0)))


def prompt_mask(labels, prompt_len) -> Column:
    """First ``prompt_len`` labels -> -100."""
    return F.transform(_c(labels), lambda x, i: F.when(i < _c(prompt_len), F.lit(IGNORE)).otherwise(x))


def pad_to(a, length, value) -> Column:
    """Right-pad ``a`` with ``value`` up to ``length``."""
    a = _c(a)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(0), _c(length) - F.size(a)).cast("int")))


def neg_log_sigmoid(x) -> Column:
    """-log(sigmoid(x)), stable for large |x|."""
    x = _c(x)
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
