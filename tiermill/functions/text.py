"""String column functions (JVM-side regex / HOF expressions, no UDFs).

Python's ``str.strip``/``str.split`` treat every Unicode whitespace character
as space, while Spark's ``trim`` only strips U+0020.  All helpers below use one
explicit class, ``WS``, so that results equal the Python rules.  The same
pattern text runs in Java regex and in RE2 (the oracle), so the class is
written with ``\\x{..}`` escapes that both understand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts.
WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# Markers that separate the answer from the echoed prompt, with
# the piece that is kept (-1 = last piece, 2 = the piece after the first one).
ANSWER_MARKERS = [("<|im_start|>assistant", -1), ("@@ Response", 2), ("### Response:", 2)]
# End-of-turn tokens removed from generated text.
END_TOKENS = ["<|im_end|>", "<|endoftext|>"]
# Fixed value: the stdout that stands for "ground truth did not run".
GT_FAILED = "GT_FAILED_PLACEHOLDER"

# The fence and the fenced blocks.
FENCE = "```"
# First fenced block: optional tag of word characters, '+' or '-', lazy body.
FIRST_FENCE = r"(?s)```(?:[\p{L}\p{N}_+\-]+)?" + WS + r"*(.*?)```"
# Java-flavoured block used by the line-format post-processor (case-insensitive).
JAVA_FENCE = r"(?si)```(?:java)?" + WS + r"*(.*?)" + WS + r"*```"
# Fixed values, adapted to the regex dialect: Unicode whitespace and word characters.
CLASS_NAME = "class" + WS + r"+([\p{L}\p{N}_]+)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), rf"^{WS}+|{WS}+\z", "")


def blank(c) -> Column:
    """True when the value is null or only whitespace (``not s.strip()``)."""
    c = _c(c)
    return c.isNull() | c.rlike(rf"^{WS}*\z")


def tokens(c) -> Column:
    """``str.split()``: whitespace tokens with empties dropped."""
    return F.array_remove(F.split(_c(c), rf"{WS}+"), "")


def n_tokens(c) -> Column:
    return F.size(tokens(c))


def first_fence(c, pattern: str = FIRST_FENCE) -> Column:
    """Body of the first fenced block (stripped), else the stripped text."""
    c = _c(c)
    return (F.when(c.isNull(), F.lit(""))
             .when(c.rlike(pattern), py_strip(F.regexp_extract(c, pattern, 1)))
             .otherwise(py_strip(c)))


def java_fence(c) -> Column:
    """Fence extract applied only when a fence occurs (case-insensitive tag)."""
    c = _c(c)
    return F.when(c.contains(FENCE) & c.rlike(JAVA_FENCE),
                  F.regexp_extract(c, JAVA_FENCE, 1)).otherwise(c)


def strip_fences(c) -> Column:
    """Delete fence+letters, then bare fences, then strip."""
    c = F.regexp_replace(_c(c), "```[a-zA-Z]*", "")
    return py_strip(F.replace(c, F.lit(FENCE), F.lit("")))


def strip_tokens(c, toks=END_TOKENS) -> Column:
    """Literal (non-regex) removal of every token in ``toks``."""
    c = _c(c)
    for t in toks:
        c = F.replace(c, F.lit(t), F.lit(""))
    return c


def after_marker(c, markers=ANSWER_MARKERS) -> Column:
    """Answer part after the first marker present, in priority order."""
    c = _c(c)
    out = c
    for marker, piece in reversed(markers):
        out = F.when(c.contains(marker), F.split_part(c, F.lit(marker), F.lit(piece))).otherwise(out)
    return out


def clean_answer(c) -> Column:
    """Generated text -> candidate code: marker split, end tokens, fences."""
    return strip_fences(strip_tokens(after_marker(c)))


# Line comments (to the end of a line only) and block comments.
LINE_COMMENT, BLOCK_COMMENT = r"(?d)//.*", r"(?s)/\*.*?\*/"


def strip_comments(c) -> Column:
    """Line comments first, then block comments (both quirks kept)."""
    return F.regexp_replace(F.regexp_replace(_c(c), LINE_COMMENT, ""), BLOCK_COMMENT, "")


def one_line(c) -> Column:
    """Collapse all whitespace runs (newlines included) to one space, strip."""
    return py_strip(F.regexp_replace(_c(c), rf"{WS}+", " "))


def to_line_format(c) -> Column:
    """Generated Java -> one-line form: fence, comments, whitespace."""
    return one_line(strip_comments(java_fence(c)))


def class_name(c, default: str = "Main") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(_c(c), CLASS_NAME, 1), F.lit("")), F.lit(default))
