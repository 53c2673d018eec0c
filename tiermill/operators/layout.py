"""Token-stream layout (F10): rebuild indented text from one line whose
tokens carry NEW_LINE / INDENT / DEDENT markers.

Semantics (sequential): apostrophes are dropped, the line is stripped and
split on whitespace; the level starts at 0 and never goes below 0; NEW_LINE
emits a line break plus four spaces per level; INDENT raises the level and
emits four spaces; DEDENT (at level > 0) lowers it and takes back four of
the spaces just emitted, if the output ends with them; a word is preceded
by one space unless the output is empty or ends with a line break or with
four spaces.

Closed form used here: a run is the markers between two words, and the level
before any token is S - min(0, lowest S so far), S the sum of INDENT(+1) /
DEDENT(-1) up to it.  A run contributes
  * 4 * e0 spaces, e0 = floored sum of the markers before its first NEW_LINE
    (the spaces INDENT left after the previous word),
  * per NEW_LINE: "\\n" + 4 * (level before the next NEW_LINE or word) spaces,
  * then the separator of the next word: " " when the run has no NEW_LINE
    and e0 = 0 (not for the first word), or when it has one and both the
    level at the last NEW_LINE and the level at the word are 0.
So a row can be cut behind any word: all that a part needs from the parts
before is the level and whether there was a word.  A row becomes blocks that
end with a word; what a block does to the level is a pair of numbers (sum, lowest
running sum), the pairs are composed in the row that the blocks leave, and blocks
are written out side by side.  A huge row is spread over many tasks until its text
is put together.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiermill.functions.text import py_strip, tokens
from tiermill.operators.overlap import by_repeats
from tiermill.operators.scans import plain_keys

# The structural tokens and one indent unit.
NEW_LINE, INDENT, DEDENT = "NEW_LINE", "INDENT", "DEDENT"
UNIT = "    "


BLOCK = 16_384  # tokens


def write_out(toks: list[str], level: int, first: bool) -> str:
    """The text of a block that begins at ``level``; ``first``: no word came before it."""
    out, e0, lines, at_last = [], 0, [], 0
    for t in toks:
        if t == NEW_LINE:
            lines.append(level)
            at_last = level
        elif t == INDENT or t == DEDENT:
            level = level + 1 if t == INDENT else max(0, level - 1)
            if lines:
                lines[-1] = level
            else:
                e0 = e0 + 1 if t == INDENT else max(0, e0 - 1)
        else:
            if lines:
                out.append(UNIT * e0 + "".join(["\n" + UNIT * n for n in lines]) + (" " + t if level == at_last == 0 else t))
                lines = []
            elif e0:
                out.append(UNIT * e0 + t)
            else:
                out.append(t if first else " " + t)
            first, e0 = False, 0
    return "".join([*out, UNIT * e0, *("\n" + UNIT * n for n in lines)])


def _blocks(t: F.Column, size: int) -> F.Column:
    """Token array -> array of blocks that end with a word: cut behind the first word of each ``size`` tokens."""
    n = F.size(t)
    word = lambda x: ~x.isin(NEW_LINE, INDENT, DEDENT)
    starts = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / F.lit(size)).cast("int"))
    place = lambda b: F.array_position(F.transform(F.slice(t, b * size + 1, F.lit(size)), word), True).cast("int")
    cuts = F.filter(F.transform(starts, lambda b: F.when((b > 0) & (place(b) > 0), b * size + place(b))), lambda c: c.isNotNull() & (c < n))
    ends = F.concat(cuts, F.array(n))
    begins = F.concat(F.array(F.lit(0)), cuts)
    return F.transform(F.arrays_zip(begins.alias("a"), ends.alias("z")),
                       lambda p, i: F.struct(i.alias("blk"), F.slice(t, p["a"] + 1, p["z"] - p["a"]).alias("part")))


def layout_lines(df: DataFrame, key: str, col: str, out: str = "code", size: int = BLOCK) -> DataFrame:
    """``key, out``: the text of every row; rows have different keys."""
    toks = tokens(py_strip(F.replace(F.col(col), F.lit("'"), F.lit(""))))
    rows = df.select(key, F.coalesce(toks, F.array().cast("array<string>")).alias("t"))
    once, again = by_repeats(rows, [key])
    parts = _written(_in_rows(once, key, size), key)
    if again is not None:
        parts = parts.unionByName(_written(_by_window(again, key, size), key))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", "text"))), lambda p: p["text"]), "")
    return parts.groupBy(key).agg(joined.alias(out))


def _move(part) -> F.Column:
    """What a block does: sum and lowest running sum of the level, and is there a word."""
    step = lambda s, t: F.struct((s["s"] + F.when(t == INDENT, 1).when(t == DEDENT, -1).otherwise(0)).alias("s"),
                                 F.least(s["low"], s["s"] + F.when(t == DEDENT, -1).otherwise(0)).alias("low"),
                                 (s["w"] | ~t.isin(NEW_LINE, INDENT, DEDENT)).alias("w"))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("low"), F.lit(False).alias("w"))
    return F.aggregate(part, start, step)


def _in_rows(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``key, blk, part, level, first``: what comes before a block is summed up in the row that the blocks leave, a move per
    block but the last, so that it needs neither a second pass over the tokens nor a join."""
    x = rows.select(key, _blocks(F.col("t"), size).alias("_b"))
    x = x.select(key, "_b", F.transform(F.slice("_b", F.lit(1), F.size("_b") - 1), lambda p: _move(p["part"])).alias("_m"))
    add = lambda a, m: F.struct((a["s"] + m["s"]).alias("s"), F.least(a["low"], a["s"] + m["low"]).alias("low"), (a["w"] | m["w"]).alias("w"))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("low"), F.lit(False).alias("w"))
    before = F.transform("_b", lambda p, i: F.struct(p["blk"].alias("blk"), p["part"].alias("part"), F.aggregate(F.slice("_m", F.lit(1), i), start, add).alias("m")))
    x = x.select(key, F.explode(before).alias("b")).select(key, "b.blk", "b.part", (F.col("b.m.s") - F.col("b.m.low")).cast("int").alias("level"),
                                                           (~F.col("b.m.w")).alias("first"))
    x, names = plain_keys(x, [key])
    return x.repartition(*names, "blk").select(key, "blk", "part", "level", "first")


def _by_window(rows: DataFrame, key: str, size: int) -> DataFrame:
    """:func:`_in_rows` of keys that stand in several rows, whose blocks follow each other by number: moves as a table, composed by
    a window."""
    x = rows.select(key, F.explode(_blocks(F.col("t"), size)).alias("b")).select(key, "b.blk", "b.part")
    x, names = plain_keys(x, [key])
    x = x.repartition(*names, "blk")
    moves = x.select(*names, "blk", _move("part").alias("m"))
    before = Window.partitionBy(*names).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    moves = moves.select(*names, "blk", "m.low", "m.w", F.coalesce(F.sum("m.s").over(before), F.lit(0)).alias("s"))
    low = F.least(F.lit(0), F.min(F.col("s") + F.col("low")).over(before))
    moves = moves.select(*names, "blk", (F.col("s") - low).cast("int").alias("level"),
                         (~F.coalesce(F.max("w").over(before), F.lit(False))).alias("first"))
    return x.join(moves, [*names, "blk"]).select(key, "blk", "part", "level", "first")


def _written(x: DataFrame, key: str) -> DataFrame:
    """``key, blk, text``."""
    def run(batches):
        for b in batches:
            text = [write_out(*r) for r in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], [key, "blk", "text"])

    return x.mapInArrow(run, f"`{key}` {x.schema[key].dataType.simpleString()}, blk int, text string")
