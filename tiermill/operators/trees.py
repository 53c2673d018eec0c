"""Subtree inventory and membership ratios.

No grammar parser: a tree is given by nested open/close markers (HTML tags
of every kind or of chosen ones).  Every element that contains at least one
other marker is a subtree; the virtual root (all markers) is included.
Its shape is the space-joined marker sequence from its open to its close.

Plan: markers are extracted by ``regexp_extract_all`` and matched in-row with one
stack over Arrow batches (an expression would copy the stack with every marker);
a subtree is known by a digest of the digests inside it, so that neither
matching nor comparing cuts a shape out.  Only the subtrees are exploded.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.functions.text import strip_comments as _strip_comments
from tiermill.operators import overlap as OV

# The tag kinds that are always closed in the page fixture, which the SQL of tree_shapes and tree_match names.
HTML_TAGS = ["ul", "li", "a", "nav", "div", "article", "footer", "title", "head", "style", "script", "h1"]


def tag_pattern(tags: Sequence[str] | None) -> str:
    """Markers of the given kinds, or of every kind."""
    return r"<(/?[A-Za-z][A-Za-z0-9:-]*)[\s/>]" if tags is None else r"<(/?(?:" + "|".join(tags) + r"))[\s>]"


def inventory(marks: Sequence[str]) -> tuple[list[tuple[int, int, int, int]], int]:
    """``(open, close, depth, digest)`` of every subtree of a row's markers, in the order of the opens, and the digest of all.

    A close ends the latest open element of its own kind; what was opened in between is unclosed and gives none, and a close
    without an open is passed over, so neither changes the elements around it.  Digests are built bottom-up in the order of
    the closes: an element's is that of its kind, the digests of the elements right inside and the stray markers between.  So
    equal digests stand for equal marker sequences, and each marker is looked at once, whatever the row's length."""
    digest = lambda parts: blake2b(b"".join(parts), digest_size=8).digest()
    name = {m: b"." + m.encode() + b" " for m in set(marks)}  # a stray marker; an element is "(" and 8 bytes
    kinds, places, inside = [""], [-1], [[]]  # the open elements, the root first: kind, place, what is right inside
    open_of: dict[str, list[int]] = {}
    found = []
    for i, m in enumerate(marks):
        if m[0] != "/":
            open_of.setdefault(m, []).append(len(kinds))
            kinds.append(m)
            places.append(i)
            inside.append([])
            continue
        at = open_of.get(m[1:])
        if not at:
            inside[-1].append(name[m])
            continue
        at = at.pop()
        parts = inside[at]
        for k in range(at + 1, len(kinds)):  # unclosed ones: what is inside them moves up, once
            open_of[kinds[k]].pop()
            parts.append(name[kinds[k]])
            parts.extend(inside[k])
        own = digest([b"<", name[kinds[at]], *parts])
        if i > places[at] + 1:
            found.append((places[at], i, own))
        del kinds[at:], places[at:], inside[at:]
        inside[-1].append(b"(" + own)
    rest = [x for k in range(len(kinds)) for x in ([name[kinds[k]]] if k else []) + inside[k]]
    number = lambda d: int.from_bytes(d, "little", signed=True)
    out, around = [], []
    for a, z, d in sorted(found):
        while around and around[-1] < a:
            around.pop()
        around.append(z)
        out.append((a, z, len(around) + 1, number(d)))
    return out, number(digest(rest))


def _inventories(df: DataFrame, carry: Sequence[str], col: str, tags: Sequence[str] | None, strip_comments: bool,
                 markers: bool) -> DataFrame:
    """``carry, m`` (with ``markers``), ``el``: the subtrees of each row that has a marker, the root last as (-1, size - 1, 1)."""
    src = _strip_comments(F.col(col)) if strip_comments else F.col(col)
    found = F.regexp_extract_all(F.lower(src) if tags is None else src, F.lit(tag_pattern(tags)), 1)
    rows = df.select(*carry, found.alias("m")).where(F.size("m") > 0)
    kind = "array<struct<pos:int,close_pos:int,depth:int,h:bigint>>"
    kept = [*carry, "m"] if markers else list(carry)
    arrow = pa.list_(pa.struct([("pos", pa.int32()), ("close_pos", pa.int32()), ("depth", pa.int32()), ("h", pa.int64())]))

    def run(batches):
        for b in batches:
            out = []
            for m in b.column(b.num_columns - 1).to_pylist():
                el, root = inventory(m)
                out.append([*el, (-1, len(m) - 1, 1, root)])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(out, arrow)], [*kept, "el"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + f", el {kind}")


def tree_digests(df: DataFrame, carry: Sequence[str], col: str, tags: Sequence[str] | None = None,
                 strip_comments: bool = False) -> DataFrame:
    """``carry, pos, depth, size, h`` of every subtree: :func:`tree_shapes` with a 64-bit digest in place of the shape.  No
    shuffle and no window; the work is linear in the markers."""
    x = _inventories(df, carry, col, tags, strip_comments, markers=False).select(*carry, F.inline("el"))
    size = F.when(F.col("pos") < 0, F.col("close_pos") + 1).otherwise(F.col("close_pos") - F.col("pos") + 1)
    return x.select(*carry, F.col("pos").cast("bigint").alias("pos"), F.col("depth").cast("bigint").alias("depth"),
                    size.cast("bigint").alias("size"), "h")


def tree_shapes(df: DataFrame, key: str, col: str, tags: Sequence[str] | None = None,
                strip_comments: bool = False) -> DataFrame:
    """(key, pos, depth, size, shape): pos = index of the open marker (-1 for
    the root), depth 1 = root, size = markers in the subtree.  Markers are
    matched by :func:`inventory`: unclosed ones stay in the shapes around
    them, and count neither as subtree nor as a level.  ``tags`` None reads every
    kind, in lower case.
    ``strip_comments`` first removes line and block comments with the same
    rule whatever the language (line comments first).  The shapes of a row
    take as much room as its markers times their depth; where only equality
    counts, :func:`tree_digests` is enough."""
    x = _inventories(df, [key], col, tags, strip_comments, markers=True).select(key, "m", F.inline("el"))
    first = F.greatest(F.col("pos"), F.lit(0))
    size = F.col("close_pos") - first + 1
    return x.select(key, F.col("pos").cast("bigint").alias("pos"), F.col("depth").cast("bigint").alias("depth"),
                    size.cast("bigint").alias("size"), F.array_join(F.slice("m", first + 1, size), " ").alias("shape"))


def membership_ratio(ref: DataFrame, cand: DataFrame, keys: Sequence[str], items: Sequence[str]) -> DataFrame:
    """Per key: matched = reference items (with multiplicity) whose value
    occurs at least once on the candidate side; total = reference items;
    ratio = matched / total (null without reference items).

    One union and one groupBy instead of distinct + semi-join: the map-side
    partial aggregation collapses repeated items before the shuffle.
    """
    keys, items = list(keys), list(items)
    u = (ref.select(*keys, *items, F.lit(1).alias("_r"), F.lit(0).alias("_c"))
            .unionByName(cand.select(*keys, *items, F.lit(0).alias("_r"), F.lit(1).alias("_c"))))
    return membership_counts(u, keys, items)


def membership_counts(u: DataFrame, keys: Sequence[str], items: Sequence[str]) -> DataFrame:
    """:func:`membership_ratio` of rows that carry their side: ``_r`` = 1 on the
    reference side, ``_c`` = 1 on the candidate side."""
    per_item = u.groupBy(*keys, *items).agg(F.sum("_r").alias("nr"), F.max("_c").alias("hc"))
    out = per_item.groupBy(*keys).agg(
        F.sum(F.when(F.col("hc") > 0, F.col("nr")).otherwise(0)).cast("bigint").alias("matched"),
        F.sum("nr").cast("bigint").alias("total"))
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.col("matched") / F.col("total")))


def membership_in_rows(df: DataFrame, keys: Sequence[str], ref: F.Column, cand: F.Column) -> DataFrame:
    """:func:`membership_ratio` of items that stand in arrays of the same row, a null array being an empty one; a row without any
    item gives none.  Items are hashed to 64 bits and counted inside the row, so that none is shuffled; rows of keys that
    stand in several rows go through :func:`membership_ratio`."""
    keys = list(keys)
    x = df.select(*keys, OV.hashes(ref).alias("_ref"), OV.hashes(cand).alias("_cand"))
    once, again = OV.by_repeats(x, keys)
    st = OV.row_stats(once, keys, "_cand", "_ref", 1, unigrams=False).where("hl + rl > 0")
    out = st.select(*keys, F.col("mm1").alias("matched"), F.col("mt1").alias("total")).withColumn(
        "ratio", F.when(F.col("total") > 0, F.col("matched") / F.col("total")))
    if again is None:
        return out
    one = lambda c: again.select(*keys, F.explode(c).alias("_item"))
    return out.unionByName(membership_ratio(one("_ref"), one("_cand"), keys, ["_item"]))


def adjacent_pairs(tokens_col: str) -> F.Column:
    """array<struct<src, dst>> of adjacent tokens (the edge stand-in); a zip
    of the array with itself shifted by one, no lambda."""
    t = F.col(tokens_col)
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.slice(F.arrays_zip(t.alias("src"), F.slice(t, 2, n).alias("dst")), 1, n)
