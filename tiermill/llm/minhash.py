"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. Each text's set of word shingles is hashed once; the range of the hash is cut into ``bands * rows`` bins and the
   smallest hash of each bin kept (one permutation).  An empty bin copies the bin that a fixed random walk, the same for
   all documents, reaches first among the filled ones (optimal densification).  ``rows`` bins make a band's bucket key.
2. Rows with equal sets are one class from here on; copies are never paired with one another.
3. In each bucket that holds several classes, one class is the centre and is compared with the others: a star, so a bucket
   of n classes makes n - 1 pairs.  Candidates are confirmed on the full shingle sets.
4. A star can miss a link between two outer classes.  Where a bucket's classes are not all of one component after the
   stars, its *outsiders* (classes outside the bucket's largest component) are compared with all its classes, in blocks
   of a bounded number of shingles: a block pair is one group of bounded size, intersections are one matrix product,
   and only links that join components leave it.  So every two classes that share a bucket are compared or known to be
   in one component, no pair of classes becomes a row, and a large group that is one component costs its star.

Centres are the classes that share most buckets with others (the text that the copies were made from), chosen by an
aggregation with partial maxima; no window or list over a bucket is built, so one bucket may hold a third of all rows.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text with fewer words than a shingle has its whole
sequence as its one shingle; a null text, or one without words, has no shingles, links with nothing and is a component
of its own; rows that repeat an id and its text share a class; a null id is never a component's name unless no other
id is there; an empty table gives an empty result.

With 28 bands of 5 rows a pair of similarity 0.85 is missed with a chance of 7e-8, one of 0.8 with 1.5e-5.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.bpe_lexicon import slices
from tiermill.llm.common import stored
from tiermill.llm.components import components
from tiermill.operators.joins import bounded_broadcast

BLOCK_SHINGLES = 200_000  # in a block of classes that are compared at once
SLICE = 2 << 20  # bytes of text hashed at once
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts ``buf[off[i]:off[i + 1]]``."""
    gap = np.ones(len(buf) + 1, bool)
    gap[:-1] = (buf == 32) | ((buf >= 9) & (buf <= 13))
    before = np.ones(len(buf) + 1, bool)
    before[1:] = gap[:-1]
    before[off] = True
    starts = np.flatnonzero(~gap & before)
    after = gap[1:].copy()
    inner = off[(off > 0) & (off <= len(buf))]
    after[inner - 1] = True
    ends = np.flatnonzero(~gap[:-1] & after) + 1
    return starts, ends


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[starts[i]:ends[i]]``, all from one running sum of byte codes times powers."""
    with np.errstate(over="ignore"):
        odd = 0x9E3779B97F4A7C15
        code = mix(np.arange(1, 257, dtype=np.uint64))
        power = np.full(len(buf) + 1, odd, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(code[buf] * power[:-1], out=total[1:])
        back = np.full(len(buf) + 1, pow(odd, -1, 1 << 64), np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        return mix((total[ends] - total[starts]) * back[starts])


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    starts, ends = word_spans(low, off)
    with np.errstate(over="ignore"):
        h = span_hashes(low, starts, ends)
        first = np.searchsorted(starts, off)
        whole = np.zeros(len(h), np.uint64)
        for k in range(size):
            part = np.zeros(len(h), np.uint64)
            part[:len(h) - k] = h[k:]
            whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + part)
        out = []
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            if z - a >= size:
                out.append(np.unique(whole[a:z - size + 1]))
            elif z > a:
                x = np.full(1, 0x5851F42D4C957F2D, np.uint64)
                for k in range(a, z):
                    x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k:k + 1])
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of ``bins`` values for each set, none of them empty."""
    n = np.array([len(s) for s in sets])
    out = np.full((len(sets), bins), EMPTY, np.uint64)
    if not n.sum():
        return out
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), n)
    at = (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)  # rises with h: sets are sorted
    first = np.ones(len(h), bool)
    first[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
    out[row[first], at[first]] = h[first]
    filled = out != EMPTY
    r, b = np.nonzero(~filled & (n > 0)[:, None])
    walk = 0
    while len(r):
        walk += 1
        with np.errstate(over="ignore"):
            source = (mix((b * 0x10001 + walk * 0x3C6EF372).astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % bins
        hit = filled[r, source]
        out[r[hit], b[hit]] = out[r[hit], source[hit]]
        r, b = r[~hit], b[~hit]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = signature.reshape(len(signature), bands, rows)
        key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), s.shape[:2]).copy()
        for k in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
    return key.view(np.int64)


def _node(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def sketched(docs: DataFrame, size: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tag, n, node, keys`` per row: ``tag`` tells rows of one id apart, ``node`` names the shingle set."""
    def run(batches):
        for b in batches:
            for a, buf, off in slices(b.column(2), SLICE):
                sets = shingle_sets(buf, off, size)
                keys = band_keys(signatures(sets, bands * rows), bands, rows)
                m = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, m), b.column(1).slice(a, m), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_node(s) for s in sets], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * bands, pa.int32()), pa.array(keys.ravel()))],
                    ["doc_id", "tag", "n", "node", "keys"])

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tag"),
                    F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(run, "doc_id long, tag long, n long, node binary, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``node, n, items`` of the classes ``wanted`` (node, rep): texts are read again only for these."""
    def run(batches):
        for b in batches:
            node = b.column(0).to_pylist()
            for a, buf, off in slices(b.column(1), SLICE):
                sets = shingle_sets(buf, off, size)
                own = [i for i, s in enumerate(sets) if _node(s) == node[a + i]]  # rows of one id may differ
                ends = np.cumsum([0] + [len(sets[i]) for i in own])
                flat = np.concatenate([np.zeros(0, np.uint64), *[sets[i] for i in own]]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node[a + i] for i in own], pa.binary()), pa.array([len(sets[i]) for i in own], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["node", "n", "items"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    w = bounded_broadcast(wanted)
    x = d.join(w, F.col("id").eqNullSafe(F.col("rep"))).select("node", "text")
    return x.mapInArrow(run, "node binary, n long, items array<long>").dropDuplicates(["node"])


def near_links(classes: DataFrame, docs: DataFrame, size: int, threshold: int, id_col: str = "doc_id",
               text_col: str = "text") -> tuple[DataFrame | None, DataFrame | None]:
    """``links`` (a, b) between classes that connect everything there is to connect, and the ``labels`` of linked nodes."""
    member = classes.select("node", F.explode("keys").alias("key"))
    # sides with a row per bucket are stored first: of two plain sides adaptive execution can split a hot bucket
    several = stored(member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    member = stored(member.join(several, "key").select("key", "node", "size"))
    if member.isEmpty():
        return None, None
    degree = member.groupBy("node").agg(F.sum("size").alias("degree"))
    wanted = degree.join(classes.select("node", "rep"), "node").select("node", "rep")
    sets = stored(_sets(docs, wanted, size, id_col, text_col))
    known = degree.join(sets.select("node", "n"), "node")
    member = stored(member.select("key", "node").join(known, "node"))
    centres = stored(member.groupBy("key").agg(F.max(F.struct("degree", "node", "n")).alias("c"))
                           .select("key", F.col("c.node").alias("b"), F.col("c.n").alias("bn")))
    pairs = (member.join(centres, "key").where("node <> b")
                   .where(100 * F.least("n", "bn") >= threshold * F.greatest("n", "bn"))
                   .select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct())
    sa = sets.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("items").alias("ai"))
    sb = sets.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("items").alias("bi"))
    found = (pairs.join(sa, "a").join(sb, "b").withColumn("both", F.size(F.array_intersect("ai", "bi")))
                  .where(100 * F.col("both") >= threshold * (F.col("an") + F.col("bn") - F.col("both"))).select("a", "b"))
    links = stored(found)
    labels = components(links)
    # a centre has been compared with its whole bucket; what is left open are the other classes' pairs
    left = member.join(centres.select("key", F.col("b").alias("node")), ["key", "node"], "left_anti")
    left = left.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    # a block's size counts small sets as 200 shingles, which bounds its classes too
    per = left.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum(F.greatest("n", F.lit(200))).alias("t"))
    open_ = (per.groupBy("key").agg(F.max(F.struct("c", "label", "t")).alias("main"), F.sum("t").alias("t"), F.count("*").alias("parts"))
                .where("parts > 1").select("key", F.col("main.label").alias("main"), F.expr(f"1 + t div {BLOCK_SHINGLES}").alias("ni"),
                                           F.expr(f"1 + (t - main.t) div {BLOCK_SHINGLES}").alias("nj")))
    left = stored(left.join(stored(open_), "key"))
    if left.isEmpty():
        return links, labels
    deal = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n))
    inner = left.select("key", deal(1, "ni").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nj") - 1)).alias("j"), "node", "label",
                        F.lit(False).alias("outer"))
    outer = left.where("label <> main").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ni") - 1)).alias("i"), deal(2, "nj").alias("j"),
                                               "node", "label", F.lit(True).alias("outer"))
    blocks = inner.unionByName(outer).join(sets.select("node", "items"), "node")
    more = blocks.groupBy("key", "i", "j").applyInArrow(_block_links(threshold), "a binary, b binary")
    links = stored(links.unionByName(more.distinct()))
    return links, components(links)


def _block_links(threshold: int):
    """Of one block's links between its outsiders and its members, those that join components."""
    def run(block: pa.Table) -> pa.Table:
        node, label = block.column("node").to_pylist(), block.column("label").to_pylist()
        items = block.column("items").combine_chunks()
        off = items.offsets.to_numpy() - items.offsets[0].as_py()
        n = np.diff(off)
        values, code = np.unique(items.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(np.arange(len(node)), n)
        is_outer = np.array(block.column("outer").to_pylist(), bool)
        outer, inner = np.flatnonzero(is_outer), np.flatnonzero(~is_outer)
        both = np.zeros((len(outer), len(inner)), np.float32)
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        for low in range(0, len(values), 4096):  # some columns at a time bound the matrix
            a, z = np.searchsorted(code, [low, low + 4096])
            part = np.zeros((len(node), 4096), np.float32)
            part[row[a:z], code[a:z] - low] = 1
            both += part[outer] @ part[inner].T
        link = 100 * both >= threshold * (n[outer][:, None] + n[inner][None, :] - both)
        root: dict[bytes, bytes] = {}

        def find(x):
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        out = []
        for k, o in enumerate(outer.tolist()):
            for m in inner[np.flatnonzero(link[k])].tolist():
                x, y = find(label[o]), find(label[m])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((min(node[o], node[m]), max(node[o], node[m])))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def near_groups(docs: DataFrame, size: int = 5, threshold: int = 80, bands: int = 28, rows: int = 5,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tag, n_shingles, component_id, kept`` per row; texts with 100 * |A and B| >= threshold * |A or B| are
    linked."""
    sketch = stored(sketched(docs, size, bands, rows, id_col, text_col))
    classes = stored(sketch.where("n > 0").groupBy("node")
                                .agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")))
    _, labels = near_links(classes, docs, size, threshold, id_col, text_col)
    named = classes.select("node", "rep")
    if labels is not None:
        x = named.join(labels, "node")
        least = x.groupBy("label").agg(F.min("rep").alias("least"))
        linked = x.join(least, "label").select("node", "least")
        named = named.join(linked, "node", "left").select("node", F.coalesce("least", "rep").alias("rep"))
    row = sketch.select("doc_id", "tag", "n", "node")
    x = row.join(named, "node", "left")
    own = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id"))
    return x.select("doc_id", "tag", F.col("n").alias("n_shingles"), own.alias("component_id"),
                    F.col("doc_id").eqNullSafe(own).alias("kept"))


def dedup_near(docs: DataFrame, size: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document with the smallest id.  Rows that
    repeat both id and text stay or go together."""
    gone = (near_groups(docs, size, threshold, id_col=id_col, text_col=text_col).where(~F.col("kept"))
            .select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct())
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    key = F.col(f"row.`{id_col}`").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(f"row.`{text_col}`")) == F.col("_tag"))
    return row.join(gone, key, "left_anti").select("row.*")
