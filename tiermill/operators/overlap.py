"""Overlap counts of hashed sequences, inside the rows that hold them.

The grams of a row meet only grams of the same row, so nothing of them has to be shuffled: a row brings its sequences as arrays of
64-bit token hashes, and Arrow batches are counted a few rows at a time by sorting gram keys.  A key is (row of the slice, 55 bits
of the gram's hash, side); a slice is at most 16 or 256 rows and, but for a single longer row, SLICE hashes, which bounds the room
whatever the batch.  What leaves a row is numbers, and single unigrams only where a caller joins them with a keyword table.

Keys that stand in several rows are counted over all these rows by a plain aggregation of grams (:func:`by_repeats` tells them apart).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiermill.operators.joins import bounded_broadcast

SLICE = 1 << 18
HASH_BITS = 55
SIDE_BITS = 5  # of a hypothesis and its references in a part; the rest of 64 bits number the rows of a slice
SIDES = 1 << SIDE_BITS
UNIGRAM = pa.list_(pa.struct([("g", pa.int64()), ("b", pa.int64()), ("c", pa.int64())]))
UNIGRAM_SQL = "array<struct<g:bigint,b:bigint,c:bigint>>"


def hashes(toks) -> Column:
    """Token array -> array of 64-bit hashes."""
    return F.transform(toks, lambda t: F.xxhash64(t))


def unigram_id(token: str) -> Column:
    """The id that a token has among the unigrams of :func:`count_grams`."""
    return F.shiftrightunsigned(F.xxhash64(token), 64 - HASH_BITS)


def _grams(v: np.ndarray, left: np.ndarray, max_n: int):
    """``n, places, hashes`` of the n-grams of sequences that stand one behind the other; ``left``: elements up to the end of each's own."""
    g = at = None
    for n in range(1, max_n + 1):
        if n == 1:
            at, g = np.arange(len(v)), v
        else:
            on = left[at] >= n
            at, g = at[on], g[on]
            with np.errstate(over="ignore"):
                g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + v[at + n - 1] + np.uint64(n)
                g = (g ^ (g >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                g ^= g >> np.uint64(31)
        yield n, at, g


def count_grams(v: np.ndarray, lens: np.ndarray, rows: np.ndarray, sides: np.ndarray, max_n: int, side_bits: int):
    """Runs of equal grams of sequences: for every n ``(n, row, side, id, count, hyp, best)``, a run per row, side and gram, sorted;
    ``hyp`` is the gram's count on side 0 and ``best`` the largest on another side of the row.  Sequence i holds the next ``lens[i]``
    hashes of ``v`` and is side ``sides[i]`` of row ``rows[i]``."""
    ends = np.repeat(np.cumsum(lens), lens)
    row_side = np.repeat((rows.astype(np.uint64) << np.uint64(HASH_BITS + side_bits)) | sides.astype(np.uint64), lens)
    for n, at, g in _grams(v, ends - np.arange(len(v)), max_n):
        k = np.sort(row_side[at] | ((g >> np.uint64(64 - HASH_BITS)) << np.uint64(side_bits)))
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        count = np.diff(np.append(start, len(k)))
        k = k[start]
        side = (k & np.uint64((1 << side_bits) - 1)).astype(np.int64)
        group = k >> np.uint64(side_bits)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(k) else np.zeros(0, int)
        width = np.diff(np.append(first, len(k)))
        hyp = np.repeat(np.where(side[first] == 0, count[first], 0), width)
        best = np.repeat(np.maximum.reduceat(np.where(side > 0, count, 0), first), width) if len(k) else count
        yield n, (group >> np.uint64(HASH_BITS)).astype(np.int64), side, (group & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64), count, hyp, best


def slices(sizes: np.ndarray, most: int, room: int = SLICE):
    """Ranges of rows: at most ``most`` of them, and ``room`` elements unless it is a single row."""
    a = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > a and (i - a == most or total + n > room):
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def unigram_lists(owner: np.ndarray, n_owners: int, g: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.Array:
    """Unigrams, sorted by owner, as a list per owner."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_owners))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (g, b, c)], ["g", "b", "c"]))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of an array column of hashes; null counts as empty."""
    lens = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lens


def row_stats(df: DataFrame, carry: Sequence[str], hyp: str, ref: str, max_n: int, unigrams: bool) -> DataFrame:
    """``carry, hl, rl, nref, m1.., t1.., mm1.., mt1.., uni`` of rows with two arrays of hashes: lengths, is there a reference, clipped
    matches, grams of the hypothesis, reference grams that the hypothesis has and all, and with ``unigrams`` the distinct reference
    unigrams as (id, clipped matches, count).  No shuffle."""
    carry = list(carry)
    span = range(1, max_n + 1)
    numbers = ["hl", "rl", "nref", *[f"{c}{n}" for c in ("m", "t", "mm", "mt") for n in span]]
    x = df.select(*carry, hyp, ref)

    def run(batches):
        for b in batches:
            (hv, hn), (rv, rn) = flat(b.column(len(carry))), flat(b.column(len(carry) + 1))
            ho, ro = np.concatenate([[0], np.cumsum(hn)]), np.concatenate([[0], np.cumsum(rn)])
            has = b.column(len(carry) + 1).is_valid().to_numpy(zero_copy_only=False)
            for a, z in slices(hn + rn, 256):
                k = z - a
                out = {"hl": hn[a:z], "rl": rn[a:z], "nref": has[a:z].astype(np.int64)}
                uni = pa.nulls(k, UNIGRAM)
                v = np.concatenate([hv[ho[a]:ho[z]], rv[ro[a]:ro[z]]])
                lens, rows, sides = np.concatenate([hn[a:z], rn[a:z]]), np.tile(np.arange(k), 2), np.repeat([0, 1], k)
                for n, row, side, g, c, ch, best in count_grams(v, lens, rows, sides, max_n, 1):
                    r = side == 1
                    total = lambda on, w: np.bincount(row[on], weights=w[on], minlength=k).astype(np.int64)  # noqa: B023, E731
                    out |= {f"m{n}": total(r, np.minimum(c, ch)), f"t{n}": total(~r, c), f"mm{n}": total(r & (ch > 0), c), f"mt{n}": total(r, c)}
                    if unigrams and n == 1:
                        uni = unigram_lists(row[r], k, g[r], np.minimum(c, ch)[r], c[r])
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(a, k) for i in range(len(carry))), *(pa.array(out[c]) for c in numbers), uni],
                                                 [*carry, *numbers, "uni"])

    schema = ", ".join([*(f"`{c}` {x.schema[c].dataType.simpleString()}" for c in carry), *(f"{c} bigint" for c in numbers), f"uni {UNIGRAM_SQL}"])
    return x.mapInArrow(run, schema)


def reference_stats(sides: DataFrame, key: str, max_n: int, unigrams: bool) -> DataFrame:
    """Counts of hypotheses and their references, given as rows (key, part, split, hyp, kwg, v: array of hashes), where a part of a key
    has one hypothesis row and about SIDES / 2 references (a null array is none).  A row per part with side 0 (``m1..``, clipped by the largest
    count of any reference of the part, ``t1..``; with ``split`` also ``best``, the clipped count of each gram) and one per reference (``len``,
    ``wn1..`` clipped matches, ``mm1..``, ``mt1..``, and with ``unigrams`` its unigrams ``uni``).  Each has its hypothesis' length, ``hl``,
    and ``kwg``.  Parts without a hypothesis give no row.  Texts are shuffled once, and sorted so that a part's rows stand together."""
    span = range(1, max_n + 1)
    own = ["hl", "len", *[f"{c}{n}" for c in ("m", "t", "wn", "mm", "mt") for n in span]]
    x = sides.select(key, "part", "split", "hyp", "kwg", "v").repartition(key, "part").sortWithinPartitions(key, "part", F.desc("hyp"))
    best_type = pa.list_(pa.struct([("n", pa.int64()), ("g", pa.int64()), ("b", pa.int64())]))
    names = [key, "part", "split", "kwg", "side", *own, "uni", "best"]

    def whole_parts(batches):
        """Tables that end where a part ends."""
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            ids = list(zip(t.column(0).to_pylist(), t.column(1).to_pylist()))
            cut = len(ids)
            while cut and ids[cut - 1] == ids[-1]:
                cut -= 1
            rest = t.slice(cut)
            if cut:
                yield t.slice(0, cut), ids[:cut]
        if rest is not None and rest.num_rows:
            yield rest, list(zip(rest.column(0).to_pylist(), rest.column(1).to_pylist()))

    def run(batches):
        for t, ids in whole_parts(batches):
            valid = t.column(5).is_valid()
            ids = [x for x, on in zip(ids, valid.to_pylist()) if on]
            t = t.filter(valid).combine_chunks()
            if not ids:
                continue
            starts = [i for i, x in enumerate(ids) if not i or x != ids[i - 1]]
            is_hyp = t.column(3).to_pylist()
            column = lambda c: pa.concat_arrays(t.column(c).chunks)  # noqa: B023, E731
            v, lens = flat(column(5))
            off = np.concatenate([[0], np.cumsum(lens)])
            ranges = [(a, z) for a, z in zip(starts, [*starts[1:], len(ids)]) if is_hyp[a]]
            if not ranges:
                continue
            for a, z in slices(np.array([off[z] - off[a] for a, z in ranges]), 1 << (64 - HASH_BITS - SIDE_BITS)):
                got = ranges[a:z]
                at = np.concatenate([np.arange(i, j) for i, j in got])  # rows of the table
                width = np.array([j - i for i, j in got])
                if width.max() > SIDES:
                    yield from one_by_one(t, got, v, lens, off, column)
                    continue
                yield counted(at, np.repeat(np.arange(len(got)), width), width, v, lens, off, column)

    def one_by_one(t, got, v, lens, off, column):
        for i, j in got:
            if j - i <= SIDES:
                yield counted(np.arange(i, j), np.zeros(j - i, int), np.array([j - i]), v, lens, off, column)
            else:  # a part that the hash of its references has filled beyond SIDES
                yield counted(np.arange(i, j), np.zeros(j - i, int), np.array([j - i]), v, lens, off, column, (j - i).bit_length())

    def counted(at, rows, width, v, lens, off, column, side_bits=SIDE_BITS):
        first = np.concatenate([[0], np.cumsum(width)[:-1]])
        side = np.arange(len(at)) - np.repeat(first, width)
        k = len(at)
        vv = np.concatenate([v[off[i]:off[i + 1]] for i in at]) if k else v[:0]
        ln = lens[at]
        out = {"hl": np.repeat(ln[first], width), "len": ln}
        uni, best_of = pa.nulls(k, UNIGRAM), []
        split = column(2).take(pa.array(at))
        is_split = np.repeat(np.array(split.take(pa.array(first)).to_pylist()), width)
        for n, row, s, g, c, ch, top in count_grams(vv, ln, rows, side, max_n, side_bits):
            owner = first[row] + s
            r = s > 0
            total = lambda on, w: np.bincount(owner[on], weights=w[on], minlength=k).astype(np.int64)  # noqa: B023, E731
            clipped = np.minimum(c, ch)
            out |= {f"m{n}": total(~r, np.minimum(c, top)), f"t{n}": total(~r, c), f"wn{n}": total(r, clipped),
                    f"mm{n}": total(r & (ch > 0), c), f"mt{n}": total(r, c)}
            if unigrams and n == 1:
                o = np.argsort(owner[r], kind="stable")
                uni = unigram_lists(owner[r][o], k, g[r][o], clipped[r][o], c[r][o])
            on = ~r & is_split[owner]
            if on.any():
                best_of.append((owner[on], np.full(on.sum(), n), g[on], np.minimum(c, top)[on]))
        best = pa.nulls(k, best_type)
        if best_of:
            owner, *fields = (np.concatenate(f) for f in zip(*best_of))
            o = np.argsort(owner, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=k))]).astype(np.int32)
            best = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(f[o].astype(np.int64)) for f in fields], ["n", "g", "b"]))
        take = pa.array(at)
        group = column(4).take(pa.array(at[np.repeat(first, width)]))
        return pa.RecordBatch.from_arrays([column(0).take(take), column(1).take(take), split, group, pa.array(side.astype(np.int32)),
                                           *(pa.array(out[c]) for c in own), uni, best], names)

    simple = lambda c: f"`{c}` {x.schema[c].dataType.simpleString()}"
    schema = ", ".join([simple(key), "part int", "split boolean", simple("kwg"), "side int", *(f"{c} bigint" for c in own), f"uni {UNIGRAM_SQL}",
                        "best array<struct<n:bigint,g:bigint,b:bigint>>"])
    return x.mapInArrow(run, schema)


def by_repeats(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """``df`` without the rows whose ``keys`` (nulls are equal) stand in several rows, and those rows, None if there are none."""
    keys = list(keys)
    names = [f"_again{i}" for i in range(len(keys))]
    again = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    again = bounded_broadcast(again)
    if again.isEmpty():
        return df, None
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")
