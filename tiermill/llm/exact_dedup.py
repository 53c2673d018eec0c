"""Exact deduplication with a cuckoo-filter index.

Texts are equal when they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``.  Only the
256-bit digest of the normalised text, its home bucket and the row's rank values leave the scan; no text is
shuffled to find groups.

A :class:`CuckooIndex` holds the live digests of one index bucket: 16-bit fingerprints in a cuckoo filter
answer "certainly new" without touching the stored keys; a filter hit is verified against the full keys stored
for its home slot; a failed placement doubles the filter and refills it from the stored keys.  Digests can be
inserted and deleted.  It runs twice: over each scan partition (so that a text held by a third of all rows leaves a
task as one row) and over each digest bucket after the shuffle.

Defined cases: a null text counts as empty and all empty texts are equal; a null doc_id ranks after every other
id; rows repeated with the same id are separate rows, of which exactly one may stay; an empty table gives an empty
result; extra columns are carried by :func:`dedup_exact` untouched, whatever their names.  Ids are integers (an id that can't be
cast to long raises).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiermill.llm.common import ASCII_SPACE, stored, whole
from tiermill.session import cut_lineage, shared_dir

SLOTS = 4
MAX_KICKS = 200
ROWS_PER_BUCKET = 50_000


class CuckooIndex:
    """Live digests with a payload: ``upsert``, ``delete``, ``get``, ``items``.

    ``merge(old, new)`` combines the payloads of equal digests.
    """

    def __init__(self, merge, n_buckets: int = 64):
        self.merge = merge
        self.n = n_buckets
        self.slots = [0] * (n_buckets * SLOTS)
        self.stored: dict[int, dict[bytes, object]] = {}
        self.size = 0
        self.resizes = 0

    def _fp(self, key: bytes) -> int:
        return int.from_bytes(key[:2], "little") or 1

    def _home(self, key: bytes) -> int:
        return int.from_bytes(key[2:8], "little") & (self.n - 1)

    def _other(self, i: int, fp: int) -> int:
        return (i ^ (fp * 0x5BD1E995 >> 3)) & (self.n - 1)

    def _seat(self, i: int, fp: int) -> bool:
        for s in range(i * SLOTS, i * SLOTS + SLOTS):
            if not self.slots[s]:
                self.slots[s] = fp
                return True
        return False

    def _maybe(self, key: bytes) -> bool:
        fp, i = self._fp(key), self._home(key)
        j = self._other(i, fp)
        return fp in self.slots[i * SLOTS:i * SLOTS + SLOTS] or fp in self.slots[j * SLOTS:j * SLOTS + SLOTS]

    def _place(self, key: bytes) -> bool:
        fp, i = self._fp(key), self._home(key)
        if self._seat(i, fp) or self._seat(self._other(i, fp), fp):
            return True
        for kick in range(MAX_KICKS):
            s = i * SLOTS + kick % SLOTS
            fp, self.slots[s] = self.slots[s], fp
            i = self._other(i, fp)
            if self._seat(i, fp):
                return True
        return False

    def _resize(self) -> None:
        """Double the filter until every stored key has a seat.

        More keys with one fingerprint and home than both buckets can seat never fit any size of filter that
        shares the bits, so the home takes more key bits with every doubling.
        """
        keys = [k for home in self.stored.values() for k in home]
        while True:
            self.n *= 2
            self.resizes += 1
            self.slots = [0] * (self.n * SLOTS)
            if all(self._place(k) for k in keys):
                break
        old, self.stored = self.stored, {}
        for home in old.values():
            for k, v in home.items():
                self.stored.setdefault(self._home(k), {})[k] = v

    def upsert(self, key: bytes, payload) -> None:
        if self._maybe(key):
            home = self.stored.get(self._home(key))
            if home is not None and key in home:
                home[key] = self.merge(home[key], payload)
                return
        self.stored.setdefault(self._home(key), {})[key] = payload
        self.size += 1
        if not self._place(key):
            self._resize()

    def get(self, key: bytes):
        if not self._maybe(key):
            return None
        return self.stored.get(self._home(key), {}).get(key)

    def delete(self, key: bytes) -> bool:
        """Forget a live digest; True if it was there."""
        if self.get(key) is None:
            return False
        del self.stored[self._home(key)][key]
        fp, i = self._fp(key), self._home(key)
        for b in (i, self._other(i, fp)):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.slots[s] == fp:
                    self.slots[s] = 0
                    self.size -= 1
                    return True
        raise AssertionError("a stored digest has no fingerprint")

    def items(self) -> Iterator[tuple[bytes, object]]:
        for home in self.stored.values():
            yield from home.items()


_SCHEMA = "bucket int, digest binary, n_chars long, id long, row long, copies long"


def _better(a, b):
    """Payloads are (n_chars, id, row, copies); more code points win, then the smaller id, null ids last, then the row."""
    first = a if (-a[0], a[1] is None, a[1] or 0, a[2]) <= (-b[0], b[1] is None, b[1] or 0, b[2]) else b
    return *first[:3], a[3] + b[3]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per live digest of this partition."""
    index: dict[int, CuckooIndex] = {}
    schema = None
    for b in batches:
        schema = b.schema
        cols = [b.column(i).to_pylist() for i in range(6)]
        for bucket, key, *payload in zip(*cols):
            one = index.get(bucket)
            if one is None:
                one = index[bucket] = CuckooIndex(_better)
            one.upsert(key, tuple(payload))
    if schema is None:
        return
    rows: list = []
    for bucket, one in index.items():
        rows.extend((bucket, k, *v) for k, v in one.items())
        if len(rows) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, n_chars, digest`` of each row (no text), in the shared folder; ``row`` is a number of its own."""
    text = whole(F.col(text_col))
    return cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("n_chars"), F.unhex(F.sha2(F.translate(text, ASCII_SPACE, ""), 256)).alias("digest")))


def live_digests(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """``digest, keep_chars, keep_id, keep_row, group_size`` of each different text among ``digested`` rows, in the shared
    folder: a join with it is one of two plain sides, so that adaptive execution can split a hot digest.

    ``buckets`` is the number of independent index buckets (a bucket is what one task must hold at least); unset, it
    follows the number of rows.
    """
    buckets = buckets or max(4096, rows.count() // ROWS_PER_BUCKET)
    b = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    slim = rows.select(b.alias("bucket"), "digest", "n_chars", F.col("doc_id").alias("id"), "row",
                       F.lit(1).cast("long").alias("copies"))
    local = slim.mapInArrow(_combine, _SCHEMA)
    out = local.repartition("bucket").mapInArrow(_combine, _SCHEMA)
    return stored(out.select("digest", F.col("n_chars").alias("keep_chars"), F.col("id").alias("keep_id"),
                             F.col("row").alias("keep_row"), F.col("copies").alias("group_size")), "live-digests")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = digested(docs, id_col, text_col)
    x = rows.join(live_digests(rows), "digest")
    return x.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"))


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one per group of equal texts.

    Rows meet the winners by digest, id and length, so that the rows of a hot digest are dealt out by their ids.  Of rows
    that repeat the winner's id and length the one with the smallest text stays."""
    names = docs.columns
    keep = live_digests(digested(docs, id_col, text_col)).select("digest", F.col("keep_chars").alias("n"), "keep_id")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    text = whole(F.col(f"row.`{text_col}`"))
    x = row.select("row", F.col(f"row.`{id_col}`").cast("long").alias("id"),
                   F.char_length(text).cast("long").alias("n"),
                   F.unhex(F.sha2(F.translate(text, ASCII_SPACE, ""), 256)).alias("digest"))
    x, k = x.alias("x"), keep.alias("k")
    same = (F.col("x.digest") == F.col("k.digest")) & (F.col("x.n") == F.col("k.n")) & F.col("id").eqNullSafe(F.col("keep_id"))
    w = Window.partitionBy(F.col("x.digest"), F.col("id")).orderBy(whole(F.col(f"row.`{text_col}`")))
    return x.join(k, same).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("row.*")


# ----------------------------------------------------------------------------------------------------------------
# the index as a table: batches of insertions and deletions

_INDEX = "bucket int, digest binary, n_chars long, id long, copies long"


def _copy_key(digest: bytes, n: int | None, i: int | None) -> bytes:
    """What tells the copies of a text apart, spread over all bits: copies of a hot text have different homes."""
    return hashlib.sha256(b"%s|%d|%s" % (digest, -1 if n is None else n, b"" if i is None else b"%d" % i)).digest()


def update_index(index: DataFrame | None, changes: DataFrame, buckets: int = 4096) -> DataFrame:
    """Apply ``changes`` (op '+' or '-', digest, n_chars, id) to an index table and return the new one: a row for each
    (digest, n_chars, id) that is live, with its number of copies.

    Deletions follow insertions within a batch: each '-' takes one copy of its digest, length and id away (a copy that
    isn't there stays away); what has no copy left leaves the filter.  Buckets go by digest and id, so a hot text is
    spread over them.  The new index is written to the shared folder (one file set per call).
    """
    spark = changes.sparkSession
    b = F.pmod(F.xxhash64("digest", "id"), F.lit(buckets)).cast("int")
    delta = changes.select(b.alias("bucket"), "op", "digest", "n_chars", "id", F.lit(1).cast("long").alias("copies"))
    if index is not None:
        delta = delta.unionByName(index.withColumn("op", F.lit("+")))

    def apply(batches):
        live: dict[int, CuckooIndex] = {}
        gone = []
        for x in batches:
            for bucket, op, digest, n, i, c in zip(*[x.column(k).to_pylist() for k in
                                                     ("bucket", "op", "digest", "n_chars", "id", "copies")]):
                if op == "+":
                    one = live.setdefault(bucket, CuckooIndex(lambda a, b: (*a[:3], a[3] + b[3])))
                    one.upsert(_copy_key(digest, n, i), (digest, n, i, c))
                else:
                    gone.append((bucket, _copy_key(digest, n, i)))
        for bucket, key in gone:
            one = live.get(bucket)
            had = one.get(key) if one else None
            if had is None:
                continue
            one.delete(key)
            if had[3] > 1:
                one.upsert(key, (*had[:3], had[3] - 1))
        rows = [(bk, *v) for bk, one in live.items() for _, v in one.items()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
                names=["bucket", "digest", "n_chars", "id", "copies"])

    path = shared_dir(spark, "cuckoo-index")
    delta.repartition("bucket").mapInArrow(apply, _INDEX).write.parquet(path)
    return spark.read.parquet(path)


def keepers(index: DataFrame) -> DataFrame:
    """``digest, keep_chars, keep_id, group_size`` of every live text of an index table: the longest original, then the
    smallest id (nulls last).  After deletions it is the best of the copies that are left."""
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("none"), "id")).alias("b")
    x = index.groupBy("digest").agg(best, F.sum("copies").alias("group_size"))
    return x.select("digest", (-F.col("b.n")).alias("keep_chars"), F.col("b.id").alias("keep_id"), "group_size")
