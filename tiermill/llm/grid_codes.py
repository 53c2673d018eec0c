"""Product codes of vectors, trained exactly with memoised grid cells.

1. Components become integers once and the rows go to a table in the shared folder.  A vector is cut into equal parts; each
   part position has its own codebook, which starts as that part of the vectors with the smallest ids.
2. Space is cut into coarse cells of side ``cell``.  For the cell of a part the box's least and greatest distance to every
   entry is known without the part: an entry whose least distance exceeds the smallest greatest distance can't be nearest
   anywhere in the box.  The entries that are left are remembered under the cell (a worker keeps at most MEMO cells of
   a codebook; past that it starts anew, which costs time and changes nothing), and only they are evaluated exactly.
3. Each round sums the parts of every entry inside the tasks, then by Spark; what reaches the driver is one row per
   (part, entry, component), whatever the data.  New entries are exact integer floors, so that any order of rows and any
   number of lost tasks gives the same books.

Defined cases: rows with a null vector, or with null or non-finite components, are left out, as are vectors whose length
differs from ``dim`` (unset: the commonest length that can be cut, of equals the smaller).  Null ids are coded but never
start an entry (without any other id nothing is coded); rows that repeat an id are rows of their own, and ties among starters go by the vector.  With fewer rows than
entries the books are as short as the rows are few; an empty table gives an empty result.  Extra columns of the input stay
out of the result, whatever their names.  Components beyond +-2^27 raise (``vectors.grid``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import stored, worker_cache
from tiermill.llm.vectors import add_up, grid, matrix, squares
from tiermill.operators.joins import bounded_broadcast

MEMO = 200_000  # cells that a worker remembers for a codebook
SLICE = 4096


class Cells:
    """The entries of one codebook that can be nearest in a cell, remembered by cell."""

    def __init__(self, book: np.ndarray, cell: int):
        self.book, self.cell, self.known = book, cell, {}

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """For each distinct cell (a row of coordinates): which entries aren't dominated across its box."""
        low = cells * self.cell
        high = low + self.cell - 1
        near, far = (np.empty((len(cells), len(self.book)), np.int64) for _ in range(2))
        for k, e in enumerate(self.book):
            a, b = low - e, e - high
            gap = np.maximum(np.maximum(a, b), 0)
            reach = np.maximum(np.abs(a), np.abs(b))
            near[:, k], far[:, k] = np.einsum("ij,ij->i", gap, gap), np.einsum("ij,ij->i", reach, reach)
        return near <= far.min(1)[:, None]  # an equal bound may still be a tie that a lower index wins

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry (ties: lower index) of every part and its squared distance."""
        cells = np.ascontiguousarray(parts // self.cell)
        keys = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        names = [k.tobytes() for k in keys[first]]
        if len(self.known) + len(names) > MEMO:
            self.known.clear()
        new = [i for i, k in enumerate(names) if k not in self.known]
        if new:
            mask = self.candidates(cells[first[new]])
            self.known.update(zip([names[i] for i in new], mask))
        mask = np.array([self.known[k] for k in names])[back.ravel()]
        best, dist = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
        for k, e in enumerate(self.book):  # ascending, and only a smaller distance replaces: ties stay with the lower index
            rows = np.flatnonzero(mask[:, k])
            d = parts[rows] - e
            d = np.einsum("ij,ij->i", d, d)
            less = d < dist[rows]
            best[rows[less]], dist[rows[less]] = k, d[less]
        return best, dist


def _cells(books: np.ndarray, cell: int) -> list[Cells]:
    """This worker's memo of a round's codebooks; that of the round before goes."""
    name = hashlib.sha256(books.tobytes() + str(cell).encode()).hexdigest()
    cache = worker_cache()
    if cache.get("grid_codes", ("",))[0] != name:
        cache["grid_codes"] = name, [Cells(b, cell) for b in books]
    return cache["grid_codes"][1]


def start_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """``books[part, entry, component]`` from the ``entries`` smallest ids."""
    first = rows.where("vec_id IS NOT NULL").orderBy("vec_id", "vec").limit(entries).select("vec").collect()
    v = np.array([r.vec for r in first], np.int64)
    return np.ascontiguousarray(v.reshape(len(v), parts, -1).transpose(1, 0, 2)) if len(v) else np.zeros((parts, 0, 0), np.int64)


def _assign(rows: DataFrame, books: np.ndarray, cell: int, run_slice, columns: list[str], schema: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape

    def run(batches):
        memo = _cells(sent.value, cell)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                piece = b.slice(at, SLICE)
                v = matrix(piece.column(piece.schema.get_field_index("vec")), parts * width).reshape(-1, parts, width)
                found = [memo[p].nearest(np.ascontiguousarray(v[:, p])) for p in range(parts)]
                yield from run_slice(piece, v, found)

    return rows.select(*columns).mapInArrow(run, schema)


def train(rows: DataFrame, books: np.ndarray, rounds: int = 6, cell: int = 512) -> np.ndarray:
    """Codebooks after ``rounds`` of assignment and exact floor means."""
    parts, entries, width = books.shape

    def sums(piece, v, found):
        for p, (best, _) in enumerate(found):
            for k in np.unique(best).tolist():
                own = v[best == k, p]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([k], pa.int32()),
                                                  pa.array([len(own)], pa.int64()),
                                                  pa.array([own.sum(0).tolist()], pa.list_(pa.int64()))],
                                                 ["part", "entry", "n", "total"])

    for _ in range(rounds):
        got = add_up(_assign(rows, books, cell, sums, ["vec"], "part int, entry int, n long, total array<long>"),
                     ["part", "entry"], width)
        books = books.copy()
        for r in got:
            books[r.part, r.entry, r.i] = int(r.t) // r.n
    return books


def assign(rows: DataFrame, books: np.ndarray, cell: int = 512) -> DataFrame:
    """``vec_id, label, code, error`` of every row of ``vec_id, label, vec``."""
    def codes(piece, v, found):
        index = np.stack([best for best, _ in found], 1).astype(np.uint8)
        error = np.sum([d for _, d in found], axis=0)
        hexes = index.tobytes().hex()
        width = 2 * index.shape[1]
        yield pa.RecordBatch.from_arrays(
            [piece.column(0), piece.column(1), pa.array([hexes[i:i + width] for i in range(0, len(hexes), width)], pa.string()),
             pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return _assign(rows, books, cell, codes, ["vec_id", "label", "vec"], f"vec_id long, label {kind}, code string, error long")


def prepared(vectors: DataFrame, parts: int = 8, scale: int = 4096, dim: int | None = None, id_col: str = "vec_id",
             vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, vec``: the rows that count, with integer components, in the shared folder."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    x = grid(x.where((F.size("vec") > 0) & (F.size("vec") % parts == 0)), "vec", scale)
    x = stored(x if dim is None else x.where(F.size("vec") == dim), "grid-vectors")
    if dim is None:
        common = x.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
        x = x.where(F.size("vec") == (common.n if common else 0))
    return x


def digest(books: np.ndarray) -> str:
    """Digest of all entries' components by part, entry and place, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, cell: int = 512,
             dim: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
             ) -> tuple[DataFrame, np.ndarray]:
    """``(codes, books)``: ``vec_id, label, code, error`` of every vector that counts, and the trained codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a part's index is one byte: 1 to 256 entries")
    rows = prepared(vectors, parts, scale, dim, id_col, vec_col, label_col)
    books = start_books(rows, parts, entries)
    if not books.shape[1]:  # no row with an id: nothing to code by
        kind = rows.schema["label"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), books
    books = train(rows, books, rounds, cell)
    return assign(rows, books, cell), books


def label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors summed over equal labels (nulls are equal).  A hot label is summed inside
    the tasks first; the sums are a stored table of one row per label, broadcast only where its measured size allows."""
    sums = bounded_broadcast(codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
                                  .withColumnRenamed("label", "_label"))
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
