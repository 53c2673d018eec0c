"""Centroid clustering with heap-ordered bounds.

1. Components become integers once.  The rows of a task are cut into blocks of bounded size, one table row per block in
   the shared folder; blocks need no shuffle, so no key can make one large.
2. A block keeps a heap of its vectors for each cluster.  A vector enters with the gap between a lower bound on the distance
   to any other centroid and the upper bound on that to its own, plus the drift that the cluster has accumulated so far
   (the move of its own centroid and the largest move of another, summed over the rounds).  While that key is above the
   cluster's drift the centroid is surely still the only nearest one; so each round looks at the top of each heap, pops
   what has expired, compares only those vectors with all centroids (exactly, in integers) and pushes them anew.
3. A block hands on how the sums of its clusters change by vectors that moved; tasks and then Spark add these up, and the
   driver keeps one sum per cluster and component.  Centroids are exact integer floors.
4. Each round writes the blocks anew; a lost task is read again from the table of the round before.

Bounds are floats widened by more than their rounding; ties and all distances are decided on integers, so results don't
depend on them.

Defined cases: rows with a null vector, another number of components than ``dim``, or null or non-finite components are left
out.  Null ids are clustered but never start a centroid; rows that repeat an id are rows of their own, and those with an
equal hash start by the vector.  With fewer rows than centroids there are as many centroids as rows; an empty table gives an
empty result.  Extra columns of the input stay out of the result.  Components beyond +-2^27 raise (``vectors.grid``).
"""

from __future__ import annotations

import hashlib
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.common import stored
from tiermill.llm.vectors import add_up, grid, matrix, squares

BLOCK = 2048
WIDEN = 1e-9  # far above the rounding of the bounds
STATE = ("ids array<long>, vecs binary, heap_key array<double>, heap_pos array<int>, heap_end array<int>, "
         "moved_n array<long>, moved binary, popped long")


@dataclass
class Model:
    """Centroids, the drift of each cluster so far, and the running sums."""
    centroids: np.ndarray
    drift: np.ndarray
    sums: list[list[int]]
    counts: list[int]

    def update(self, changes) -> None:
        """Add the changes of a round and move every non-empty centroid to the floor of its mean."""
        counted = set()
        for r in changes:
            self.sums[r.cluster][r.i] += int(r.t)
            if r.cluster not in counted:
                counted.add(r.cluster)
                self.counts[r.cluster] += r.n
        new = np.array([[s // n for s in row] if n else old for row, n, old in
                        zip(self.sums, self.counts, self.centroids.tolist())], np.int64).reshape(self.centroids.shape)
        step = np.sqrt(((new - self.centroids) ** 2).sum(1).astype(float)) * (1 + WIDEN)
        others = np.array([max([*step[:k], *step[k + 1:]], default=0.0) for k in range(len(step))])
        self.drift = (self.drift + step + others) * (1 + 1e-15)
        self.centroids = new


class Heaps:
    """The heaps of one block: per cluster a heap of (key, place in the block)."""

    def __init__(self, keys: np.ndarray, places: np.ndarray, ends: np.ndarray):
        self.keys, self.places, self.ends = keys, places, ends
        self.open: dict[int, list] = {}

    @classmethod
    def empty(cls, k: int) -> "Heaps":
        return cls(np.zeros(0), np.zeros(0, np.int32), np.zeros(k + 1, np.int32))

    def _heap(self, c: int) -> list:
        if c not in self.open:
            a, z = self.ends[c], self.ends[c + 1]
            self.open[c] = list(zip(self.keys[a:z].tolist(), self.places[a:z].tolist()))
        return self.open[c]

    def expired(self, drift: np.ndarray) -> tuple[list[int], list[int]]:
        """Pop every vector whose key its cluster's drift has reached: ``places, clusters``.  A heap whose top is still
        above the drift isn't unpacked."""
        places, clusters = [], []
        for c in range(len(self.ends) - 1):
            if self.ends[c] == self.ends[c + 1] or self.keys[self.ends[c]] > drift[c]:
                continue
            heap, limit = self._heap(c), drift[c]
            while heap and heap[0][0] <= limit:
                places.append(heapq.heappop(heap)[1])
                clusters.append(c)
        return places, clusters

    def push(self, c: int, keys: np.ndarray, places: np.ndarray) -> None:
        heap, new = self._heap(c), list(zip(keys.tolist(), places.tolist()))
        if len(new) * 4 > len(heap):
            heap.extend(new)
            heapq.heapify(heap)
        else:
            for x in new:
                heapq.heappush(heap, x)

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and places, heap after heap, and where each ends."""
        keys, places, ends = [], [], [0]
        for c in range(len(self.ends) - 1):
            if c in self.open:
                keys.append(np.array([x[0] for x in self.open[c]], float))
                places.append(np.array([x[1] for x in self.open[c]], np.int32))
            else:
                keys.append(self.keys[self.ends[c]:self.ends[c + 1]])
                places.append(self.places[self.ends[c]:self.ends[c + 1]])
            ends.append(ends[-1] + len(keys[-1]))
        return np.concatenate(keys), np.concatenate(places), np.array(ends, np.int32)


def rescan(heaps: Heaps, vecs: np.ndarray, places: np.ndarray, old: np.ndarray, centroids: np.ndarray,
           drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compare ``places`` with all centroids, push them anew; how counts and sums of the clusters change."""
    k = len(centroids)
    n, total = np.zeros(k, np.int64), np.zeros((k, vecs.shape[1]), np.int64)
    if not len(places):
        return n, total
    v = vecs[places]
    d = squares(v, centroids)
    now = d.argmin(1)  # the first of equals: the smaller number
    row = np.arange(len(v))
    upper = np.sqrt(d[row, now].astype(float))
    if k > 1:
        d[row, now] = np.iinfo(np.int64).max
        lower = np.sqrt(d.min(1).astype(float))
    else:
        lower = np.full(len(v), math.inf)
    key = lower - upper + drift[now]
    key -= np.where(np.isinf(lower), 0, WIDEN * (lower + upper + drift[now]))
    for c in np.unique(now).tolist():
        mine = now == c
        heaps.push(c, key[mine], places[mine])
    moved = now != old
    for c in np.unique(np.concatenate([now[moved], old[moved]])).tolist():
        if c >= 0:
            come, go = v[moved & (now == c)], v[moved & (old == c)]
            n[c] += len(come) - len(go)
            total[c] += come.sum(0) - go.sum(0)
    return n, total


def _state(heaps: Heaps, ids, raw: bytes, n, total, popped: int) -> pa.RecordBatch:
    keys, places, ends = heaps.flat()
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([raw], pa.binary()), pa.array([keys], pa.list_(pa.float64())), pa.array([places], pa.list_(pa.int32())),
         pa.array([ends], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64())), pa.array([total.tobytes()], pa.binary()),
         pa.array([popped], pa.int64())],
        ["ids", "vecs", "heap_key", "heap_pos", "heap_end", "moved_n", "moved", "popped"])


def first_round(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Blocks of ``vec_id, vec``, all vectors compared with all centroids."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        cents = sent.value
        k, dim = cents.shape
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                piece = b.slice(at, BLOCK)
                vecs = matrix(piece.column(1), dim)
                heaps, every = Heaps.empty(k), np.arange(len(vecs), dtype=np.int32)
                n, total = rescan(heaps, vecs, every, np.full(len(vecs), -1), cents, np.zeros(k))
                ids = pa.array([piece.column(0).to_pylist()], pa.list_(pa.int64()))
                yield _state(heaps, ids, vecs.astype("<i4").tobytes(), n, total, len(vecs))

    return stored(rows.select("vec_id", "vec").mapInArrow(run, STATE), "heap-blocks")


def next_round(blocks: DataFrame, model: Model) -> DataFrame:
    """The blocks after popping and rescanning what the drift of the centroids has let expire."""
    sent = blocks.sparkSession.sparkContext.broadcast((model.centroids, model.drift))

    def run(batches):
        cents, drift = sent.value
        dim = cents.shape[1]
        for b in batches:
            for i in range(b.num_rows):
                raw, *heap = (b.column(j)[i] for j in range(1, 5))
                raw = raw.as_py()
                heaps = Heaps(*(x.values.to_numpy(zero_copy_only=False) for x in heap))
                vecs = np.frombuffer(raw, "<i4").astype(np.int64).reshape(-1, dim)
                places, old = heaps.expired(drift)
                n, total = rescan(heaps, vecs, np.array(places, np.int32), np.array(old, np.int64), cents, drift)
                yield _state(heaps, b.column(0).slice(i, 1), raw, n, total, len(places))

    return stored(blocks.mapInArrow(run, STATE), "heap-blocks")


def changes(blocks: DataFrame, dim: int) -> list:
    """How the clusters' counts and sums change, summed over all blocks: a row per cluster and component."""
    def run(batches):
        n = total = None
        for b in batches:
            for a, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, t = np.array(a, np.int64), np.frombuffer(raw, np.int64).reshape(-1, dim)
                n, total = (a, t.copy()) if n is None else (n + a, total + t)
        if n is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64()),
                                              pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return add_up(blocks.select("moved_n", "moved").mapInArrow(run, "cluster int, n long, total array<long>"), ["cluster"], dim)


def members(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector, by the heap it is in."""
    sent = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        cents = sent.value
        for b in batches:
            for i in range(b.num_rows):
                places = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                ends = b.column(3)[i].values.to_numpy(zero_copy_only=False)
                cluster = np.empty(len(places), np.int32)
                cluster[places] = np.repeat(np.arange(len(cents), dtype=np.int32), np.diff(ends))
                d = np.frombuffer(b.column(1)[i].as_py(), "<i4").astype(np.int64).reshape(len(places), -1) - cents[cluster]
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(cluster),
                                                  pa.array(np.einsum("ij,ij->i", d, d))], ["vec_id", "cluster", "distance"])

    return blocks.select("ids", "vecs", "heap_pos", "heap_end").mapInArrow(run, "vec_id long, cluster int, distance long")


def start_centroids(rows: DataFrame, k: int, seed: str = "1:") -> np.ndarray:
    """The vectors with the smallest sha256 of seed and id, in the order of the hash."""
    named = rows.where("vec_id IS NOT NULL").withColumn("_hash", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256))
    first = named.orderBy("_hash", "vec").limit(k).select("vec").collect()
    return np.array([r.vec for r in first], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, id_col: str = "vec_id",
            vec_col: str = "embedding") -> tuple[DataFrame, Model, list[int]]:
    """``(members, model, scanned)``: ``vec_id, cluster, distance`` of every vector that counts, the final centroids, and how
    many vectors each assignment compared with all centroids."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).where(F.size("vec") == dim)
    rows = grid(x, "vec", scale)
    centroids = start_centroids(rows, k)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), Model(np.zeros((0, dim), np.int64), np.zeros(0), [], []), []
    k = len(centroids)
    model = Model(centroids, np.zeros(k), [[0] * dim for _ in range(k)], [0] * k)
    blocks = first_round(rows, centroids)
    scanned = [blocks.agg(F.sum("popped")).first()[0]]
    for _ in range(rounds):
        model.update(changes(blocks, dim))
        blocks = next_round(blocks, model)
        scanned.append(blocks.agg(F.sum("popped")).first()[0])
    return stored(members(blocks, model.centroids), "heap-members"), model, scanned


def digests(model: Model) -> list[str]:
    """The digest of each centroid: its components as decimal numbers joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model.centroids.tolist()]


def with_inertia(found: DataFrame, model: Model) -> DataFrame:
    """``found`` with the inertia of each row's cluster and of all, and the digest of its centroid.  The sums are one row per
    cluster; they enter the plan as literals."""
    sums = {r.cluster: int(r.s) for r in
            found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = digests(model)
    if not names:
        return found.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"),
                            F.lit("").alias("centroid_sha256"))

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)

    return found.select("*", pick([sums.get(c, 0) for c in range(len(names))]).cast("long").alias("cluster_inertia"),
                        F.lit(sum(sums.values())).cast("long").alias("inertia"), pick(names).alias("centroid_sha256"))
