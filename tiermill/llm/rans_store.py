"""Token ids in binary files: static range ANS with shared frequency tables.

1. Every text is tokenized once; ids go to a table in the shared folder together with counts per id.
2. The counts of all documents, scaled to a power of two, are the one frequency table of the data set (its size is the
   vocabulary's).
3. Ids are cut into independent blocks of up to BLOCK ids of one document.  A block's ids are dealt to LANES
   interleaved coder states that share one stream of 32-bit words; after every CHECK rounds a checkpoint keeps the states
   and the place in the stream, so a reader decodes all checkpoint spans of all blocks side by side; each block has a CRC.
4. Encoded documents (no ids, no text) are dealt by ranges of doc_id and written in ascending doc_id order, one file per
   range, with an index at the end of the file.  A file's name is of one task attempt; the manifest, written when all
   are done, names those that count, so lost or repeated tasks leave no trace.

File format (little-endian): ``header`` magic, version, lanes, scale bits, CRC of the table; ``blocks`` n ids, n words,
n spans, CRC-32 of what follows, spans (word offset, states), words; ``index`` doc_id, place, n ids, CRC-32 of the ids,
n blocks, null flag for each document; ``tail`` place of the index, documents, ids, CRC-32 of the index.

Defined cases: null and empty texts have the end id alone; null ids come first and repeated ids stay side by side as
rows of their own; an empty table writes an empty manifest and gives an empty result; a damaged block raises.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiermill.llm.bpe_lexicon import load_bpe, slices, worker_encoder
from tiermill.llm.bpe_text import share
from tiermill.session import shared_dir

BITS = 18  # the table's scale: frequencies add up to 2**BITS
LANES = 4
BLOCK = 8192  # ids in a block at most
CHECK = 512  # rounds between checkpoints
CODED_BYTES = 8 << 20  # ids that are encoded side by side; the rounds of the longest blocks are shared by more of them
LOW = 1 << 31  # states are at least LOW and under LOW << 32
HEADER = "<8sHHII"
BLOCK_HEAD = "<IIII"
ENTRY = np.dtype([("doc_id", "<i8"), ("place", "<i8"), ("n", "<i8"), ("crc", "<u4"), ("blocks", "<u4"), ("null", "<u4"), ("pad", "<u4")])
TAIL = "<QQQI8s"
MAGIC = b"RANSIDS1"


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Integer frequencies that add up to 2**bits, at least 1 for every id that occurs."""
    total = 1 << bits
    seen = counts > 0
    if seen.sum() > total:
        raise ValueError("more different ids than the scale has room for")
    f = np.zeros(len(counts), np.int64)
    if seen.any():
        f[seen] = np.maximum(1, np.floor(counts[seen] * (total / counts.sum()))).astype(np.int64)
        gap = total - int(f.sum())
        for i in np.argsort(-f, kind="stable"):  # what is over or missing goes to the most frequent ids
            if not gap:
                break
            step = gap if gap > 0 else -min(-gap, int(f[i]) - 1)
            f[i] += step
            gap -= step
    return f


class Table:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def encode_blocks(t: Table, ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The bytes of each block ``ids[start[i]:start[i] + n[i]]``."""
    order = np.argsort(-n, kind="stable")
    s, m = start[order], n[order]
    rounds = -(-m // LANES)
    lane = np.arange(LANES)
    bits, limit = np.uint64(t.bits), np.uint64((LOW >> t.bits) << 32)
    half, low32 = np.uint64(32), np.uint64(0xFFFFFFFF)
    x = np.full((len(s), LANES), LOW, np.uint64)
    words, owner, when = [], [], []
    spans: dict[int, np.ndarray] = {}
    for r in range(int(rounds[0]) - 1 if len(s) else -1, -1, -1):
        k = int(np.searchsorted(-rounds, -r, "left"))  # blocks that have this round
        at = r * LANES + lane
        valid = at < m[:k, None]
        a = ids[np.where(valid, s[:k, None] + at, s[:k, None])]
        f, c, y = t.freq[a], t.cum[a], x[:k]
        full = valid & (y >= limit * f)
        row, _ = np.nonzero(full)
        words.append((y[full] & low32).astype(np.uint32))
        owner.append(row)
        when.append(r)
        y = np.where(full, y >> half, y)
        q = y // f
        x[:k] = np.where(valid, (q << bits) + (y - q * f) + c, y)
        if r % CHECK == 0:
            spans[r // CHECK] = x[:k].copy()
    out: list = [b""] * len(s)
    if not len(s):
        return out
    words.reverse(), owner.reverse(), when.reverse()
    own = np.concatenate(owner)
    span_of = np.repeat(np.array(when) // CHECK, [len(w) for w in words])
    by = np.argsort(own, kind="stable")
    stream = np.concatenate(words)[by]
    width = len(spans)
    per = np.bincount(own * width + span_of, minlength=len(s) * width).reshape(len(s), width)
    place = np.concatenate([np.zeros((len(s), 1), np.int64), np.cumsum(per, axis=1)], axis=1)
    first = np.concatenate([[0], np.cumsum(place[:, -1])])
    n_spans = -(-rounds // CHECK)
    for i in range(len(s)):
        body = [struct.pack("<I", place[i, j]) + spans[j][i].astype("<u8").tobytes() for j in range(int(n_spans[i]))]
        body.append(stream[first[i]:first[i + 1]].astype("<u4").tobytes())
        body = b"".join(body)
        out[order[i]] = struct.pack(BLOCK_HEAD, int(m[i]), int(place[i, -1]), int(n_spans[i]), zlib.crc32(body)) + body
    return out


def decode_blocks(t: Table, raw: bytes, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """``ids, offsets`` of the blocks at ``places``; all checkpoint spans are decoded side by side."""
    span = struct.Struct(f"<I{LANES}Q")
    state, pointer, size, target, chunks = [], [], [], [], []
    offsets = np.zeros(len(places) + 1, np.int64)
    n_words = 0
    for b, at in enumerate(places):
        n, w, k, crc = struct.unpack_from(BLOCK_HEAD, raw, at)
        body = at + struct.calcsize(BLOCK_HEAD)
        end = body + k * span.size + 4 * w
        if zlib.crc32(raw[body:end]) != crc:
            raise ValueError(f"block at {at}: checksum doesn't match")
        for j in range(k):
            word, *x = span.unpack_from(raw, body + j * span.size)
            state.append(x)
            pointer.append(n_words + word)
            size.append(min(CHECK * LANES, n - j * CHECK * LANES))
            target.append(offsets[b] + j * CHECK * LANES)
        chunks.append(raw[end - 4 * w:end])
        n_words += w
        offsets[b + 1] = offsets[b] + n
    ids = np.zeros(int(offsets[-1]), np.int32)
    if not state:
        return ids, offsets
    words = np.append(np.frombuffer(b"".join(chunks), "<u4"), np.uint32(0)).astype(np.uint64)
    order = np.argsort(-np.array(size), kind="stable")
    x = np.array(state, np.uint64)[order]
    p, m, o = np.array(pointer)[order], np.array(size)[order], np.array(target)[order]
    rounds = -(-m // LANES)
    lane = np.arange(LANES)
    bits, mask, half, low = np.uint64(t.bits), np.uint64((1 << t.bits) - 1), np.uint64(32), np.uint64(LOW)
    for r in range(int(rounds[0])):
        k = int(np.searchsorted(-rounds, -r, "left"))
        at = r * LANES + lane
        valid = at < m[:k, None]
        y = x[:k]
        slot = y & mask
        a = t.symbol[slot]
        ids[(o[:k, None] + at)[valid]] = a[valid]
        y = t.freq[a] * (y >> bits) + slot - t.cum[a]
        need = valid & (y < low)
        rank = np.cumsum(need, axis=1)
        x[:k] = np.where(need, (y << half) | words[np.where(need, p[:k, None] + rank - 1, 0)], y)
        p[:k] += rank[:, -1]
    return ids, offsets


# ------------------------------------------------------------------------------------------------------------ jobs

def _fs(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _tokenized(docs: DataFrame, bpe_path: str, end_id: int, id_col: str, text_col: str) -> str:
    """Write ``doc_id, ids`` and, in rows of their own, ``counts`` per id; returns the table's place."""
    spark = docs.sparkSession
    bpe = load_bpe(bpe_path)
    size, sent = max(bpe.size, end_id + 1), share(spark, bpe)
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def run(batches):
        enc = worker_encoder(sent, None)
        names = ["doc_id", "ids", "counts"]
        counts = np.zeros(size, np.int64)
        for b in batches:
            for a, buf, off in slices(b.column(1)):
                ids, upto = enc.encode(buf, off)
                n = len(off) - 1
                whole = np.insert(ids, upto[1:], end_id)
                counts += np.bincount(whole, minlength=size)
                raw = whole.astype(kind).tobytes()
                cut = ((upto + np.arange(n + 1)) * kind.itemsize).tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, n), pa.array([raw[i:j] for i, j in zip(cut, cut[1:])], pa.binary()),
                     pa.nulls(n, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                                          pa.array([counts.astype("<i8").tobytes()], pa.binary())], names)

    path = shared_dir(spark, "rans-ids")
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    (x.mapInArrow(run, "doc_id long, ids binary, counts binary")
      .write.option("compression", "zstd").parquet(path))
    return path


def _add_counts(batches):
    total = None
    for b in batches:
        for x in b.column(0).to_pylist():
            c = np.frombuffer(x, "<i8")
            total = c.copy() if total is None else total + c
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])


def write_ids(docs: DataFrame, bpe_path: str, end_id: int = 2, ids_per_file: int = 8_000_000, id_col: str = "doc_id",
              text_col: str = "text") -> str:
    """Tokenize ``docs``, append ``end_id`` to each document and write the files; returns their folder.

    ``ids_per_file`` sets the number of files; raise it with the data so that their number stays in the ten thousands (the
    bounds between files are one list on the driver)."""
    spark = docs.sparkSession
    size = max(load_bpe(bpe_path).size, end_id + 1)
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    tokens = spark.read.parquet(_tokenized(docs, bpe_path, end_id, id_col, text_col))
    counts = np.zeros(size, np.int64)
    sums = (tokens.where("counts IS NOT NULL").select("counts").mapInArrow(_add_counts, "id int, n long")
                  .groupBy("id").agg(F.sum("n").alias("n")))
    for r in sums.collect():  # a row per id of the vocabulary
        counts[r.id] = r.n
    freq = scaled(counts)
    folder = shared_dir(spark, "rans-files")
    system, path = _fs(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/table.bin") as f:
        f.write(freq.astype("<u4").tobytes())

    rows = tokens.where("ids IS NOT NULL").select("doc_id", "ids")
    n_files = max(1, -(-int(counts.sum()) // ids_per_file))
    quantiles = [i / n_files for i in range(1, n_files)]
    bounds = rows.select(F.percentile_approx("doc_id", quantiles or [0.5], max(10_000, 20 * n_files)).alias("q")).first().q or []
    bounds = np.array(sorted(set(bounds)) if quantiles else [], np.int64)
    sent = spark.sparkContext.broadcast(freq)

    def encode(batches):
        t = Table(sent.value)
        for b in batches:
            doc, col = b.column(0), b.column(1).to_pylist()
            a = 0
            while a < len(col):
                z, bytes_ = a, 0
                while z < len(col) and (z == a or bytes_ + len(col[z]) < CODED_BYTES):
                    bytes_ += len(col[z])
                    z += 1
                part = doc.slice(a, z - a)
                n = np.array([len(x) // kind.itemsize for x in col[a:z]], np.int64)
                ids = np.frombuffer(b"".join(col[a:z]), kind).astype(np.int32)
                first = np.concatenate([[0], np.cumsum(n)])
                blocks = -(-n // BLOCK)
                of = np.repeat(np.arange(z - a), blocks)
                nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                begin = first[of] + nth * BLOCK
                made = encode_blocks(t, ids, begin, np.minimum(BLOCK, first[of + 1] - begin))
                le = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(le[4 * i:4 * j]) for i, j in zip(first, first[1:])]
                upto = np.concatenate([[0], np.cumsum(blocks)])
                where = np.searchsorted(bounds, part.fill_null(-1 << 63).to_numpy(zero_copy_only=False), "left")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), part, pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array(blocks, pa.int32()),
                     pa.array([b"".join(made[i:j]) for i, j in zip(upto, upto[1:])], pa.binary())],
                    ["part", "doc_id", "n", "crc", "blocks", "body"])
                a = z

    def store(batches):
        system, path = _fs(folder)
        system.create_dir(path, recursive=True)
        table_crc = Table(sent.value).crc
        now, out = None, None
        for b in batches:
            for part, doc, n, crc, blocks, body in zip(*[c.to_pylist() for c in b.columns]):
                if part != now:
                    if out:
                        yield out.close()
                    now, out = part, _File(system, path, part, table_crc)
                out.add(doc, n, crc, blocks, body)
        if out:
            yield out.close()

    coded = rows.mapInArrow(encode, "part int, doc_id long, n long, crc long, blocks int, body binary")
    files = (coded.repartition(n_files, "part").sortWithinPartitions("part", "doc_id", "crc", "n")
                  .mapInArrow(store, "part int, file string, docs long, ids long, bytes long"))
    files.write.parquet(f"{folder}/manifest")
    return folder


class _File:
    """One file of ascending documents."""

    def __init__(self, system, path, part, table_crc):
        self.part, self.name = part, f"ids-{part:06d}-{uuid.uuid4().hex[:12]}.rans"
        self.out = system.open_output_stream(f"{path}/{self.name}")
        self.at = self.out.write(struct.pack(HEADER, MAGIC, 1, LANES, BITS, table_crc)) or struct.calcsize(HEADER)
        self.index, self.ids = [], 0

    def add(self, doc, n, crc, blocks, body):
        self.index.append((doc or 0, self.at, n, crc, blocks, doc is None, 0))
        self.out.write(body)
        self.at += len(body)
        self.ids += n

    def close(self):
        index = np.array(self.index, ENTRY).tobytes()
        self.out.write(index)
        self.out.write(struct.pack(TAIL, self.at, len(self.index), self.ids, zlib.crc32(index), MAGIC))
        self.out.close()
        return pa.RecordBatch.from_pylist([{"part": self.part, "file": self.name, "docs": len(self.index), "ids": self.ids,
                                            "bytes": self.at + len(index) + struct.calcsize(TAIL)}],
                                          schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()),
                                                            ("ids", pa.int64()), ("bytes", pa.int64())]))


def read_file(system, path: str, t: Table, ids_at_once: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``index entries, ids, offsets`` of consecutive documents of a file."""
    with system.open_input_file(path) as f:
        size = f.size()
        magic, _, lanes, bits, crc = struct.unpack(HEADER, f.read_at(struct.calcsize(HEADER), 0))
        place, docs, _, index_crc, end = struct.unpack(TAIL, f.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        if magic != MAGIC or end != MAGIC or lanes != LANES or bits != t.bits or crc != t.crc:
            raise ValueError(f"{path} isn't a file of this format and table")
        index = f.read_at(docs * ENTRY.itemsize, place)
        if zlib.crc32(index) != index_crc:
            raise ValueError(f"{path}: the index is damaged")
        index = np.frombuffer(index, ENTRY)
        upto = np.concatenate([[0], np.cumsum(index["n"])])
        a = 0
        while a < docs:
            z = max(a + 1, int(np.searchsorted(upto, upto[a] + ids_at_once, "right")) - 1)
            here = int(index["place"][a])
            raw = f.read_at((int(index["place"][z]) if z < docs else place) - here, here)
            places, at = [], 0
            while at < len(raw):
                places.append(at)
                _, w, k, _ = struct.unpack_from(BLOCK_HEAD, raw, at)
                at += struct.calcsize(BLOCK_HEAD) + k * (4 + 8 * LANES) + 4 * w
            ids, _ = decode_blocks(t, raw, places)
            yield index[a:z], ids, upto[a:z + 1] - upto[a]
            a = z


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of every document, decoded from the files of a folder."""
    files = spark.read.parquet(f"{folder}/manifest")
    # one row per file: the window's single task holds file names only
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("part", "file", F.coalesce(before, F.lit(0)).alias("base"), "ids")

    def run(batches):
        system, path = _fs(folder)
        with system.open_input_file(f"{path}/table.bin") as f:
            t = Table(np.frombuffer(f.read(), "<u4").astype(np.int64))
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for index, ids, off in read_file(system, f"{path}/{name}", t):
                    le = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(le[4 * i:4 * j]) for i, j in zip(off, off[1:])]
                    if crc != index["crc"].tolist():
                        raise ValueError(f"{name}: decoded ids don't match their checksums")
                    n = len(index)
                    cols = [pa.array(index["doc_id"], mask=index["null"].astype(bool)), pa.array(base + off[:-1]),
                            pa.array(index["n"].astype(np.int64)), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())))
                        names.append("ids")
                    base += int(off[-1])
                    yield pa.RecordBatch.from_arrays(cols, names)

    n = max(1, files.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return files.select("file", "base", "part").repartition(n, "part").mapInArrow(run, schema)
