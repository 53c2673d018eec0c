"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

1. All words of all texts are counted (per Arrow batch by a vectorised hash, then by Spark's aggregation).
2. The most frequent ``lexicon_size`` words are merged once on the driver and compiled into a minimal acyclic automaton
   with shared suffixes.  Its transitions carry the number of accepted words that sort before the branch; their sum
   along a path is the word's number, and a table maps numbers to ids.  The bound ``lexicon_size`` keeps the driver's part
   and the file independent of the data.
3. The automaton is one array file in the shared folder, memory-mapped by the workers (read whole where that folder
   isn't a file system that can be mapped).  All words of a batch walk it in step, one byte at a time.
4. The words that the automaton doesn't accept are merged exactly by the tokenizer's rule, the different ones of a
   slice together; a worker remembers a bounded number of them.  So ids never depend on which words are in the lexicon.

Defined cases: null and empty texts have no ids and decode to the empty text; the special token's string inside a
text is that token, as the library has it; repeated rows give equal rows; an empty table gives an empty result;
texts are taken whole, however long (a batch is worked through in slices of bounded bytes, a text never cut).
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiermill.llm.bpe_text import Bpe, arrow_bytes, gather, share, shared
from tiermill.llm.common import stored, worker_cache
from tiermill.session import shared_dir

MAX_WORD_BYTES = 32  # longer words are never compiled
SLICE_BYTES = 3 << 20
MEMO_WORDS = 500_000  # merged words that a worker remembers

_BPES: dict[str, Bpe] = {}


def load_bpe(path: str) -> Bpe:
    """Parsed once per driver process."""
    if path not in _BPES:
        _BPES[path] = Bpe(path)
    return _BPES[path]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, bytes, offsets`` of consecutive runs of texts with about ``size`` bytes or one text each."""
    buf, off = arrow_bytes(texts)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, buf[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


# ---------------------------------------------------------------------------------------------------------- counts

#: Masks of the first k bytes of a 64-bit value, and the odd numbers that mix such values.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)


def word_keys(buf: np.ndarray, begins: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words ``buf[begins[i]:begins[i] + size[i]]`` of up to 32 bytes as four 64-bit values each, and a hash of these."""
    raw = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", raw, strides=(1,))
    keys = np.zeros((4, len(begins)), np.uint64)
    keys[0] = eight[begins] & FIRST_BYTES[np.minimum(size, 8)]
    h = (keys[0] + size.astype(np.uint64)) * np.uint64(MIX[0])
    for k in (1, 2, 3):
        lane = np.flatnonzero(size > 8 * k)
        keys[k, lane] = eight[begins[lane] + 8 * k] & FIRST_BYTES[np.minimum(size[lane] - 8 * k, 8)]
        h[lane] = (h[lane] ^ (h[lane] >> np.uint64(29)) ^ keys[k, lane]) * np.uint64(MIX[k])
    h ^= h >> np.uint64(32)
    return keys, h * np.uint64(MIX[1])


def count_words(docs: DataFrame, bpe, text_col: str = "text") -> DataFrame:
    """``word, n``: how often each word of up to MAX_WORD_BYTES bytes stands in the texts (``bpe``: broadcast)."""
    def count(batches):
        vocabulary = shared(bpe)
        for batch in batches:
            for _, buf, off in slices(batch.column(0)):
                begins, special = vocabulary.words(buf, off)
                ok = (np.diff(begins) <= MAX_WORD_BYTES) & (special < 0)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                _, first, n = np.unique(word_keys(buf, begins[at], np.diff(begins)[at])[1], return_index=True, return_counts=True)
                first = at[first]
                raw = buf.tobytes()
                words = [raw[i:j] for i, j in zip(begins[first].tolist(), begins[first + 1].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    seen = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------------------------------------------- automaton

class Lexicon:
    """A minimal acyclic automaton over words with the ids of each word.

    ``table[state, class] = (next state, words before the branch)``; state 0 is the dead state, 1 the start.
    """

    def __init__(self, table, classes, accepts, offsets, ids):
        self.table, self.classes, self.accepts, self.offsets, self.ids = table, classes, accepts, offsets, ids

    @classmethod
    def compile(cls, words: list[bytes], merge) -> "Lexicon":
        """Incremental construction from sorted words: the branch that later words can't reach any more is replaced by an
        equal one built before, if there is one."""
        words = sorted(set(words))
        edges: list[dict[int, int]] = [{}]
        final = [False]
        known: dict[tuple, int] = {}
        path = [0]

        def freeze(depth):
            while len(path) - 1 > depth:
                child = path.pop()
                key = (final[child], tuple(edges[child].items()))
                same = known.setdefault(key, child)
                if same != child:
                    parent = edges[path[-1]]
                    parent[next(reversed(parent))] = same

        last = b""
        for w in words:
            shared = 0
            for x, y in zip(last, w):
                if x != y:
                    break
                shared += 1
            freeze(shared)
            for b in w[shared:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][b] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            last = w
        freeze(0)

        number: dict[int, int] = {}
        order: list[int] = []
        stack = [(0, False)]
        while stack:  # children before parents
            s, done = stack.pop()
            if done:
                order.append(s)
            elif s not in number:
                number[s] = len(number) + 1
                stack.append((s, True))
                stack.extend((t, False) for t in edges[s].values() if t not in number)
        used = sorted({b for s in order for b in edges[s]})
        classes = np.zeros(256, np.uint8)
        classes[used] = np.arange(1, len(used) + 1)
        table = np.zeros((len(number) + 1, len(used) + 1, 2), np.int32)
        accepts = np.zeros(len(number) + 1, bool)
        below: dict[int, int] = {}

        def reach(s):  # how many words end at or below a state
            todo = [s]
            while todo:
                x = todo[-1]
                open_ = [t for t in edges[x].values() if t not in below]
                if open_:
                    todo.extend(open_)
                else:
                    below[x] = final[x] + sum(below[t] for t in edges[x].values())
                    todo.pop()
            return below[s]

        for s in order:
            reach(s)
            accepts[number[s]] = final[s]
            skip = int(final[s])
            for b, t in sorted(edges[s].items()):
                table[number[s], classes[b]] = number[t], skip
                skip += reach(t)
        ids = [merge(w) for w in words]
        offsets = np.zeros(len(ids) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return cls(table, classes, accepts, offsets, np.array([i for x in ids for i in x], np.int32))

    def numbers(self, buf: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The number of each word ``buf[begins[i]:begins[i + 1]]``, -1 if it isn't accepted."""
        out = np.full(len(begins) - 1, -1, np.int64)
        if self.table.shape[0] < 2:
            return out
        width = self.table.shape[1]
        flat = self.table.reshape(-1, 2)
        at = begins[:-1].copy()
        end = begins[1:]
        lane = np.flatnonzero(end > at)
        at, end = at[lane], end[lane]
        state, total = np.ones(len(lane), np.int64), np.zeros(len(lane), np.int64)
        while len(lane):
            cell = flat[state * width + self.classes[buf[at]]]
            state = cell[:, 0].astype(np.int64)
            total += cell[:, 1]
            at += 1
            over = at == end
            hit = over & self.accepts[state]
            out[lane[hit]] = total[hit]
            go = np.flatnonzero(~over & (state > 0))
            lane, at, end, state, total = lane[go], at[go], end[go], state[go], total[go]
        return out

    # -- one file: a header of sizes, then the arrays, each aligned to 64 bytes

    def parts(self):
        return [self.table, self.classes, self.accepts.astype(np.uint8), self.offsets, self.ids]

    def dump(self, out) -> None:
        head = np.zeros((5, 4), np.int64)
        at = 192
        for k, x in enumerate(self.parts()):
            head[k, :1 + x.ndim] = at, *x.shape
            at += -(-x.nbytes // 64) * 64
        out.write(head.tobytes().ljust(192, b"\0"))
        for x in self.parts():
            out.write(np.ascontiguousarray(x).tobytes().ljust(-(-x.nbytes // 64) * 64, b"\0"))

    @classmethod
    def view(cls, raw: np.ndarray) -> "Lexicon":
        head = raw[:160].view(np.int64).reshape(5, 4)
        kinds = (np.int32, np.uint8, np.uint8, np.int64, np.int32)
        out = []
        for (at, *shape), kind in zip(head.tolist(), kinds):
            shape = shape[:3] if kind is np.int32 and not out else shape[:1]
            n = int(np.prod(shape)) * np.dtype(kind).itemsize
            out.append(raw[at:at + n].view(kind).reshape(shape))
        out[2] = out[2].astype(bool)
        return cls(*out)

    @classmethod
    def open(cls, uri: str) -> "Lexicon":
        """Map the file, or read it where it isn't on a mounted file system."""
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
        if isinstance(system, fs.LocalFileSystem):
            return cls.view(np.memmap(path, np.uint8, "r"))
        with system.open_input_stream(path) as f:
            return cls.view(np.frombuffer(f.read(), np.uint8))


def build_lexicon(docs: DataFrame, bpe_path: str, lexicon_size: int = 65_536, min_count: int = 2,
                  text_col: str = "text") -> str:
    """Count, compile and write the lexicon of ``docs``; returns its place in the shared folder."""
    from pyarrow import fs

    spark = docs.sparkSession
    bpe = load_bpe(bpe_path)
    counts = stored(count_words(docs, share(spark, bpe), text_col).where(F.col("n") >= min_count)
                    .withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "word-counts")
    # the lowest level of frequency from which on the words still fit; a sort would send every task's best words to the driver
    levels = sorted(((r.level, r.words) for r in counts.groupBy("level").agg(F.count("*").alias("words")).collect()), reverse=True)
    low, room = levels[0][0] if levels else 0, lexicon_size
    for level, words in levels:
        room -= words
        if room < 0:
            break
        low = level
    top = counts.where(F.col("level") >= low).select("word").limit(lexicon_size).collect()
    uri = shared_dir(spark, "bpe-lexicon")
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    system.create_dir(path, recursive=True)
    out = io.BytesIO()
    Lexicon.compile([bytes(r.word) for r in top], bpe.merge).dump(out)
    with system.open_output_stream(f"{path}/lexicon.bin") as f:
        f.write(out.getvalue())
    return f"{uri}/lexicon.bin"


# --------------------------------------------------------------------------------------------------------- encoding

class Grown:
    """A ragged array of rows that are only ever added, in a buffer that doubles."""

    def __init__(self, kind):
        self.values, self.offsets, self.rows = np.zeros(1024, kind), np.zeros(1024, np.int64), 0

    def add(self, values: np.ndarray, lens: np.ndarray) -> None:
        at, n = int(self.offsets[self.rows]), self.rows + len(lens)
        while at + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        while n >= len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.values[at:at + len(values)] = values
        self.offsets[self.rows + 1:n + 1] = at + np.cumsum(lens)
        self.rows = n

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        return self.values[:self.offsets[self.rows]], self.offsets[:self.rows + 1]


class WordMemo:
    """Numbers of the words seen so far, by an open hash table that all words of a slice probe at once.

    A word of up to 32 bytes is its length and four 64-bit values; a probe compares those, so it is exact whatever the hash.
    A word that finds no free place within PROBES gets a new number each time, which costs time and changes nothing.  Longer words,
    few for their bytes, go through a dictionary."""

    BITS, PROBES, WIDE = 20, 8, 32

    def __init__(self):
        self.number = np.full(1 << self.BITS, -1, np.int32)
        self.keys, self.sizes, self.words = np.zeros((4, 1024), np.uint64), np.zeros(1024, np.uint8), 0
        self.long: dict[bytes, int] = {}

    def _find(self, keys: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        out = np.full(len(slot), -1, np.int64)
        lane = np.arange(len(slot))
        for _ in range(self.PROBES):
            at = self.number[slot]
            n = np.maximum(at, 0)
            same = (at >= 0) & (self.keys[0, n] == keys[0, lane]) & (self.sizes[n] == size[lane])
            wide = np.flatnonzero(same & (size[lane] > 8))
            for k in (1, 2, 3):
                same[wide] &= self.keys[k, n[wide]] == keys[k, lane[wide]]
            out[lane[same]] = at[same]
            go = ~same & (at >= 0)
            lane, slot = lane[go], (slot[go] + 1) & ((1 << self.BITS) - 1)
            if not len(lane):
                break
        return out

    def _learn(self, keys: np.ndarray, size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Give new words, all different, their numbers and a place."""
        n = self.words + len(size)
        while n > len(self.sizes):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.keys[:, self.words:n], self.sizes[self.words:n] = keys, size
        made = mine = np.arange(self.words, n)
        self.words = n
        for _ in range(self.PROBES):
            if not len(slot):
                break
            free = np.flatnonzero(self.number[slot] < 0)
            self.number[slot[free]] = mine[free]  # of several that want a place the last has it
            go = self.number[slot] != mine
            mine, slot = mine[go], (slot[go] + 1) & ((1 << self.BITS) - 1)
        return made

    def number_all(self, buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, learn: bool = True) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word ``buf[begins[i]:ends[i]]``, and the words that are new, in the order of their numbers.  Without
        ``learn`` the new ones have numbers for this call only."""
        size = ends - begins
        out = np.empty(len(size), np.int64)
        short = np.flatnonzero(size <= self.WIDE)
        keys, h = word_keys(buf, begins[short], size[short])
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        found = self._find(keys, size[short], slot)
        new: list[bytes] = []
        first_new = self.words
        miss = np.flatnonzero(found < 0)
        if len(miss):
            order = miss[np.lexsort((*keys[:, miss], size[short[miss]]))]
            first = np.ones(len(order), bool)
            first[1:] = (size[short[order[1:]]] != size[short[order[:-1]]]) | (keys[:, order[1:]] != keys[:, order[:-1]]).any(0)
            one = order[first]
            if learn:
                self._learn(keys[:, one], size[short[one]], slot[one])
            found[order] = first_new + np.cumsum(first) - 1
            raw = buf.tobytes()
            new = [raw[i:j] for i, j in zip(begins[short[one]].tolist(), ends[short[one]].tolist())]
        out[short] = found
        if len(short) < len(size):
            here: dict[bytes, int] = self.long if learn else {}
            for i in np.flatnonzero(size > self.WIDE).tolist():
                w = buf[begins[i]:ends[i]].tobytes()
                at = self.long.get(w, here.get(w))
                if at is None:
                    at = here[w] = first_new + len(new)
                    new.append(w)
                    if learn:
                        self._learn(np.zeros((4, 1), np.uint64), np.zeros(1, np.uint8), np.zeros(0, np.int64))
                out[i] = at
        return out, new


class Encoder:
    """Ids of whole batches: lexicon first, exact merges for the rest."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon | None):
        self.bpe, self.lexicon = bpe, lexicon
        self._forget()

    def _forget(self):
        """Start with what is always known: the ids themselves (for special tokens), then the lexicon's words."""
        self.memo, self.ids = WordMemo(), Grown(np.int32)
        self.ids.add(np.arange(self.bpe.size, dtype=np.int32), np.ones(self.bpe.size, np.int64))
        if self.lexicon:
            self.ids.add(self.lexicon.ids, np.diff(self.lexicon.offsets))
        self.base = self.ids.rows

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids, offsets`` of the texts ``buf[off[i]:off[i + 1]]``."""
        begins, special = self.bpe.words(buf, off)
        number = self.lexicon.numbers(buf, begins) if self.lexicon else np.full(len(begins) - 1, -1, np.int64)
        rest = np.flatnonzero((number < 0) & (special < 0))
        number += self.bpe.size
        at = np.flatnonzero(special >= 0)
        number[at] = special[at]
        if len(rest):
            # a full memo keeps what it has, until that no longer covers most of what comes
            learn, rows = self.memo.words < MEMO_WORDS, self.ids.rows
            picked, new = self.memo.number_all(buf, begins[rest], begins[rest + 1], learn)
            made, upto = self.bpe.merge_many(new)
            self.ids.add(made, np.diff(upto))
            number[rest] = self.base + picked
        values, offsets = self.ids.flat()
        ids, lens = gather(values, offsets, number)
        if len(rest) and not learn:
            self.ids.rows = rows
            if len(new) > 0.2 * len(rest):
                self._forget()
        upto = np.zeros(len(begins), np.int64)
        np.cumsum(lens, out=upto[1:])
        return ids, upto[np.searchsorted(begins, off)]


def worker_encoder(bpe, lexicon_uri: str | None) -> Encoder:
    """One encoder per worker process, vocabulary and lexicon."""
    cache = worker_cache()
    key = ("encoder", lexicon_uri, bpe.value["size"])
    if key not in cache:
        for old in [k for k in cache if k[0] == "encoder"]:
            del cache[old]
        cache[key] = Encoder(shared(bpe), Lexicon.open(lexicon_uri) if lexicon_uri else None)
    return cache[key]


def decode(bpe: Bpe, ids: np.ndarray) -> bytes:
    """UTF-8 bytes of the decoded ids (bytes that form no character become U+FFFD, as in the library)."""
    values, offsets = bpe_bytes(bpe)
    out, _ = gather(values, offsets, ids)
    return out.tobytes().decode("utf-8", "replace").encode()


def bpe_bytes(bpe: Bpe) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids end to end, and their offsets."""
    if not hasattr(bpe, "flat"):
        offsets = np.zeros(bpe.size + 1, np.int64)
        np.cumsum([len(x) for x in bpe.bytes_of], out=offsets[1:])
        bpe.flat = np.frombuffer(b"".join(bpe.bytes_of), np.uint8), offsets
    return bpe.flat


def encode_texts(docs: DataFrame, bpe_path: str, lexicon_uri: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` per row of ``docs``."""
    bpe = share(docs.sparkSession, load_bpe(bpe_path))

    def run(batches):
        enc = worker_encoder(bpe, lexicon_uri)
        for b in batches:
            for a, buf, off in slices(b.column(1)):
                ids, upto = enc.encode(buf, off)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, len(off) - 1), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))],
                    ["doc_id", "ids"])

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, bpe_path: str, ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` per row of ``rows`` (doc_id, ids); null ids decode to the empty text."""
    bpe = share(rows.sparkSession, load_bpe(bpe_path))

    def run(batches):
        for b in batches:
            out = [decode(shared(bpe), np.array(x or [], np.int64)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, bpe_path: str, lexicon_size: int = 65_536, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode each whole text, decode its ids, digest both.

    Encoding and decoding share one pass, so that ids don't go through the JVM.
    """
    spark = docs.sparkSession
    uri = build_lexicon(docs, bpe_path, lexicon_size, text_col=text_col)
    bpe = share(spark, load_bpe(bpe_path))

    def run(batches):
        enc = worker_encoder(bpe, uri)
        values, offsets = bpe_bytes(shared(bpe))
        for b in batches:
            for a, buf, off in slices(b.column(1)):
                ids, upto = enc.encode(buf, off)
                text, lens = gather(values, offsets, ids)
                place = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(lens, out=place[1:])
                text, cut = text.tobytes(), place[upto].tolist()
                le, at = ids.astype("<u4").tobytes(), (upto * 4).tolist()
                x = [hashlib.sha256(le[i:j]).hexdigest() for i, j in zip(at, at[1:])]
                y = [hashlib.sha256(text[i:j].decode("utf-8", "replace").encode()).hexdigest() for i, j in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(x)), pa.array(np.diff(upto), pa.int64()),
                                                  pa.array(x), pa.array(y)],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
