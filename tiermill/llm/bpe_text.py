"""Byte-level BPE files: vocabulary, merge rule and the cut of texts into words, over whole Arrow batches.

:class:`Bpe` is built on the driver from a tokenizer file and shipped to the workers by broadcast; its size is that of
the file (a few MB), whatever the data.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

#: Classes of code points, as the word pattern of byte-level BPE tells them apart.
OTHER, LETTER, NUMBER, WHITE, SPACE, NONE, SPECIAL = range(7)
_NEVER = np.iinfo(np.int32).max
_PROBED = 0x33480  # beyond: unassigned, private use, tags and variation selectors, none of them letter, number or white


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: Latin-1's printable characters stand
    for themselves, the others take the code points from 256 on, in order."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {**{chr(b): b for b in keep}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def _class_table(cut) -> np.ndarray:
    """The class of each code point, asked of the library's own pre-tokenizer ``cut(text) -> [(piece, (from, to))]``."""
    cps = [c for c in range(_PROBED) if not 0xD800 <= c < 0xE000]

    def joined(mark):  # for each code point: does it stay in one piece with the mark before it?
        text = "".join(f"{mark}{chr(c)}\n" for c in cps)
        starts = {a for _, (a, _) in cut(text)}
        return [3 * i + 1 not in starts for i in range(len(cps))]

    table = np.full(0x110000, OTHER, np.uint8)
    for mark, kind in (("a", LETTER), ("1", NUMBER)):
        table[np.array(cps)[joined(mark)]] = kind
    other = np.zeros(0x110000, bool)
    other[np.array(cps)[joined("!")]] = True
    other[_PROBED:] = True
    table[(table == OTHER) & ~other] = WHITE
    table[0xD800:0xE000] = OTHER
    table[0x20] = SPACE
    return table


class Bpe:
    """Vocabulary and merges of a byte-level BPE tokenizer file, and its word pattern as classes of code points."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE tokenizer")
        back = byte_alphabet()
        ids = model["vocab"]
        self.size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for s, i in ids.items():
            self.bytes_of[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s
        self.byte_id = [0] * 256
        for s, b in back.items():
            self.byte_id[b] = ids[s]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}
        self._rank_of_bytes = np.full((256, 256), _NEVER, np.int32)
        for a in range(256):
            for b in range(256):
                if m := self.merges.get((self.byte_id[a], self.byte_id[b])):
                    self._rank_of_bytes[a, b] = m[0]
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self._made = np.array([new for _, new in self.merges.values()], np.int32)
        self.classes = _class_table(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: repeatedly the pair of lowest rank, leftmost first."""
        get, byte_id = self.merges.get, self.byte_id
        w = [byte_id[b] for b in word]
        if len(w) > 48:
            return self._merge_long(w)
        while len(w) > 1:
            best = None
            for i in range(len(w) - 1):
                m = get((w[i], w[i + 1]))
                if m is not None and (best is None or m < best):
                    best, at = m, i
            if best is None:
                break
            w[at:at + 2] = [best[1]]
        return w

    def _merge_long(self, w: list[int]) -> list[int]:
        """The same rule with a heap over a linked list, for very long words."""
        get, n = self.merges.get, len(w)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*m, i, w[i], w[i + 1]) for i in range(n - 1) if (m := get((w[i], w[i + 1])))]
        heap = [(r, i, a, b, new) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if w[i] != a or j >= n or w[j] != b:
                continue
            w[i], w[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get((new, w[k])):
                    heapq.heappush(heap, (m[0], i, new, w[k], m[1]))
            h = before[i]
            if h >= 0 and (m := get((w[h], new))):
                heapq.heappush(heap, (m[0], h, w[h], new, m[1]))
        return [x for x in w if x >= 0]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); _NEVER for those that don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._ranks[at], _NEVER)

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many words at once: ``ids, offsets``.  All words of a width take one merge per round."""
        n = len(words)
        length = np.array([len(w) for w in words], np.int64)
        flat, counts, order = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        low = 0
        for width in (4, 8, 12, 16, 24, 32):
            here = np.flatnonzero((length > low) & (length <= width))
            low = width
            if not len(here):
                continue
            raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in here.tolist()]), np.uint8).reshape(-1, width)
            col = np.arange(width)
            ids = np.where(col < length[here, None], np.array(self.byte_id, np.int32)[raw], -1)
            ids = np.concatenate([ids, np.full((len(here), 1), -1, ids.dtype)], axis=1).astype(np.int32)
            rank = np.full((len(here), width), _NEVER, np.int32)
            rank[:, :-1] = np.where(col[1:] < length[here, None], self._rank_of_bytes[raw[:, :-1], raw[:, 1:]], _NEVER)
            result = np.empty((len(here), width), np.int32)
            row = np.arange(len(here))
            while len(row):
                at = rank.argmin(1)
                every = np.arange(len(row))
                r = rank[every, at]
                live = r < _NEVER
                if not live.all():
                    result[row[~live]] = ids[~live, :-1]
                    row, ids, rank, at, r = row[live], ids[live], rank[live], at[live], r[live]
                    every = np.arange(len(row))
                    if not len(row):
                        break
                ids[every, at] = self._made[r]
                step = col + (col > at[:, None])  # close the gap after the merged pair
                ids[:, :-1] = np.take_along_axis(ids, step, 1)
                rank = np.take_along_axis(rank, np.minimum(col + (col > at[:, None]), width - 1), 1)
                rank[:, -1] = _NEVER
                rank[every, at] = self._rank(ids[every, at], ids[every, at + 1])
                left = np.flatnonzero(at > 0)
                rank[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
            order.append(here)
            counts.append((result >= 0).sum(1))
            flat.append(result[result >= 0])
        for i in np.flatnonzero((length > low) | (length == 0)).tolist():
            order.append(np.array([i]))
            flat.append(np.array(self.merge(words[i]), np.int32))
            counts.append(np.array([len(flat[-1])]))
        found = np.zeros(n + 1, np.int64)
        np.cumsum(np.concatenate(counts), out=found[1:])
        ids, lens = gather(np.concatenate(flat), found, np.argsort(np.concatenate(order)))
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(lens, out=offsets[1:])
        return ids, offsets

    def words(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cut texts into words: ``buf`` holds the UTF-8 bytes of all texts end to end, ``starts`` where each begins
        and, last, where the bytes end.  Returns the words' starts with the end as last entry (words cover all bytes,
        each inside one text), and the special id of each word or -1."""
        if not len(buf):
            return np.zeros(1, np.int64), np.zeros(0, np.int32)
        cuts = [starts]
        special = []
        raw = buf.tobytes() if any(s in memoryview(buf).tobytes() for s in self.special) else b""
        for s, i in self.special.items() if raw else ():
            at = raw.find(s)
            while at >= 0:
                d = np.searchsorted(starts, at, "right") - 1
                if at + len(s) <= starts[d + 1]:
                    special.append((at, len(s), i))
                    at = raw.find(s, at + len(s))
                else:
                    at = raw.find(s, at + 1)
        if special:
            cuts.append(np.array([x for a, n, _ in special for x in (a, a + n)], np.int64))
        section = np.zeros(len(buf) + 1, bool)
        section[np.concatenate(cuts)] = True
        pos = np.flatnonzero((buf & 0xC0) != 0x80)
        b0 = buf[pos]
        kind = self.classes[b0]
        wide = np.flatnonzero(b0 >= 0xC0)
        if len(wide):
            p = pos[wide]
            x = [np.pad(buf, (0, 3))[p + k].astype(np.int32) for k in range(4)]
            tail = [y & 0x3F for y in x]
            cp = np.where(x[0] < 0xE0, (x[0] & 0x1F) << 6 | tail[1],
                          np.where(x[0] < 0xF0, (x[0] & 0x0F) << 12 | tail[1] << 6 | tail[2],
                                   (x[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3]))
            kind[wide] = self.classes[np.minimum(cp, 0x10FFFF)]
        first = section[pos]
        for a, n, _ in special:
            i = np.searchsorted(pos, a)
            kind[i:np.searchsorted(pos, a + n)] = SPECIAL
        n = len(pos)
        prev = np.empty(n, np.uint8)
        prev[0] = NONE
        prev[1:] = kind[:-1]
        prev[first] = NONE
        nxt = np.empty(n, np.uint8)
        nxt[-1] = NONE
        nxt[:-1] = np.where(first[1:], NONE, kind[1:])
        white = (kind == WHITE) | (kind == SPACE)
        start = np.where(white, ((prev != WHITE) & (prev != SPACE)) | (nxt < WHITE), (prev != kind) & (prev != SPACE))
        start |= first
        # the apostrophe forms: 's 't 'm 'd 're 've 'll, where an apostrophe begins a word
        q = np.flatnonzero((b0 == 0x27) & start)
        if len(q):
            at = np.pad(b0, (0, 3))
            same = np.pad(first, (0, 3), constant_values=True)
            c1, c2 = at[q + 1], at[q + 2]
            one = np.isin(c1, np.frombuffer(b"stmd", np.uint8)) & ~same[q + 1]
            two = (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e")))
                   | ((c1 == ord("l")) & (c2 == ord("l")))) & ~same[q + 1] & ~same[q + 2]
            start[q[one | two] + 1] = False
            after = np.concatenate([q[one] + 2, q[two] + 3])
            start[after[after < n]] = True
        begins = pos[start]
        tokens = np.full(len(begins), -1, np.int32)
        for a, _, i in special:
            tokens[np.searchsorted(begins, a)] = i
        return np.append(begins, len(buf)), tokens


def share(spark, bpe: Bpe):
    """Broadcast a tokenizer as plain values, so that workers need not import this package to read it."""
    return spark.sparkContext.broadcast(dict(vars(bpe)))


def shared(sent) -> Bpe:
    bpe = Bpe.__new__(Bpe)
    bpe.__dict__ = sent.value
    return bpe


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the texts' offsets in them; null counts as empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_utf8())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def gather(values: np.ndarray, offsets: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the rows ``picked`` of a ragged array; also the length of each."""
    lens = np.diff(offsets)[picked]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(offsets[picked] - (ends - lens), lens)
    return values[shift + np.arange(total)], lens
