"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic machines, run over whole Arrow batches in step:

* The *cutter* reads code point classes and marks word starts.  It has eleven states; a mark may concern the code
  point just read or the one before.  Texts are cut into chunks of CHUNK code points, the map "state before -> state after"
  of every chunk is computed for all eleven states at once, and the maps are composed by a parallel prefix scan, which gives
  each chunk its first state; then all chunks emit their marks side by side.  So a very long text costs the cutter no more
  steps than a short one.
* The *counter* reads the bytes of a word.  Each transition carries by how much the number of tokens of the word read so
  far changes.  A state stands for all prefixes that no continuation can tell apart: the longest suffix that a token could
  still extend, and for each place where such a token could begin the last token before it and the tokens gained since.  The
  next last token is the one whose pair with its predecessor the merge rule leaves alone.  Transitions are compiled when
  first met, up to ``max_states`` states; words that would need more, and words of more than LONG_WORD bytes (text without
  spaces, encoded data), are merged by the rule itself, so counts are exact whatever has been compiled.

Defined cases: null and empty texts have no bytes and no tokens; the special token's string inside a text counts as
one token, as in the library; repeated rows give equal rows; an empty table gives an empty result.  Ids are integers (an id that
can't be cast to long raises).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiermill.llm.bpe_lexicon import load_bpe, slices
from tiermill.llm.bpe_text import LETTER, NUMBER, OTHER, SPACE, WHITE, Bpe, share, shared
from tiermill.llm.common import worker_cache

CHUNK = 1024
LONG_WORD = 256  # bytes; longer words would be as many steps of the counter as they have bytes

# ---------------------------------------------------------------------------------------------------------- cutter

FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, APOSTROPHE, PENDING_E, PENDING_L = range(11)
STATES = 11
HERE, BEFORE = 1, 2  # marks: this code point begins a word; the one before does

#: Input symbols: the classes of ``bpe_text`` and, apart, the letters of the apostrophe forms and the apostrophe.
SHORT, E, R_OR_V, EL, QUOTE, PAD = 7, 8, 9, 10, 11, 12
SYMBOLS = 13
LETTERS = (LETTER, SHORT, E, R_OR_V, EL)


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """``next[state, symbol]`` and ``mark[state, symbol]``."""
    def kind(c):
        return LETTER if c in LETTERS else OTHER if c == QUOTE else c

    fresh = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SPACE: ONE_SPACE, WHITE: ONE_WHITE}
    white = {SPACE: RUN_SPACE, WHITE: RUN_WHITE}

    def step(s, c):
        k = kind(c)
        begin = (APOSTROPHE if c == QUOTE else fresh[k], HERE)
        if s in (IN_LETTERS, IN_NUMBERS, IN_OTHER) and fresh[k] == s:
            return s, 0
        if s in (FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER):
            return begin
        if s in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
            if k in white:
                return white[k], 0
            late = BEFORE if s in (RUN_SPACE, RUN_WHITE) else 0  # the last of several white characters is a word's start
            return (fresh[k], late) if s in (ONE_SPACE, RUN_SPACE) else (begin[0], begin[1] | late)
        if s == APOSTROPHE:
            if c == SHORT:
                return FRESH, 0
            if c in (R_OR_V, EL):
                return (PENDING_E if c == R_OR_V else PENDING_L), 0
            return (IN_OTHER, 0) if k == OTHER else begin
        if (s, c) in ((PENDING_E, E), (PENDING_L, EL)):
            return FRESH, 0
        return (IN_LETTERS, BEFORE) if k == LETTER else (begin[0], begin[1] | BEFORE)

    nxt, mark = np.zeros((STATES, SYMBOLS), np.uint8), np.zeros((STATES, SYMBOLS), np.uint8)
    for s in range(STATES):
        nxt[s, PAD] = s
        for c in (OTHER, LETTER, NUMBER, WHITE, SPACE, SHORT, E, R_OR_V, EL, QUOTE):
            nxt[s, c], mark[s, c] = step(s, c)
    return nxt, mark


def symbols(bpe: Bpe, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places and input symbols of the code points of ``buf``."""
    pos = np.flatnonzero((buf & 0xC0) != 0x80)
    b0 = buf[pos]
    ascii_ = bpe.classes[:256].copy()
    for chars, symbol in (("stmd", SHORT), ("e", E), ("rv", R_OR_V), ("l", EL), ("'", QUOTE)):
        ascii_[[ord(c) for c in chars]] = symbol
    out = ascii_[b0]
    wide = np.flatnonzero(b0 >= 0xC0)
    if len(wide):
        x = np.pad(buf, (0, 3))[pos[wide][:, None] + np.arange(4)].astype(np.int32)
        t = x & 0x3F
        two, three = (x[:, 0] & 0x1F) << 6 | t[:, 1], (x[:, 0] & 0x0F) << 12 | t[:, 1] << 6 | t[:, 2]
        four = (x[:, 0] & 0x07) << 18 | t[:, 1] << 12 | t[:, 2] << 6 | t[:, 3]
        out[wide] = bpe.classes[np.minimum(np.where(x[:, 0] < 0xE0, two, np.where(x[:, 0] < 0xF0, three, four)), 0x10FFFF)]
    return pos, out


def scan(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps: row i becomes the map of all rows of its text up to i.  ``first[i]``
    is the row where the text of row i begins.  log2(longest text) rounds, each over all rows at once."""
    maps = maps.copy()
    index = np.arange(len(maps))
    reach = 1
    while True:
        later = np.flatnonzero(index - first >= reach)
        if not len(later):
            return maps
        maps[later] = np.take_along_axis(maps[later], maps[later - reach], 1)
        reach *= 2


def word_starts(symbol: np.ndarray, sections: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True for each code point that begins a word; ``sections`` are the places where texts begin, with the end last."""
    nxt, mark = _cutter()
    flat_next, flat_mark = nxt.ravel(), mark.ravel()
    sections = np.unique(sections)
    length = np.diff(sections)
    per = -(-length // chunk)
    of = np.repeat(np.arange(len(length)), per)
    first = (np.cumsum(per) - per)[of]
    nth = np.arange(len(of)) - first
    begin = sections[of] + nth * chunk
    size = np.minimum(chunk, sections[of + 1] - begin)
    order = np.argsort(-size, kind="stable")  # chunks that end early leave the step loop
    b, n = begin[order], size[order]
    active = np.searchsorted(-n, -np.arange(int(n[0])), "left") if len(n) else []
    # the maps of all chunks, for all states before
    maps = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (len(n), STATES)).copy()
    for j, k in enumerate(active):
        maps[:k] = flat_next[maps[:k] * np.uint8(SYMBOLS) + symbol[b[:k] + j][:, None]]
    by_place = np.empty_like(maps)
    by_place[order] = maps
    done = scan(by_place, first)
    state = np.full(len(n), FRESH, np.uint8)
    follow = np.flatnonzero(nth > 0)
    state[follow] = done[follow - 1, FRESH]
    state = state[order]
    out = np.zeros(len(symbol) + 1, np.uint8)
    for j, k in enumerate(active):
        at = b[:k] + j
        cell = state[:k] * np.uint8(SYMBOLS) + symbol[at]
        out[at] = flat_mark[cell]
        state[:k] = flat_next[cell]
    starts = (out[:-1] & HERE) > 0
    late = np.flatnonzero(out & BEFORE)
    starts[late - 1] = True
    last = done[np.cumsum(per) - 1, FRESH] if len(per) else np.zeros(0, np.uint8)
    open_ = sections[1:][(last == PENDING_E) | (last == PENDING_L)]  # "'r", "'v", "'l" at the end of a text
    starts[open_ - 1] = True
    starts[sections[:-1]] = True
    return starts


# --------------------------------------------------------------------------------------------------------- counter

class Counter:
    """The word transducer: ``table[state, byte]`` is ``next state * 256 + change of the count + 128``, -1 if it isn't
    compiled yet, -2 if it would need a state too many."""

    def __init__(self, bpe: Bpe, max_states: int):
        self.bpe, self.max_states = bpe, max_states
        special = set(bpe.special.values())
        self.token = {b: i for i, b in enumerate(bpe.bytes_of) if b and i not in special}
        self.begins = {b[:k] for b in self.token for k in range(1, len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.table = np.full((1024, 256), -1, np.int32)
        # a state: the longest suffix that a token may extend, and (length, last token before, tokens since) of each such suffix
        start = (b"", ((0, -1, 0),))
        self.known = {start: 0}
        self.states = [start]

    def stable(self, a: int, t: int) -> bool:
        """Does the merge rule leave the token ``t`` after the token ``a`` (-1: at a word's start) as it is?"""
        out = self.pairs.get((a, t))
        if out is None:
            of = self.bpe.bytes_of
            out = self.bpe.merge(of[t]) == [t] if a < 0 else self.bpe.merge(of[a] + of[t]) == [a, t]
            self.pairs[a, t] = out
        return out

    def compile(self, state: int, byte: int) -> None:
        """Add one transition."""
        suffix, places = self.states[state]
        text = suffix + bytes((byte,))
        for length, before, since in places:  # longest first
            t = self.token.get(text[len(text) - length - 1:])
            if t is not None and self.stable(before, t):
                break
        else:
            raise AssertionError("no token ends here; the vocabulary lacks single bytes")
        change = 1 - since  # tokens of the longer prefix less those of this one
        kept = tuple((n + 1, a, s + change) for n, a, s in places if text[len(text) - n - 1:] in self.begins)
        longest = kept[0][0] if kept else 0
        new = (text[len(text) - longest:], kept + ((0, t, 0),))
        to = self.known.get(new)
        if to is None:
            if len(self.states) >= self.max_states:
                self.table[state, byte] = -2
                return
            to = self.known[new] = len(self.states)
            self.states.append(new)
            if to >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        self.table[state, byte] = to * 256 + change + 128

    def counts(self, buf: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Tokens of each word ``buf[begins[i]:begins[i + 1]]``."""
        out = np.zeros(len(begins) - 1, np.int64)
        size = np.diff(begins)
        lane = np.flatnonzero((size > 0) & (size <= LONG_WORD))
        at, end = begins[:-1][lane], begins[1:][lane]
        state, total = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
        left = [long] if len(long := np.flatnonzero(size > LONG_WORD)) else []
        while len(lane):
            byte = buf[at]
            where = state * 256 + byte
            cell = self.table.ravel()[where]
            miss = cell < 0
            if miss.any():
                for w in np.unique(where[cell == -1]).tolist():
                    self.compile(w >> 8, w & 255)
                cell = self.table.ravel()[where]
                miss = cell < 0
                if miss.any():
                    left.append(lane[miss])
                    ok = ~miss
                    lane, at, end, total, cell = lane[ok], at[ok], end[ok], total[ok], cell[ok]
            state = (cell >> 8).astype(np.int64)
            total = total + ((cell & 255) - 128)
            at = at + 1
            over = at == end
            out[lane[over]] = total[over]
            go = np.flatnonzero(~over)
            lane, at, end, state, total = lane[go], at[go], end[go], state[go], total[go]
        if left:
            rest = np.concatenate(left)
            raw = buf.tobytes()
            place: dict[bytes, int] = {}
            which = [place.setdefault(raw[i:j], len(place)) for i, j in zip(begins[rest].tolist(), begins[rest + 1].tolist())]
            _, offsets = self.bpe.merge_many(list(place))
            out[rest] = np.diff(offsets)[which]
        return out


def _special_places(bpe: Bpe, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
    raw, out = buf.tobytes(), []
    for s in bpe.special:
        at = raw.find(s)
        while at >= 0:
            d = int(np.searchsorted(off, at, "right")) - 1
            inside = at + len(s) <= off[d + 1]
            if inside:
                out.append((at, at + len(s)))
            at = raw.find(s, at + (len(s) if inside else 1))
    return out


def count_batch(counter: Counter, buf: np.ndarray, off: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Tokens of each text ``buf[off[i]:off[i + 1]]``."""
    if not len(buf):
        return np.zeros(len(off) - 1, np.int64)
    special = _special_places(counter.bpe, buf, off)
    pos, symbol = symbols(counter.bpe, buf)
    cuts = np.concatenate([off, np.array([x for s in special for x in s], np.int64)])
    begins = np.append(pos[word_starts(symbol, np.searchsorted(pos, cuts), chunk)], len(buf))
    n = np.zeros(len(begins), np.int64)
    if special:
        a, z = np.array(special).T
        # a special token's text is one token: its words count nothing, its first place one
        a, z = np.sort(a), np.sort(z)
        inside = np.searchsorted(a, begins[:-1], "right") - 1
        drop = (inside >= 0) & (begins[:-1] < z[np.maximum(inside, 0)])
        n[1:] = np.where(drop, np.isin(begins[:-1], a), counter.counts(buf, begins))
    else:
        n[1:] = counter.counts(buf, begins)
    upto = np.cumsum(n)
    return np.diff(upto[np.searchsorted(begins, off)])


def token_counts(docs: DataFrame, bpe_path: str, limit: int = 512, max_states: int = 40_000, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row."""
    sent = share(docs.sparkSession, load_bpe(bpe_path))

    def run(batches):
        cache = worker_cache()
        key = ("counter", bpe_path, max_states)
        if key not in cache:
            cache[key] = Counter(shared(sent), max_states)
        counter = cache[key]
        for b in batches:
            for a, buf, off in slices(b.column(1)):
                n = count_batch(counter, buf, off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(n)), pa.array(np.diff(off)), pa.array(n),
                                                  pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
