"""Language identification by cross-parsing.

1. From the labelled texts outside the held-out fold a bounded sample is drawn per language: different texts in the order
   of a hash, those of at most ``row_bytes`` bytes first, at most ``rows`` of them and ``sample_bytes`` bytes in all.  Only this
   sample reaches the driver.
2. A suffix automaton of a language's sample holds all its substrings.  Walking it along a text gives the longest match at
   a place; where it can't go on a phrase ends and the next begins.  (A symbol the sample lacks is a phrase of its own.)
3. The automata are sent as lists of transitions and become one table in a worker, whose entries also say whether a phrase
   begins.  Texts are lower-cased, everything but letters becomes a separator, runs of it one; they are cut into
   blocks of BLOCK symbols where a phrase ends in any case, and all blocks of a slice walk all automata in step.  So a
   text of any length is read whole, and a very long one is only more blocks.
4. The language with the fewest phrases for each symbol wins (ties: the smaller name).  The score is the share of phrases
   it saves against the next language: 0 for a tie, 1 if no other language was learned.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be learned;
labels that are null, rows without an id and texts without a letter teach nothing; repeated texts teach once for each label; a
null id is not held out; ids keep their type and rows that repeat an id are rows of their own; an empty table gives an empty
result; extra columns of the input stay out of the result, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiermill.llm.bpe_text import arrow_bytes
from tiermill.llm.common import worker_cache
from tiermill.llm.quality import held_out

BLOCK = 512  # symbols that are parsed in one go
SLICE_BYTES = 4 << 20
SEPARATOR = 0


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of ``text``; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:  # q stands for longer substrings too: split off those that end here
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


def symbols(buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts given as bytes end to end, and where each text's begin; runs of separators count once, those at
    the begin of a text not at all."""
    s = classes[buf]
    before = np.empty(len(s), s.dtype)
    before[1:] = s[:-1]
    begins = offsets[:-1]
    before[begins[begins < len(s)]] = SEPARATOR
    keep = (s != SEPARATOR) | (before != SEPARATOR)
    upto = np.concatenate([[0], np.cumsum(keep)])
    return s[keep], upto[offsets]


class Parser:
    """The automata of all languages as one table of ``next state, does a phrase begin``."""

    def __init__(self, classes: np.ndarray, n_symbols: int, automata: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]):
        self.classes, self.n = classes, n_symbols
        sizes = [states for *_, states in automata]
        self.roots = np.concatenate([[0], np.cumsum(sizes)])[:-1] * n_symbols
        table = np.empty((sum(sizes), n_symbols), np.int32)
        for (a, c, z, states), root in zip(automata, self.roots.tolist()):
            at = root // n_symbols
            start = np.full(n_symbols, root * 2 + 1, np.int32)  # an unknown symbol: a phrase, and back to the start
            own = a == 0
            start[c[own]] = (root + z[own] * n_symbols) * 2 + 1
            table[at:at + states] = start
            table[at + a[~own], c[~own]] = (root + z[~own] * n_symbols) * 2
        self.table = table.ravel()

    def phrases(self, syms: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """``[language, text]``: how many phrases each text needs."""
        size = np.diff(upto)
        blocks = -(-size // BLOCK)
        text = np.repeat(np.arange(len(size)), blocks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = upto[:-1][text] + nth * BLOCK
        length = np.minimum(BLOCK, upto[1:][text] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, text = begin[order], length[order], text[order]
        state = np.repeat(self.roots[:, None].astype(np.int32), len(begin), axis=1)
        count = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-length, -np.arange(1, BLOCK + 1), "right")  # blocks of at least t symbols
        for t in range(int(length[0]) if len(length) else 0):
            m = live[t]
            got = self.table[state[:, :m] + syms[begin[:m] + t]]
            count[:, :m] += got & 1
            state[:, :m] = got >> 1
        out = np.zeros((len(self.roots), len(size)), np.int64)
        for k in range(len(out)):
            out[k] = np.bincount(text, weights=count[k], minlength=len(size))
        return out


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame, sample_bytes: int = 32_768, rows: int = 64, row_bytes: int = 4_096):
    """``(languages, classes of bytes, number of symbols, automata)`` from ``text, lang`` rows."""
    x = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("lang", F.lower("text").alias("text"))
    x = x.select("lang", "text", F.xxhash64("text").alias("h"), (F.octet_length("text") > row_bytes).alias("long"))
    # the first of a language among the first of each of 64 parts of it: no task reads more than 64 * rows of a common one
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("long", "h"))
    picked = x.select("lang", "long", "h").distinct().withColumn("part", F.pmod("h", F.lit(64)))
    picked = picked.withColumn("r", first("lang", "part")).where(F.col("r") <= rows)
    picked = picked.withColumn("r", first("lang")).where(F.col("r") <= rows).select("lang", "h", "r")
    # at most `rows` a language: the broadcast is as small as the set of labels
    texts = (x.join(F.broadcast(picked), ["lang", "h"]).select("lang", "r", F.substring("text", 1, sample_bytes).alias("text"))
              .groupBy("lang", "r").agg(F.min("text").alias("text")).orderBy("lang", "r").collect())
    samples: dict[str, list[bytes]] = {}
    for t in texts:
        samples.setdefault(t.lang, []).append(t.text.encode())
    used = np.zeros(256, bool)
    used[np.frombuffer(b"".join(b"".join(s) for s in samples.values()), np.uint8)] = True
    classes = np.zeros(256, np.uint8)
    letters = [b for b in range(256) if 97 <= b < 123 or (b >= 128 and used[b])]
    classes[letters] = np.arange(1, len(letters) + 1)
    unknown = len(letters) + 1
    classes[[b for b in range(128, 256) if not used[b]]] = unknown
    border = unknown + 1  # between the texts of a sample; no text to parse has it
    automata = []
    for lang in sorted(samples):
        parts, room = [], sample_bytes
        for s in samples[lang]:
            raw = np.frombuffer(s, np.uint8)
            sym, _ = symbols(raw, np.array([0, len(raw)]), classes)
            parts.append(sym[:room].tobytes() + bytes([border]))
            room -= len(sym)
            if room <= 0:
                break
        made = suffix_automaton(b"".join(parts))
        edges = [(a, c, z) for a, out in enumerate(made) for c, z in out.items()]
        a, c, z = np.array(edges, np.int32).reshape(-1, 3).T
        automata.append((a, c, z, len(made)))
    return sorted(samples), classes, border + 1, automata


def predict_languages(docs: DataFrame, sample_bytes: int = 32_768, rows: int = 64, row_bytes: int = 4_096, id_col: str = "doc_id",
                      text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; learned from the labels of the rows that aren't held out."""
    spark = docs.sparkSession
    x = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                    F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    learned = learn(x.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text", "lang"), sample_bytes, rows, row_bytes)
    languages = learned[0]
    name, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(learned[1:])

    def parser():  # tasks of a worker share the table; that of an earlier call goes
        cache = worker_cache()
        if cache.get("cross_parse", ("",))[0] != name:
            cache["cross_parse"] = name, Parser(*sent.value)
        return cache["cross_parse"][1]

    def run(batches):
        p = parser() if languages else None
        for b in batches:
            n = b.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            buf, off = arrow_bytes(b.column(2))
            a = 0
            while p and a < n:
                z = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_BYTES, "right")) - 1)
                count = p.phrases(*symbols(buf[off[a]:off[z]], off[a:z + 1] - off[a], p.classes))
                best[a:z] = count.argmin(0)
                low = np.sort(count, axis=0)
                score[a:z] = 1 - low[0] / np.maximum(low[1], 1) if len(low) > 1 else 1.0
                a = z
            none = ~b.column(3).to_numpy(zero_copy_only=False).astype(bool) | (best < 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.where(none, "und", np.array([*languages, "und"], object)[best])),
                 pa.array(np.where(none, 0.0, score))], ["doc_id", "held_out", "lang_pred", "score"])

    kind = x.schema["doc_id"].dataType.simpleString()
    return (x.select("doc_id", "held_out", F.lower(F.coalesce("text", F.lit(""))).alias("text"), has_letter(F.col("text")).alias("letter"))
             .mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double"))
