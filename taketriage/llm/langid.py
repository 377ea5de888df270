"""Language ID by cross-parsing.

For each language a suffix automaton of labelled text is built.  A text is cut
into the fewest phrases that each occur in that text, going left to right and
taking the longest match each time; the fewer phrases (times the bits that an
address in the labelled text takes, per character), the closer the language.

The automata are learned from a bounded sample: at most ``SAMPLE_CHARS``
characters in all, shared evenly by the languages, from documents drawn by a
hash of their id; of the ``MAX_LANGUAGES`` languages with the most labelled
text, should there be more.  So the model that goes to the workers is bounded
too: the transitions that there are, in a list.  Each worker makes its table of
them, of all symbols for each state, which has the bound of the sample.

A text is parsed in blocks of ``BLOCK`` symbols, all blocks of a batch together,
one symbol at a time, and then those again, from the state that the block
before ends in, whose phrases do not end as they did: so a phrase goes on over
the end of a block, and the count is that of one parse of the whole text.

Every learned letter is a symbol of its own; letters that were not learned are
one more symbol, which no automaton has: a phrase each.

A null text, or one without letters, is ``und`` with score 0.  Without any
labelled document every text is ``und``.  Repeated rows give repeated results;
an empty table gives no rows; other columns of any name are ignored.  Texts of
any length are parsed whole.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import id_text, map_batches, slices
from .words import suffix_automaton

UND = "und"
#: Characters of labelled text learned from, in all; of one document at most;
#: languages at most.
SAMPLE_CHARS, DOC_CHARS, MAX_LANGUAGES = 320_000, 4_000, 512
#: Languages with more symbols than this have their transitions hashed.
DENSE = 62
#: Symbols of a block; steps after which states are noted; code points of a
#: slice of a batch.
BLOCK, STEPS, SLICE = 512, 32, 2_000_000
#: Above this many bits a symbol, the first phrase not counted, no learned
#: language is near (text of learned languages takes 2 to 5, random letters
#: 10).  Languages of many symbols take more: see Model.far.
FAR_BITS = 8.0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """Transitions of the suffix automaton of ``symbols``, which are below k.

    Symbols are renumbered: those that occur, then all others as one, then
    padding (k - 1), which keeps the state.  Where a state lacks a transition
    the phrase has ended before the symbol, which begins the next: the root's
    transition is taken, marked.  The last state has none; parsing begins there,
    and a symbol that the root lacks leads there, so it is a phrase of its own.
    With up to DENSE symbols transitions are looked up in a table, whose states
    are kept multiplied by the number of symbols; else they are hashed.
    """

    MARKED = np.int32(1 << 30)

    def __init__(self, symbols: np.ndarray, k: int) -> None:
        own = np.unique(symbols)
        self.local = np.full(k, len(own), np.min_scalar_type(len(own) + 1))
        self.local[own] = np.arange(len(own))
        self.local[k - 1] = len(own) + 1
        self.bits, self.k = math.log2(max(2, len(symbols))), len(own) + 2
        nexts = [*suffix_automaton(self.local[symbols].tolist())[0], {}]
        self.dense = len(own) <= DENSE
        step = self.k if self.dense else 1
        self.end = (len(nexts) - 1) * step
        self.root = np.full(self.k, self.end, np.int32)
        for c, s in nexts[0].items():
            self.root[c] = s * step
        if self.dense:
            self.counts = np.array([len(out) for out in nexts], np.uint8)
            self.symbols = np.array([c for out in nexts for c in out], np.uint8)
            self.to = np.array([s * step for out in nexts for s in out.values()], np.int32)
        else:
            self._hash(nexts)

    @property
    def table(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            n = len(self.counts)
            table = np.tile(self.root | self.MARKED, (n, 1))
            table[np.repeat(np.arange(n), self.counts), self.symbols] = self.to
            table[:, self.k - 1] = np.arange(n, dtype=np.int32) * self.k
            self._table = table.ravel()
        return self._table

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def _hash(self, nexts: list[dict[int, int]]) -> None:
        """Open addressing, half full at most; -1 is a free slot."""
        todo = np.array([i * self.k + c for i, out in enumerate(nexts) for c in out], np.int64)
        to = np.array([s for out in nexts for s in out.values()], np.int32)
        self.log = (2 * len(todo)).bit_length()
        self.keys, self.to = np.full(1 << self.log, -1, np.int64), np.zeros(1 << self.log, np.int32)
        at = self._slots(todo)
        while len(todo):
            free = np.flatnonzero(self.keys[at] < 0)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[free]], self.to[at[free]] = todo[free], to[free]
            left = np.ones(len(todo), bool)
            left[free] = False
            todo, to, at = todo[left], to[left], (at[left] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.log)).astype(np.int64)

    def _found(self, keys: np.ndarray) -> np.ndarray:
        """Where each key leads; -1 where it leads nowhere."""
        at = self._slots(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.to[at], -1).astype(np.int64)
        on = np.flatnonzero((got != keys) & (got >= 0))
        while len(on):
            at[on] = (at[on] + 1) & (len(self.keys) - 1)
            got = self.keys[at[on]]
            hit = got == keys[on]
            out[on[hit]] = self.to[at[on[hit]]]
            on = on[~hit & (got >= 0)]
        return out

    def run(self, steps: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each column of ``steps`` (renumbered), entered
        in ``state``, and the state it is left in."""
        marks = np.zeros(steps.shape[1], np.int32)
        if self.dense:
            table = self.table
            for c in steps:
                got = table[state + c]
                marks += got >> 30
                state = got & (self.MARKED - 1)
            return marks, state
        for c in steps:
            got, kept = self._found(state.astype(np.int64) * self.k + c), c == self.k - 1
            ends = (got < 0) & ~kept
            marks += ends
            state = np.where(kept, state, np.where(ends, self.root[c], got)).astype(np.int32)
        return marks, state

    def phrases(self, steps: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases of each text, whose blocks are the columns of ``steps`` from
        each of ``first`` on."""
        steps = self.local[steps]
        n, width = steps.shape
        cuts = [slice(i, i + STEPS) for i in range(0, n, STEPS)]
        marks, states = np.zeros((len(cuts), width), np.int32), np.zeros((len(cuts), width), np.int32)
        entered = np.full(width, self.end, np.int32)
        state = entered
        for i, cut in enumerate(cuts):
            marks[i], state = self.run(steps[cut], state)
            states[i] = state
        begins = np.zeros(width, bool)
        begins[first] = True
        while True:
            before = np.where(begins, self.end, np.roll(states[-1], 1))
            todo = np.flatnonzero(before != entered)
            if not len(todo):
                return np.add.reduceat(marks.sum(axis=0), first)
            entered[todo] = before[todo]
            state = before[todo]
            for i, cut in enumerate(cuts):
                marks[i, todo], state = self.run(steps[cut][:, todo], state)
                off = states[i, todo] != state
                states[i, todo] = state
                todo, state = todo[off], state[off]
                if not len(todo):
                    break


class Model:
    """Alphabet and automata, learned from lists of texts by language."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.langs = sorted(samples)
        texts = {lang: [t.lower() for t in samples[lang]] for lang in self.langs}
        every = np.concatenate([np.zeros(0, np.uint32), *[code_points(t) for ts in texts.values() for t in ts]])
        self.alphabet = np.unique(every[letters()[every]])
        #: blank, letters, other letters, and the padding, which keeps the state
        self.k = len(self.alphabet) + 3
        self.automata = []
        #: bits a symbol that are still near, if more than usual: of many symbols
        #: even learned text takes many, so halfway from what one half of the
        #: sample takes by the other to a phrase for each letter
        self.far = np.zeros(len(self.langs))
        for i, lang in enumerate(self.langs):
            joined = np.concatenate([np.zeros(0, np.uint8), *[self.symbols(t)[0] for t in texts[lang]]])
            self.automata.append(Automaton(joined, self.k))
            if not self.automata[i].dense:
                half = Automaton(joined[: len(joined) // 2], self.k)
                rest = joined[len(joined) // 2 :]
                typical = half.phrases(*self._blocks([rest]))[0] * half.bits / len(rest)
                most = self.automata[i].bits * np.count_nonzero(joined) / len(joined)
                self.far[i] = (min(typical, most) + most) / 2

    @property
    def lut(self) -> np.ndarray:
        if not hasattr(self, "_lut"):
            lut = np.where(letters(), self.k - 2, 0).astype(np.min_scalar_type(self.k))
            lut[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
            self._lut = lut
        return self._lut

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_lut"}

    def symbols(self, text: str) -> tuple[np.ndarray, bool]:
        """Symbols with runs of blanks as one, after a leading blank; any letter?"""
        s = self.lut[code_points(text)]
        s = np.concatenate([np.zeros(1, np.uint8), s])
        keep = np.concatenate([np.ones(1, bool), (s[1:] != 0) | (s[:-1] != 0)])
        return s[keep], bool(s.any())

    def _blocks(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The parts in columns of BLOCK symbols, and the first column of each."""
        blocks = np.array([-(-len(s) // BLOCK) for s in parts])
        first = np.cumsum(blocks) - blocks
        lanes = np.full((blocks.sum(), BLOCK), self.k - 1, self.lut.dtype)
        for s, at, n in zip(parts, first, blocks, strict=True):
            lanes[at : at + n].reshape(-1)[: len(s)] = s
        return np.ascontiguousarray(lanes.T), first

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol by text and language, infinite without letters; and
        without each text's first phrase."""
        out = np.full((2, len(texts), len(self.langs)), np.inf)
        parts = [self.symbols(t.lower()) for t in texts]
        rows = [i for i, (_, any_) in enumerate(parts) if any_]
        if rows and self.langs:
            n = np.array([len(parts[i][0]) for i in rows])
            steps, first = self._blocks([parts[i][0] for i in rows])
            for lang, a in enumerate(self.automata):
                phrases = a.phrases(steps, first)
                out[0, rows, lang], out[1, rows, lang] = phrases * a.bits / n, (phrases - 1) * a.bits / n
        return out[0], out[1]

    def predict(self, texts: list[str | None], far_bits: float = FAR_BITS) -> tuple[list[str], list[float], list[bool]]:
        """Language and score of each text, and whether that language is near."""
        bits, after = self.bits([t or "" for t in texts])
        langs, scores, near = [], [], []
        for row, rest in zip(bits, after, strict=True):
            best = int(np.argmin(row)) if len(row) else -1
            if best < 0 or not np.isfinite(row[best]):
                langs.append(UND), scores.append(0.0), near.append(False)
                continue
            weight = np.exp2(-8 * (row - row[best]))
            langs.append(self.langs[best]), scores.append(float(1 / weight.sum()))
            near.append(bool(rest[best] <= max(far_bits, self.far[best])))
        return langs, scores, near


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def sampled(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, doc_chars: int = DOC_CHARS, max_languages: int = MAX_LANGUAGES) -> dict[str, list[str]]:
    """Texts to learn from by language, of (doc_id, text, lang) rows with both.

    Documents are drawn by a hash of their id: so many of each language that
    its share of ``sample_chars`` is reached, each cut at ``doc_chars`` (of the
    learned text only; texts to predict are whole).
    """
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    stats = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.length("text"), F.lit(doc_chars))).alias("chars"))
    found = {r["lang"]: r for r in stats.orderBy(F.desc("chars"), "lang").limit(max_languages).collect()}
    if not found:
        return {}
    share = sample_chars // len(found)
    # twice the documents needed on average, and some: enough for all but odd draws, bounded in any case
    rate = {lang: min(1.0, (2.0 * share / max(1, r["chars"])) + 32 / r["n"]) for lang, r in found.items()}
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    under = F.create_map(*[x for lang, r in rate.items() for x in (F.lit(lang), F.lit(r))])[F.col("lang")]
    rows = (
        labelled.select("lang", "doc_id", F.substring("text", 1, doc_chars).alias("text"), draw.alias("draw"))
        .where(F.col("draw") < under)
        .collect()
    )
    samples: dict[str, list[str]] = {}
    left = dict.fromkeys(found, share)
    for r in sorted(rows, key=lambda r: (r["lang"], r["draw"], r["doc_id"] is not None, r["doc_id"], r["text"])):
        if left[r["lang"]] > 0:
            samples.setdefault(r["lang"], []).append(r["text"][: left[r["lang"]]])
            left[r["lang"]] -= len(r["text"])
    return samples


def fit(labelled: DataFrame, **bounds: int) -> Model:
    return Model(sampled(labelled, **bounds))


def _batch_predict(model: Model, texts: list[str | None], far_bits: float = FAR_BITS) -> tuple[list[str], list[float], list[bool]]:
    out: tuple[list[str], list[float], list[bool]] = ([], [], [])
    for a, b in slices([len(t or "") for t in texts], SLICE):
        for whole, part in zip(out, model.predict(texts[a:b], far_bits), strict=True):
            whole.extend(part)
    return out


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        langs, scores, _ = _batch_predict(shipped.value, batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
        )

    return map_batches(id_text(docs, id_col, text_col), fn, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Held-out prediction: learns from the documents that aren't held out."""
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    model = fit(learn)
    return predicted(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def in_known_language(docs: DataFrame, model: Model, text_col: str = "text", far_bits: float = FAR_BITS) -> DataFrame:
    """The rows, unchanged, whose text is in a learned language: it has letters
    and, beyond its first phrase, takes at most ``far_bits`` bits a symbol in
    its best language.  The same rule holds for texts of every length."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        near = _batch_predict(shipped.value, batch.column(at).to_pylist(), far_bits)[2]
        yield batch.filter(pa.array(near, pa.bool_()))

    return map_batches(docs, fn, docs.schema, at)
