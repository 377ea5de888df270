"""Benchmark decontamination by suffix arrays of the training text.

Each shard of documents gets a suffix array of its words.  Every suffix of
every benchmark item that has a window (13 words; all, for a shorter item) is
looked up in it by binary search, which gives all places of that window.
Windows found one after the other, in the document as in the item, are one
verbatim match; so each document gets its longest match with each item, of any
length, and where it is in both.  Words inside a place of a window are hit, and
documents with a twentieth of their words hit are removed.  Matches shorter
than a window are not told.

Suffixes that start with a word, or a run of words shorter than any window,
that no item has can't match and stay out of the array.  The rest are sorted
by their first ``WINDOW`` words, in rounds of sorting ranks.

The benchmark goes to the workers in blocks of ``BLOCK_BYTES``; a larger one
makes more passes over the same rows, none larger; after every ``PASSES`` of
them the rows are written, and the blocks before are let go.

Words are ``[0-9a-z]`` and all characters beyond ASCII, A-Z lower-cased.  A
null or empty text has no words, hits or items and isn't contaminated; an item
without words has no window.  Items with one id are one item; an item without
an id makes hits, and is in no list of items.  Repeated rows give repeated
results; an empty table gives no rows, an empty benchmark no hits.  Other
columns of any name are kept or ignored.  Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .shared import discard, map_batches, written
from .words import ALNUM, suffix_automaton, word_hashes

WINDOW = 13
#: A document is removed when SHARE_ONE_IN times its hit words reach its words.
SHARE_ONE_IN = 20
#: Bytes of benchmark text in a block, words of a shard's array.
BLOCK_BYTES, SHARD_WORDS = 8 << 20, 1_000_000
#: Blocks of the benchmark that one plan goes through.
PASSES = 4


class Items:
    """Word hashes of a block of benchmark items, with the windows in them."""

    def __init__(self, rows: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.window = window
        self.ids = [i for i, _ in rows]
        self.words, self.starts = word_hashes([t for _, t in rows], ALNUM)
        self.vocabulary = np.unique(self.words)
        lengths = np.diff(self.starts)
        #: windows by start: their length and item
        at, size, item = [], [], []
        for j, n in enumerate(lengths):
            if n:
                w = min(window, int(n))
                a = np.arange(n - w + 1) + self.starts[j]
                at.append(a), size.append(np.full(len(a), w)), item.append(np.full(len(a), j))
        none = np.zeros(0, np.int64)
        self.at, self.size, self.item = (np.concatenate([none, *x]) for x in (at, size, item))
        self.shortest = int(self.size.min()) if len(self.size) else 0


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark's rows in blocks of bounded size, read as a stream."""
    rows, size = [], 0
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    for r in items.toLocalIterator():
        rows.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    yield rows


class SuffixArray:
    """Places of a word sequence, sorted by their first ``depth`` words.

    Words are ranks in a vocabulary, 0 for a word that can't match and for the
    end; suffixes that start with a 0 aren't in the array.
    """

    def __init__(self, ranks: np.ndarray, depth: int) -> None:
        self.text = np.concatenate([ranks, np.zeros(depth, ranks.dtype)])
        self.at = np.flatnonzero(ranks)
        order = np.zeros(len(ranks) + 2 * depth, np.int64)
        order[: len(ranks)] = ranks
        width, done = np.int64(max(len(ranks), int(ranks.max(initial=0))) + 2), 1
        while done < depth:  # ranks by `done` words become ranks by twice as many, or by `depth`
            step = min(done, depth - done)
            _, inverse = np.unique(order[self.at] * width + order[self.at + step], return_inverse=True)
            order = np.zeros_like(order)
            order[self.at] = inverse + 1
            done += step
        self.at = self.at[np.argsort(order[self.at], kind="stable")]

    def _compare(self, places: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        return self.text[self.at[places] + k].astype(np.int64) - queries

    def ranges(self, text: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) of the array whose suffixes begin with text[at:at+size]."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.at), np.int64)
        for k in range(int(size.max()) if len(size) else 0):  # narrow by one word at a time
            todo = np.flatnonzero((size > k) & (lo < hi))
            if not len(todo):
                break
            q = text[at[todo] + k]
            lo[todo], hi[todo] = self._bisect(lo[todo], hi[todo], q, k, False), self._bisect(lo[todo], hi[todo], q, k, True)
        return lo, hi

    def _bisect(self, lo: np.ndarray, hi: np.ndarray, q: np.ndarray, k: int, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            d = self._compare(mid, q[open_], k)
            down = d <= 0 if right else d < 0
            lo[open_[down]] = mid[down] + 1
            hi[open_[~down]] = mid[~down]
        return lo


def _longest_in(item: list[int], words: list[int]) -> tuple[int, int, int]:
    """Length of the longest match, where it begins in ``words`` and in ``item``."""
    nexts, link, length, first = suffix_automaton(item)
    best, state, n = (0, 0, 0), 0, 0
    for i, w in enumerate(words):
        while state and w not in nexts[state]:
            state = link[state]
            n = length[state]
        if w in nexts[state]:
            state, n = nexts[state][w], n + 1
            if n > best[0]:
                best = (n, i - n + 1, first[state] - n + 1)
    return best


class _Found:
    """Places of windows, shard by shard: where, of which item, at which of its
    words, of which size, and whether the item has that window again."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = [np.zeros((5, 0), np.int64)]

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(np.stack(columns).astype(np.int64))

    def longest(self, words: np.ndarray, starts: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, length, word of the text, word of the item) of the
        longest match of each item in each text, the first if several."""
        place, item, at, size, again = np.concatenate(self.parts, axis=1)
        doc = np.searchsorted(starts, place, side="right") - 1
        order = np.lexsort((place, item, doc))
        doc, place, item, at, size, again = (x[order] for x in (doc, place, item, at, size, again))
        pair = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])[: len(doc)]
        on = (place[1:] == place[:-1] + 1) & (at[1:] == at[:-1] + 1)
        first = np.flatnonzero(pair | ~np.concatenate([[False], on])[: len(doc)])
        length = np.diff(np.append(first, len(doc))) + size[first] - 1
        best = first[np.lexsort((at[first], place[first], -length, item[first], doc[first]))]
        size_of = dict(zip(first.tolist(), length.tolist(), strict=True))
        which = np.cumsum(pair) - 1
        ends = np.append(np.flatnonzero(pair), len(doc))
        repeats = np.add.reduceat(again, ends[:-1]) > 0 if len(doc) else again
        seen = -1
        for k in best.tolist():
            if which[k] == seen:
                continue
            seen = int(which[k])
            d, i = int(doc[k]), int(item[k])
            got = (size_of[k], int(place[k]), int(at[k]))
            if repeats[seen]:  # a window of the item isn't at one place in it
                own = items.words[items.starts[i] : items.starts[i + 1]].tolist()
                a, b = ends[seen], ends[seen + 1]
                cuts = np.append(np.flatnonzero(np.diff(place[a:b], prepend=-2) != 1) + a, b)
                runs = [(x, _longest_in(own, words[place[x] : place[y - 1] + size[x]].tolist())) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                n, p, o = min(((-r[0], int(place[x]) + r[1], r[2]) for x, r in runs))
                got = (-n, p, o)
            yield d, i, got[0], got[1] - int(starts[d]), got[2]


def shard_hits(texts: list[bytes | None], items: Items) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[tuple[int, int, int, int]]]]:
    """For each text: number of words, matched [start, end) word ranges (merged),
    and for each item with an occurring window: its number, the length of its
    longest match, and the word of the text and of the item where that begins."""
    words, starts = word_hashes(texts, ALNUM)
    n_words = np.diff(starts)
    ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    if not len(words) or not len(items.at):
        return n_words, ranges, found
    vocabulary = items.vocabulary
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    ranks = np.where(vocabulary[at] == words, at + 1, 0).astype(np.int64)
    # how many words of the vocabulary follow from each place, within its text
    bad = np.flatnonzero(ranks == 0)
    stops = np.union1d(bad, starts[1:])
    run = stops[np.searchsorted(stops, np.arange(len(ranks)), side="right")] - np.arange(len(ranks))
    long_ = np.flatnonzero((ranks > 0) & (run >= items.shortest))
    if not len(long_):
        return n_words, ranges, found
    n = len(ranks) + 1
    usable = np.cumsum(np.bincount(long_, minlength=n) - np.bincount(long_ + run[long_], minlength=n))[:-1] > 0
    ranks = np.where(usable, ranks, 0)
    query = np.searchsorted(vocabulary, items.words) + 1
    cover = np.zeros(n, np.int64)
    places = _Found()
    # shards: whole texts, of so many usable words
    for a, b in _shards(usable, starts):
        part = slice(starts[a], starts[b])
        sa = SuffixArray(ranks[part], items.window)
        lo, hi = sa.ranges(query, items.at, items.size)
        # each window of an item that occurs, once however often the item has it
        there = np.flatnonzero(lo < hi)
        windows = np.stack([lo, hi, items.size, items.item])[:, there]
        windows, one, times = np.unique(windows, axis=1, return_index=True, return_counts=True)
        if not windows.shape[1]:
            continue
        lo, hi, size, item = windows
        at = items.at[there[one]] - items.starts[item]
        which = np.repeat(np.arange(len(lo)), hi - lo)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        place = sa.at[lo[which] + nth] + starts[a]
        within = run[place] >= size[which]  # not over the end of a text
        place, which = place[within], which[within]
        cover += np.bincount(place, minlength=n) - np.bincount(place + size[which], minlength=n)
        places.add(place, item[which], at[which], size[which], times[which] > 1)
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
    for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        while s < e:  # a run can span texts
            d = int(np.searchsorted(starts, s, side="right")) - 1
            stop = min(e, int(starts[d + 1]))
            ranges[d].append((int(s - starts[d]), int(stop - starts[d])))
            s = stop
    for d, *match in places.longest(words, starts, items):
        found[d].append(tuple(match))
    return n_words, ranges, found


def _shards(usable: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    total = np.concatenate([[0], np.cumsum(usable)])[starts]
    a, n = 0, len(starts) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, total[a] + SHARD_WORDS, side="right")) - 1)
        yield a, min(b, n)
        a = b


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_MATCH = pa.list_(pa.struct([("item", pa.string()), ("length", pa.int64()), ("at", pa.int64()), ("item_at", pa.int64())]))
_MATCHES = "array<struct<item:string,length:long,at:long,item_at:long>>"


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(a + b):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _best(matches: list[dict]) -> list[dict]:
    """One match for each item id, by id: the longest, then the first."""
    out: dict[str, dict] = {}
    for m in sorted(matches, key=lambda m: (-m["length"], m["at"], m["item_at"])):
        out.setdefault(m["item"], m)
    return [out[i] for i in sorted(out)]


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A struct of the row (``doc``), n_words, hits (word ranges), matches (the
    longest with each item: id, length, word of the text, word of the item)."""
    sc = docs.sparkSession.sparkContext
    text = F.col(f"doc.`{text_col}`").cast("binary").alias("text")
    df = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    none = F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("hits"), F.expr(f"cast(array() as {_MATCHES})").alias("matches")
    df = df.select("doc", text, F.lit(0).cast("long").alias("n_words"), *none)
    schema = T.StructType(df.schema.fields)
    before, open_ = None, []
    for rows in item_blocks(benchmark, item_col, block_bytes=block_bytes):
        if len(open_) == PASSES:
            df = written(df, "decontaminated")
            for b in open_:
                b.destroy()
            if before is not None:
                discard(before)
            before, open_ = df, []
        shipped = sc.broadcast(Items(rows, window))  # of a block: bounded
        open_.append(shipped)

        def fn(batch: pa.RecordBatch, shipped=shipped) -> Iterator[pa.RecordBatch]:
            items = shipped.value
            n, ranges, found = shard_hits(batch.column("text").to_pylist(), items)
            old = batch.column("hits").to_pylist()
            hits = [[{"start": s, "end": e} for s, e in _union([(x["start"], x["end"]) for x in o], r)] for o, r in zip(old, ranges, strict=True)]
            new = [[{"item": items.ids[i], "length": m, "at": p, "item_at": q} for i, m, p, q in f if items.ids[i] is not None] for f in found]
            matches = [_best(o + f) for o, f in zip(batch.column("matches").to_pylist(), new, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("text"), pa.array(n, pa.int64()), pa.array(hits, _HITS), pa.array(matches, _MATCH)],
                ["doc", "text", "n_words", "hits", "matches"],
            )

        df = map_batches(df, fn, schema)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    df = df.select("doc", "n_words", "hits", "matches", n_hit.alias("n_hit"))
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE_ONE_IN * F.col("n_hit") >= F.col("n_words")))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    df = with_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    ids = F.transform("matches", lambda m: m["item"])
    told = F.transform("matches", lambda m: F.concat_ws(":", m["item"], m["length"], m["at"], m["item_at"]))
    return df.select(
        F.col("doc.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("matches").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        "contaminated",
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0).cast("long")).alias("longest"),
        F.array_join(told, ",").alias("matches"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that aren't contaminated, with their columns."""
    return with_hits(docs, benchmark, text_col).where(~F.col("contaminated")).select("doc.*")


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "[array_to_string(w[i : i + n - 1], ' ') for i in range(1, len(w) - n + 2)]"
ORACLE = f"""
WITH iw AS (SELECT row_number() OVER () AS r, CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT r, item, n, unnest({_RUNS}) AS run, unnest(range(0, len(w) - n + 1)) AS item_at FROM (SELECT *, least({WINDOW}, len(w)) AS n FROM iw) WHERE n > 0),
dw AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
dr AS (SELECT doc_id, n, unnest({_RUNS}) AS run, unnest(range(0, len(w) - n + 1)) AS pos FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT dr.doc_id, dr.pos, dr.n, win.r, win.item, win.item_at FROM dr JOIN win ON win.n = dr.n AND win.run = dr.run),
words AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM (SELECT DISTINCT doc_id, pos, n FROM hit)) GROUP BY 1),
island AS (SELECT *, pos - item_at AS shift, pos - row_number() OVER (PARTITION BY doc_id, r, pos - item_at ORDER BY pos) AS i FROM hit WHERE item IS NOT NULL),
run AS (SELECT doc_id, item, n + count(*) - 1 AS length, min(pos) AS pos, min(item_at) AS item_at FROM island GROUP BY doc_id, r, item, n, shift, i),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY length DESC, pos, item_at) AS k FROM run),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids, max(length) AS longest,
  string_agg(concat(item, ':', length, ':', pos, ':', item_at), ',' ORDER BY item) AS matches FROM best WHERE k = 1 GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND {SHARE_ONE_IN} * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0) AS longest, coalesce(matches, '') AS matches
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
