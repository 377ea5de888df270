"""Near-duplicate documents by b-bit MinHash.

A document's set is its distinct five-word shingles (all its words as one, if
fewer).  Documents with one set are one class; classes are linked when their
sets have a resemblance of 0.75 or more.

1. Signature: the minima of 128 permutations; bands of 4 minima each are
   hashed, then only 4 low bits of each minimum are retained, packed in 8 longs.
2. Candidates: members of a band's bucket against its least and its greatest
   member, so a bucket of any size gives a linear number.
3. Estimate: bit counts of the XOR of packed signatures, corrected for values
   that collide in their low bits; far pairs go.
4. Confirm the nearest candidates of each class on the full sets, and join
   linked classes to components.
5. The rest: in each bucket that still spans components, members of different
   components are compared, block by block, by estimate.  A member near one of
   another component is confirmed against all of that component, on full sets.
   So every pair of a bucket is linked, in one component already, or tested;
   there is no cap, and no stage has a row for each pair of a group.

A pair of resemblance 0.75 shares no bucket with a probability of 5e-6.

A node is a class of equal sets, under a number given as classes are written;
so an id that many rows have, or lack, is no hot key.  Rows with one doc_id are
in one component, whatever their texts.  A row without a doc_id is linked by its
text alone; the component_id is the smallest id in the component, null where it
has none, and a row without an id is kept in such a component only.

Words are runs of anything but white space, A-Z lower-cased.  A null or empty
text, or one without words, has an empty set and is linked with nothing: its
component is its own id.  Repeated rows give repeated results; an empty table
gives no rows; other columns of any name are kept or ignored; texts of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import NULL_ID, discard, map_batches, ready, slices, written
from .words import NOT_SPACE, mixed, shingle_hashes, word_hashes

SHINGLE, PERMUTATIONS, ROWS, BITS = 5, 128, 4, 4
BANDS = PERMUTATIONS // ROWS
LONGS = PERMUTATIONS * BITS // 64
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Pairs estimated below this aren't confirmed: five deviations below a link.
NEAR = 0.55
#: Candidates of each class confirmed first.
FIRST = 4
#: Members compared with each other in one block by estimate; pairs of one
#: head confirmed in one group; residents of a component in one group.
BLOCK, GROUP, RESIDENTS = 8192, 64, 256


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return (
        (r.integers(0, 2**32, PERMUTATIONS, np.uint32) | np.uint32(1))[:, None],
        r.integers(0, 2**32, PERMUTATIONS, np.uint32)[:, None],
    )


def minima(shingles: np.ndarray) -> np.ndarray:
    a, b = _permutations()
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, x.shape[1], 2048):
        m = x[:, i : i + 2048] * a
        m += b
        np.minimum(out, m.min(axis=1), out=out)
    return out


def band_keys(minima_: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = np.arange(1, BANDS + 1, dtype=np.uint64)
        for col in minima_.reshape(BANDS, ROWS).T:
            acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + col.astype(np.uint64))
    return acc.view(np.int64)


def packed(minima_: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 16 of them in a long, after a mix that
    makes the low bits depend on all others."""
    with np.errstate(over="ignore"):
        low = ((minima_ * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64).reshape(LONGS, -1)
    shifts = np.arange(low.shape[1], dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low << shifts, axis=1).view(np.int64)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for a, b in slices([len(t or b"") for t in texts], 4 << 20):
        words, starts = word_hashes(texts[a:b], NOT_SPACE)
        for i in range(b - a):
            yield shingle_hashes(words[starts[i] : starts[i + 1]], SHINGLE)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, copy (a hash of the text, for ids that repeat or lack), text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("copy"), F.col(text_col).cast("binary").alias("text"))


_SIG = [f"s{i}" for i in range(LONGS)]


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, copy, n_shingles, digest (of the set), bands, s0.. (packed low bits)."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        import xxhash

        n, digests, bands, sigs = [], [], [], []
        for s in shingle_sets(batch.column("text").to_pylist()):
            n.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            if len(s):
                m = minima(s)
                bands.append(band_keys(m)), sigs.append(packed(m))
            else:
                bands.append(None), sigs.append(np.zeros(LONGS, np.int64))
        packed_ = np.stack(sigs)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("copy"),
                pa.array(n, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                *[pa.array(packed_[:, i]) for i in range(LONGS)],
            ],
            ["doc_id", "copy", "n_shingles", "digest", "bands", *_SIG],
        )

    longs = ", ".join(f"{s} long" for s in _SIG)
    return map_batches(rows, fn, f"doc_id long, copy long, n_shingles long, digest binary, bands array<long>, {longs}")


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Resemblance from packed signatures, corrected for chance collisions."""
    ones = F.lit(0x1111111111111111)
    differ = F.lit(0)
    for x, y in zip(a, b, strict=True):
        v = x.bitwiseXOR(y)
        v = v.bitwiseOR(F.shiftrightunsigned(v, 1))
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        differ = differ + F.bit_count(v.bitwiseAND(ones))
    chance = 2.0**-BITS
    return (1 - differ / PERMUTATIONS - chance) / (1 - chance)


def _size_fits(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _candidates(members: DataFrame, heads: DataFrame, reps: DataFrame) -> DataFrame:
    """a < b, est: members against their bucket's two heads, near by estimate."""
    pairs = (
        members.join(heads, "key")
        .select(F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("hi").alias("b")))).alias("p"))
        .select("p.a", "p.b")
        .where("a < b")
        .groupBy("a", "b")
        .agg(F.lit(1).alias("_"))
        .drop("_")
    )
    side = lambda c: reps.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), *[F.col(s).alias(f"{c}_{s}") for s in _SIG])
    est = estimate([F.col(f"a_{s}") for s in _SIG], [F.col(f"b_{s}") for s in _SIG])
    return (
        pairs.join(side("b"), "b")
        .join(side("a"), "a")
        .where(_size_fits(F.col("n_a"), F.col("n_b")))
        .select("a", "b", est.alias("est"))
        .where(F.col("est") >= NEAR)
    )


_EDGE = "a long, b long"


def _with_sets(rows: DataFrame, reps: DataFrame, needs: DataFrame) -> DataFrame:
    """(group columns, node, role, shingles): each node's set, made once from
    its whole text, for every group that needs it.

    needs: node, group (a struct).  Rows with one id and text are one before
    they are dealt.  Both sides are merged at every size, which can spill.
    """
    key = [F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "copy"]
    needs = needs.groupBy("node").agg(F.collect_list("group").alias("groups")).join(reps.select("node", "id", "copy"), "node")
    once = rows.groupBy(*key).agg(F.first("text").alias("text"))
    texts = once.join(needs.hint("merge"), ["id", "copy"]).select("node", "text", "groups")
    group = dict(texts.dtypes)["groups"]

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            made = [s.view(np.int64) for s in shingle_sets(part.column("text").to_pylist())]
            values = np.concatenate([np.zeros(0, np.int64), *made])
            ends = np.concatenate([[0], np.cumsum([len(s) for s in made])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), part.column("groups"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "groups", "shingles"]
            )

    made = map_batches(texts, sets, f"node long, groups {group}, shingles array<long>")
    return made.select("node", F.explode("groups").alias("g"), "shingles").select("g.*", "node", "shingles")


def _first_links(table: pa.Table) -> list[tuple[int, int]]:
    """(visitor, resident): for each visitor the first resident that it is
    linked with, by an index of the residents' shingles."""
    ids, role = table.column("node").to_numpy(), table.column("role").to_numpy()
    lists = table.column("shingles").combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    at = [values[ends[i] : ends[i + 1]] for i in range(len(ids))]
    homes = np.flatnonzero(role == 0)
    none = np.zeros(0, np.int64)
    terms = np.concatenate([none, *[at[i] for i in homes]])
    owner = np.repeat(np.arange(len(homes)), [len(at[i]) for i in homes])
    order = np.argsort(terms, kind="stable")
    terms, owner = terms[order], owner[order]
    sizes = np.array([len(at[i]) for i in homes], np.int64)
    out: dict[int, int] = {}
    for v in np.flatnonzero(role == 1):
        if int(ids[v]) in out or not len(homes):
            continue
        lo, hi = np.searchsorted(terms, at[v]), np.searchsorted(terms, at[v], side="right")
        n = hi - lo
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(owner[where], minlength=len(homes))
        hit = np.flatnonzero((100 * both >= PERCENT * (len(at[v]) + sizes - both)) & (both > 0) & (ids[homes] != ids[v]))
        if len(hit):
            out[int(ids[v])] = int(ids[homes[hit[0]]])
    return list(out.items())


def _linked(made: DataFrame, *keys: str) -> DataFrame:
    n = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def test(table: pa.Table) -> pa.Table:
        links = _first_links(table)
        return pa.table({"a": pa.array([b for _, b in links], pa.int64()), "b": pa.array([a for a, _ in links], pa.int64())})

    return made.repartition(n, *keys).groupBy(*keys).applyInArrow(test, _EDGE)


def confirmed(pairs: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) linked on their full sets.

    Pairs of one ``a`` are dealt to groups of about GROUP.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("salts"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    to = lambda role: F.struct("a", "salt", F.lit(role).alias("role")).alias("group")
    heads = dealt.groupBy("a", "salt").agg(F.lit(1).alias("_")).select(F.col("a").alias("node"), to(0))
    return _linked(_with_sets(rows, reps, dealt.select(F.col("b").alias("node"), to(1)).unionByName(heads)), "a", "salt")


def confirmed_with(visits: DataFrame, labels: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) of visitors with any member of the components they visit.

    visits: node, comp.  A component's members are dealt to groups of about
    RESIDENTS; a visitor goes to all of them and is linked once in each.
    """
    asked = visits.groupBy("comp").agg(F.lit(1).alias("_")).select("comp")
    homes = labels.join(asked, "comp").select("node", "comp").unionByName(
        asked.join(labels.select(F.col("node").alias("comp")), "comp", "left_anti").select(F.col("comp").alias("node"), "comp")
    )
    counts = homes.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / RESIDENTS).alias("salts"))
    to = lambda role: F.struct("comp", F.col("salt").cast("long").alias("salt"), F.lit(role).alias("role")).alias("group")
    dealt = homes.join(counts, "comp").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts"))).select("node", to(0))
    calls = visits.join(counts, "comp").withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int")))).select("node", to(1))
    return _linked(_with_sets(rows, reps, dealt.unionByName(calls)), "comp", "salt")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of every node with an edge.

    Labels go down along edges and jump to the label of their label, until
    none changes; each round is written.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        other = labels.select(F.col("node").alias("b"), F.col("comp").alias("c"))
        near = both.join(other, "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        moved = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        jump = moved.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        new = written(moved.join(jump, "comp").select("node", "was", F.least("comp", "to").alias("comp")), "labels")
        discard(labels)
        if new.where("comp < was").isEmpty():
            discard(both)
            return new.select("node", "comp")
        labels = written(new.select("node", "comp"), "labels")
        discard(new)


def _visits(members: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, comp): nodes near, by estimate, a member of another component in
    a common bucket, the smaller component (then the later one) visiting.

    A pair counts in the first bucket that its two members share, so it is
    told once, however many bands they have in common."""
    sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    lab = labels.join(sizes, "comp").select(F.col("node").alias("n"), "comp", "size")
    at = members.join(lab, members["node"] == lab["n"], "left")
    at = written(at.select("key", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size")), "members")
    open_ = (
        at.groupBy("key")
        .agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
        .where("c0 < c1")
        .select("key", "nb")
    )
    mine = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    with_blocks = at.join(open_, "key").withColumn("k", mine).join(reps.select("node", "n_shingles", "bands", *_SIG), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")
    dealt = with_blocks.select("*", other).withColumn("i", F.least("k", "o")).withColumn("j", F.greatest("k", "o"))
    most = int(PERMUTATIONS * (1 - (NEAR * (1 - 2.0**-BITS) + 2.0**-BITS)))

    def test(table: pa.Table) -> pa.Table:
        node, comp, size, n, k = (table.column(c).to_numpy() for c in ("node", "comp", "size", "n_shingles", "k"))
        sig = np.stack([table.column(s).to_numpy() for s in _SIG], axis=1).view(np.uint64)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        band = int(np.flatnonzero(bands[0] == table.column("key")[0].as_py())[0])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(k == i), np.flatnonzero(k == j)
        found: set[tuple[int, int]] = set()
        for x in left:
            y = right[right > x] if i == j else right
            y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= PERCENT * np.maximum(n[y], n[x]))]
            if not len(y):
                continue
            v = sig[y] ^ sig[x]
            v |= v >> np.uint64(1)
            v |= v >> np.uint64(2)
            y = y[np.bitwise_count(v & np.uint64(0x1111111111111111)).sum(axis=1) <= most]
            y = y[np.argmax(bands[y] == bands[x], axis=1) == band]
            goes = (size[x] < size[y]) | ((size[x] == size[y]) & (comp[x] > comp[y]))
            found.update((int(node[x]), c) for c in comp[y[goes]].tolist())
            found.update((c, int(comp[x])) for c in node[y[~goes]].tolist())
        return pa.table({"node": pa.array([a for a, _ in found], pa.int64()), "comp": pa.array([b for _, b in found], pa.int64())})

    # as many tasks as there are partitions: rows are few and small, work is not
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = dealt.repartition(n, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(test, "node long, comp long")
    return out.groupBy("node", "comp").agg(F.lit(1).alias("_")).drop("_")


def _same_id(sigs: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes that rows of one doc_id are in."""
    rows = sigs.where("n_shingles > 0 and doc_id is not null").select("doc_id", "digest")
    several = rows.groupBy("doc_id").agg(F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("d0 != d1")
    nodes = reps.select("digest", "node")
    pairs = rows.join(several, "doc_id").where("digest != d0").groupBy("digest", "d0").agg(F.lit(1).alias("_"))
    return pairs.join(nodes.withColumnRenamed("node", "b"), "digest").join(nodes.select(F.col("digest").alias("d0"), F.col("node").alias("a")), "d0").select("a", "b")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, copy, n_shingles, component_id, kept, a row for each of ``docs``."""
    ready(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    sigs = written(signatures(rows), "signatures")
    row = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "copy")
    shape = F.struct("n_shingles", "bands", *_SIG)
    first = sigs.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.min(row).alias("at"), F.first(shape).alias("x"))
    numbered = first.select(F.monotonically_increasing_id().alias("node"), "digest", "least_id", "at.*", "x.*")
    reps = written(numbered, "classes")  # the numbers hold from here on
    band = reps.select("node", F.explode("bands").alias("key"))
    heads = band.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    heads = written(heads, "heads")
    members = written(band.join(heads.select("key"), "key"), "bucket-members")
    near = written(_candidates(members, heads, reps), "candidates")
    # the nearest partners of each class first; it has as many as bands, at most twice
    order = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("est"), "a"))
    told = written(near.withColumn("r", order).where(F.col("r") <= FIRST).select("a", "b"), "first")
    links = written(confirmed(told, rows, reps).unionByName(_same_id(sigs, reps)), "links")
    discard(heads, near, told)
    labels = components(links)
    visits = written(_visits(members, reps, labels), "visits")
    more = written(confirmed_with(visits, labels, rows, reps), "more-links")
    discard(members, visits)
    labels = components(links.unionByName(more))
    discard(links, more)
    of = reps.select("node", "digest", "least_id").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = of.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    label = of.join(least, "comp").select("digest", "component_id", F.lit(True).alias("found"))
    comp = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        sigs.select("doc_id", "copy", "n_shingles", "digest")
        .join(label, "digest", "left")
        .select("doc_id", "copy", "n_shingles", comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return _marked(docs, id_col, text_col).drop("copy")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are kept, as they are."""
    key = lambda i: F.coalesce(i.cast("long"), F.lit(NULL_ID))
    marked = _marked(docs, id_col, text_col).where("kept")
    kept = marked.groupBy(key(F.col("doc_id")).alias("id"), "copy").agg(F.lit(1).alias("_")).drop("_")
    at = F.struct(key(F.col(id_col)).alias("id"), F.xxhash64(F.col(text_col)).alias("copy"))
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), at.alias("at"))
    found = whole.join(kept, (F.col("at.id") == kept["id"]) & (F.col("at.copy") == kept["copy"]), "left_semi")
    return found.select("doc.*")
