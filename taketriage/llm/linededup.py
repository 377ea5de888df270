"""Line dedup with levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z lower-cased.
Documents come in batches.  A batch's keys are counted; those that a run has
settled (found in enough documents, with a largest id that the batch doesn't
pass) are anti-joined away, and the rest are written as a run of the lowest
level.  When a level has ``FAN`` runs, they are merged into one of the next
level.  All runs together tell the keys found in ``MIN_DOCS`` documents or
more, and the largest id of each.

Runs are tables bucketed and sorted by key, so neither a merge nor the
anti-join deals them anew: only a batch's own counts go over the network.  A
manifest in the runs' folder lists them; :meth:`LineRuns.open` goes on from it
in another session, and a later batch of documents meets all earlier ones.

Within one table, batches are ranges of descending ids.  Keys are compared as
128-bit hashes.  Counts are pre-aggregated, so that a line in a third of all
documents is a row for each task.

A null or empty text is one empty line.  A null doc_id counts as the smallest
id.  Rows with one doc_id are one document to the counts; each row gets its
result, by id and text, so no id is hot.  An empty table gives no rows.  Other
columns of any name are kept or ignored.  Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .shared import NULL_ID, delete_folder, discard, map_batches, scratch, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Batches of one table (each a distributed job of any size), runs of a level.
BATCHES, FAN = 4, 2
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()  # of bytes: A-Z only


def counted(key: bytes, min_chars: int = MIN_CHARS) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def key_hash(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


def _identity(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id, and a hash of the text for ids that repeat."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("copy")]


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, copy, key: hashes of each row's distinct counted keys."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        of, keys = [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            if t:
                own = {k for line in t.split(b"\n") if len(k := line_key(line)) >= min_chars}
                own = [key_hash(k) for k in own if counted(k, min_chars)]
                of += [i] * len(own)
                keys += own
        at = pa.array(of, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("copy").take(at), pa.array(keys, pa.binary())], ["doc_id", "copy", "key"])

    rows = docs.select(*_identity(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    return map_batches(rows, fn, "doc_id long, copy long, key binary")


class LineRuns:
    """Levels of runs (key, n_docs, last_id) in a folder.

    ``n_docs`` counts on only until a key is settled; it tells "enough" right,
    as each document comes in one batch.
    """

    _SCHEMA = "key BINARY, n_docs BIGINT, last_id BIGINT"

    def __init__(self, spark: SparkSession, path: str | None = None, min_docs: int = MIN_DOCS, fan: int = FAN, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path or scratch(spark, "line-runs")
        self.min_docs, self.fan = min_docs, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineRuns:
        """The runs that the newest manifest in a folder lists."""
        lines = spark.read.option("pathGlobFilter", "manifest-*.json").text(path)
        newest = lines.orderBy(F.desc(F.col("_metadata.file_name"))).first()
        if newest is None:
            raise FileNotFoundError(f"{path}: no manifest")
        doc = json.loads(newest["value"])
        runs = cls(spark, path, doc["min_docs"], doc["fan"], doc["buckets"])
        runs.levels, runs.version = doc["levels"], doc["version"]
        return runs

    def _save(self) -> None:
        """A manifest is a new file, put in place by its rename."""
        self.version += 1
        doc = {"version": self.version, "min_docs": self.min_docs, "fan": self.fan, "buckets": self.buckets, "levels": self.levels}
        jvm = self.spark.sparkContext._jvm
        name = lambda v: jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{v:08d}.json")
        new = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.new-{uuid.uuid4().hex}")
        fs = new.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(new)
        out.write(bytearray(json.dumps(doc).encode()))
        out.close()
        if not fs.rename(new, name(self.version)):
            raise RuntimeError(f"{self.path}: version {self.version} exists: another writer is at work")
        fs.delete(name(self.version - 1), False)

    def _run(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({self._SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one, bucket by bucket."""
        x, y = self._run(a).alias("x"), self._run(b).alias("y")
        n = F.coalesce("x.n_docs", F.lit(0)) + F.coalesce("y.n_docs", F.lit(0))
        both = x.join(y, F.col("x.key") == F.col("y.key"), "full_outer")
        return both.select(F.coalesce("x.key", "y.key").alias("key"), n.alias("n_docs"), F.greatest("x.last_id", "y.last_id").alias("last_id"))

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _merge(self, names: list[str]) -> tuple[str, list[str]]:
        """The runs as one; and those that it takes the place of."""
        one, gone = names[0], []
        for name in names[1:]:
            gone += [one, name]
            one = self._write(self._merged(one, name))
        return one, gone

    def _put(self, name: str, level: int) -> list[str]:
        """Adds a run to a level, and merges while that is full."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) < self.fan:
            return []
        one, gone = self._merge(self.levels[level])
        self.levels[level] = []
        return gone + self._put(one, level + 1)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_folder(self.spark, f"{self.path}/{name}")

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of documents, as rows with doc_id and key."""
        once = keys.groupBy("doc_id", "key").agg(F.lit(1).alias("n"))
        new = once.groupBy("key").agg(F.sum("n").alias("n_docs"), F.max("doc_id").alias("last_id"))
        new = new.repartition(self.buckets, "key")
        for name in self._names():  # a handful: one or two of a level
            settled = self._run(name).where(F.col("n_docs") >= self.min_docs).select(F.col("key").alias("known"), F.col("last_id").alias("up_to"))
            new = new.join(settled, (F.col("key") == F.col("known")) & (F.col("up_to") >= F.col("last_id")), "left_anti")
        gone = self._put(self._write(new), 0)
        self._save()
        self._drop(gone)

    def compact(self) -> None:
        """All runs as one, of the highest level."""
        if len(names := self._names()) > 1:
            one, gone = self._merge(names)
            self.levels = [[] for _ in self.levels[:-1]] + [[one]]
            self._save()
            self._drop(gone)

    def common(self) -> DataFrame:
        """key, last_id of the keys found in enough documents."""
        self.compact()
        rows = self._run(self._names()[0]) if self._names() else self.spark.createDataFrame([], self._SCHEMA)
        return rows.where(F.col("n_docs") >= self.min_docs).select("key", "last_id")

    def delete(self) -> None:
        self._drop(self._names())
        delete_folder(self.spark, self.path)


def _batch(ids: DataFrame, n: int) -> Column:
    """Number of a doc_id's batch: ranges of about the same size, of descending ids."""
    found = ids.agg(F.percentile_approx("doc_id", F.lit([i / n for i in range(1, n)] or [0.5]), F.lit(1000)).alias("b")).first()["b"]
    below = [(F.col("doc_id") < b).cast("int") for b in sorted(set(found or []))[: n - 1]]
    return sum(below, F.lit(0))


def common_lines(keys: DataFrame, batches: int = BATCHES, min_docs: int = MIN_DOCS, fan: int = FAN) -> DataFrame:
    """key, last_id of common lines, batch by batch through the runs.

    keys: doc_id, batch, key."""
    runs = LineRuns(keys.sparkSession, None, min_docs, fan)
    for i in range(batches):
        runs.add(keys.where(F.col("batch") == i).select("doc_id", "key"))
    common = written(runs.common(), "common-lines")
    runs.delete()
    return common


def with_drops(docs: DataFrame, batches: int = BATCHES, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, text_col: str = "text") -> DataFrame:
    """A struct of the row (``doc``), its text, and ``drops``, hashes of the keys it loses."""
    batch = _batch(docs.select(*_identity("doc_id", text_col)), batches)
    keys = written(line_keys(docs, min_chars, text_col=text_col).withColumn("batch", batch), "line-keys", by="batch")
    # written: the join then deals both sides itself, and can split a common key
    common = common_lines(keys, batches, min_docs)
    lost = written(
        keys.join(common, "key")
        .where(F.col("doc_id") < F.col("last_id"))
        .groupBy("doc_id", "copy")
        .agg(F.collect_set("key").alias("drops")),
        "lost-lines",
    )
    discard(keys, common)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), *_identity("doc_id", text_col))
    # a merge join at every size: it can spill, and a hot partition can be split
    done = rows.join(lost.hint("merge"), ["doc_id", "copy"], "left")
    return done.select("doc", F.col(f"doc.`{text_col}`").cast("binary").alias("text"), "drops")


def kept_lines(text: bytes | None, drops: set[bytes]) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, the text of the lines that stay."""
    lines = (text or b"").split(b"\n")
    if not drops:
        return len(lines), 0, text or b""
    kept = [x for x in lines if not (len(k := line_key(x)) >= 1 and key_hash(k) in drops)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def line_digest(docs: DataFrame) -> DataFrame:
    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, m, h = [], [], []
        for t, d in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist(), strict=True):
            a, b, kept = kept_lines(t, set(d or ()))
            n.append(a), m.append(b), h.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(h, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )

    df = with_drops(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return map_batches(df.select("doc.doc_id", "text", "drops"), fn, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def deduplicated(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Every row with the lines it keeps as its text (and their length, where
    the table has that column)."""
    rows = with_drops(docs, text_col=text_col)
    schema = T.StructType([rows.schema["doc"], T.StructField("text", T.StringType())])

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = [
            None if t is None else (kept_lines(t, set(d))[2] if d else t).decode()
            for t, d in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.string())], ["doc", "text"])

    done = map_batches(rows, fn, schema)
    own = {text_col: F.col("text"), chars_col: F.length("text").cast("long")}
    return done.select(*[own.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


ORACLE = r"""
WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id < c.last_id AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id"""
