"""What the operators share: table access, the shared folder, Arrow passes."""

from __future__ import annotations

import atexit
import os
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A null doc_id takes part in keyed steps as this value, below any other id.
NULL_ID = -(2**63)
#: Bytes of text that are Python objects at once (one row at least).
SLICE_BYTES = 8 << 20

_RUN = uuid.uuid4().hex
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_cleaned: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Lets Python workers started by this session import this package."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Without that setting there is one only where all run in one process (as in
    tests), below the warehouse; on a cluster it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's name for an intermediate table of this process, which
    deletes them all when it ends."""
    root = f"{shared_dir(spark)}/llm-{_RUN}"
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_delete_at_exit, spark, root)
    return f"{root}/{what}-{uuid.uuid4().hex}"


def _delete_at_exit(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session may have been stopped before
        delete_folder(spark, root)


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    This cuts the lineage; a lost executor costs no recomputation of it.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    out = df.write.partitionBy(by) if by else df.write
    out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _folders[back] = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes written frames that nothing will read again."""
    for df in frames:
        if path := _folders.pop(df, None):
            delete_folder(df.sparkSession, path)


def by_bytes(batch: pa.RecordBatch, column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for a, b in slices(lengths, most):
        yield batch.slice(a, b - a)


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, column: str | int = "text"
) -> DataFrame:
    """A narrow Arrow pass; ``fn`` gets slices of bounded bytes of ``column``
    and yields batches."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in by_bytes(batch, column):
                    yield from fn(part)

    return df.mapInArrow(run, schema)


def slices(lengths: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive [a, b) row ranges of at most ``most`` in sum, one row at least."""
    a, total = 0, 0
    for i, n in enumerate(lengths):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, so that other columns can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
