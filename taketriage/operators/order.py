"""Sums along an order over all rows, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.session import cut


def running(rows: DataFrame, by: list[str], **sums: str) -> DataFrame:
    """Adds, for each name, the sum of a column over all rows before in the
    order of ``by``; equal rows have the order in which they lie.

    Rows are dealt by ranges of ``by`` and written, so that the parts hold;
    sums run within parts, and over the parts' totals, one row a part.
    """
    parts = cut(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    totals = parts.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda x, c: F.coalesce(x, F.lit(0).cast(dict(rows.dtypes)[c]))
    starts = totals.select("__part", *[zero(F.sum(f"__{n}").over(earlier), c).alias(f"__{n}") for n, c in sums.items()])
    inner = Window.partitionBy("__part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)

    def before(n: str, c: str) -> Column:
        return (F.col(f"__{n}") + zero(F.sum(c).over(inner), c)).alias(n)

    return parts.join(F.broadcast(starts), "__part").select(*rows.columns, *[before(n, c) for n, c in sums.items()])
