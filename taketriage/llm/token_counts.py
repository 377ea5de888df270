"""Token counts from the exact histogram of encoded lengths.

Documents are aggregated by encoded length; suffix sums of that histogram then
answer totals, quantiles and truncated totals for every context limit without
another look at the documents.  Between two lengths that occur, a truncated
total is linear in the limit, so one row per length that occurs answers all.

The histogram is written once; every text is encoded once.  Suffix sums go by
digits of the length: what is longer has the same digits before some place and
a greater one there.  So no window has more rows than a digit has values,
whatever the lengths.

A null or empty text has length 0.  An empty table gives no rows.  Repeated
rows count each time.  Other columns of any name are ignored.  Texts of any
length are encoded whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .bpe import token_lengths
from .shared import written

#: Bits of a digit of a length.
DIGIT = 6


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """n_tokens, n_docs.  Map-side partial counts: no key is hot."""
    return lengths.groupBy(F.col(length).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, digit: int = DIGIT) -> DataFrame:
    """For each length that occurs, taken as the context limit.

    n_tokens (the limit), n_docs (of just that length), docs_over,
    tokens_over (documents longer than the limit, and their tokens),
    total_docs, total_tokens, truncated_tokens (every document cut at the
    limit), lost_tokens, share_within (of documents; the length is the
    quantile of every q up to it).
    """
    hist = hist.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"))
    total = hist.agg(F.sum("n_docs").alias("total_docs"), F.sum("tokens").alias("total_tokens"), F.max("n_tokens").alias("longest"))
    longest = total.first()["longest"] or 0
    sums = hist.withColumns({"d": F.lit(0).cast("long"), "t": F.lit(0).cast("long")})
    for place in range(0, max(1, longest.bit_length()), digit):
        upto, above = (F.shiftright("n_tokens", n).alias(c) for n, c in ((place, "upto"), (place + digit, "above")))
        cells = hist.groupBy(upto, above).agg(F.sum("n_docs").alias("cd"), F.sum("tokens").alias("ct"))
        after = Window.partitionBy("above").orderBy(F.desc("upto")).rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.select("upto", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(c) for c in ("cd", "ct")])
        sums = sums.withColumn("upto", upto).join(cells, "upto").select("n_tokens", "n_docs", (F.col("d") + F.col("cd")).alias("d"), (F.col("t") + F.col("ct")).alias("t"))
    return (
        sums.crossJoin(F.broadcast(total.drop("longest")))  # one row
        .select("n_tokens", "n_docs", F.col("d").alias("docs_over"), F.col("t").alias("tokens_over"), "total_docs", "total_tokens")
        .withColumn("lost_tokens", F.col("tokens_over") - F.col("n_tokens") * F.col("docs_over"))
        .withColumn("truncated_tokens", F.col("total_tokens") - F.col("lost_tokens"))
        .withColumn("share_within", 1 - F.col("docs_over") / F.col("total_docs"))
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length with a share of ``q`` of documents within it."""
    return sums.where(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def at_limit(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_tokens for any limits: they are lengths that
    no document has, if none has."""
    asked = hist.sparkSession.range(1).select(F.explode(F.lit(sorted(set(limits))).cast("array<bigint>")).alias("n_tokens"), F.lit(0).cast("long").alias("n_docs"))
    both = hist.select("n_tokens", "n_docs").unionByName(asked).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    sums = suffix_sums(both).join(asked.select("n_tokens"), "n_tokens", "left_semi")
    return sums.select(F.col("n_tokens").alias("limit"), "docs_over", "truncated_tokens")


def token_count_sums(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    return suffix_sums(written(histogram(token_lengths(docs, ranks_path, pattern)), "lengths"))
