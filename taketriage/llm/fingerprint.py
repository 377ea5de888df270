"""Document fingerprints: a threshold-scaled sketch, in SQL functions only.

Of all five-word shingle hashes (64 bits) every one below a fixed fraction of
the range is retained, whatever the length of the text, and nothing else: so
the sketch of a union is the union of the sketches, and the share of a text's
retained hashes that another text retains estimates how much of it the other
contains, however unequal they are.  Where a text retains none (short texts
may), its containment is null: it can't be told.  The least of all hashes goes
with the sketch; it stands for the text only where neither of two texts retains
any, for their likeness and in the written fingerprint (after a ``~``).

Words are runs of anything but white space (space, \\t to \\r), lower-cased; a
text of one to four words has its whole sequence as one shingle.  A null text
counts as empty.  Two texts without words are alike (1.0), one of them and
another are not (0.0).  Equal texts have equal fingerprints.

"Next" is the next row by (doc_id, text), after the last the first; so a table
of one row is its own next.  A null doc_id sorts first.  Repeated rows follow
each other; an empty table gives no rows; other columns of any name are
ignored; texts of any length are sketched whole.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import NULL_ID, id_text

WORDS = 5
#: One shingle in so many is retained.
SCALE = 4
#: Buckets of consecutive ids for each shuffle partition.
BUCKETS = 8


def with_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE) -> DataFrame:
    """Adds ``out``, the sketch of column ``text``: struct<least: bigint, kept:
    sorted distinct array<bigint>>; least is null without words."""
    w, s = f"__{out}_words", f"__{out}_shingles"
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    df = df.withColumn(w, words)
    n = F.size(w)
    at = lambda i: F.xxhash64(*[F.get(F.col(w), i + k) for k in range(WORDS)])
    shingles = (
        F.when(n >= WORDS, F.transform(F.sequence(F.lit(0), n - WORDS), at))
        .when(n > 0, F.array(F.xxhash64(F.col(w))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    kept = F.sort_array(F.array_distinct(F.filter(s, lambda h: h < _limit(scale))))
    return df.withColumn(s, shingles).withColumn(out, F.struct(F.array_min(s).alias("least"), kept.alias("kept"))).drop(w, s)


def _limit(scale: int) -> int:
    return min(-(2**63) + 2**64 // scale, 2**63 - 1)


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of the shingle sets."""
    common = F.size(F.array_intersect(a["kept"], b["kept"]))
    union = F.size(a["kept"]) + F.size(b["kept"]) - common
    return F.when(union > 0, common / union).otherwise(F.when(a["least"].eqNullSafe(b["least"]), 1.0).otherwise(0.0))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; null if ``a`` retains none."""
    return F.try_divide(F.size(F.array_intersect(a["kept"], b["kept"])), F.size(a["kept"]))


def merged(a: Column, b: Column) -> Column:
    """The sketch of the union of the shingle sets."""
    return F.struct(F.least(a["least"], b["least"]).alias("least"), F.sort_array(F.array_union(a["kept"], b["kept"])).alias("kept"))


def as_text(sketch: Column) -> Column:
    hexed = lambda h: F.lpad(F.hex(h), 16, "0")
    least = F.coalesce(F.concat(F.lit("~"), hexed(sketch["least"])), F.lit(""))
    return F.when(F.size(sketch["kept"]) > 0, F.array_join(F.transform(sketch["kept"], hexed), ",")).otherwise(least)


def _bucket(bounds: Column, n: int, key: Column) -> Column:
    """Index of the last bound that is at most ``key``, by halving."""
    steps = max(1, math.ceil(math.log2(max(n, 2))) + 1)
    state = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        up = F.get(bounds, mid) <= key
        more = acc["hi"] - acc["lo"] > 1
        return F.struct(
            F.when(more & up, mid).otherwise(acc["lo"]).alias("lo"), F.when(more & ~up, mid).otherwise(acc["hi"]).alias("hi")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, halve)["lo"]


def with_next(df: DataFrame, columns: list[str], id_col: str = "doc_id", tie: str = "text") -> DataFrame:
    """Adds ``next_<c>`` of the next row by (id, tie), the first after the last.

    One shuffle: rows go to buckets of consecutive ids, whose bounds are ids
    that occur (as many as a few for each shuffle partition).  The first row of
    a bucket also goes, as a guest, to the bucket before.
    """
    spark = df.sparkSession
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col), F.lit(NULL_ID))
    probs = F.from_json(F.lit(json.dumps([i / n for i in range(n)])), "array<double>")
    found = df.agg(F.percentile_approx(key, probs, F.lit(max(10_000, 20 * n))).alias("b")).first()["b"]
    ids = sorted(set(found or [0]))
    bounds, m = F.from_json(F.lit(json.dumps(ids)), "array<bigint>"), len(ids)
    df = df.withColumn("__key", key).withColumn("__b", _bucket(bounds, m, F.col("__key")))
    first = F.get(bounds, F.col("__b")) == F.col("__key")
    own, guest = F.struct(F.col("__b").alias("b"), F.lit(0).alias("guest")), F.struct(((F.col("__b") + m - 1) % m).alias("b"), F.lit(1).alias("guest"))
    df = df.withColumn("__to", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    w = Window.partitionBy("__to.b").orderBy("__to.guest", "__key", tie)
    df = df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return df.where("__to.guest = 0").drop("__key", "__b", "__to")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (a sketch)."""
    return with_sketch(id_text(docs, id_col, text_col), "text", "fingerprint", scale).drop("text")


def fingerprint_digest(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness, how
    much of either the other contains, and how much the next text does."""
    df = id_text(docs).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    df = with_next(with_sketch(df, "text", "fp", scale), ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half))
    df = df.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    df = with_sketch(df, "edited", "edited_fp", scale)
    fp, edited_fp, next_fp = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(fp).alias("fingerprint"),
        as_text(edited_fp).alias("edited_fingerprint"),
        likeness(fp, edited_fp).alias("near_edited"),
        likeness(fp, next_fp).alias("near_next"),
        F.size("fp.kept").cast("long").alias("n_retained"),
        containment(fp, edited_fp).alias("contained_in_edited"),
        containment(edited_fp, fp).alias("edited_contained"),
        containment(fp, next_fp).alias("contained_in_next"),
    )
