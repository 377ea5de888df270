"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of
prime size; shards take turns claiming their next free slot until all are
taken.  A key's slot is its hash modulo the size, and the broadcast table gives
the shard: constant time for a key, no shuffle, no hot shard by construction.
Adding or removing a shard moves few slots besides those it gains or loses.

The table has ``size`` rows whatever the input, so broadcasting it is bounded.
A null key is placed as the empty string.  Equal keys share a shard; repeated
rows are placed alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Production table: slots (a prime, over 100 for each shard) and shards.
SIZE, SHARDS = 65537, 128
MAX_SIZE = 1 << 22


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:04d}" for i in range(n)]


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: Sequence[str], size: int = SIZE, weights: Sequence[int] | None = None) -> list[int]:
    """Slot -> index of the shard that claimed it.

    ``weights``: turns a shard takes in each round (1 by default).
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not is_prime(size) or not len(shards) <= size <= MAX_SIZE:
        raise ValueError("size must be a prime, at least the number of shards and at most MAX_SIZE")
    turns = list(weights or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("one weight of at least 1 for each shard")
    at = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            for _ in range(turns[i]):
                while left and table[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % size
                if left:
                    table[at[i]], left = i, left - 1
    return table


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """slot, shard: the table as rows, made by one literal on the JVM."""
    rows = F.from_json(F.lit(json.dumps(list(table))), "array<int>")
    return spark.range(1).select(F.posexplode(rows).alias("slot", "shard"))


def slot_of(key: Column, size: int) -> Column:
    """60 bits of the key's MD5, modulo the size."""
    h = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return (h % size).cast("int")


def placed(docs: DataFrame, key: str = "doc_id", table: Sequence[int] | None = None) -> DataFrame:
    """doc_id, slot, shard for every row, by the broadcast table."""
    table = table or lookup_table(shard_names())
    slots = F.broadcast(table_frame(docs.sparkSession, table))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), slot_of(F.col(key), len(table)).alias("slot"))
    return keyed.join(slots, "slot").select("doc_id", F.col("slot").cast("long").alias("slot"), F.col("shard").cast("long").alias("shard"))


def moved_share(before: Sequence[int], after: Sequence[int]) -> float:
    return sum(a != b for a, b in zip(before, after, strict=True)) / len(before)


def oracle() -> str:
    table = ",".join(map(str, lookup_table(shard_names())))
    return f"""
WITH t AS (SELECT CAST(string_split('{table}', ',') AS BIGINT[]) AS shards),
k AS (SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {SIZE} AS slot FROM documents)
SELECT doc_id, slot, shards[slot + 1] AS shard FROM k, t"""
