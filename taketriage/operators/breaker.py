"""Doomed shots: the odds that a shot's usable yield is below the floor."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.kernels import CONFIDENCE, FLOOR, doom_probability


def breaker_states(takes: DataFrame, floor: float = FLOOR, confidence: float = CONFIDENCE) -> DataFrame:
    """By shot (not empty): takes, mechanical_kills, doom_probability, doomed,
    worst (the mechanical kill ranked deepest).

    takes: clip, shot, verdict, judged (a judge's block exists), rank_in_shot.
    """
    mech = (F.col("verdict") == "kill") & ~F.coalesce("judged", F.lit(False))
    df = takes.where("verdict is not null and shot is not null and shot != ''").groupBy("shot").agg(
        F.count(F.lit(1)).alias("takes"),
        F.count_if(mech).alias("mechanical_kills"),
        F.min_by("clip", F.when(mech, F.struct(-F.coalesce("rank_in_shot", F.lit(0)), "clip"))).alias("worst"),
    )
    p = doom_probability(F.col("mechanical_kills"), F.col("takes") - F.col("mechanical_kills"), floor)
    df = df.withColumn("doom_probability", p)
    return df.withColumn("doomed", F.col("doom_probability") >= confidence)
