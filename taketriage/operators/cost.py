"""Judge and generation spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values
MTOK = 1e6


def usage_usd(rate_in: Column, rate_out: Column) -> Column:
    return (F.col("prompt_tokens") * F.coalesce(rate_in, F.lit(0.0)) + F.col("completion_tokens") * F.coalesce(rate_out, F.lit(0.0))) / MTOK


def cost_block(takes: DataFrame, usage: DataFrame, prices: DataFrame, clip_usd: float | None = None) -> DataFrame:
    """(clip, vlm_usd, clip_usd, total_usd, unpriced array): a take's spend.

    Engines without a price are named, never priced at zero; engines without
    calls don't count.
    """
    p = F.broadcast(prices.select("engine", "input", "output", F.lit(True).alias("priced")))
    rows = usage.where("calls > 0").join(p, "engine", "left")
    usd = F.when(F.col("priced"), usage_usd(F.col("input"), F.col("output"))).otherwise(0.0)
    sums = rows.groupBy("clip").agg(
        F.sum(usd).alias("vlm_usd"), F.sort_array(F.collect_set(F.when(F.col("priced").isNull(), F.col("engine")))).alias("unpriced")
    )
    flat = F.lit(clip_usd).cast("double")
    return takes.select("clip").join(sums, "clip", "left").select(
        "clip",
        F.coalesce("vlm_usd", F.lit(0.0)).alias("vlm_usd"),
        flat.alias("clip_usd"),
        (F.coalesce("vlm_usd", F.lit(0.0)) + F.coalesce(flat, F.lit(0.0))).alias("total_usd"),
        F.coalesce("unpriced", F.array().cast("array<string>")).alias("unpriced"),
    )


def cost_summary(takes: DataFrame) -> DataFrame:
    """Overall (shot null) and by shot: takes with a cost, total, usable (all
    takes that aren't killed), per usable take (null if none).  Groups without
    a cost are left out."""
    shot = F.coalesce(F.nullif("shot", F.lit("")), F.lit("untagged"))
    usable = F.coalesce(F.col("verdict") != "kill", F.lit(True))
    rows = takes.select(shot.alias("shot"), "total_usd", usable.alias("usable"))
    sums = rows.rollup("shot").agg(F.count("total_usd").alias("takes"), F.sum("total_usd").alias("total_usd"), F.count_if("usable").alias("usable"))
    return sums.where("takes > 0").withColumn("per_usable", F.try_divide("total_usd", "usable"))


def cost_doc(takes: DataFrame) -> dict | None:
    """The spend of a batch as published: in all, and by shot."""
    rows = {r["shot"]: r for r in cost_summary(takes).collect()}  # a row a shot
    rnd = lambda x: None if x is None else round(x, 4)
    told = {shot: {"total_usd": rnd(r["total_usd"]), "usable_takes": r["usable"], "usd_per_usable": rnd(r["per_usable"])} for shot, r in rows.items()}
    return told.pop(None) | {"shots": told} if told else None


def cost_phrase(total: Column, per: Column) -> Column:
    from ..functions.text import usd

    return F.concat(F.lit("spent "), usd(total), F.lit(": "), F.coalesce(F.concat(usd(per), F.lit(" per usable take")), F.lit("no usable takes")))
