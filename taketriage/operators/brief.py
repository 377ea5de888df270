"""Dossier of a batch: yields, kill reasons, rules, survivors, recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import kill_class, kill_side

UNTAGGED = "untagged"


def _shot():
    return F.coalesce(F.nullif("shot", F.lit("")), F.lit(UNTAGGED))


def pending(takes: DataFrame, landed: DataFrame) -> DataFrame:
    """Stubs without review whose clip has not landed."""
    stub = F.col("verdict").isNull() & (F.col("parent").isNotNull() | F.coalesce("regen", F.lit(False)))
    return takes.where(stub).join(landed.select("clip"), "clip", "left_anti")


def shot_rollup(takes: DataFrame) -> DataFrame:
    """By shot: n_takes landed, pending, kills, yield (not rounded, null
    without takes).  takes: shot, verdict, pending."""
    here = ~F.coalesce("pending", F.lit(False))
    n, kills = F.count_if(here), F.count_if(here & F.coalesce(F.col("verdict") == "kill", F.lit(False)))
    return takes.groupBy(_shot().alias("shot")).agg(
        n.alias("n_takes"), F.count_if(~here).alias("pending"), kills.alias("kills"), F.try_divide(n - kills, n).alias("yield")
    )


def totals(rollup: DataFrame) -> DataFrame:
    n, k = F.sum("n_takes"), F.sum("kills")
    return rollup.agg(F.count(F.lit(1)).alias("shots"), n.alias("n_takes"), k.alias("kills"), F.sum("pending").alias("pending"), F.try_divide(n - k, n).alias("yield"))


def kill_histogram(takes: DataFrame, reasons: DataFrame) -> DataFrame:
    """(shot, side, class, count): every reason of every killed take."""
    killed = takes.where("verdict = 'kill'").select("clip", _shot().alias("shot"))
    r = F.col("reason")
    return reasons.join(killed, "clip").groupBy("shot", kill_side(r).alias("side"), kill_class(r).alias("class")).agg(F.count(F.lit(1)).alias("count"))


def rule_stats(takes: DataFrame, defects: DataFrame) -> DataFrame:
    """By shot and rule: count, takes_affected, mean severity and confidence
    (not rounded), and the worst defect: greatest severity, then confidence,
    then earliest, then file."""
    df = defects.join(takes.select("clip", _shot().alias("shot"), "file"), "clip")
    # per take first: distinct takes are then a plain count
    per = df.groupBy("shot", "rule", "clip").agg(
        F.count(F.lit(1)).alias("c"),
        F.sum("severity").alias("sev"),
        F.sum("confidence").alias("conf"),
        F.count("confidence").alias("nc"),
        F.min(F.struct(-F.col("severity"), -F.coalesce("confidence", F.lit(0.0)), "t", "file", "pos", "note")).alias("w"),
    )
    return per.groupBy("shot", "rule").agg(
        F.sum("c").alias("count"),
        F.count(F.lit(1)).alias("takes_affected"),
        (F.sum("sev") / F.sum("c")).alias("mean_severity"),
        F.try_divide(F.sum("conf"), F.sum("nc")).alias("mean_confidence"),
        F.min("w").alias("w"),
    ).select(
        "shot", "rule", "count", "takes_affected", "mean_severity", "mean_confidence", F.col("w.file").alias("worst_file"), F.col("w.t").alias("worst_t"), F.col("w.note").alias("worst_note")
    )


def survivors(takes: DataFrame, defects: DataFrame) -> DataFrame:
    """Takes that weren't killed (unreviewed ones too), with their defects, in
    order: ranked first, rank, file."""
    n = defects.groupBy("clip").agg(F.count(F.lit(1)).alias("defects"))
    alive = takes.where(F.coalesce(F.col("verdict") != "kill", F.lit(True)))
    return (
        alive.join(n, "clip", "left")
        .select(_shot().alias("shot"), "file", "take_id", "rank_in_shot", "verdict", F.coalesce("defects", F.lit(0)).alias("defects"))
        .orderBy("shot", F.col("rank_in_shot").isNull(), "rank_in_shot", "file")
    )


def recipe_deltas(takes: DataFrame) -> DataFrame:
    """By shot: n_with_recipe, and the distinct recipe values in long form
    (kind seed, model or lora; name; value).

    takes: shot, seeds map, models array of file, loras map of file to
    strength; a take without any has no recipe.
    """
    has = F.coalesce(F.size("seeds") >= 0, F.lit(False)) | F.col("models").isNotNull() | F.col("loras").isNotNull()
    df = takes.where(has).withColumn("shot", _shot())
    n = df.groupBy("shot").agg(F.count(F.lit(1)).alias("n_with_recipe"))
    kinds = F.concat(
        F.transform(F.coalesce(F.map_entries("seeds"), F.array()), lambda e: F.struct(F.lit("seed").alias("kind"), e["key"].alias("name"), e["value"].cast("string").alias("value"))),
        F.transform(F.coalesce("models", F.array()), lambda m: F.struct(F.lit("model").alias("kind"), m.alias("name"), F.lit("").alias("value"))),
        F.transform(F.coalesce(F.map_entries("loras"), F.array()), lambda e: F.struct(F.lit("lora").alias("kind"), e["key"].alias("name"), e["value"].cast("string").alias("value"))),
    )
    values = df.select("shot", F.inline(kinds)).where("name is not null and value is not null").distinct()
    return n.join(values, "shot", "left")


def review_summary(takes: DataFrame) -> DataFrame:
    """One row: reviewed, killed, to_watch, pending."""
    reviewed = F.col("verdict").isNotNull()
    return takes.agg(
        F.count_if(reviewed).alias("reviewed"),
        F.count_if(F.col("verdict") == "kill").alias("killed"),
        F.count_if(reviewed & (F.col("verdict") != "kill")).alias("to_watch"),
        F.count_if(F.coalesce("pending", F.lit(False))).alias("pending"),
    )
