"""Ranking within shots, picks for the cut, timecodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.kernels import sigmoid
from ..functions.text import slate, timecode
from .order import running

# fixed values
DEFAULT_FPS, DEFAULT_SIZE = 24, (1280, 720)
UNRANKED = 10**6


def rank_in_shot(takes: DataFrame) -> DataFrame:
    """Adds rank_in_shot, 1 for the best.

    Order: survivors first, learned kill probability, summed severity, number
    of mechanical findings, flicker, smoothness downwards, clip.  Takes
    without a shot are one group.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    learned = zero("learned") if "learned" in takes.columns else F.lit(0.0)
    w = Window.partitionBy("shot").orderBy(
        F.col("verdict") == "kill", learned, "severity_sum", "n_findings", zero("flicker"), -zero("smoothness"), "clip"
    )
    return takes.withColumn("rank_in_shot", F.row_number().over(w))


def severity_sums(takes: DataFrame, defects: DataFrame, spans: DataFrame) -> DataFrame:
    """takes with severity_sum and n_findings."""
    sev = defects.groupBy("clip").agg(F.sum("severity").alias("severity_sum"))
    found = spans.groupBy("clip").agg(F.count(F.lit(1)).alias("n_findings"))
    return takes.join(sev, "clip", "left").join(found, "clip", "left").fillna(0, ["severity_sum", "n_findings"])


def learned_scores(takes: DataFrame, defects: DataFrame, weights: DataFrame, bias: float) -> DataFrame:
    """(clip, learned): kill probability from fitted rule weights (rule, weight)."""
    s = F.col("severity") * F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0))
    x = defects.groupBy("clip", "rule").agg((F.max(s) / 5.0).alias("x")).join(F.broadcast(weights), "rule")
    z = x.groupBy("clip").agg(F.sum(F.col("weight") * F.col("x")).alias("z"))
    return takes.select("clip").join(z, "clip", "left").select("clip", sigmoid(F.coalesce("z", F.lit(0.0)) + bias).alias("learned"))


def top_rules(defects: DataFrame) -> DataFrame:
    """(clip, rule): greatest severity, then confidence, then first."""
    best = F.min_by("rule", F.struct(-F.col("severity"), -F.coalesce("confidence", F.lit(0.0)), "pos"))
    return defects.groupBy("clip").agg(best.alias("rule"))


def top_takes(takes: DataFrame, alts: int = 0) -> DataFrame:
    """Survivors of each shot, 1 + alts deep, best rank first."""
    shot = F.coalesce("shot", F.lit("untagged"))
    alive = takes.where(F.col("verdict").isin("keep", "review")).withColumn("shot", shot)
    w = Window.partitionBy("shot").orderBy(F.coalesce("rank_in_shot", F.lit(UNRANKED)), "clip")
    return alive.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= 1 + alts)


def with_slates(takes: DataFrame, tops: DataFrame) -> DataFrame:
    df = takes.join(tops.withColumnRenamed("rule", "top_rule"), "clip", "left")
    return df.withColumn("slate", slate(F.col("shot"), F.col("take_id"), F.col("verdict"), F.col("top_rule")))


def parse_shot_list(lines: DataFrame) -> DataFrame:
    """(shot, pos) from the lines (pos, value) of a shot list; # begins a
    comment, a name's first place counts."""
    name = F.trim(F.substring_index("value", "#", 1))
    return lines.select(name.alias("shot"), "pos").where("shot != ''").groupBy("shot").agg(F.min("pos").alias("pos"))


def cut_list(picks: DataFrame, shot_list: DataFrame | None = None, fps: float = DEFAULT_FPS) -> DataFrame:
    """n, record_in, record_out, tc_in, shot, rank, verdict, take_id, clip in
    cut order: listed shots first, then by name.

    The cut is one sequence, so its running times are too: they run over the
    picks of each shot, then over shots, in parts.
    """
    if shot_list is None:
        at = picks.withColumn("pos", F.lit(None).cast("int"))
    else:
        at = picks.join(F.broadcast(shot_list), "shot", "left")
    shots = at.groupBy("shot").agg(F.first("pos").alias("pos"), F.sum("duration").alias("len"), F.count(F.lit(1)).alias("m"))
    placed = shots.withColumn("late", F.col("pos").isNull())
    starts = running(placed, ["late", "pos", "shot"], t0="len", n0="m").select("shot", "t0", "n0")
    within = Window.partitionBy("shot").orderBy("pick")
    prior = within.rowsBetween(Window.unboundedPreceding, -1)
    df = at.join(starts, "shot").withColumn("record_in", F.col("t0") + F.coalesce(F.sum("duration").over(prior), F.lit(0.0)))
    return df.select(
        (F.col("n0") + F.row_number().over(within)).alias("n"),
        "record_in",
        (F.col("record_in") + F.col("duration")).alias("record_out"),
        timecode(F.col("record_in"), F.lit(float(fps))).alias("tc_in"),
        "shot",
        F.col("rank_in_shot").alias("rank"),
        "verdict",
        "take_id",
        "clip",
    )


def rerank(takes: DataFrame, changed: DataFrame) -> DataFrame:
    """Ranks anew of only the shots that ``changed`` (clip, shot) touches, and
    of those only the rows whose rank moved.  Takes bring their old rank."""
    shots = changed.select("shot").distinct().withColumnRenamed("shot", "s")
    mine = takes.join(shots, takes["shot"].eqNullSafe(F.col("s")), "left_semi").withColumnRenamed("rank_in_shot", "was")
    return rank_in_shot(mine).where(~F.col("rank_in_shot").eqNullSafe(F.col("was"))).drop("was")
