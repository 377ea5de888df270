"""Mechanical stage: spans, flicker, candidate frames, deterministic kills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.kernels import exact_sum
from ..functions.text import tenths

# fixed values
KILL_FRACTION = 0.5
SCENE_THRESHOLD = 0.4
CANDIDATE_FRAMES, UNIFORM_INTERVAL, MAX_FRAMES = 8, 0.5, 16
MOTION_MASK_RATIO = 2.0


def parse_detector_log(log: DataFrame, clip: str = "clip", text: str = "text") -> DataFrame:
    """(clip, kind, s, e) from the detectors' log text of each clip.

    Black spans are whole on a line.  Freeze starts and ends are paired by
    position; a start without an end is still frozen at the end.
    """
    num = r"(-?[0-9.]+)"
    all_ = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), lambda x: x.try_cast("double"))
    black = F.arrays_zip(all_(rf"black_start:\s*{num}\s+black_end:").alias("s"), all_(rf"black_end:\s*{num}").alias("e"))
    freeze = F.arrays_zip(all_(rf"freeze_start:\s*{num}").alias("s"), all_(rf"freeze_end:\s*{num}").alias("e"))
    tag = lambda spans, kind: F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["0"].alias("s"), x["1"].alias("e")))
    both = F.concat(tag(_named(black), "black"), tag(_named(freeze), "freeze"))
    return log.select(clip, F.inline(both)).where("s is not null")


def _named(zipped: Column) -> Column:
    return zipped.cast("array<struct<`0`:double,`1`:double>>")


def pair_spans(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """(clip, pos, s, e): the nth start with the nth end of its clip, e null if there is none."""
    nth = lambda df, c: df.groupBy("clip").agg(F.sort_array(F.collect_list(c)).alias(c))
    both = nth(starts, "s").join(nth(ends, "e"), "clip", "left")
    pairs = F.transform("s", lambda s, i: F.struct((i + 1).alias("pos"), s.alias("s"), F.get("e", i).alias("e")))
    return both.select("clip", F.inline(pairs))


def span_totals(takes: DataFrame, spans: DataFrame) -> DataFrame:
    """takes with black_s and freeze_s; a freeze without an end runs to the duration.

    The totals are exact sums, since a reason's tenths tell a last bit at a half.
    """
    e = F.coalesce("e", F.when(F.col("kind") == "freeze", F.col("duration")))
    total = lambda k: exact_sum(F.when(F.col("kind") == k, e - F.col("s"))).alias(f"{k}_s")
    sums = spans.join(takes.select("clip", "duration"), "clip").groupBy("clip").agg(total("black"), total("freeze"))
    return takes.join(sums, "clip", "left").fillna(0.0, ["black_s", "freeze_s"])


def mechanical_kills(takes: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds black_s, freeze_s, reasons array, killed.

    ``errors`` (array of probe errors, may be null) end the matter; without a
    duration nothing kills; scene cuts never do.
    """
    df = span_totals(takes, spans)
    over = lambda c: (F.col("duration") > 0) & (F.col(c) / F.col("duration") > KILL_FRACTION)
    said = lambda word, c: F.when(over(c), F.concat(F.lit(f"{word} for "), tenths(F.col(c)), F.lit("s of "), tenths(F.col("duration")), F.lit("s")))
    probe = F.transform("errors", lambda e: F.concat(F.lit("probe: "), e))
    found = F.array_compact(F.array(said("black", "black_s"), said("frozen", "freeze_s")))
    reasons = F.when(F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0, probe).otherwise(found)
    return df.withColumn("reasons", reasons).withColumn("killed", F.size("reasons") > 0)


def flicker(frames: DataFrame) -> DataFrame:
    """clip, cap, masked_n, masked_sum, flicker (not rounded).

    The cap is twice the upper median of YDIF after the first frame; frames
    above it are motion and masked, unless that masks all.
    """
    w = Window.partitionBy("clip").orderBy("n")
    df = frames.select("clip", "n", "ydif", F.abs(F.col("yavg") - F.lag("yavg").over(w)).alias("d"))
    rest = df.where(F.col("d").isNotNull())
    by = Window.partitionBy("clip")
    ranked = rest.select(
        "*", F.row_number().over(by.orderBy("ydif")).alias("r"), F.count(F.lit(1)).over(by).alias("m")
    )
    median = F.max(F.when(F.col("r") == F.floor(F.col("m") / 2) + 1, F.col("ydif"))).over(by)
    capped = ranked.withColumn("cap", median * MOTION_MASK_RATIO)
    calm = F.col("ydif") <= F.col("cap")
    sums = capped.groupBy("clip").agg(
        F.max("cap").alias("cap"),
        F.count_if(calm).alias("masked_n"),
        F.coalesce(F.sum(F.when(calm, F.col("d"))), F.lit(0.0)).alias("masked_sum"),
        F.avg("d").alias("plain"),
    )
    few = frames.select("clip").distinct().join(sums, "clip", "left")
    mean = F.when(F.col("masked_n") > 0, F.col("masked_sum") / F.col("masked_n")).otherwise(F.col("plain"))
    return few.select("clip", "cap", "masked_n", "masked_sum", F.coalesce(mean / 255.0, F.lit(0.0)).alias("flicker"))


def candidate_frames(frames: DataFrame, n: int = CANDIDATE_FRAMES) -> DataFrame:
    """(clip, t): YDIF peaks, the first frame, and a strip every half second
    where none of those is near, up to MAX_FRAMES in time order."""
    first = F.col("n") == F.min("n").over(Window.partitionBy("clip"))
    df = frames.withColumn("first", first)
    peak = F.row_number().over(Window.partitionBy("clip", "first").orderBy(F.desc("ydif"), "n"))
    marked = df.withColumn("peak", F.col("first") | (peak <= n - 1))
    per = marked.groupBy("clip").agg(
        F.collect_set(F.when(F.col("peak"), F.col("pts"))).alias("times"), F.max_by("pts", "n").alias("end")
    )
    steps = F.greatest(F.ceil(F.col("end") / UNIFORM_INTERVAL).cast("int") - 1, F.lit(0))
    strip = F.transform(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), lambda i: i * UNIFORM_INTERVAL)
    # strip points are further apart than the distance that matters
    apart = F.filter(strip, lambda t: F.forall("times", lambda u: F.abs(t - u) > UNIFORM_INTERVAL / 3))
    room = F.greatest(F.lit(MAX_FRAMES) - F.size("times"), F.lit(0))
    times = F.array_sort(F.concat("times", F.slice(apart, F.lit(1), room)))
    return per.select("clip", F.explode(F.transform(times, lambda t: F.round(t, 3))).alias("t"))


def scene_cuts(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("score") > SCENE_THRESHOLD)
