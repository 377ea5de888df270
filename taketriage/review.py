"""Review: clips in, sidecars out.

One plan goes over all clips: content ids, the mechanical stage of what is new,
the judge's passes over what lives, kills, audit, and sidecars written where
the clips lie; then cost and ranks from the sidecars.  Media tools, judges and
file writes run on the executors; nothing but counts comes to the driver.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.kernels import AUDIT_RATE, exact_round, fixed
from .functions.text import basename, null_if_blank, parent_dir, shot_for
from .operators import cost, judge as j, labels, lineage, rank, screening, signals
from .plans.session import cut
from .sources import external, sidecars, sinks


@dataclass
class Judging:
    """The judges of a review, their rubric and their threshold."""

    ask: Callable
    engine: str
    rules: dict = field(default_factory=lambda: sidecars.DEFAULT_RUBRIC)
    samples: int = 1
    strong: Callable | None = None
    strong_engine: str | None = None
    calibration: dict | None = None
    frames: Callable = external.jpegs


@dataclass
class Signals:
    """Normalized tables of the media tools' findings."""

    probe: DataFrame
    spans: DataFrame
    frames: DataFrame
    cuts: DataFrame
    smoothness: DataFrame


def extract_signals(spark: SparkSession, clips: DataFrame) -> Signals:
    """Signals of clips by the media tools, on the executors; a clip that can't
    be decoded gets no more than its probe."""
    probed = external.extract(clips, lambda c: json.dumps(external.probe(c)), "json")
    kind = "duration double, fps double, width long, height long, frames long, errors array<string>"
    probe = cut(probed.select("clip", F.from_json("json", kind).alias("p")).select("clip", "p.*"))
    good = probe.where(F.size("errors") == 0)
    spans = cut(signals.parse_detector_log(external.extract(good, external.detector_log, "text")))
    luma = external.extract(good, lambda c: json.dumps(external.luma_series(c)), "json")
    frames = luma.select("clip", F.posexplode(F.from_json("json", "array<array<double>>")).alias("n", "f"))
    scores = external.extract(good, lambda c: json.dumps(external.scene_scores(c)), "json")
    scored = scores.select("clip", F.explode(F.from_json("json", "array<array<double>>")).alias("s")).select("clip", F.col("s")[0].alias("t"), F.col("s")[1].alias("score"))
    smooth = external.extract(good, lambda c, fps: json.dumps(external.motion_smoothness(c, fps)), "json", "fps")
    return Signals(
        probe,
        spans,
        cut(frames.select("clip", "n", F.col("f")[0].alias("pts"), F.col("f")[1].alias("yavg"), F.col("f")[2].alias("ydif"))),
        cut(signals.scene_cuts(scored)),
        cut(smooth.select("clip", F.col("json").try_cast("double").alias("smoothness"))),
    )


def mechanical(clips: DataFrame, s: Signals) -> DataFrame:
    """(clip, mechanical: JSON of the stage's block, output: JSON, times,
    reasons, verdict)."""
    lists = lambda df, name, value, *order: df.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x["v"]).alias(name))
    span = F.struct(F.col("s").alias("start"), F.col("e").alias("end")).alias("v")
    kills = signals.mechanical_kills(s.probe, s.spans)
    df = clips.select("clip").join(kills.select("clip", "duration", "fps", "width", "height", "frames", "errors", "reasons", "killed"), "clip")
    df = df.join(lists(s.spans.where("kind = 'black'"), "black_frames", span, "s"), "clip", "left")
    df = df.join(lists(s.spans.where("kind = 'freeze'"), "freeze", span, "s"), "clip", "left")
    df = df.join(lists(s.cuts, "scene_cuts", F.col("t").alias("v"), "t"), "clip", "left")
    df = df.join(lists(signals.candidate_frames(s.frames), "candidate_frames", F.col("t").alias("v"), "t"), "clip", "left")
    df = df.join(signals.flicker(s.frames).select("clip", exact_round(F.col("flicker"), 4).alias("score")), "clip", "left")
    df = df.join(s.smoothness.select("clip", F.col("smoothness").alias("motion_smoothness")), "clip", "left")
    sound = F.size("errors") == 0
    spans, numbers = "array<struct<start:double,end:double>>", "array<double>"
    listed = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    block = F.struct(
        F.struct("duration", "fps", "width", "height", "frames", "errors").alias("probe"),
        listed("black_frames", spans), listed("freeze", spans), listed("scene_cuts", numbers),
        F.when(sound, F.coalesce("score", F.lit(0.0))).alias("flicker_score"), "motion_smoothness", listed("candidate_frames", numbers), F.col("reasons").alias("kill_reasons"),
    )
    return df.select(
        "clip",
        F.to_json(block, {"ignoreNullFields": "false"}).alias("mechanical"),
        F.to_json(F.struct("fps", "frames", "width", "height")).alias("output"),
        F.coalesce("candidate_frames", F.array().cast(numbers)).alias("times"),
        "reasons",
        F.when(F.col("killed"), "kill").otherwise("review").alias("verdict"),
    )


def opened(clips: DataFrame) -> DataFrame:
    """clip, the typed core and the whole document of each clip's sidecar, or of
    its skeleton; read where the clips lie."""
    texts = external.extract(clips, lambda c: json.dumps(sinks.load_sidecar(c)), "value")
    return sidecars.typed(texts.select("clip", "value"))


def _family(spark: SparkSession, clips: DataFrame, roots: list[str]) -> DataFrame:
    """Takes beside the clips, with ids that hold within a folder."""
    folder = lambda: F.regexp_extract("clip", "^(.*/)", 1)
    here = clips.select(folder().alias("folder")).distinct()
    tagged = lambda c: F.concat("folder", F.lit("\n"), c).alias(c)
    parts = [sidecars.find_takes(spark, r, permissive=True) for r in roots]
    takes = parts[0]
    for p in parts[1:]:
        takes = takes.unionByName(p)
    takes = takes.withColumn("folder", folder()).join(F.broadcast(here), "folder", "left_semi")
    reasons = F.col("review.mechanical.kill_reasons").alias("reasons")
    return takes.dropDuplicates(["clip"]).select("clip", tagged("take_id"), tagged("parent"), F.col("recipe.prompt_text").alias("prompt_text"), F.col("review.verdict").alias("verdict"), reasons)


def _judged(t: DataFrame, family: DataFrame, g: Judging, audit_rate: float) -> DataFrame:
    """(clip, vlm, scrutiny: JSON, reasons, verdict, audit) of takes that the
    judge sees.  t: clip, take_id, parent, doc, times, reasons, score inputs."""
    spark = t.sparkSession
    rules, questions = sidecars.rubric_frames(spark, g.rules)
    guard = cut(lineage.intent_guard(family).where("guarded").select("clip", "judged_prompt"))
    seen = t.join(guard, "clip", "left")
    context = j.needs_context(rules, seen)
    is_prompt = F.col("needs") == "recipe.prompt_text"
    context = context.join(F.broadcast(rules.select("rule", "needs")), "rule").join(guard, "clip", "left").select("clip", "rule", F.when(is_prompt, F.coalesce("judged_prompt", "context")).otherwise(F.col("context")).alias("context"))
    # the root's prompt may be there where the take's own is not
    late = guard.join(t.select("clip"), "clip", "left_semi").crossJoin(F.broadcast(rules.where(is_prompt).select("rule"))).join(context.select("clip", "rule"), ["clip", "rule"], "left_anti")
    context = cut(context.unionByName(late.select("clip", "rule", F.col("judged_prompt").alias("context"))))
    block, strong, rows = _found(t, rules, questions, context, g)
    times = t.select("clip", "times")
    skipped = t.select("clip").crossJoin(F.broadcast(rules.select("rule"))).join(context, ["clip", "rule"], "left_anti")
    guarded = guard.select("clip", F.lit(True).alias("root_prompt"))
    vlm = screening.block_json(t, block, g.engine, skipped, g.samples, strong, guarded=guarded).withColumnRenamed("block", "vlm")

    fatal = _fatal(t, block, rules, g)
    state = t.join(fatal, "clip", "left").withColumn("killed", F.size(F.coalesce("more", F.array().cast("array<string>"))) > 0)
    state = cut(state.withColumn("reasons", F.concat("reasons", F.coalesce("more", F.array().cast("array<string>")))).drop("more"))

    verdict = F.when(F.col("killed"), "kill").otherwise("review")
    why = family.where("verdict = 'kill'").select("clip", F.explode("reasons").alias("reason"))
    parents = lineage.parent_kill_rules(family, why)
    again, used, subset = screening.scrutinized(state.withColumn("verdict", verdict), rows, times, parents, rules, questions, g.ask, g.strong, g.frames)
    named = (g.strong_engine or g.engine, used, subset) if used is not None else None
    held = screening.block_json(subset.select("clip").distinct(), again, g.engine, None, max(g.samples, j.SCRUTINY_SAMPLES), named, subset).withColumnRenamed("block", "scrutiny")
    fatal = _reasons(j.rule_kills(again.defects, rules))
    none = F.array().cast("array<string>")
    state = state.join(fatal, "clip", "left").withColumn("killed", F.col("killed") | (F.size(F.coalesce("more", none)) > 0)).withColumn("reasons", F.concat("reasons", F.coalesce("more", none)))
    state = labels.audited(state.withColumn("verdict", verdict), audit_rate)
    return state.join(vlm, "clip").join(held, "clip", "left").select("clip", "vlm", "scrutiny", "reasons", "verdict", "audit")


def _found(t: DataFrame, rules: DataFrame, questions: DataFrame, context: DataFrame, g: Judging) -> tuple[screening.Block, tuple | None, DataFrame]:
    """What the judge finds, the strong one where it is unsure; and the asks."""
    rows = cut(screening.asks(t, rules, questions, context, g.samples))
    times = t.select("clip", "times")
    block = screening.screened(rows, times, questions, g.ask, g.frames)
    if g.strong is None:
        return block, None, rows
    block, used, subset = screening.escalated(block, rows, times, rules, questions, g.strong, g.frames)
    return block, (g.strong_engine or g.engine, used, subset), rows


def _fatal(t: DataFrame, block: screening.Block, rules: DataFrame, g: Judging) -> DataFrame:
    """(clip, more): the reasons of kills, by the threshold if there is one."""
    return _threshold_kills(t, block, g) if g.calibration is not None else _reasons(j.rule_kills(block.defects, rules))


def predicted(docs: DataFrame, g: Judging, signals_of: Callable[[SparkSession, DataFrame], Signals] = extract_signals) -> DataFrame:
    """(clip, label: kill or pass) of takes by these judges; nothing is written."""
    spark = docs.sparkSession
    rules, questions = sidecars.rubric_frames(spark, g.rules)
    bare = cut(docs.where("review is null").select("clip"))
    new = mechanical(bare, signals_of(spark, bare)).select("clip", F.col("reasons").alias("r"), F.col("times").alias("ts"))
    none = F.array().cast("array<string>")
    m = "review.mechanical"
    state = docs.join(new, "clip", "left").select(
        "clip", "doc", F.col("review.vlm").isNotNull().alias("judged"),
        F.coalesce("r", f"{m}.kill_reasons", none).alias("reasons"), F.coalesce("ts", f"{m}.candidate_frames", F.array().cast("array<double>")).alias("times"),
    )
    state = cut(state.withColumn("dead", (F.size("reasons") > 0) & ~F.col("judged")))  # a mechanical death needs no judge
    alive = state.where("not dead")
    block, _, _ = _found(alive, rules, questions, cut(j.needs_context(rules, alive)), g)
    killed = _fatal(alive, block, rules, g).select("clip", F.lit(True).alias("killed"))
    dead = F.col("dead") | F.coalesce("killed", F.lit(False))
    return cut(state.join(killed, "clip", "left").select("clip", F.when(dead, "kill").otherwise("pass").alias("label")))


def _reasons(kills: DataFrame) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("t", "rule", "reason")))
    return kills.groupBy("clip").agg(F.transform(order, lambda x: x["reason"]).alias("more"))


def _threshold_kills(t: DataFrame, block: screening.Block, g: Judging) -> DataFrame:
    """The calibrated threshold takes the place of the rules' own."""
    spark = t.sparkSession
    lam = g.calibration.get("lambda")
    line = spark.range(1).select(F.lit(lam).cast("double").alias("lambda"))
    killed = j.calibrated_kills(j.kill_scores(t, block.defects), line).where("killed")
    if lam is None:
        return killed.select("clip", F.array(F.lit("")).alias("more")).where("false")
    text = F.concat(F.lit("calibrated kill score "), fixed(F.col("score"), 2), F.lit(" > "), fixed(F.lit(float(lam)), 2), F.lit(f" (false-kill rate <= {g.calibration.get('alpha')})"))
    return killed.select("clip", F.array(text).alias("more"))


def review(
    spark: SparkSession,
    paths: list[str],
    shot: str | None = None,
    force: bool = False,
    judging: Judging | None = None,
    prices: dict | None = None,
    audit_rate: float = AUDIT_RATE,
    signals_of: Callable[[SparkSession, DataFrame], Signals] = extract_signals,
) -> DataFrame:
    """Reviews clips of folders, globs and files and writes their sidecars.

    A clip whose content has a review keeps it, unless forced; the judge sees
    what it hasn't judged.  One row a clip: clip, file, shot, verdict,
    rank_in_shot, kill_reasons, fresh.
    """
    found = sidecars.find_clips(spark, paths).select(F.col("path").alias("clip"))
    ids = external.extract(found, external.hash_file, "id")
    docs = opened(found).join(ids, "clip")
    known = F.col("review").isNotNull() & (F.col("take_id") == F.col("id"))
    old = cut(docs.withColumn("fresh", F.lit(True) if force else ~F.coalesce(known, F.lit(False))))

    new = mechanical(old.where("fresh").select("clip"), signals_of(spark, old.where("fresh").select("clip")))
    none = F.array().cast("array<string>")
    m = "review.mechanical"
    state = old.join(new.withColumnsRenamed({"verdict": "v", "reasons": "r", "times": "ts", "output": "o"}), "clip", "left").select(
        "clip", F.col("id").alias("take_id"), "parent", "doc", "fresh", "mechanical", "o", "created",
        shot_for(F.coalesce("shot", F.lit("")), F.col("clip"), shot).alias("shot"), (F.coalesce("shot", F.lit("")) == "").alias("untagged"),
        F.when(F.col("fresh"), F.col("v")).otherwise(F.col("review.verdict")).alias("verdict"),
        F.coalesce(F.when(F.col("fresh"), F.col("r")).otherwise(F.col(f"{m}.kill_reasons")), none).alias("reasons"),
        F.coalesce(F.when(F.col("fresh"), F.col("ts")).otherwise(F.col(f"{m}.candidate_frames")), F.array().cast("array<double>")).alias("times"),
        (~F.col("fresh") & F.col("review.vlm").isNotNull()).alias("judged"),
    )
    state = cut(state)
    told = state.select("clip", F.col("reasons").alias("final"), F.col("verdict").alias("said"))
    verdicts = told.withColumns({"vlm": F.lit(None).cast("string"), "scrutiny": F.lit(None).cast("string"), "audit": F.lit(False), "asked": F.lit(False)})
    if judging is not None:
        eligible = cut(screening.pending_judgement(state, force))
        family = cut(_family(spark, eligible, _roots(paths)).unionByName(_own(eligible)).groupBy("clip").agg(*[F.max(c).alias(c) for c in ("take_id", "parent", "prompt_text", "verdict", "reasons")]))
        judged = cut(_judged(eligible, family, judging, audit_rate))
        verdicts = verdicts.join(judged.select("clip", F.lit(True).alias("a")), "clip", "left_anti").unionByName(
            judged.select("clip", F.col("reasons").alias("final"), F.col("verdict").alias("said"), "vlm", "scrutiny", "audit", F.lit(True).alias("asked"))
        )
    full = cut(state.join(verdicts, "clip"))
    sinks.patch_sidecars(full.where("fresh or asked or untagged").select("clip", _patch(audit_rate).alias("patch")))
    priced_and_ranked(full.select("clip"), prices, (judging.calibration if judging else None))
    done = opened(full.select("clip")).join(full.select("clip", (F.col("fresh") | F.col("asked")).alias("fresh")), "clip")
    return cut(
        done.select(
            "clip", F.coalesce(null_if_blank(F.col("output.file")), basename(F.col("clip"))).alias("file"), "shot", F.col("review.verdict").alias("verdict"),
            F.col("review.rank_in_shot").alias("rank_in_shot"), F.coalesce(F.col(f"{m}.kill_reasons"), none).alias("kill_reasons"), "fresh", F.to_json("doc").alias("json"),
        )
    )


def _roots(paths: list[str]) -> list[str]:
    """Folders to look in for the takes beside the clips."""
    heads = [p if os.path.isdir(p) else os.path.dirname(p) or "." for p in paths]
    return sorted(set(heads))


def _own(state: DataFrame) -> DataFrame:
    """The clips' own rows of the family, as the sidecars may not be written yet."""
    folder = F.regexp_extract("clip", "^(.*/)", 1)
    tagged = lambda c: F.concat(folder, F.lit("\n"), c).alias(c)
    prompt = F.try_variant_get("doc", "$.recipe.prompt_text", "string").alias("prompt_text")
    return state.select("clip", tagged("take_id"), tagged("parent"), prompt, "verdict", "reasons")


def _patch(audit_rate: float) -> Column:
    """What changes in a sidecar, as JSON text (see sinks.patched)."""
    parsed = lambda c: F.when(F.col(c).isNotNull(), F.parse_json(c))
    top = F.struct("take_id", "shot", F.coalesce("created", F.lit(sinks.now())).alias("created"))
    fresh = F.when(F.col("fresh"), F.struct(parsed("mechanical").alias("mechanical")))
    audit = F.when(F.col("audit"), F.struct(F.lit(audit_rate).alias("rate")))
    review = F.struct(F.col("said").alias("verdict"), parsed("vlm").alias("vlm"), parsed("scrutiny").alias("scrutiny"), audit.alias("audit"))
    return F.to_json(F.struct(top.alias("set"), parsed("o").alias("output"), fresh.alias("fresh"), review.alias("review"), F.col("final").alias("reasons")))


def priced_and_ranked(clips: DataFrame, prices: dict | None, calibration: dict | None = None) -> int:
    """Writes cost blocks, if there are prices, and ranks that moved; returns how many sidecars changed."""
    spark = clips.sparkSession
    docs = cut(opened(clips).where("review is not null"))
    flat = sidecars.flat(docs)
    defects = sidecars.defects(docs)
    spans = sidecars.spans(docs).select("clip").unionByName(docs.select("clip", F.explode("review.mechanical.scene_cuts").alias("_")).select("clip"))
    takes = rank.severity_sums(flat.drop("doc"), defects, spans)
    if calibration and calibration.get("weights"):
        weights = spark.createDataFrame(list(calibration["weights"].items()), "rule string, weight double")
        takes = takes.join(rank.learned_scores(takes, defects, weights, float(calibration.get("bias") or 0)), "clip", "left")
    moved = rank.rerank(takes, takes.select("shot").distinct()).select("clip", "rank_in_shot")
    patch = F.struct("rank_in_shot").alias("rank")
    rows = moved.select("clip", patch)
    if prices is None:
        out = rows.select("clip", F.to_json(F.struct(F.col("rank").alias("review"))).alias("patch"))
    else:
        block = cost.cost_block(flat, sidecars.usage(docs), sidecars.prices_frame(spark, prices), prices.get("clip"))
        usd = lambda c: exact_round(F.col(c), 6).alias(c)
        unpriced = F.when(F.size("unpriced") > 0, F.col("unpriced")).alias("unpriced_models")
        priced = block.select("clip", F.struct(usd("vlm_usd"), usd("clip_usd"), usd("total_usd"), unpriced).alias("cost"))
        out = priced.join(rows, "clip", "left").select("clip", F.to_json(F.struct(F.struct("cost", "rank.rank_in_shot").alias("review"))).alias("patch"))
    return sinks.patch_sidecars(out)


def listing(rows: DataFrame) -> DataFrame:
    """Reviewed takes by shot and rank, as they are shown."""
    return rows.orderBy(F.coalesce("shot", F.lit("")), F.coalesce("rank_in_shot", F.lit(0)), "clip")


def event_lines(rows: DataFrame) -> DataFrame:
    """``line``: the published event of each reviewed take, nulls told."""
    return rows.select("clip", F.to_json(F.struct("clip", "shot", "verdict", "rank_in_shot", "kill_reasons"), {"ignoreNullFields": "false"}).alias("line"))
