"""Judge stage: votes, merging, kills, escalation, scrutiny."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.kernels import exact_round
from ..functions.text import clamp_severity, rule_reason

# fixed values
CONF_KILL, MERGE_GAP, SCRUTINY_SAMPLES = 0.67, 0.8, 3
# fixed values: rule -> severities of its questions, fail_at, needed context
DEFAULT_RULES = {
    "anatomy.hands": ([4, 4], 4, None),
    "anatomy.faces": ([4, 3], 4, None),
    "anatomy.limbs": ([5, 4], 4, None),
    "artifact.morphing": ([4, 3], 4, None),
    "physics.contact": ([4, 4], 4, None),
    "physics.motion": ([4, 4], 4, None),
    "continuity.objects": ([4, 4], 4, None),
    "environment.stability": ([4, 3], 4, None),
    "text.legibility": ([4, 3, 4], 4, None),
    "adherence.prompt": ([3, 3], None, "recipe.prompt_text"),
}
DEFAULT_SEVERITY = 3


def vote(answers: DataFrame, questions: DataFrame, samples: DataFrame, first_t: float | Column = 0.0) -> DataFrame:
    """Votes of sampled answers: (clip, rule, q, n, yes_n, p, uncertain, t,
    severity, note, confidence) of every question of every judged rule.

    answers: clip, rule, sample, pos, q, yes, t, note.  questions: rule, q,
    severity, ask.  samples: clip, rule, n — the samples that parsed.  A sample
    without the question voted no.  Rows with p >= 0.5 are defects; the
    evidence is the first yes of the first sample with one.
    """
    first_t = F.lit(first_t) if isinstance(first_t, float) else first_t
    yes = answers.where("yes").groupBy("clip", "rule", "q").agg(
        F.countDistinct("sample").alias("yes_n"),
        F.min_by(F.struct("t", "note"), F.struct("sample", "pos")).alias("first"),
    )
    df = samples.where("n > 0").join(F.broadcast(questions), "rule").join(yes, ["clip", "rule", "q"], "left")
    yes_n = F.coalesce("yes_n", F.lit(0))
    p = yes_n / F.col("n")
    asked = F.substring(F.element_at(F.split("ask", "\n"), -1), 1, 200)
    note = F.when(F.coalesce(F.col("first.note"), F.lit("")) != "", F.col("first.note")).otherwise(asked)
    return df.select(
        "clip",
        "rule",
        "q",
        "n",
        yes_n.alias("yes_n"),
        p.alias("p"),
        ((p > 0) & (p < 1)).alias("uncertain"),
        F.when(p >= 0.5, F.coalesce("first.t", first_t)).alias("t"),
        clamp_severity(F.coalesce("severity", F.lit(DEFAULT_SEVERITY))).alias("severity"),
        F.when(p >= 0.5, note).alias("note"),
        F.when((p >= 0.5) & (F.col("n") > 1), exact_round(p, 2)).alias("confidence"),
    )


def voted_defects(votes: DataFrame) -> DataFrame:
    return votes.where("p >= 0.5").select("clip", "rule", "q", "t", "severity", "confidence", "note")


def uncertain_rules(votes: DataFrame) -> DataFrame:
    return votes.groupBy("clip", "rule").agg(F.bool_or("uncertain").alias("u")).where("u").select("clip", "rule")


def unparsed_rules(asked: DataFrame, parsed: DataFrame) -> DataFrame:
    """Rules asked of a clip without one reply that parsed."""
    return asked.select("clip", "rule").distinct().join(parsed, ["clip", "rule"], "left_anti")


def merge(defects: DataFrame) -> DataFrame:
    """Repeats of a defect as one: (clip, rule, t, t_end, severity, confidence, note, merged).

    Runs of a rule's defects within MERGE_GAP of the one before; the greatest
    severity with its first note, the greatest confidence, an end if the run
    has more than one.  ``pos`` orders equal times.
    """
    w = Window.partitionBy("clip", "rule").orderBy("t", "pos")
    new = F.when(F.col("t") - F.lag("t").over(w) <= MERGE_GAP, 0).otherwise(1)
    runs = defects.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.groupBy("clip", "rule", "run")
        .agg(
            F.min("t").alias("t"),
            F.max("t").alias("last"),
            F.max("severity").alias("severity"),
            F.max("confidence").alias("confidence"),
            F.min_by("note", F.struct(-F.col("severity"), "t", "pos")).alias("note"),
            F.count(F.lit(1)).alias("merged"),
        )
        .select("clip", "rule", "t", F.when(F.col("merged") > 1, F.col("last")).alias("t_end"), "severity", "confidence", "note", "merged")
    )


def rule_kills(defects: DataFrame, rules: DataFrame) -> DataFrame:
    """(clip, rule, t, reason) of the defects that reach their rule's fail_at
    and that the samples agree on."""
    sure = F.col("confidence").isNull() | (F.col("confidence") >= CONF_KILL)
    hit = defects.join(F.broadcast(rules), "rule").where((F.col("severity") >= F.col("fail_at")) & sure)
    return hit.select("clip", "rule", "t", rule_reason(F.col("rule"), F.col("severity"), F.col("t"), F.col("t_end"), F.col("note")).alias("reason"))


def kill_scores(takes: DataFrame, defects: DataFrame) -> DataFrame:
    """(clip, score): greatest severity times confidence (1 if none or 0)."""
    s = F.col("severity") * F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0))
    top = defects.groupBy("clip").agg(F.max(s).alias("score"))
    return takes.select("clip").join(top, "clip", "left").select("clip", F.coalesce("score", F.lit(0.0)).alias("score"))


def calibrated_kills(scores: DataFrame, calibration: DataFrame) -> DataFrame:
    """(clip, score, killed): above the threshold; no threshold, no kill.

    calibration: one row with ``lambda``.
    """
    return scores.crossJoin(F.broadcast(calibration.select("lambda"))).select(
        "clip", "score", F.coalesce(F.col("score") > F.col("lambda"), F.lit(False)).alias("killed")
    )


def escalation_set(uncertain: DataFrame, unparsed: DataFrame, rules: DataFrame) -> DataFrame:
    """(clip, rule) that the strong judge sees."""
    return uncertain.select("clip", "rule").union(unparsed.select("clip", "rule")).distinct().join(F.broadcast(rules.select("rule")), "rule", "left_semi").select("clip", "rule")


def all_unsure(uncertain: DataFrame, subset: DataFrame) -> DataFrame:
    """(clip, rule): the uncertain rules and all of a subset's, once each."""
    return uncertain.select("clip", "rule").union(subset.select("clip", "rule")).distinct()


def escalation_merge(defects: DataFrame, subset: DataFrame, strong: DataFrame) -> DataFrame:
    """The cheap judge's defects of other rules and the strong judge's, merged."""
    keep = defects.join(subset, ["clip", "rule"], "left_anti")
    both = keep.select("clip", "rule", "t", "severity", "confidence", "note", "pos").unionByName(
        strong.select("clip", "rule", "t", "severity", "confidence", "note", "pos")
    )
    return merge(both)


def after_escalation(uncertain: DataFrame, unparsed: DataFrame, subset: DataFrame, strong_unparsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays uncertain and unparsed once the subset has been judged again."""
    left = uncertain.join(subset, ["clip", "rule"], "left_anti")
    return left, unparsed.join(subset, ["clip", "rule"], "left_anti").unionByName(strong_unparsed.select("clip", "rule"))


def scrutiny_set(takes: DataFrame, parent_rules: DataFrame, rules: DataFrame) -> DataFrame:
    """(clip, rule): rules that killed an ancestor, of rerun takes that pass."""
    passing = takes.where(F.col("parent").isNotNull() & (F.col("verdict") != "kill")).select("clip")
    named = parent_rules.join(F.broadcast(rules.select("rule")), "rule", "left_semi")
    return named.join(passing, "clip", "left_semi").select("clip", "rule")


def needs_context(rules: DataFrame, takes: DataFrame, doc: str = "doc") -> DataFrame:
    """(clip, rule, context): rules with what they need of the take's document;
    '' when a rule needs nothing; rules whose context is absent are left out."""
    df = takes.select("clip", doc).crossJoin(F.broadcast(rules.select("rule", "needs")))
    paths = [r["needs"] for r in rules.where("needs is not null").select("needs").distinct().collect()]
    got = F.lit(None).cast("string")
    for p in paths:  # of the rubric: a handful
        got = F.when(F.col("needs") == p, F.try_variant_get(doc, f"$.{p}", "string")).otherwise(got)
    context = F.when(F.col("needs").isNull(), "").otherwise(got)
    return df.select("clip", "rule", context.alias("context")).where("context is not null")


def rules_frame(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    """rule, fail_at, needs of a rubric (the default one)."""
    rows = [(k, v[1], v[2]) for k, v in (rules or DEFAULT_RULES).items()]
    return spark.createDataFrame(rows, "rule string, fail_at int, needs string")


def usage_rollup(calls: DataFrame, *by: str) -> DataFrame:
    """Totals of each clip and engine, and of all its engines (engine null);
    with ``by`` ("rule") also of each of those, under an engine."""
    sums = [F.sum(c).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens")]
    grouped = calls.rollup("clip", "engine", *by).agg(*sums, F.grouping("clip").alias("g"))
    return grouped.where("g = 0").drop("g")
