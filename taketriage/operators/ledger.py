"""Run state: stopping rules, job table, gates for resubmission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import kill_class
from .lineage import LINEAGE_CAP

# fixed values
FUTILITY_KILLS = 3
REGEN_RATE, RATE_SECONDS, FAIL_BLOCK = 6, 60, 3
TERMINAL = ("done", "error")


def futility(kills: DataFrame) -> DataFrame:
    """(shot, rule): the kill class (first by name) that killed takes under
    FUTILITY_KILLS distinct seed signatures.

    kills: shot, reason, signature of killed takes; without a recorded
    signature a kill proves nothing.
    """
    by = kills.where("shot is not null and signature is not null").groupBy("shot", kill_class(F.col("reason")).alias("rule"))
    return by.agg(F.countDistinct("signature").alias("n")).where(F.col("n") >= FUTILITY_KILLS).groupBy("shot").agg(F.min("rule").alias("rule"))


def refresh(takes: DataFrame, jobs: DataFrame, want: DataFrame, futile: DataFrame, breaker: DataFrame, want_default: int = 1) -> DataFrame:
    """By shot of takes or jobs: want, takes, passing, mechanical_kills,
    attempts, spend_usd, status, blocked_by.

    Complete beats blocked beats doomed beats active.
    """
    named = takes.where("shot is not null and shot != ''").groupBy("shot").agg(
        F.count("verdict").alias("takes"),
        F.count_if(F.col("verdict") != "kill").alias("passing"),
        F.sum(F.when(F.col("verdict").isNotNull(), F.col("total_usd"))).alias("spend_usd"),
    )
    tried = jobs.where("shot is not null and shot != ''").groupBy("shot").agg(F.count(F.lit(1)).alias("attempts"))
    df = named.join(tried, "shot", "full_outer").join(want, "shot", "left").join(futile.withColumnRenamed("rule", "futile"), "shot", "left")
    df = df.join(breaker.select("shot", "mechanical_kills", "doomed"), "shot", "left")
    passing, wanted = F.coalesce("passing", F.lit(0)), F.coalesce("want", F.lit(want_default))
    status = (
        F.when(passing >= wanted, "complete").when(F.col("futile").isNotNull(), "blocked").when(F.coalesce("doomed", F.lit(False)), "doomed").otherwise("active")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return df.select(
        "shot", wanted.alias("want"), zero("takes"), passing.alias("passing"), zero("mechanical_kills"), zero("attempts"),
        F.coalesce("spend_usd", F.lit(0.0)).alias("spend_usd"), status.alias("status"), F.when(status == "blocked", F.col("futile")).alias("blocked_by"),
    )


def submit_gate(candidates: DataFrame, takes: DataFrame, shots: DataFrame, chains: DataFrame, attempts_cap: int | None = None, spend_cap: float | None = None, lineage_cap: int = LINEAGE_CAP) -> DataFrame:
    """(clip, ok, why) for each candidate parent; the first rule that refuses
    is the one told."""
    run = shots.agg(F.sum("attempts").alias("run_attempts"), F.sum("spend_usd").alias("run_spend"))
    df = (
        candidates.select("clip")
        .join(takes.select("clip", "shot", F.lit(True).alias("found")), "clip", "left")
        .join(shots.select("shot", "status", "passing", "want", "blocked_by", "mechanical_kills", F.col("takes").alias("n")), "shot", "left")
        .join(chains, "clip", "left")
        .crossJoin(F.broadcast(run))
    )
    say = F.concat
    s = lambda c: F.col(c).cast("string")
    rules: list[tuple[Column, Column]] = []
    if attempts_cap is not None:
        rules.append((F.col("run_attempts") >= attempts_cap, F.lit(f"global attempt cap {attempts_cap} reached")))
    if spend_cap is not None:
        rules.append((F.col("run_spend") >= spend_cap, say(F.lit("spend $"), F.format_string("%.2f", "run_spend"), F.lit(f" at the ${spend_cap:.2f} cap"))))
    shot = say(F.lit("shot "), F.col("shot"))
    rules += [
        (F.col("found").isNull(), say(F.lit("parent "), s("clip"), F.lit(" not in the scanned takes"))),
        (F.col("status") == "complete", say(shot, F.lit(" complete: "), s("passing"), F.lit(" passing of "), s("want"), F.lit(" wanted"))),
        (F.col("status") == "blocked", say(shot, F.lit(" blocked: "), F.col("blocked_by"), F.lit(" kills under distinct seeds; needs a human, not a reseed"))),
        (F.col("status") == "doomed", say(shot, F.lit(" doomed: "), s("mechanical_kills"), F.lit(" mechanical kills in "), s("n"), F.lit(" takes"))),
        (F.col("length") >= lineage_cap, say(F.lit(f"lineage cap {lineage_cap} reached for the chain ending at "), s("clip"))),
    ]
    why = F.lit(None).cast("string")
    for refused, text in reversed(rules):
        why = F.when(refused, text).otherwise(why)
    return df.select("clip", why.isNull().alias("ok"), why.alias("why"))


def orphan_kills(takes: DataFrame, jobs: DataFrame, landed: DataFrame) -> DataFrame:
    """Killed takes with a clip that no take and no job names as its parent."""
    named = takes.select("parent").union(jobs.select("parent")).where("parent is not null").distinct().withColumnRenamed("parent", "named")
    killed = takes.where("verdict = 'kill'").join(landed.select("clip"), "clip", "left_semi")
    return killed.join(named, F.col("take_id") == F.col("named"), "left_anti").select("clip", "take_id", "shot")


def job_keys(jobs: DataFrame) -> DataFrame:
    """jobs with ``key``: the job id, later repeats suffixed -dup2, -dup3, ..."""
    nth = F.row_number().over(Window.partitionBy("job").orderBy("job_seq"))
    return jobs.withColumn("key", F.when(nth == 1, F.col("job")).otherwise(F.concat("job", F.lit("-dup"), nth.cast("string"))))


def adopt(stubs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows for stubs whose job the table never recorded, one for each job."""
    new = stubs.where("job is not null").join(jobs.select("job").distinct(), "job", "left_anti")
    facts = [c for c in stubs.columns if c != "job"]
    return new.groupBy("job").agg(F.min_by(F.struct(*facts), "clip").alias("s")).select("job", "s.*", F.lit("queued").alias("state"))


def reconcile(jobs: DataFrame, landed: DataFrame, polled: DataFrame) -> DataFrame:
    """(key, state) of jobs that were pending: a clip that landed is done; else
    what the driver says; a driver that doesn't know makes it an error.

    polled: key, state.
    """
    open_ = jobs.where(~F.col("state").isin(*TERMINAL)).select("key", "clip")
    there = landed.select("clip", F.lit(True).alias("there")).distinct()
    said = polled.select("key", F.col("state").alias("said"))
    state = F.when(F.col("there"), "done").otherwise(F.coalesce("said", F.lit("error")))
    return open_.join(there, "clip", "left").join(said, "key", "left").select("key", state.alias("state"))


def rate_window(submits: DataFrame, seconds: int = RATE_SECONDS, rate: int = REGEN_RATE) -> DataFrame:
    """submits with ``recent``, those of the trailing window (itself included),
    and ``over``: it goes beyond the rate.

    The rate is global, so the window would be one partition; rows go by
    windows' length instead, each with the rows of the one before.
    """
    at = F.unix_timestamp("submitted")
    own = F.floor(at / seconds)
    df = submits.withColumn("__at", at).withColumn("__w", F.explode(F.array(F.struct(own.alias("w"), F.lit(True).alias("own")), F.struct((own + 1).alias("w"), F.lit(False).alias("own")))))
    w = Window.partitionBy("__w.w").orderBy("__at").rangeBetween(-seconds, 0)
    df = df.withColumn("recent", F.count(F.lit(1)).over(w)).where("__w.own")
    return df.drop("__at", "__w").withColumn("over", F.col("recent") > rate)


def failure_streaks(jobs: DataFrame, block: int = FAIL_BLOCK) -> DataFrame:
    """Terminal jobs with ``streak``, the shot's straight errors so far, and
    ``blocked``; a success starts anew."""
    w = Window.partitionBy("shot").orderBy("job_seq")
    ended = jobs.where(F.col("state").isin(*TERMINAL))
    runs = ended.withColumn("run", F.count_if(F.col("state") == "done").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("shot", "run").orderBy("job_seq").rowsBetween(Window.unboundedPreceding, 0)
    df = runs.withColumn("streak", F.count_if(F.col("state") == "error").over(in_run)).drop("run")
    return df.withColumn("blocked", F.col("streak") >= block)


def settled(before: DataFrame, now: DataFrame, settle: float, at: float) -> DataFrame:
    """Clips (clip, size, mtime in seconds) unchanged since the poll before,
    and for ``settle`` seconds."""
    same = now.join(before.select("clip", "size", "mtime"), ["clip", "size", "mtime"], "left_semi")
    return same.where(F.lit(at) - F.col("mtime") >= settle)
