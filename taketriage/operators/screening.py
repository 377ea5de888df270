"""Judge passes over takes: screen, escalate, scrutinize.

The judge is any callable of (messages, temperature); it is asked on the
executors, where the clips' frames are made, and its replies are checkpointed
once, as asking again costs money and answers may differ.  All that follows
from the replies is a plain plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.text import numbered, parse_answers, parse_defects
from ..plans.session import cut
from ..sources import external
from . import judge as j


@dataclass
class Block:
    """A judge's findings: frames keyed by clip."""

    defects: DataFrame
    uncertain: DataFrame
    unparsed: DataFrame
    usage: DataFrame


def pending_judgement(takes: DataFrame, force: bool = False) -> DataFrame:
    """Takes for the judge: not killed already, and not judged unless forced."""
    alive = takes.where(F.coalesce(F.col("verdict") != "kill", F.lit(True)))
    return alive if force else alive.where(~F.coalesce("judged", F.lit(False)))


def needs_review(clips: DataFrame, takes: DataFrame, force: bool = False) -> DataFrame:
    """Clips whose content has no review yet: (clip, take_id) not among the reviewed."""
    if force:
        return clips
    done = takes.where("verdict is not null and take_id is not null").select("clip", "take_id")
    return clips.join(done, ["clip", "take_id"], "left_anti")


def asks(takes: DataFrame, rules: DataFrame, questions: DataFrame, context: DataFrame, samples: int = 1) -> DataFrame:
    """(clip, rule, samples, checklist, body): what to ask of each take.

    rules: rule, prompt (of a rule without questions).  context: clip, rule,
    context of the rules that apply (judge.needs_context); it takes the place
    of {prompt}.  Rules without questions are asked once.
    """
    per = questions.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "ask"))), lambda x: x["ask"]).alias("asks"))
    known = rules.select("rule", "prompt").join(per, "rule", "left")
    rows = takes.select("clip").join(context, "clip").join(F.broadcast(known), "rule")
    lines = numbered(F.col("asks"))
    text = F.when(F.col("asks").isNotNull(), F.concat(F.lit("Rule "), F.col("rule"), F.lit(": answer each question from the frames.\n"), lines)).otherwise(
        F.concat(F.lit("Rule "), F.col("rule"), F.lit(": "), F.col("prompt"))
    )
    filled = F.when(F.col("context") != "", F.replace(text, F.lit("{prompt}"), F.col("context"))).otherwise(text)
    checklist = F.col("asks").isNotNull()
    return rows.select("clip", "rule", F.when(checklist, F.lit(max(1, samples))).otherwise(F.lit(1)).alias("samples"), checklist.alias("checklist"), filled.alias("body"))


def screened(rows: DataFrame, times: DataFrame, questions: DataFrame, ask: Callable, frames: Callable = external.jpegs) -> Block:
    """Asks, parses, votes and merges.  times: clip, times of its frames."""
    replies = cut(external.screen(rows, times, ask, frames))
    listed = replies.where("checklist").withColumn("answers", parse_answers(F.col("reply"))).where("answers is not null")
    answers = listed.select("clip", "rule", "sample", F.posexplode("answers").alias("pos", "a")).select("clip", "rule", "sample", "pos", "a.*")
    samples = listed.groupBy("clip", "rule").agg(F.countDistinct("sample").alias("n"), F.min("first_t").alias("first_t"))
    votes = cut(j.vote(answers, questions, samples, F.col("first_t")))
    told = replies.where("not checklist").withColumn("found", parse_defects(F.col("reply"))).where("found is not null")
    plain = told.select("clip", "rule", F.posexplode("found").alias("pos", "d")).select("clip", "rule", "d.t", "d.severity", F.lit(None).cast("double").alias("confidence"), "d.note", "pos")
    voted = j.voted_defects(votes).withColumnRenamed("q", "pos").select("clip", "rule", "t", "severity", "confidence", "note", "pos")
    parsed = samples.select("clip", "rule").unionByName(told.select("clip", "rule"))
    used = replies.groupBy("clip", "rule").agg(*[F.sum(c).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens")])
    return Block(cut(j.merge(voted.unionByName(plain))), j.uncertain_rules(votes), j.unparsed_rules(replies, parsed), used)


def escalated(block: Block, rows: DataFrame, times: DataFrame, rules: DataFrame, questions: DataFrame, strong: Callable, frames: Callable = external.jpegs) -> tuple[Block, DataFrame, DataFrame]:
    """The unsure rules judged again, once, by a stronger judge, whose findings
    replace theirs; the strong judge's usage, which is priced apart; and what
    was judged again."""
    subset = cut(j.escalation_set(block.uncertain, block.unparsed, rules))
    once = rows.withColumn("samples", F.lit(1)).join(subset, ["clip", "rule"], "left_semi")
    again = screened(once, times, questions, strong, frames)
    pos = lambda df: df.withColumn("pos", F.lit(0))
    defects = j.escalation_merge(pos(block.defects), subset, pos(again.defects))
    uncertain, unparsed = j.after_escalation(block.uncertain, block.unparsed, subset, again.unparsed)
    return Block(defects, uncertain, unparsed, block.usage), again.usage, subset


def scrutinized(
    takes: DataFrame, rows: DataFrame, times: DataFrame, parent_rules: DataFrame, rules: DataFrame, questions: DataFrame, ask: Callable, strong: Callable | None = None, frames: Callable = external.jpegs
) -> tuple[Block, DataFrame | None, DataFrame]:
    """Reruns that pass, judged again on what killed their ancestors: at least
    SCRUTINY_SAMPLES times, and all of it by the strong judge if there is one.
    With the strong judge's usage, and what was judged."""
    subset = cut(j.scrutiny_set(takes, parent_rules, rules))
    more = F.when(F.col("checklist"), F.greatest("samples", F.lit(j.SCRUTINY_SAMPLES))).otherwise(F.col("samples"))
    mine = rows.join(subset, ["clip", "rule"], "left_semi").withColumn("samples", more)
    block = screened(mine, times, questions, ask, frames)
    if strong is None:
        return block, None, subset
    all_unsure = Block(block.defects, j.all_unsure(block.uncertain, subset), block.unparsed, block.usage)
    block, used, _ = escalated(all_unsure, mine, times, rules, questions, strong, frames)
    return block, used, subset


def _names(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("clip").agg(F.array_sort(F.collect_set("rule")).alias(name))


def usage_json(usage: DataFrame, name: str) -> DataFrame:
    """(clip, name): calls and tokens, in all and by rule."""
    per = F.struct("calls", "prompt_tokens", "completion_tokens")
    sums = [F.sum(c).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens")]
    by = usage.groupBy("clip").agg(*sums, F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", per.alias("u"))))).alias("rules"))
    return by.select("clip", F.struct("calls", "prompt_tokens", "completion_tokens", "rules").alias(name))


def block_json(clips: DataFrame, block: Block, engine: str, skipped: DataFrame | None = None, samples: int = 1, strong: tuple[str, DataFrame, DataFrame] | None = None, scrutinized_: DataFrame | None = None, guarded: DataFrame | None = None) -> DataFrame:
    """(clip, block): the judge block of each clip as JSON text.  guarded: clip,
    root_prompt of those judged by the prompt of their root."""
    entry = F.struct("t", "rule", "t_end", "severity", "confidence", "note")
    found = block.defects.groupBy("clip").agg(F.array_sort(F.collect_list(entry)).alias("defects"))
    df = clips.select("clip", F.lit(engine).alias("engine"), F.lit(samples if samples > 1 else None).cast("int").alias("samples")).join(found, "clip", "left")
    lists = {"uncertain": block.uncertain, "unparsed": block.unparsed, "skipped": skipped, "scrutinized": scrutinized_, "escalated": strong and strong[2]}
    for name, rows in lists.items():
        if rows is not None:
            df = df.join(_names(rows, name), "clip", "left")
    df = df.join(usage_json(block.usage, "usage"), "clip", "left")
    if strong:
        df = df.join(usage_json(strong[1], "strong_usage"), "clip", "left").withColumn("strong_engine", F.when(F.col("escalated").isNotNull(), strong[0]))
    if guarded is not None:
        df = df.join(guarded, "clip", "left")
    none = F.array().cast("array<string>")
    always = [F.coalesce(c, none).alias(c) if c in df.columns else none.alias(c) for c in ("skipped", "unparsed", "uncertain")]
    empty = F.array().cast(df.schema["defects"].dataType)
    more = [c for c in ("samples", "escalated", "strong_engine", "strong_usage", "scrutinized", "usage", "root_prompt") if c in df.columns]
    return df.select("clip", F.to_json(F.struct("engine", F.coalesce("defects", empty).alias("defects"), *always, *more)).alias("block"))
