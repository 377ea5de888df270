"""Lineage: what lies above each take, safe against cycles and gaps.

Chains are climbed by doubling: each round a step is joined with the step that
begins where it ends, so a chain of any length takes as many rounds as its
length has binary digits, and no row for each of its hops.  Steps that still
don't end then lead round a cycle; those alone are walked hop by hop.  Rounds
are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import kill_class, kill_side
from ..plans.session import cut

# fixed values
LINEAGE_CAP = 4


def climbed(takes: DataFrame, own: Column | None = None, join: Callable[[Column, Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """((clip, depth, value) of takes whose chain ends, clip of those on or
    below a cycle).

    depth: hops above; an ancestor outside the index is one, and the last.
    value: ``own`` of the known ancestors, ``join``-ed nearest first.
    """
    own = F.lit(None).cast("string") if own is None else own
    join = join or (lambda near, far: near)
    index = cut(
        takes.where("take_id is not null").groupBy(F.col("take_id").alias("id")).agg(F.max_by(F.struct("parent", own.alias("own")), "clip").alias("x")).select("id", "x.*")
    )
    above = index.select(F.col("id").alias("next"), F.col("own").alias("value"))
    first = index.where("parent is not null").select("id", F.col("parent").alias("next")).join(above, "next", "left")
    known = index.select(F.col("id").alias("next"), F.lit(True).alias("known"))
    step = first.join(known, "next", "left").select("id", F.when(F.col("known"), F.col("next")).alias("next"), F.lit(1).cast("long").alias("depth"), "value")
    step = cut(step)
    rounds = max(1, step.count()).bit_length()
    for _ in range(rounds):
        far = step.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("depth").alias("more"), F.col("value").alias("beyond"))
        joined = step.join(far, "next", "left").select(
            "id", F.col("then").alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.when(F.col("more").isNull(), F.col("value")).otherwise(join(F.col("value"), F.col("beyond"))).alias("value")
        )
        step = cut(joined)
        if step.where("next is not null").isEmpty():
            break
    # a take's own row may not be the index's: its step is to its parent, then the parent's
    up = index.select(F.col("id").alias("parent"), "own").join(step.select(F.col("id").alias("parent"), "next", "depth", "value"), "parent", "left")
    mine = takes.select("clip", "parent").join(up.withColumn("found", F.lit(True)), "parent", "left")
    depth = F.when(F.col("parent").isNull(), 0).otherwise(1 + F.coalesce("depth", F.lit(0))).cast("int")
    value = F.when(F.col("depth").isNull(), F.col("own")).otherwise(join(F.col("own"), F.col("value")))
    mine = cut(mine.select("clip", F.col("next").isNotNull().alias("loops"), depth.alias("depth"), value.alias("value")))
    return mine.where("not loops").drop("loops"), mine.where("loops").select("clip")


def walks(takes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(clip, depth, pid, known, loops): every hop of the takes (``of`` some
    clips), nearest first, one round a hop: for chains that lead into a cycle.

    ``pid`` is the ancestor's take_id; ``known``: it is in the index; ``loops``:
    its own parent came before, which ends the walk.  An ancestor outside the
    index is a hop, and the last one.
    """
    index = (
        takes.where("take_id is not null")
        .groupBy(F.col("take_id").alias("pid"))
        .agg(F.max_by(F.struct("parent"), "clip").alias("up"))
        .select("pid", F.col("up.parent").alias("next"), F.lit(True).alias("known"))
    )
    begin = takes if of is None else takes.join(of, "clip", "left_semi")
    open_ = begin.where("parent is not null").select("clip", F.lit(1).alias("depth"), F.col("parent").alias("pid"), F.array("parent").alias("seen"))
    rounds = []
    while True:
        hop = open_.join(index, "pid", "left").withColumn("known", F.coalesce("known", F.lit(False)))
        hop = cut(hop.withColumn("loops", F.coalesce(F.array_contains("seen", F.col("next")), F.lit(False))))
        rounds.append(hop.select("clip", "depth", "pid", "known", "loops"))
        more = hop.where("next is not null and not loops")
        if more.isEmpty():
            break
        open_ = more.select("clip", (F.col("depth") + 1).alias("depth"), F.col("next").alias("pid"), F.concat("seen", F.array("next")).alias("seen"))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def depths(takes: DataFrame) -> DataFrame:
    """(clip, depth): hops above each take."""
    done, loops = climbed(takes)
    out = done.select("clip", "depth")
    if loops.isEmpty():
        return out
    return out.unionByName(walks(takes, loops).groupBy("clip").agg(F.max("depth").alias("depth")))


def lineage_by_shot(takes: DataFrame) -> DataFrame:
    """shot, reruns, max_depth."""
    d = takes.join(depths(takes), "clip", "left")
    return d.groupBy(F.coalesce("shot", F.lit("untagged")).alias("shot")).agg(
        F.count_if(F.col("parent").isNotNull()).alias("reruns"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth")
    )


def chain_lengths(takes: DataFrame) -> DataFrame:
    """(clip, length): takes in the chain, itself and an unknown last one
    included; on a cycle, up to and with the first take met again."""
    done, loops = climbed(takes)
    out = done.select("clip", (1 + F.col("depth")).alias("length"))
    if loops.isEmpty():
        return out
    own = walks(takes, loops).join(takes.select("clip", "take_id"), "clip")
    per = own.groupBy("clip").agg(
        F.max("depth").alias("d"), F.bool_or("loops").alias("loops"), F.coalesce(F.bool_or(F.col("pid") == F.col("take_id")), F.lit(False)).alias("back")
    )
    again = F.when(F.col("loops") & ~F.col("back"), 1).otherwise(0)
    return out.unionByName(per.select("clip", (1 + F.col("d") + again).alias("length")))


def root_prompts(takes: DataFrame) -> DataFrame:
    """(clip, root_prompt): the prompt recorded deepest above each take."""
    done, loops = climbed(takes, F.col("prompt_text"), lambda near, far: F.coalesce(far, near))
    out = done.where("value is not null").select("clip", F.col("value").alias("root_prompt"))
    if loops.isEmpty():
        return out
    prompts = takes.where("take_id is not null and prompt_text is not null").select(F.col("take_id").alias("pid"), "prompt_text")
    round_ = walks(takes, loops).where("known").join(prompts, "pid").groupBy("clip").agg(F.max_by("prompt_text", "depth").alias("root_prompt"))
    return out.unionByName(round_)


def intent_guard(takes: DataFrame) -> DataFrame:
    """takes with judged_prompt, the root's where it differs, and guarded."""
    df = takes.join(root_prompts(takes), "clip", "left")
    guarded = F.col("root_prompt").isNotNull() & ~F.col("root_prompt").eqNullSafe(F.col("prompt_text"))
    return df.withColumn("guarded", guarded).withColumn("judged_prompt", F.when(guarded, F.col("root_prompt")).otherwise(F.col("prompt_text"))).drop("root_prompt")


def parent_kill_rules(takes: DataFrame, reasons: DataFrame) -> DataFrame:
    """(clip, rule): rules that killed an ancestor; mechanical and calibrated
    kills name none.  reasons: clip, reason of killed takes."""
    named = reasons.where((kill_side(F.col("reason")) == "rule") & (kill_class(F.col("reason")) != "calibrated"))
    per = named.groupBy("clip").agg(F.array_sort(F.collect_set(kill_class(F.col("reason")))).alias("rules"))  # of a rubric's rules
    known = cut(takes.select("clip", "take_id", "parent").join(per, "clip", "left"))
    none = F.array().cast("array<string>")
    either = lambda a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none))
    done, loops = climbed(known, F.col("rules"), either)
    out = done.select("clip", F.explode("value").alias("rule"))
    if loops.isEmpty():
        return out
    told = known.select(F.col("take_id").alias("pid"), F.explode("rules").alias("rule"))
    return out.unionByName(walks(takes, loops).where("known").join(told, "pid").select("clip", "rule").distinct())
