"""Human labels: conformal threshold, fitted weights, judge agreement."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.kernels import audit_pick, kappa
from .order import running

# fixed values
DEFAULT_ALPHA, MIN_KAPPA = 0.05, 0.6


def valid_gold(gold: DataFrame) -> DataFrame:
    return gold.where(F.col("label").isin("pass", "kill"))


def conformal(scored: DataFrame, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """One row: alpha, lambda, n_pass, n_kill, kill_recall, needed.

    scored: label, score.  Lambda is the k-th smallest score of passes, with
    k = ceil((n + 1)(1 - alpha)), null if there are fewer.  Scores are counted
    by value first, so the running count goes over distinct scores, in parts.
    """
    passes = scored.where("label = 'pass'").groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    ranked = running(passes, ["score"], before="c").select("score", (F.col("before") + F.col("c")).alias("upto"))
    n = scored.agg(F.count_if(F.col("label") == "pass").alias("n_pass"), F.count_if(F.col("label") == "kill").alias("n_kill"))
    n = n.withColumn("k", F.ceil((F.col("n_pass") + 1) * (1 - F.lit(alpha))))
    lam = ranked.crossJoin(F.broadcast(n)).where("upto >= k").agg(F.min("score").alias("lambda"))
    above = (
        scored.where("label = 'kill'").crossJoin(F.broadcast(lam)).agg(F.avg(F.when(F.col("score") > F.col("lambda"), 1.0).otherwise(0.0)).alias("r"))
    )
    return n.crossJoin(lam).crossJoin(above).select(
        F.lit(alpha).alias("alpha"),
        "lambda",
        "n_pass",
        "n_kill",
        F.when(F.col("lambda").isNotNull(), F.col("r")).alias("kill_recall"),
        F.when(F.col("lambda").isNull(), F.lit(math.ceil((1 - alpha) / alpha))).alias("needed"),
    )


def rule_features(defects: DataFrame) -> DataFrame:
    """(clip, rule, x): greatest severity times confidence, as a share of 5;
    the vectors in long form, rules without a defect being 0."""
    s = F.col("severity") * F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0))
    return defects.groupBy("clip", "rule").agg((F.max(s) / 5.0).alias("x"))


def feature_matrix(features: DataFrame, rules: list[str]) -> DataFrame:
    return features.groupBy("clip").pivot("rule", rules).agg(F.first("x")).na.fill(0.0)


def fit_weights(gold: DataFrame, features: DataFrame, iters: int = 2000, lr: float = 0.5, l2: float = 1e-3) -> DataFrame:
    """One row: weights map, bias, n_fit, fit_accuracy of a logistic fit.

    gold: clip, label.  Full-batch gradient descent from zero, bias without
    penalty.  Equal feature rows with equal labels are merged with a count
    first (features take few values), so that what meets in the one group is
    bounded by distinct rows, and by how many takes people label, not by takes.
    """
    entries = F.array_sort(F.collect_list(F.struct("rule", "x")))
    rows = gold.join(features, "clip", "left").groupBy("clip", "label").agg(entries.alias("f"))
    rows = rows.groupBy("label", "f").agg(F.count(F.lit(1)).alias("c"))

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [[(e["rule"], e["x"]) for e in f if e["rule"] is not None] for f in pdf["f"]]
        names = sorted({r for f in lists for r, _ in f})
        c = pdf["c"].to_numpy(float)
        if c.sum() < 4:
            raise RuntimeError(f"at least 4 labelled takes are needed to fit, found {int(c.sum())}")
        if not names:
            raise RuntimeError("no defects among the labelled takes: nothing to fit")
        at = {r: i for i, r in enumerate(names)}
        x = np.zeros((len(lists), len(names)))
        for i, f in enumerate(lists):
            for r, v in f:
                x[i, at[r]] = v
        y = (pdf["label"] == "kill").to_numpy(float)
        w, b, n = np.zeros(len(names)), 0.0, c.sum()
        prob = lambda: 1.0 / (1.0 + np.exp(-np.clip(b + x @ w, -60, 60)))
        for _ in range(iters):
            err = (prob() - y) * c
            b, w = b - lr * err.sum() / n, w - lr * (x.T @ err / n + l2 * w)
        right = (((prob() >= 0.5) == (y == 1)) * c).sum()
        return pd.DataFrame(
            {"weights": [{r: round(float(v), 4) for r, v in zip(names, w, strict=True)}], "bias": [round(float(b), 4)], "n_fit": [int(n)], "fit_accuracy": [round(float(right / n), 3)]}
        )

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(descend, "weights map<string,double>, bias double, n_fit long, fit_accuracy double")


def judge_agreement(gold: DataFrame, predicted: DataFrame, landed: DataFrame) -> DataFrame:
    """One row: n, agreement, kappa, false_kills, missed_kills, missing_clips.

    gold: clip, label; predicted: clip, label of the judge; landed: clips that
    exist.  Labelled takes without a clip are counted apart.
    """
    there = gold.join(landed.select("clip"), "clip", "left_semi")
    missing = gold.join(landed.select("clip"), "clip", "left_anti").agg(F.count(F.lit(1)).alias("missing_clips"))
    g, p = F.col("label"), F.col("predicted")
    pairs = there.join(predicted.select("clip", F.col("label").alias("predicted")), "clip")
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(g == p, 1.0).otherwise(0.0)).alias("agreement"),
        kappa(g, p).alias("kappa"),
        F.count_if((g == "pass") & (p == "kill")).alias("false_kills"),
        F.count_if((g == "kill") & (p == "pass")).alias("missed_kills"),
    ).crossJoin(missing)


def judge_gate(runs: DataFrame, floor: float = MIN_KAPPA, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (or one for each history, told by ``by``): ok, why — may an
    unattended loop trust this judge?

    runs: seq, kappa, created of the first history that exists.
    """
    last = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("kappa", "created"), "seq").alias("last"))
    k = F.col("last.kappa")
    why = (
        F.when(F.col("n") == 0, "no judge-check runs found")
        .when(k.isNull(), "the last judge-check run records no kappa")
        .when(k < floor, F.concat(F.lit("judge kappa "), F.format_string("%.2f", k), F.lit(" (checked "), F.col("last.created"), F.lit(f") is below the {floor:.2f} floor")))
    )
    return last.select(*by, why.isNull().alias("ok"), why.alias("why"))


def audited(takes: DataFrame, rate: float) -> DataFrame:
    """takes with audit (picked reruns that pass) and the verdict that follows."""
    pick = F.col("parent").isNotNull() & (F.col("verdict") != "kill") & audit_pick(F.col("take_id"), rate)
    return takes.withColumn("audit", pick).withColumn("verdict", F.when(pick, "review").otherwise(F.col("verdict")))


def top_weights(weights: Column, k: int = 5) -> Column:
    by_size = F.array_sort(F.map_entries(weights), lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(0))
    return F.slice(by_size, 1, k)
