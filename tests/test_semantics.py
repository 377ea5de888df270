"""Pinned behaviour on small inline tables."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from taketriage import schema
from taketriage.functions import kernels, text
from taketriage.operators import breaker, brief, cost, judge, labels, ledger, lineage, rank, signals


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def by_clip(df, *cols):
    return {r["clip"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_doom_probability(spark):
    p = lambda k, n: one(spark, p=kernels.doom_probability(F.lit(k), F.lit(n)))["p"]
    assert p(0, 0) == pytest.approx(0.25)
    assert p(8, 0) == pytest.approx(0.92492, abs=1e-5)
    assert p(7, 0) == pytest.approx(0.89989, abs=1e-5)
    assert p(8, 1) == pytest.approx(0.75597, abs=1e-5)
    assert 0 <= p(900, 5000) < 1e-9
    r = one(spark, p=kernels.doom_probability_any_prior(F.lit(8), F.lit(0), prior=(1.0, 1.0)))
    assert r["p"] == pytest.approx(0.92492, abs=1e-5)


def test_beta_tail_is_monotone_and_symmetric():
    t = kernels._log_beta_tail
    xs = [t(3, 5, i / 20) for i in range(21)]
    assert xs == sorted(xs) and xs[0] == 0 and xs[-1] == 1
    assert t(2.5, 4.5, 0.3) == pytest.approx(1 - t(4.5, 2.5, 0.7))


def test_vote(spark):
    answers = spark.createDataFrame(
        [(1, "r", s, s, 1, y, None if s else 2.0, f"n{s}") for s, y in enumerate([True, True, False])] + [(2, "r", 0, 0, 1, True, None, ""), (2, "r", 1, 1, 1, False, None, "")],
        "clip long, rule string, sample int, pos int, q int, yes boolean, t double, note string",
    )
    questions = spark.createDataFrame([("r", 1, 9, "look\nis it off?")], "rule string, q int, severity int, ask string")
    samples = spark.createDataFrame([(1, "r", 3), (2, "r", 2)], "clip long, rule string, n long")
    v = judge.vote(answers, questions, samples, 0.5)
    assert by_clip(v, "confidence", "severity", "t", "note", "uncertain") == {1: (0.67, 5, 2.0, "n0", True), 2: (0.5, 5, 0.5, "is it off?", True)}
    kills = judge.rule_kills(
        judge.voted_defects(v).withColumn("t_end", F.lit(None).cast("double")), spark.createDataFrame([("r", 4)], "rule string, fail_at int")
    )
    assert [(r["clip"], r["reason"]) for r in kills.collect()] == [(1, "r severity 5 at 2.0s: n0")]


def test_merge(spark):
    rows = [(1, "a", 3.875 + i * 0.0764, s, c, i, f"n{i}") for i, (s, c) in enumerate([(3, None), (4, 0.5), (4, 0.67), (2, None), (3, 0.9), (1, None), (1, None)])]
    rows += [(1, "a", 9.0, 2, None, 9, "far"), (1, "b", 4.0, 2, None, 10, "other")]
    df = spark.createDataFrame(rows, "clip long, rule string, t double, severity int, confidence double, pos int, note string")
    out = {(r["rule"], round(r["t"], 3)): r for r in judge.merge(df).collect()}
    m = out["a", 3.875]
    assert (round(m["t_end"], 3), m["severity"], m["confidence"], m["note"], m["merged"]) == (4.333, 4, 0.9, "n1", 7)
    assert out["a", 9.0]["t_end"] is None and ("b", 4.0) in out


def test_kill_score_and_conformal(spark):
    takes = spark.createDataFrame([(1,), (2,), (3,)], "clip long")
    d = spark.createDataFrame([(1, 5, 0.67), (1, 3, None), (2, 4, 0.0)], "clip long, severity int, confidence double")
    assert by_clip(judge.kill_scores(takes, d), "score") == {1: pytest.approx(3.35), 2: 4.0, 3: 0.0}
    scored = spark.createDataFrame([("pass", float(s)) for s in (0, 0, 1, 2, 4)] + [("kill", 5.0), ("kill", 1.0)], "label string, score double")
    r = labels.conformal(scored, 0.5).first()
    assert (r["lambda"], r["kill_recall"], r["n_pass"], r["needed"]) == (1.0, 0.5, 5, None)
    r = labels.conformal(scored, 0.05).first()
    assert (r["lambda"], r["kill_recall"], r["needed"]) == (None, None, 19)


def test_calibration_off_means_no_kill(spark):
    scores = spark.createDataFrame([(1, 5.0)], "clip long, score double")
    cal = spark.createDataFrame([(None,)], "lambda double")
    assert judge.calibrated_kills(scores, cal).first()["killed"] is False


def test_fit(spark):
    gold = spark.createDataFrame([(i, "kill" if i < 8 else "pass") for i in range(12)], "clip long, label string")
    f = spark.createDataFrame([(i, "a.kills" if i < 8 else "b.noise", 0.8) for i in range(12)], "clip long, rule string, x double")
    r = labels.fit_weights(gold, f).first()
    assert r["weights"]["a.kills"] > r["weights"]["b.noise"] and r["fit_accuracy"] >= 0.9 and r["n_fit"] == 12
    with pytest.raises(Exception, match="4 labelled"):
        labels.fit_weights(gold.limit(2), f).collect()


def test_kappa(spark):
    def k(pairs):
        return spark.createDataFrame(pairs, "g string, p string").agg(kernels.kappa(F.col("g"), F.col("p")).alias("k")).first()["k"]

    assert k([("kill", "kill"), ("pass", "pass")]) == 1.0
    assert k([("kill", "kill"), ("kill", "pass"), ("pass", "kill"), ("pass", "pass")]) == 0.0
    assert k([("pass", "pass")]) == 1.0
    assert k([]) is None


@pytest.mark.parametrize("runs,ok,why", [([], False, "no judge-check"), ([(1, 0.9, "a"), (2, 0.5, "b")], False, "0.50 (checked b) is below the 0.60"), ([(1, 0.2, "a"), (2, 0.7, "b")], True, None), ([(1, None, "a")], False, "records no kappa")])
def test_judge_gate(spark, runs, ok, why):
    r = labels.judge_gate(spark.createDataFrame(runs, "seq int, kappa double, created string")).first()
    assert r["ok"] is ok and (why in r["why"] if why else r["why"] is None)


def chain(spark, *rows):
    return spark.createDataFrame([(c, c, p, "s", None) for c, p in rows], "clip string, take_id string, parent string, shot string, prompt_text string")


def test_lineage_cycles_and_gaps(spark):
    t = chain(spark, ("a", "b"), ("b", "a"), ("x", None), ("y", "x"), ("z", "gone"), ("s", "s"), ("p", "q"), ("q", "r"), ("r", "q"))
    assert by_clip(lineage.chain_lengths(t), "length") == {"a": 3, "b": 3, "x": 1, "y": 2, "z": 2, "s": 2, "p": 4, "q": 3, "r": 3}
    d = by_clip(lineage.depths(t), "depth")
    assert (d["a"], d["x"], d["y"], d["z"]) == (2, 0, 1, 1)
    rules = lineage.parent_kill_rules(t, spark.createDataFrame([("b", "hand severity 4 at 1.0s: x"), ("q", "face severity 4 at 1.0s: x")], "clip string, reason string"))
    assert sorted(tuple(r) for r in rules.collect()) == [("a", "hand"), ("b", "hand"), ("p", "face"), ("q", "face"), ("r", "face")]


def test_long_chains(spark):
    t = chain(spark, ("c0", "gone"), *[(f"c{i}", f"c{i - 1}") for i in range(1, 70)])
    t = t.withColumn("prompt_text", F.when(F.col("clip").isin("c3", "c40"), F.col("clip")))
    assert by_clip(lineage.chain_lengths(t), "length") == {f"c{i}": i + 2 for i in range(70)}
    assert by_clip(lineage.root_prompts(t), "root_prompt") == {f"c{i}": "c3" for i in range(4, 70)}
    rules = lineage.parent_kill_rules(t, spark.createDataFrame([("c9", "hand severity 4 at 1.0s: x")], "clip string, reason string"))
    assert sorted(int(r["clip"][1:]) for r in rules.collect()) == list(range(10, 70))


def test_running_sums_over_parts(spark):
    from taketriage.operators.order import running

    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 9).alias("v"), (F.col("id") / 4).alias("x"))
    rows = sorted((r["k"], r["v"], r["x"]) for r in df.collect())
    got = sorted((r["k"], r["a"], r["b"]) for r in running(df, ["k"], a="v", b="x").collect())
    assert got == [(k, sum(v for _, v, _ in rows[:n]), sum(x for _, _, x in rows[:n])) for n, (k, _, _) in enumerate(rows)]


def test_intent_guard(spark):
    t = spark.createDataFrame(
        [("c1", "i1", None, "root"), ("c2", "i2", "i1", None), ("c3", "i3", "i2", "patched"), ("c4", "i4", "i1", "root")], "clip string, take_id string, parent string, prompt_text string"
    )
    out = by_clip(lineage.intent_guard(t), "judged_prompt", "guarded")
    assert out == {"c1": ("root", False), "c2": ("root", True), "c3": ("root", True), "c4": ("root", False)}


def test_parent_kill_rules_skip_mechanical_and_calibrated(spark):
    t = chain(spark, ("a", None), ("b", "a"), ("c", "b"))
    why = spark.createDataFrame([("a", "hand.x severity 4 at 1.0s: n"), ("a", "black for 3.0s of 4.0s"), ("b", "calibrated kill score 4 > 3")], "clip string, reason string")
    got = lineage.parent_kill_rules(t, why).collect()
    assert sorted((r["clip"], r["rule"]) for r in got) == [("b", "hand.x"), ("c", "hand.x")]


def test_breaker_boundary(spark):
    rows = [(i, f"s{n}", "kill", False, 1 + i) for n in (7, 8) for i in range(n)] + [(99, None, "kill", False, 1)]
    t = spark.createDataFrame(rows, "clip long, shot string, verdict string, judged boolean, rank_in_shot int")
    got = {r["shot"]: (r["doomed"], r["worst"]) for r in breaker.breaker_states(t).collect()}
    assert got == {"s7": (False, 6), "s8": (True, 7)}


def test_futility_needs_distinct_seeds(spark):
    rows = [("two", "x severity 4 at 1.0s: n", s) for s in ("1", "2", "2")] + [("three", "x severity 4 at 1.0s: n", s) for s in ("1", "2", "3")] + [("none", "black for 1.0s of 1.0s", None)] * 4
    got = ledger.futility(spark.createDataFrame(rows, "shot string, reason string, signature string")).collect()
    assert [(r["shot"], r["rule"]) for r in got] == [("three", "x")]


def gate_inputs(spark, status="active", length=1, spend=1.1):
    takes = spark.createDataFrame([("c", "s")], "clip string, shot string")
    shots = spark.createDataFrame(
        [("s", status, 1, 1, "hand", 8, 9, 5, spend)], "shot string, status string, passing long, want int, blocked_by string, mechanical_kills long, takes long, attempts long, spend_usd double"
    )
    return takes, shots, spark.createDataFrame([("c", length)], "clip string, length int")


@pytest.mark.parametrize(
    "kw,caps,clip,why",
    [
        ({}, {}, "c", None),
        ({}, {"spend_cap": 1.0}, "c", "spend $1.10 at the $1.00 cap"),
        ({}, {"attempts_cap": 5, "spend_cap": 1.0}, "c", "global attempt cap 5 reached"),
        ({}, {}, "d", "parent d not in the scanned takes"),
        ({"status": "complete", "length": 9}, {}, "c", "shot s complete: 1 passing of 1 wanted"),
        ({"status": "blocked"}, {}, "c", "shot s blocked: hand kills under distinct seeds; needs a human, not a reseed"),
        ({"status": "doomed"}, {}, "c", "shot s doomed: 8 mechanical kills in 9 takes"),
        ({"length": 4}, {}, "c", "lineage cap 4 reached for the chain ending at c"),
    ],
)
def test_submit_gate_order(spark, kw, caps, clip, why):
    takes, shots, chains = gate_inputs(spark, **kw)
    r = ledger.submit_gate(spark.createDataFrame([(clip,)], "clip string"), takes, shots, chains, **caps).first()
    assert (r["ok"], r["why"]) == (why is None, why)


def test_job_keys_and_streaks(spark):
    jobs = spark.createDataFrame([(i, j, "s", s) for i, (j, s) in enumerate([("a", "error"), ("a", "error"), ("b", "done"), ("a", "error"), ("c", "running")])], "job_seq long, job string, shot string, state string")
    assert [r["key"] for r in ledger.job_keys(jobs).orderBy("job_seq").collect()] == ["a", "a-dup2", "b", "a-dup3", "c"]
    assert [(r["job_seq"], r["streak"]) for r in ledger.failure_streaks(jobs).orderBy("job_seq").collect()] == [(0, 1), (1, 2), (2, 0), (3, 1)]


def test_flicker_masks_motion(spark):
    def score(rows):
        return signals.flicker(spark.createDataFrame([(1, i, float(i), float(a), float(d)) for i, (a, d) in enumerate(rows)], "clip long, n long, pts double, yavg double, ydif double")).first()["flicker"]

    calm = [(100, 1)] * 20
    assert score(calm[:10] + [(180, 60)] + [(180, 1)] * 10) < 0.01
    assert score([(100 if i % 2 else 130, 30) for i in range(20)]) > 0.05
    assert score([(100, 1)]) == 0.0


def test_candidate_frames_cover_calm_stretches(spark):
    rows = [(1, i, i / 8, 0.0, 50.0 - i if i in range(20, 27) else 0.0) for i in range(80)]
    f = spark.createDataFrame(rows, "clip long, n long, pts double, yavg double, ydif double")
    t = sorted(r["t"] for r in signals.candidate_frames(f).collect())
    assert len(t) == 16 and t[0] == 0.0 and sum(x < 2.0 for x in t) >= 4


def test_mechanical_kills(spark):
    takes = spark.createDataFrame([(1, 4.0, None), (2, 4.0, ["no moov"]), (3, 4.0, None), (4, None, None)], "clip long, duration double, errors array<string>")
    spans = spark.createDataFrame([(1, "freeze", 1.0, None), (3, "black", 0.0, 2.0), (4, "black", 0.0, 9.0)], "clip long, kind string, s double, e double")
    got = by_clip(signals.mechanical_kills(takes, spans), "reasons")
    assert got == {1: ["frozen for 3.0s of 4.0s"], 2: ["probe: no moov"], 3: [], 4: []}


def test_mechanical_kills_in_any_order_of_spans(spark):
    """In some orders a plain sum of these freezes is 12.65, in others the double below it, which reads 12.6."""
    freezes = [(0.375, None), (1.625, None), (0.0, 1.5), (0.0, 0.75)]
    orders = list(enumerate(itertools.permutations(freezes)))
    takes = spark.createDataFrame([(i, 6.2, None) for i, _ in orders], "clip long, duration double, errors array<string>")
    spans = spark.createDataFrame([(i, "freeze", s, e) for i, p in orders for s, e in p], "clip long, kind string, s double, e double")
    got = by_clip(signals.mechanical_kills(takes, spans.coalesce(1)), "freeze_s", "reasons")
    assert got == {i: (12.65, ["frozen for 12.7s of 6.2s"]) for i, _ in orders}


def test_exact_sum(spark):
    rng = random.Random(5)
    groups = [[rng.choice((-1, 1)) * rng.random() * 10 ** rng.randint(-3, 9) for _ in range(n)] for n in (1, 2, 7, 50, 9000)]
    groups += [[0.1] * 10, [1e9, 1e-5, -1e9], [], [2.0**60, 0.5], [math.inf, 1.0], [2.0**31 - 2.0**-22] * 5000]
    df = spark.createDataFrame([(g, x) for g, xs in enumerate(groups) for x in [*xs, None]], "clip long, x double")
    got = by_clip(df.groupBy("clip").agg(kernels.exact_sum(F.col("x")).alias("sum")), "sum")
    assert got == {g: math.fsum(xs) for g, xs in enumerate(groups)}
    assert math.isnan(one(spark, s=kernels.exact_sum(F.lit(math.nan)))["s"])


def test_detector_log(spark):
    log = "black_start:0 black_end:1.5 black_duration:1.5\nfreeze_start: 2\nfreeze_end: 3.5\nx freeze_start: 9.25"
    rows = signals.parse_detector_log(spark.createDataFrame([(1, log)], "clip long, text string")).collect()
    assert [(r["kind"], r["s"], r["e"]) for r in rows] == [("black", 0.0, 1.5), ("freeze", 2.0, 3.5), ("freeze", 9.25, None)]


def test_cost(spark):
    takes = spark.createDataFrame([(1,), (2,)], "clip long")
    usage = spark.createDataFrame([(1, "cheap", 3, 1_000_000, 0), (1, "odd", 1, 5, 5), (1, "zero", 0, 9, 9)], "clip long, engine string, calls long, prompt_tokens long, completion_tokens long")
    prices = spark.createDataFrame([("cheap", 0.25, 0.75)], "engine string, input double, output double")
    got = by_clip(cost.cost_block(takes, usage, prices, 0.05), "vlm_usd", "total_usd", "unpriced")
    assert got[1] == (0.25, pytest.approx(0.3), ["odd"]) and got[2] == (0.0, 0.05, [])
    r = cost.cost_summary(spark.createDataFrame([("s", 0.3, "review"), ("s", 0.2, "kill")], "shot string, total_usd double, verdict string")).where("shot is null").first()
    assert r["per_usable"] == pytest.approx(0.5)


def test_brief_corpus(spark):
    takes = spark.createDataFrame([("c1", "shot-a", "kill", "f1"), ("c2", "shot-a", "kill", "f2"), ("c3", "shot-a", "review", "f3"), ("c4", None, None, "f4")], "clip string, shot string, verdict string, file string").withColumn("pending", F.lit(False))
    roll = {r["shot"]: (r["n_takes"], r["kills"], r["yield"]) for r in brief.shot_rollup(takes).collect()}
    assert roll == {"shot-a": (3, 2, pytest.approx(1 / 3)), "untagged": (1, 0, 1.0)}
    d = spark.createDataFrame([("c3", "hands", 1.0, 4, 0.9, 1, "x"), ("c3", "hands", 0.5, 3, 0.7, 2, "y")], "clip string, rule string, t double, severity int, confidence double, pos int, note string")
    r = brief.rule_stats(takes, d).first()
    assert (r["count"], r["takes_affected"], r["mean_severity"], r["worst_note"]) == (2, 1, 3.5, "x") and r["mean_confidence"] == pytest.approx(0.8)


def test_replies(spark):
    def answers(s):
        return one(spark, a=text.parse_answers(F.lit(s)))["a"]

    got = answers('say ```{"answers": [{"q": 1, "yes": "Yes", "t": 1.23456}, {"q": "x"}, {"q": "2", "yes": false}, 7]}``` done')
    assert [(a["q"], a["yes"], a["t"]) for a in got] == [(1, True, 1.235), (2, False, None)]
    assert answers("nothing here") is None and answers('{"answers": 3}') is None
    for junk in ('{"answers": [{"q": 1}]} and {x}', '{"answers": [{"q": 1}]}{"answers": []}', '{"answers": [{"q": 1}]}, {"b": 2}', '{"answers": [{"q": 1}]}]}', '{"answers": [{"q": 1}'):
        assert answers(junk) is None, junk
    got = answers('{"answers": [{"q": 2.9, "yes": 1, "t": "2.0005", "note": null}, {"q": "2.5"}, {"q": true, "yes": "TRUE ", "t": "x", "note": 7}, {"q": null}]}')
    assert [tuple(a) for a in got] == [(2, True, 2.001, "None"), (1, True, None, "7")]
    d = one(spark, d=text.parse_defects(F.lit('{"defects": [{"t": "1.5", "severity": 9, "note": "n"}, {"t": 1}]}')))["d"]
    assert [(x["t"], x["severity"], x["note"]) for x in d] == [(1.5, 5, "n")]


def test_text_functions(spark):
    r = one(
        spark,
        cls=text.kill_class(F.lit("probe: bad")),
        none=text.kill_class(F.lit("")),
        tc=text.timecode(F.lit(3661.5), F.lit(24.0)),
        slug=text.slug(F.lit(" Shot #A/1 ")),
        want=text.want_pair(F.lit("a=b=3")),
        bad=text.want_pair(F.lit("a=0")),
        fps=text.frame_rate(F.lit("30000/1001")),
        nofps=text.frame_rate(F.lit("0/0")),
        usd=text.usd(F.lit(0.05)),
        sid=text.short_id(F.lit("sha256:0123456789ab")),
        unh=text.short_id(F.lit(None).cast("string")),
        esc=text.drawtext_escape(F.lit("a:b'c")),
        st=text.poll_state(F.lit('{"state": "done"}')),
        ok=text.poll_state(F.lit('{"state": "done", "output": "x"}')),
        id=text.submit_id_ok(F.lit("a\nb")),
    )
    assert (r["cls"], r["none"], r["tc"], r["slug"]) == ("probe", "unknown", "01:01:01:12", "shot-a-1")
    assert (r["want"]["shot"], r["want"]["k"], r["bad"], r["fps"], r["nofps"]) == ("a=b", 3, None, 29.97, None)
    assert (r["usd"], r["sid"], r["unh"], r["esc"]) == ("$0.050", "01234567", "unhashed", "a\\:b\\'c")
    assert (r["st"], r["ok"], r["id"]) == (None, "done", False)


def test_audit_rate(spark):
    df = spark.range(4000).select(kernels.audit_pick(F.concat(F.lit("sha256:"), F.col("id")), 0.15).alias("p"))
    assert 0.12 < df.where("p").count() / 4000 < 0.18
    assert one(spark, p=kernels.audit_pick(F.lit(None).cast("string")))["p"] is False


def test_mutated_seeds(spark):
    r = one(spark, m=kernels.mutated_seeds(F.create_map(F.lit("3"), F.lit(7).cast("long"), F.lit("4"), F.lit(8).cast("long")), F.lit("t"), F.lit(1)), e=kernels.mutated_seeds(F.lit(None).cast("map<string,bigint>"), F.lit("t"), F.lit(1)))
    assert set(r["m"]) == {"3", "4"} and r["m"]["3"] != 7 and set(r["e"]) == {"seed"} and 0 <= r["e"]["seed"] < 2**32


def test_rank_order(spark):
    rows = [("k", "s", "kill", 0, 0, 0.0, None), ("b", "s", "review", 5, 0, 0.0, None), ("a", "s", "review", 5, 0, 0.0, None), ("c", "s", "review", 1, 3, 0.5, 0.9), ("n", None, "review", 0, 0, 0.0, None)]
    t = spark.createDataFrame(rows, "clip string, shot string, verdict string, severity_sum long, n_findings long, flicker double, smoothness double")
    assert by_clip(rank.rank_in_shot(t), "rank_in_shot") == {"c": 1, "a": 2, "b": 3, "k": 4, "n": 1}


def test_shot_list(spark):
    lines = spark.createDataFrame([(0, "b # first"), (1, "# none"), (2, "a"), (3, "b")], "pos int, value string")
    assert sorted((r["shot"], r["pos"]) for r in rank.parse_shot_list(lines).collect()) == [("a", 2), ("b", 0)]


def test_schema_is_published(spark):
    doc = json.loads(schema.published("take"))
    assert doc["required"] == ["output"] and doc["properties"]["review"]["properties"]["verdict"]["type"] == ["string", "null"]
    for name in ("calibration", "judge-history"):
        assert json.loads(schema.published(name))["title"] == name


def test_rounding_is_of_the_binary_value(spark):
    import random

    r = random.Random(4)
    xs = [2.675, 0.125, 0.35, 0.45, 1.15, 2.55, 8.65, 0.05, 0.25, 0.75, 1e-9, 12345.6785, 99.995, 0.0, 2.0, *(r.uniform(0, 100) for _ in range(300)), *(r.randrange(10**5) / 1000 for _ in range(1500))]
    cols = [f(F.col("x"), d).alias(f"{f.__name__}{d}") for f in (kernels.exact_round, kernels.fixed) for d in (1, 2, 3)]
    for row in spark.createDataFrame([(x,) for x in xs], "x double").select("x", *cols).collect():
        x = row["x"]
        assert [row[f"exact_round{d}"] for d in (1, 2, 3)] == [round(x, d) for d in (1, 2, 3)], x
        assert [row[f"fixed{d}"] for d in (1, 2, 3)] == [f"{x:.1f}", f"{x:.2f}", f"{x:.3f}"], x
    got = one(spark, n=kernels.exact_round(F.lit(None).cast("double"), 2), m=kernels.fixed(F.lit(-2.675), 2), z=kernels.fixed(F.lit(None).cast("double"), 1))
    assert tuple(got) == (None, "-2.67", None)
