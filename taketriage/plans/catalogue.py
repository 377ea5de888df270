"""Registered queries: each operator on the bridged tables, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import kernels, text
from ..operators import breaker, brief, cost, judge, labels, ledger, lineage, rank, signals
from .bridge import ctes, frames
from .session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(tables: str = "", sql: str | None = None):
    """Registers a function of the named tables' frames under its name; ``sql``
    is the oracle's, after the definitions of the same tables."""
    names = tables.split()

    def register(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(*frames(spark, sf_dir, *names)) if names else fn(spark, sf_dir)
        if sql:
            ORACLES[fn.__name__] = f"{ctes(*names)}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().lstrip('+')}" if names else sql
        return fn

    return register


# ---- sources and scalar functions

_PATH = """concat('/clips/shot-', user_id % 100, '/take-', event_id % 5000,
  CASE event_id % 7 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MOV' WHEN 2 THEN '.webm' WHEN 3 THEN '.mkv' WHEN 4 THEN '.avi' WHEN 5 THEN '.txt' ELSE '' END)"""


@query(sql=f"""SELECT DISTINCT path FROM (SELECT {_PATH} AS path FROM events)
  WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.mp4', '.mov', '.webm', '.mkv', '.avi')""")
def clip_scan_dedupe(spark, sf_dir):
    from ..sources.sidecars import clips

    return clips(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(_PATH).alias("path")))


@query(sql=f"""SELECT event_id, path, coalesce(nullif(shot, ''), nullif(regexp_extract(path, '([^/]+)/[^/]*$', 1), '')) AS shot,
    regexp_extract(path, '([^/]*)$', 1) AS file FROM
  (SELECT event_id, {_PATH} AS path, CASE WHEN event_id % 3 = 0 THEN 'tagged' WHEN event_id % 3 = 1 THEN '' END AS shot FROM events)""")
def shot_tagging(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.expr(_PATH).alias("path"), F.expr("CASE WHEN event_id % 3 = 0 THEN 'tagged' WHEN event_id % 3 = 1 THEN '' END").alias("shot")
    )
    path = F.col("path")
    return df.select("event_id", "path", text.shot_for(F.col("shot"), path).alias("shot"), text.basename(path).alias("file"))


_REPLIES = """+ p AS (SELECT clip, turn, CASE WHEN json_valid(regexp_extract(reply, '(\\{.*\\})', 1, 's')) THEN regexp_extract(reply, '(\\{.*\\})', 1, 's')::JSON END AS j FROM fx_replies)"""


def _int(field: str) -> str:
    """A JSON field as a whole number: a number cut off, a text of digits."""
    v = f"json_extract(v, '$.{field}')"
    return f"""CASE json_type({v}) WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match({v} ->> '$', '[+-]?[0-9]+') THEN CAST({v} ->> '$' AS INT) END ELSE CAST(trunc(TRY_CAST({v} ->> '$' AS DOUBLE)) AS INT) END"""


_T = "CAST(printf('%.3f', TRY_CAST(json_extract_string(v, '$.t') AS DOUBLE)) AS DOUBLE)"
_NOTE = "substr(CASE json_type(json_extract(v, '$.note')) WHEN 'NULL' THEN 'None' ELSE coalesce(json_extract_string(v, '$.note'), '') END, 1, 300)"


@query("fx_replies", _REPLIES + f""",
  a AS (SELECT clip, turn, unnest(CAST(json_extract(j, '$.answers[*]') AS JSON[])) AS v FROM p WHERE j IS NOT NULL)
  SELECT clip, turn, {_int('q')} AS q, lower(trim(coalesce(json_extract_string(v, '$.yes'), ''))) IN ('yes', 'true', '1') AS yes, {_T} AS t, {_NOTE} AS note FROM a WHERE {_int('q')} IS NOT NULL""")
def parse_answers(replies):
    return replies.select("clip", "turn", F.inline(text.parse_answers(F.col("reply"))))


@query("fx_replies", _REPLIES + f""",
  a AS (SELECT clip, turn, unnest(CAST(json_extract(j, '$.defects[*]') AS JSON[])) AS v FROM p WHERE j IS NOT NULL)
  SELECT clip, turn, {_T} AS t, greatest(1, least(5, {_int('severity')})) AS severity, {_NOTE} AS note FROM a WHERE {_T} IS NOT NULL AND {_int('severity')} IS NOT NULL""")
def parse_defects(replies):
    return replies.select("clip", "turn", F.inline(text.parse_defects(F.col("reply"))))


# ---- mechanical stage

_TOTALS = """k AS (SELECT clip, duration + clip % 20 / 20.0::DOUBLE AS duration FROM fx_takes), t AS (SELECT k.clip, k.duration,
    coalesce(sum(CASE WHEN s.kind = 'black' THEN s.e - s.s END), 0.0) AS black_s,
    coalesce(sum(CASE WHEN s.kind = 'freeze' THEN coalesce(s.e, k.duration) - s.s END), 0.0) AS freeze_s
  FROM k LEFT JOIN fx_spans s ON s.clip = k.clip GROUP BY 1, 2)"""


@query("fx_takes fx_spans", f"""+ {_TOTALS}
  SELECT clip, black_s, round(freeze_s, 6) AS freeze_s, concat_ws('; ', CASE WHEN black_s / duration > 0.5 THEN printf('black for %.1fs of %.1fs', black_s, duration) END,
    CASE WHEN freeze_s / duration > 0.5 THEN printf('frozen for %.1fs of %.1fs', freeze_s, duration) END) AS reasons,
    black_s / duration > 0.5 OR freeze_s / duration > 0.5 AS killed FROM t""")
def mechanical_kill(takes, spans):
    takes = takes.select("clip", (F.col("duration") + F.col("clip") % 20 / F.lit(20.0)).alias("duration"), F.lit(None).cast("array<string>").alias("errors"))
    df = signals.mechanical_kills(takes, spans)
    return df.select("clip", "black_s", F.round("freeze_s", 6).alias("freeze_s"), F.array_join("reasons", "; ").alias("reasons"), "killed")


@query("fx_spans", """+ f AS (SELECT * FROM fx_spans WHERE kind = 'freeze'),
  s AS (SELECT clip, s, row_number() OVER (PARTITION BY clip ORDER BY s) AS pos FROM f),
  e AS (SELECT clip, e, row_number() OVER (PARTITION BY clip ORDER BY e) AS pos FROM f WHERE e IS NOT NULL)
  SELECT s.clip, CAST(s.pos AS INT) AS pos, s.s, e.e FROM s LEFT JOIN e ON s.clip = e.clip AND s.pos = e.pos""")
def span_pairing(spans):
    f = spans.where("kind = 'freeze'")
    return signals.pair_spans(f.select("clip", "s"), f.where("e is not null").select("clip", "e"))


@query("fx_frames", """+ d AS (SELECT *, abs(yavg - lag(yavg) OVER (PARTITION BY clip ORDER BY n)) AS d FROM fx_frames),
  r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY ydif) AS r, count(*) OVER (PARTITION BY clip) AS m FROM d WHERE d IS NOT NULL),
  c AS (SELECT clip, 2 * max(CASE WHEN r = m // 2 + 1 THEN ydif END) AS cap FROM r GROUP BY 1),
  f AS (SELECT r.clip, c.cap, count(*) FILTER (ydif <= cap) AS masked_n, coalesce(sum(d) FILTER (ydif <= cap), 0.0) AS masked_sum, avg(d) AS plain
        FROM r JOIN c ON c.clip = r.clip GROUP BY 1, 2)
  SELECT k.clip, cap, masked_n, masked_sum, coalesce(CASE WHEN masked_n > 0 THEN masked_sum / masked_n ELSE plain END / 255.0::DOUBLE, 0.0) AS flicker
  FROM (SELECT DISTINCT clip FROM fx_frames) k LEFT JOIN f ON f.clip = k.clip""")
def flicker_score(frames_):
    return signals.flicker(frames_)


@query("fx_frames", """+ m AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY ydif DESC, n) AS r FROM fx_frames WHERE n > 0),
  p AS (SELECT clip, pts AS t FROM m WHERE r <= 7 UNION SELECT clip, pts FROM fx_frames WHERE n = 0),
  e AS (SELECT clip, max(pts) AS last FROM fx_frames GROUP BY 1), c AS (SELECT clip, count(*) AS c FROM p GROUP BY 1),
  u AS (SELECT clip, i * 0.5::DOUBLE AS t FROM (SELECT clip, last, unnest(generate_series(1, 100000)) AS i FROM (SELECT clip, last, 1 FROM e WHERE last > 0.5)) WHERE i * 0.5 < last),
  s AS (SELECT u.clip, u.t, row_number() OVER (PARTITION BY u.clip ORDER BY u.t) AS r FROM u
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.clip = u.clip AND abs(u.t - p.t) <= 0.5::DOUBLE / 3))
  SELECT clip, round(t, 3) AS t FROM p UNION ALL SELECT s.clip, round(s.t, 3) FROM s JOIN c ON c.clip = s.clip WHERE s.r <= 16 - c.c""".replace(
    "unnest(generate_series(1, 100000))", "unnest(generate_series(1, CAST(ceil(last * 2) AS BIGINT)))"))
def candidate_frames(frames_):
    return signals.candidate_frames(frames_)


# ---- judge stage

_VOTE = """+ n AS (SELECT clip, rule, count(DISTINCT sample) AS n FROM fx_answers GROUP BY 1, 2),
  q AS (SELECT rule, q, CASE q WHEN 1 THEN 4 ELSE 3 END AS severity, concat('ask ', rule, ' ', q) AS ask FROM (SELECT DISTINCT rule FROM fx_answers), (SELECT 1 AS q UNION ALL SELECT 2)),
  y AS (SELECT clip, rule, q, count(DISTINCT sample) AS yes_n, arg_min({'t': t, 'note': note}, {'s': sample, 'p': pos}) AS first FROM fx_answers WHERE yes GROUP BY 1, 2, 3),
  v AS (SELECT n.clip, n.rule, q.q, n.n, coalesce(y.yes_n, 0) AS yes_n, coalesce(y.yes_n, 0) / n.n::DOUBLE AS p, y.first, q.severity, q.ask
        FROM n JOIN q ON q.rule = n.rule LEFT JOIN y ON y.clip = n.clip AND y.rule = n.rule AND y.q = q.q)"""


def _votes(answers):
    samples = answers.groupBy("clip", "rule").agg(F.countDistinct("sample").alias("n"))
    questions = answers.select("rule").distinct().select("rule", F.explode(F.array(F.lit(1), F.lit(2))).alias("q"))
    questions = questions.select("rule", "q", F.when(F.col("q") == 1, 4).otherwise(3).alias("severity"), F.concat(F.lit("ask "), "rule", F.lit(" "), "q").alias("ask"))
    return judge.vote(answers, questions, samples)


@query("fx_answers", _VOTE + """
  SELECT clip, rule, q, n, yes_n, p, p > 0 AND p < 1 AS uncertain, CASE WHEN p >= 0.5 THEN coalesce(first.t, 0.0) END AS t, severity,
    CASE WHEN p >= 0.5 THEN coalesce(nullif(first.note, ''), ask) END AS note,
    CASE WHEN p >= 0.5 AND n > 1 THEN round(p, 2) END AS confidence FROM v""")
def vote_aggregate(answers):
    return _votes(answers)


@query("fx_answers fx_rules", _VOTE + """
  , u AS (SELECT DISTINCT clip, rule FROM v WHERE p > 0 AND p < 1), x AS (SELECT DISTINCT clip, rule FROM fx_answers WHERE pos % 17 = 0)
  SELECT clip, rule FROM (SELECT * FROM u UNION SELECT * FROM x) WHERE rule IN ('click', 'purchase', 'view')""")
def escalation_set(answers, rules):
    known = rules.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("click", "purchase", "view")))).alias("rule"))
    unparsed = answers.where("pos % 17 = 0").select("clip", "rule").distinct()
    return judge.escalation_set(judge.uncertain_rules(_votes(answers)), unparsed, known)


_MERGE = """g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 0.8 THEN 0 ELSE 1 END AS new FROM {src} WINDOW w AS (PARTITION BY clip, rule ORDER BY t, pos)),
  i AS (SELECT *, sum(new) OVER (PARTITION BY clip, rule ORDER BY t, pos) AS run FROM g),
  m AS (SELECT clip, rule, run, min(t) AS t, CASE WHEN count(*) > 1 THEN max(t) END AS t_end, max(severity) AS severity, max(confidence) AS confidence,
    arg_min(note, {'s': -severity, 't': t, 'p': pos}) AS note, count(*) AS merged FROM i GROUP BY 1, 2, 3)"""


@query("fx_defects", "+" + _MERGE.replace("{src}", "fx_defects") + " SELECT clip, rule, t, t_end, severity, confidence, note, merged FROM m")
def defect_merge(defects):
    return judge.merge(defects)


@query("fx_defects", "+ a AS (SELECT * FROM fx_defects WHERE NOT (rule IN ('rule.1', 'rule.4') AND clip % 2 = 0) UNION ALL SELECT clip, rule, t + 0.25, severity, confidence, pos, note, t_end FROM fx_defects WHERE rule IN ('rule.1', 'rule.4') AND clip % 2 = 0 AND severity > 2), " + _MERGE.replace("{src}", "a") + " SELECT clip, rule, t, t_end, severity, confidence, note FROM m")
def escalation_merge(defects):
    weak = F.col("rule").isin("rule.1", "rule.4") & (F.col("clip") % 2 == 0)
    strong = defects.where(weak & (F.col("severity") > 2)).withColumn("t", F.col("t") + 0.25)
    return judge.escalation_merge(defects, defects.where(weak).select("clip", "rule").distinct(), strong).drop("merged")


@query("fx_defects fx_rules", "+" + _MERGE.replace("{src}", "fx_defects") + """
  SELECT m.clip, m.rule, m.t, concat(m.rule, ' severity ', m.severity, ' at ', CAST(m.t AS VARCHAR), CASE WHEN m.t_end IS NOT NULL AND m.t_end <> 0 THEN concat('-', CAST(m.t_end AS VARCHAR)) ELSE '' END, 's: ', m.note) AS reason
  FROM m JOIN fx_rules r ON r.rule = m.rule WHERE m.severity >= r.fail_at AND (m.confidence IS NULL OR m.confidence >= 0.67)""")
def rule_kills(defects, rules):
    return judge.rule_kills(judge.merge(defects), rules)


_SCORE = "sc AS (SELECT t.clip, coalesce(max(d.severity * coalesce(nullif(d.confidence, 0), 1.0::DOUBLE)), 0.0::DOUBLE) AS score FROM fx_takes t LEFT JOIN fx_defects d ON d.clip = t.clip GROUP BY 1)"


@query("fx_takes fx_defects", f"+ {_SCORE} SELECT clip, score FROM sc")
def kill_score(takes, defects):
    return judge.kill_scores(takes, defects)


@query("fx_takes fx_defects", f"+ {_SCORE} SELECT clip, score, score > 3.5 AS killed FROM sc")
def calibrated_kills(takes, defects):
    cal = takes.sparkSession.range(1).select(F.lit(3.5).alias("lambda"))
    return judge.calibrated_kills(judge.kill_scores(takes, defects), cal)


# ---- labels

_CONFORMAL = """p AS (SELECT sc.score, row_number() OVER (ORDER BY sc.score) AS r FROM sc JOIN fx_gold g ON g.clip = sc.clip WHERE g.label = 'pass'),
  n AS (SELECT count(*) AS n FROM p), l AS (SELECT max(CASE WHEN p.r = ceil((n.n + 1) * (1 - 0.25::DOUBLE)) THEN p.score END) AS lam, max(n.n) AS n_pass FROM p, n),
  k AS (SELECT sc.score FROM sc JOIN fx_gold g ON g.clip = sc.clip WHERE g.label = 'kill')"""


@query("fx_takes fx_defects fx_gold", f"""+ {_SCORE}, {_CONFORMAL}
  SELECT 0.25::DOUBLE AS alpha, lam AS lambda, n_pass, (SELECT count(*) FROM k) AS n_kill,
    CASE WHEN lam IS NOT NULL THEN (SELECT avg(CASE WHEN score > lam THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM k, l) END AS kill_recall,
    CASE WHEN lam IS NULL THEN 3 END AS needed FROM l""")
def conformal_threshold(takes, defects, gold):
    scored = judge.kill_scores(takes, defects).join(labels.valid_gold(gold), "clip")
    return labels.conformal(scored, 0.25)


@query("fx_defects", "SELECT clip, rule, max(severity * coalesce(nullif(confidence, 0), 1.0::DOUBLE)) / 5.0::DOUBLE AS x FROM fx_defects GROUP BY 1, 2")
def rule_features(defects):
    return labels.rule_features(defects)


@query("fx_gold fx_defects")
def logistic_fit(gold, defects):
    return labels.fit_weights(labels.valid_gold(gold), labels.rule_features(defects))


_WEIGHTS = [(f"rule.{i}", (i - 4) / 4) for i in range(10)]


@query("fx_reviews fx_defects fx_spans", "+" + """ x AS (SELECT clip, rule, max(severity * coalesce(nullif(confidence, 0), 1.0::DOUBLE)) / 5.0::DOUBLE AS x FROM fx_defects GROUP BY 1, 2),
  z AS (SELECT clip, sum((CAST(substr(rule, 6) AS INT) - 4) / 4.0::DOUBLE * x) AS z FROM x GROUP BY 1)
  SELECT t.clip, round(1 / (1 + exp(-(coalesce(z.z, 0) + 0.5))), 9) AS learned FROM fx_reviews t LEFT JOIN z ON z.clip = t.clip""")
def learned_scores(takes, defects, spans):
    weights = takes.sparkSession.createDataFrame(_WEIGHTS, "rule string, weight double")
    return rank.learned_scores(takes, defects, weights, 0.5).select("clip", F.round("learned", 9).alias("learned"))


@query("fx_reviews fx_gold", """+ p AS (SELECT g.label AS g, CASE WHEN t.verdict = 'kill' THEN 'kill' ELSE 'pass' END AS p, t.landed FROM fx_gold g JOIN fx_reviews t ON t.clip = g.clip),
  a AS (SELECT count(*) FILTER (landed) AS n, avg(CASE WHEN g = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (landed) AS po, avg(CASE WHEN g = 'kill' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (landed) AS gk,
    avg(CASE WHEN p = 'kill' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (landed) AS pk, count(*) FILTER (landed AND g = 'pass' AND p = 'kill') AS false_kills,
    count(*) FILTER (landed AND g = 'kill' AND p = 'pass') AS missed_kills, count(*) FILTER (NOT landed) AS missing_clips FROM p)
  SELECT n, po AS agreement, round((po - (gk * pk + (1 - gk) * (1 - pk))) / (1 - (gk * pk + (1 - gk) * (1 - pk))), 9) AS kappa, false_kills, missed_kills, missing_clips FROM a""")
def judge_agreement(takes, gold):
    predicted = takes.select("clip", F.when(F.col("verdict") == "kill", "kill").otherwise("pass").alias("label"))
    out = labels.judge_agreement(gold, predicted, takes.where("landed"))
    return out.withColumn("kappa", F.round("kappa", 9))


@query("fx_jobs", """+ r AS (SELECT shot AS h, job_seq AS seq, CASE WHEN job_seq % 7 = 0 THEN NULL ELSE job_seq % 100 / 100.0::DOUBLE END AS kappa FROM fx_jobs),
  l AS (SELECT h, arg_max({'k': kappa}, seq).k AS k, count(*) AS n FROM r GROUP BY 1)
  SELECT h AS history, n > 0 AND k IS NOT NULL AND k >= 0.6 AS ok, CASE WHEN n = 0 THEN 'no judge-check runs found' WHEN k IS NULL THEN 'the last judge-check run records no kappa'
    WHEN k < 0.6 THEN concat('judge kappa ', printf('%.2f', k), ' (checked now) is below the 0.60 floor') END AS why FROM l""")
def judge_gate(jobs):
    runs = jobs.select(
        F.col("shot").alias("history"), F.col("job_seq").alias("seq"), F.when(F.col("job_seq") % 7 != 0, F.col("job_seq") % 100 / 100.0).alias("kappa"), F.lit("now").alias("created")
    )
    return labels.judge_gate(runs, by=("history",))


@query("fx_reviews", """+ p AS (SELECT *, verdict <> 'kill' AND parent IS NOT NULL AND ('0x' || substr(sha256(take_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.15 AS pick FROM fx_reviews WHERE verdict IS NOT NULL)
  SELECT clip, coalesce(pick, false) AS audit, verdict FROM p""")
def audit_sample(takes):
    return labels.audited(takes.where("verdict is not null"), kernels.AUDIT_RATE).select("clip", "audit", "verdict")


# ---- dossier

_CLASS = """CASE WHEN regexp_extract(reason, '^(\\S+) severity \\d+ at ', 1) <> '' THEN regexp_extract(reason, '^(\\S+) severity \\d+ at ', 1)
  WHEN starts_with(reason, 'calibrated kill score') THEN 'calibrated' ELSE rtrim(coalesce(nullif(regexp_extract(reason, '^\\s*(\\S+)', 1), ''), 'unknown'), ':') END"""
_SIDE = "CASE WHEN regexp_extract(reason, '^(\\S+) severity \\d+ at ', 1) <> '' OR starts_with(reason, 'calibrated kill score') THEN 'rule' ELSE 'mechanical' END"


@query("fx_reasons", f"SELECT clip, reason, {_SIDE} AS side, {_CLASS} AS class FROM fx_reasons")
def kill_class(reasons):
    r = F.col("reason")
    return reasons.select("clip", "reason", text.kill_side(r).alias("side"), text.kill_class(r).alias("class"))


@query("fx_reviews fx_reasons", f"""SELECT coalesce(nullif(t.shot, ''), 'untagged') AS shot, {_SIDE} AS side, {_CLASS} AS class, count(*) AS count
  FROM fx_reasons r JOIN fx_reviews t ON t.clip = r.clip WHERE t.verdict = 'kill' GROUP BY 1, 2, 3""")
def kill_histogram(takes, reasons):
    return brief.kill_histogram(takes, reasons)


@query("fx_reviews fx_defects", """+ d AS (SELECT coalesce(nullif(t.shot, ''), 'untagged') AS shot, t.file, d.* FROM fx_defects d JOIN fx_reviews t ON t.clip = d.clip),
  w AS (SELECT *, row_number() OVER (PARTITION BY shot, rule ORDER BY severity DESC, coalesce(confidence, 0) DESC, t, file, pos) AS r FROM d)
  SELECT shot, rule, count(*) AS count, count(DISTINCT clip) AS takes_affected, sum(severity) / count(*)::DOUBLE AS mean_severity,
    sum(confidence) / nullif(count(confidence), 0)::DOUBLE AS mean_confidence, max(file) FILTER (r = 1) AS worst_file, max(t) FILTER (r = 1) AS worst_t, max(note) FILTER (r = 1) AS worst_note
  FROM w GROUP BY 1, 2""")
def rule_stats(takes, defects):
    return brief.rule_stats(takes, defects)


_RANK = """rk AS (SELECT t.clip, t.shot, t.take_id, t.file, t.verdict, t.duration, t.judged, coalesce(d.s, 0) AS severity_sum, coalesce(s.c, 0) AS n_findings, row_number() OVER (PARTITION BY t.shot ORDER BY t.verdict = 'kill', coalesce(d.s, 0), coalesce(s.c, 0), t.clip) AS rank_in_shot
  FROM fx_reviews t LEFT JOIN (SELECT clip, sum(severity) AS s FROM fx_defects GROUP BY 1) d ON d.clip = t.clip
  LEFT JOIN (SELECT clip, count(*) AS c FROM fx_spans GROUP BY 1) s ON s.clip = t.clip WHERE t.verdict IS NOT NULL)"""


def _ranked(takes, defects, spans):
    df = rank.severity_sums(takes.where("verdict is not null"), defects, spans)
    return rank.rank_in_shot(df.withColumns({"flicker": F.lit(0.0), "smoothness": F.lit(0.0)})).drop("flicker", "smoothness")


@query("fx_reviews fx_defects fx_spans", f"+ {_RANK} SELECT clip, shot, verdict, CAST(severity_sum AS BIGINT) AS severity_sum, n_findings, CAST(rank_in_shot AS INT) AS rank_in_shot FROM rk")
def rank_in_shot(takes, defects, spans):
    return _ranked(takes, defects, spans).select("clip", "shot", "verdict", "severity_sum", "n_findings", "rank_in_shot")


@query("fx_reviews fx_defects fx_spans", f"""+ {_RANK} SELECT coalesce(nullif(t.shot, ''), 'untagged') AS shot, t.file, t.take_id, CAST(k.rank_in_shot AS INT) AS rank_in_shot, t.verdict, coalesce(d.c, 0) AS defects
  FROM fx_reviews t LEFT JOIN rk k ON k.clip = t.clip LEFT JOIN (SELECT clip, count(*) AS c FROM fx_defects GROUP BY 1) d ON d.clip = t.clip WHERE t.verdict IS NULL OR t.verdict <> 'kill'""")
def survivors(takes, defects, spans):
    ranks = _ranked(takes, defects, spans).select("clip", "rank_in_shot")
    return brief.survivors(takes.join(ranks, "clip", "left"), defects)


_ROLL = """ro AS (SELECT coalesce(nullif(shot, ''), 'untagged') AS shot, count(*) FILTER (NOT p) AS n_takes, count(*) FILTER (p) AS pending, count(*) FILTER (NOT p AND verdict = 'kill') AS kills
  FROM (SELECT *, verdict IS NULL AND parent IS NOT NULL AND NOT landed AS p FROM fx_reviews) GROUP BY 1)"""


def _with_pending(takes):
    return takes.withColumn("pending", F.expr("verdict is null and parent is not null and not landed"))


@query("fx_reviews", f"+ {_ROLL} SELECT shot, n_takes, pending, kills, CASE WHEN n_takes > 0 THEN (n_takes - kills) / n_takes::DOUBLE END AS yield FROM ro")
def brief_shot_rollup(takes):
    return brief.shot_rollup(_with_pending(takes))


@query("fx_reviews", f"+ {_ROLL} SELECT count(*) AS shots, CAST(sum(n_takes) AS BIGINT) AS n_takes, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(pending) AS BIGINT) AS pending, (sum(n_takes) - sum(kills)) / sum(n_takes)::DOUBLE AS yield FROM ro")
def brief_totals(takes):
    return brief.totals(brief.shot_rollup(_with_pending(takes)))


@query("fx_reviews", "SELECT clip FROM fx_reviews WHERE verdict IS NULL AND (parent IS NOT NULL OR clip % 3 = 0) AND NOT landed")
def pending_regen(takes):
    return brief.pending(takes.withColumn("regen", F.col("clip") % 3 == 0), takes.where("landed")).select("clip")


@query("fx_reviews", """+ r AS (SELECT coalesce(nullif(shot, ''), 'untagged') AS shot, seed3, clip % 3 AS m, clip % 4 AS l FROM fx_reviews WHERE seed3 IS NOT NULL),
  n AS (SELECT shot, count(*) AS n_with_recipe FROM r GROUP BY 1),
  v AS (SELECT DISTINCT shot, 'seed' AS kind, '3' AS name, CAST(seed3 AS VARCHAR) AS value FROM r UNION ALL SELECT DISTINCT shot, 'model', concat('m', m), '' FROM r
        UNION ALL SELECT DISTINCT shot, 'lora', 'look', CAST(l / 4.0::DOUBLE AS VARCHAR) FROM r)
  SELECT n.shot, n_with_recipe, kind, name, value FROM n LEFT JOIN v ON v.shot = n.shot""")
def recipe_deltas(takes):
    has = F.col("seed3").isNotNull()
    return brief.recipe_deltas(
        takes.select(
            "shot",
            F.when(has, F.create_map(F.lit("3"), F.col("seed3"))).alias("seeds"),
            F.when(has, F.array(F.concat(F.lit("m"), F.col("clip") % 3))).alias("models"),
            F.when(has, F.create_map(F.lit("look"), F.col("clip") % 4 / 4.0)).alias("loras"),
        )
    )


@query("fx_reviews", "SELECT count(verdict) AS reviewed, count(*) FILTER (verdict = 'kill') AS killed, count(*) FILTER (verdict <> 'kill') AS to_watch, count(*) FILTER (verdict IS NULL AND parent IS NOT NULL AND NOT landed) AS pending FROM fx_reviews")
def review_summary(takes):
    return brief.review_summary(_with_pending(takes))


@query("fx_reviews fx_reasons", """SELECT concat('{"clip":"', t.file, '",', CASE WHEN t.shot IS NOT NULL THEN concat('"shot":"', t.shot, '",') ELSE '' END, '"verdict":"', t.verdict, '","kill_reasons":[',
    coalesce(string_agg('"' || r.reason || '"', ',' ORDER BY r.reason), ''), ']}') AS line FROM fx_reviews t LEFT JOIN fx_reasons r ON r.clip = t.clip WHERE t.verdict IS NOT NULL GROUP BY t.clip, t.file, t.shot, t.verdict""")
def serialize_lines(takes, reasons):
    from ..sources.sinks import event_lines

    return event_lines(takes.where("verdict is not null").drop("rank_in_shot"), reasons)


# ---- lineage

_UP = """ix AS (SELECT take_id, parent FROM fx_takes), up AS (SELECT clip, 1 AS depth, parent AS pid FROM fx_takes WHERE parent IS NOT NULL
  UNION ALL SELECT up.clip, up.depth + 1, ix.parent FROM up JOIN ix ON ix.take_id = up.pid WHERE ix.parent IS NOT NULL)"""


@query("fx_takes", f"+ {_UP} SELECT coalesce(t.shot, 'untagged') AS shot, count(t.parent) AS reruns, CAST(coalesce(max(d.depth), 0) AS INT) AS max_depth FROM fx_takes t LEFT JOIN (SELECT clip, max(depth) AS depth FROM up GROUP BY 1) d ON d.clip = t.clip GROUP BY 1")
def lineage_depth(takes):
    return lineage.lineage_by_shot(takes)


@query("fx_takes", f"+ {_UP} SELECT t.clip, CAST(1 + coalesce(max(up.depth), 0) AS INT) AS length FROM fx_takes t LEFT JOIN up ON up.clip = t.clip GROUP BY 1")
def chain_length(takes):
    return lineage.chain_lengths(takes)


@query("fx_takes", f"""+ {_UP}, r AS (SELECT up.clip, arg_max(a.prompt_text, up.depth) AS root FROM up JOIN fx_takes a ON a.take_id = up.pid WHERE a.prompt_text IS NOT NULL GROUP BY 1)
  SELECT t.clip, r.root IS NOT NULL AND r.root IS DISTINCT FROM t.prompt_text AS guarded, CASE WHEN r.root IS NOT NULL THEN r.root ELSE t.prompt_text END AS judged_prompt FROM fx_takes t LEFT JOIN r ON r.clip = t.clip""")
def root_prompt(takes):
    return lineage.intent_guard(takes).select("clip", "guarded", "judged_prompt")


_PKR = f"""pk AS (SELECT DISTINCT up.clip, {_CLASS} AS rule FROM up JOIN fx_takes a ON a.take_id = up.pid JOIN fx_reasons r ON r.clip = a.clip WHERE {_SIDE} = 'rule')"""


@query("fx_takes fx_reasons", f"+ {_UP}, {_PKR} SELECT clip, rule FROM pk")
def parent_kill_rules(takes, reasons):
    return lineage.parent_kill_rules(takes, reasons)


@query("fx_takes fx_reviews fx_reasons fx_rules", f"+ {_UP}, {_PKR} SELECT pk.clip, pk.rule FROM pk JOIN fx_reviews t ON t.clip = pk.clip WHERE t.parent IS NOT NULL AND t.verdict <> 'kill' AND pk.rule IN (SELECT rule FROM fx_rules)")
def scrutiny_set(takes, reviews, reasons, rules):
    return judge.scrutiny_set(reviews, lineage.parent_kill_rules(takes, reasons), rules)


# ---- cut

@query("fx_reviews fx_defects fx_spans", f"""+ {_RANK}, tr AS (SELECT clip, arg_min(rule, {{'s': -severity, 'c': -coalesce(confidence, 0), 'p': pos}}) AS top_rule FROM fx_defects GROUP BY 1),
  pk AS (SELECT rk.clip, coalesce(rk.shot, 'untagged') AS shot, rk.take_id, rk.verdict, rk.rank_in_shot, row_number() OVER (PARTITION BY coalesce(rk.shot, 'untagged') ORDER BY rank_in_shot, rk.clip) AS pick FROM rk WHERE verdict = 'review')
  SELECT pk.clip, pk.shot, CAST(pk.rank_in_shot AS INT) AS rank_in_shot, CAST(pick AS INT) AS pick, concat_ws('  ', pk.shot, substr(substr(pk.take_id, 8), 1, 8), pk.verdict, tr.top_rule) AS slate
  FROM pk LEFT JOIN tr ON tr.clip = pk.clip WHERE pick <= 3""")
def assemble_topk(takes, defects, spans):
    picks = rank.top_takes(_ranked(takes, defects, spans), alts=2)
    return rank.with_slates(picks, rank.top_rules(defects)).select("clip", "shot", "rank_in_shot", "pick", "slate")


@query("fx_reviews fx_defects fx_spans fx_want", f"""+ {_RANK}, pk AS (SELECT clip, coalesce(shot, 'untagged') AS shot, duration, row_number() OVER (PARTITION BY coalesce(shot, 'untagged') ORDER BY rank_in_shot, clip) AS pick FROM rk WHERE verdict = 'review'),
  o AS (SELECT pk.*, w.want AS pos, row_number() OVER (ORDER BY w.want IS NULL, w.want, pk.shot, pk.pick) AS n FROM pk LEFT JOIN fx_want w ON w.shot = pk.shot WHERE pick <= 2),
  c AS (SELECT *, coalesce(sum(duration) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS record_in FROM o)
  SELECT n, clip, shot, record_in, record_in + duration AS record_out, printf('%02d:%02d:%02d:%02d', CAST(record_in AS BIGINT) // 3600, CAST(record_in AS BIGINT) % 3600 // 60, CAST(record_in AS BIGINT) % 60, CAST(record_in * 24 AS BIGINT) % 24) AS tc_in FROM c""")
def cut_timecodes(takes, defects, spans, want):
    picks = rank.top_takes(_ranked(takes, defects, spans), alts=1)
    return rank.cut_list(picks, want.select("shot", F.col("want").alias("pos"))).select("n", "clip", "shot", "record_in", "record_out", "tc_in")


# ---- cost

@query("fx_usage", """SELECT clip, engine, calls, prompt_tokens, completion_tokens FROM fx_usage
  UNION ALL SELECT clip, NULL, CAST(sum(calls) AS BIGINT), CAST(sum(prompt_tokens) AS BIGINT), CAST(sum(completion_tokens) AS BIGINT) FROM fx_usage GROUP BY 1""")
def usage_rollup(usage):
    return judge.usage_rollup(usage)


_COST = """co AS (SELECT t.clip, round(coalesce(sum((u.prompt_tokens * p.input + u.completion_tokens * p.output) / 1e6::DOUBLE), 0.0), 9) AS vlm_usd,
  coalesce(string_agg(DISTINCT CASE WHEN u.engine IS NOT NULL AND p.engine IS NULL THEN u.engine END, ','), '') AS unpriced
  FROM fx_takes t LEFT JOIN fx_usage u ON u.clip = t.clip LEFT JOIN fx_prices p ON p.engine = u.engine GROUP BY 1)"""


@query("fx_takes fx_usage fx_prices", f"+ {_COST} SELECT clip, vlm_usd, 0.0625::DOUBLE AS clip_usd, round(vlm_usd + 0.0625, 9) AS total_usd, unpriced FROM co")
def cost_block(takes, usage, prices):
    df = cost.cost_block(takes, usage, prices, 0.0625)
    return df.select("clip", F.round("vlm_usd", 9).alias("vlm_usd"), "clip_usd", F.round("total_usd", 9).alias("total_usd"), F.array_join("unpriced", ",").alias("unpriced"))


# amounts in whole sixteenths: sums are exact in any order
_SPEND = "CASE WHEN clip % 9 = 0 THEN NULL ELSE clip % 32 / 16.0::DOUBLE END"


@query("fx_reviews", f"""+ r AS (SELECT coalesce(shot, 'untagged') AS shot, {_SPEND} AS usd, coalesce(verdict <> 'kill', true) AS u FROM fx_reviews)
  SELECT shot, count(usd) AS takes, sum(usd) AS total_usd, count(*) FILTER (u) AS usable, sum(usd) / nullif(count(*) FILTER (u), 0) AS per_usable FROM r GROUP BY 1 HAVING count(usd) > 0
  UNION ALL SELECT NULL, count(usd), sum(usd), count(*) FILTER (u), sum(usd) / nullif(count(*) FILTER (u), 0) FROM r""")
def cost_summary(takes):
    return cost.cost_summary(takes.withColumn("total_usd", F.when(F.col("clip") % 9 != 0, F.col("clip") % 32 / 16.0)))


# ---- breaker and ledger

_DOOM = """br AS (SELECT shot, count(*) AS takes, count(*) FILTER (verdict = 'kill' AND NOT judged) AS mechanical_kills,
  arg_min(clip, {'r': -rank_in_shot, 'c': clip}) FILTER (verdict = 'kill' AND NOT judged) AS worst FROM rk WHERE shot IS NOT NULL GROUP BY 1),
  bp AS (SELECT shot, least(1.0, sum(exp(lgamma(takes + 2) - lgamma(j + 1) - lgamma(takes + 2 - j) + j * ln(0.75) + (takes + 1 - j) * ln(0.25)))) AS p
    FROM (SELECT shot, takes, unnest(generate_series(0, mechanical_kills)) AS j FROM br) GROUP BY 1)"""


@query("fx_reviews fx_defects fx_spans", f"""+ {_RANK}, {_DOOM} SELECT br.shot, takes, mechanical_kills, worst, round(p, 6) AS doom_probability, p >= 0.9 AS doomed FROM br JOIN bp ON bp.shot = br.shot""")
def breaker_states(takes, defects, spans):
    df = breaker.breaker_states(_ranked(takes, defects, spans))
    return df.withColumn("doom_probability", F.round("doom_probability", 6))


_FUTILE = f"""fu AS (SELECT shot, min(rule) AS rule FROM (SELECT t.shot, {_CLASS} AS rule FROM fx_reasons r JOIN fx_reviews t ON t.clip = r.clip
  WHERE t.shot IS NOT NULL AND t.seed3 IS NOT NULL AND t.verdict = 'kill' GROUP BY 1, 2 HAVING count(DISTINCT t.seed3) >= 3) GROUP BY 1)"""


def _futile(takes, reasons):
    killed = takes.where("verdict = 'kill'").select("clip", "shot", F.when(F.col("seed3").isNotNull(), F.create_map(F.lit("3"), F.col("seed3"))).alias("seeds"))
    return ledger.futility(reasons.join(killed, "clip").select("shot", "reason", kernels.seed_signature(F.col("seeds")).alias("signature")))


@query("fx_reviews fx_reasons", f"+ {_FUTILE} SELECT shot, rule FROM fu")
def futility(takes, reasons):
    return _futile(takes, reasons)


_LEDGER = f"""{_RANK}, {_DOOM}, {_FUTILE},
  a AS (SELECT shot, count(verdict) AS takes, count(*) FILTER (verdict <> 'kill') AS passing, sum(CASE WHEN verdict IS NOT NULL THEN {_SPEND} END) AS spend FROM fx_reviews WHERE shot IS NOT NULL GROUP BY 1),
  j AS (SELECT shot, count(*) AS attempts FROM fx_jobs GROUP BY 1),
  s AS (SELECT coalesce(a.shot, j.shot) AS shot, coalesce(w.want, 90) AS want, coalesce(a.takes, 0) AS takes, coalesce(passing, 0) AS passing, coalesce(mechanical_kills, 0) AS mechanical_kills,
    coalesce(attempts, 0) AS attempts, coalesce(spend, 0.0) AS spend_usd,
    CASE WHEN coalesce(passing, 0) >= coalesce(w.want, 90) THEN 'complete' WHEN fu.rule IS NOT NULL THEN 'blocked' WHEN coalesce(p >= 0.9, false) THEN 'doomed' ELSE 'active' END AS status, fu.rule
    FROM a FULL JOIN j ON j.shot = a.shot LEFT JOIN fx_want w ON w.shot = coalesce(a.shot, j.shot) LEFT JOIN fu ON fu.shot = coalesce(a.shot, j.shot)
    LEFT JOIN br ON br.shot = coalesce(a.shot, j.shot) LEFT JOIN bp ON bp.shot = coalesce(a.shot, j.shot))"""


def _refreshed(takes, defects, spans, reasons, jobs, want):
    takes = takes.withColumn("total_usd", F.when(F.col("clip") % 9 != 0, F.col("clip") % 32 / 16.0))
    states = breaker.breaker_states(_ranked(takes, defects, spans))
    return ledger.refresh(takes, jobs, want, _futile(takes, reasons), states, want_default=90)


@query("fx_reviews fx_defects fx_spans fx_reasons fx_jobs fx_want", f"+ {_LEDGER} SELECT shot, want, takes, passing, mechanical_kills, attempts, spend_usd, status, CASE WHEN status = 'blocked' THEN rule END AS blocked_by FROM s")
def ledger_refresh(takes, defects, spans, reasons, jobs, want):
    return _refreshed(takes, defects, spans, reasons, jobs, want)


@query("fx_reviews fx_defects fx_spans fx_reasons fx_jobs fx_want", f"""+ {_LEDGER}, {_UP}, ch AS (SELECT clip, 1 + max(depth) AS length FROM up GROUP BY 1)
  SELECT c.clip, why IS NULL AS ok, why FROM (SELECT c.clip, CASE WHEN t.clip IS NULL THEN concat('parent ', c.clip, ' not in the scanned takes')
    WHEN s.status = 'complete' THEN concat('shot ', s.shot, ' complete: ', s.passing, ' passing of ', s.want, ' wanted')
    WHEN s.status = 'blocked' THEN concat('shot ', s.shot, ' blocked: ', s.rule, ' kills under distinct seeds; needs a human, not a reseed')
    WHEN s.status = 'doomed' THEN concat('shot ', s.shot, ' doomed: ', s.mechanical_kills, ' mechanical kills in ', s.takes, ' takes')
    WHEN coalesce(ch.length, 1) >= 4 THEN concat('lineage cap 4 reached for the chain ending at ', c.clip) END AS why
  FROM (SELECT clip FROM fx_jobs) c LEFT JOIN fx_reviews t ON t.clip = c.clip LEFT JOIN s ON s.shot = t.shot LEFT JOIN ch ON ch.clip = c.clip) c""")
def submit_gate(takes, defects, spans, reasons, jobs, want):
    shots = cut(_refreshed(takes, defects, spans, reasons, jobs, want))  # asked of twice
    return ledger.submit_gate(jobs.select("clip"), takes, shots, lineage.chain_lengths(takes))


@query("fx_reviews fx_jobs", """SELECT t.clip, t.take_id, t.shot FROM fx_reviews t WHERE t.verdict = 'kill' AND t.landed
  AND t.take_id NOT IN (SELECT parent FROM fx_reviews WHERE parent IS NOT NULL UNION SELECT parent FROM fx_jobs WHERE parent IS NOT NULL)""")
def orphan_kills(takes, jobs):
    return ledger.orphan_kills(takes, jobs, takes.where("landed"))


@query("fx_jobs", "+ k AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY job_seq) AS n FROM fx_jobs) SELECT job_seq, job, CASE WHEN n = 1 THEN job ELSE concat(job, '-dup', n) END AS key FROM k")
def job_keys(jobs):
    return ledger.job_keys(jobs).select("job_seq", "job", "key")


@query("fx_jobs fx_takes", """+ st AS (SELECT clip, parent, shot, concat('job-', clip % 150) AS job FROM fx_takes WHERE stub)
  SELECT job, arg_min(clip, clip) AS clip, arg_min({'p': parent}, clip).p AS parent, arg_min({'s': shot}, clip).s AS shot, 'queued' AS state FROM st WHERE job NOT IN (SELECT job FROM fx_jobs) GROUP BY 1""")
def job_adopt(jobs, takes):
    stubs = takes.where("stub").select("clip", "parent", "shot", F.concat(F.lit("job-"), F.col("clip") % 150).alias("job"))
    return ledger.adopt(stubs, jobs)


@query("fx_jobs fx_takes", """SELECT CAST(job_seq AS VARCHAR) AS key, CASE WHEN clip IN (SELECT clip FROM fx_takes WHERE landed) THEN 'done' WHEN job_seq % 3 = 0 THEN 'running' WHEN job_seq % 3 = 1 THEN 'queued' ELSE 'error' END AS state
  FROM fx_jobs WHERE state NOT IN ('done', 'error')""")
def job_reconcile(jobs, takes):
    keyed = jobs.withColumn("key", F.col("job_seq").cast("string"))
    polled = keyed.where("job_seq % 3 < 2").select("key", F.when(F.col("job_seq") % 3 == 0, "running").otherwise("queued").alias("state"))
    return ledger.reconcile(keyed, takes.where("landed"), polled)


@query("fx_jobs", """+ f AS (SELECT job_seq, CAST(floor(epoch(submitted)) AS BIGINT) AS sec FROM fx_jobs)
  SELECT job_seq, count(*) OVER w AS recent, count(*) OVER w > 6 AS "over" FROM f WINDOW w AS (ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)""")
def rate_window(jobs):
    return ledger.rate_window(jobs, seconds=3600).select("job_seq", "recent", "over")


@query("fx_jobs", """+ e AS (SELECT *, sum(CASE WHEN state = 'done' THEN 1 ELSE 0 END) OVER (PARTITION BY shot ORDER BY job_seq) AS run FROM fx_jobs WHERE state IN ('done', 'error')),
  s AS (SELECT job_seq, shot, state, sum(CASE WHEN state = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY shot, run ORDER BY job_seq) AS streak FROM e)
  SELECT job_seq, shot, state, CAST(streak AS BIGINT) AS streak, streak >= 3 AS blocked FROM s""")
def failure_streak(jobs):
    return ledger.failure_streaks(jobs).select("job_seq", "shot", "state", "streak", "blocked")


# the fresh seeds are free, what holds of them isn't: the same names, other values, 32 bits
@query("fx_reviews", "SELECT clip, CASE WHEN seed3 IS NULL THEN 'seed' ELSE '3' END AS names, true AS fresh, true AS fits, true AS replays FROM fx_reviews")
def seed_mutation(takes):
    seeds = F.when(F.col("seed3").isNotNull(), F.create_map(F.lit("3"), F.col("seed3").cast("long")))
    df = takes.select("clip", "seed3", kernels.mutated_seeds(seeds, F.col("take_id"), F.lit(1)).alias("a"), kernels.mutated_seeds(seeds, F.col("take_id"), F.lit(1)).alias("b"))
    value = F.map_values("a")[0]
    fresh = F.coalesce(value != F.col("seed3"), F.lit(True))
    return df.select("clip", F.array_join(F.map_keys("a"), ",").alias("names"), fresh.alias("fresh"), value.between(0, 2**32 - 1).alias("fits"), (value == F.map_values("b")[0]).alias("replays"))


# batches of the replay are a quarter each; a shot is told by the first batch that shows it
@query(sql="""WITH RECURSIVE r AS (SELECT concat('shot-', user_id % 100) AS shot, event_id % 4 AS part, user_id % 9 = 0 OR event_id % 4 = 0 AS m FROM events),
  s AS (SELECT DISTINCT r.shot, p.part FROM r JOIN (SELECT DISTINCT part FROM r) p ON p.part IN (SELECT part FROM r x WHERE x.shot = r.shot)),
  b AS (SELECT s.shot, s.part, count(*) AS takes, count(*) FILTER (r.m) AS mechanical_kills FROM s JOIN r ON r.shot = s.shot AND r.part <= s.part GROUP BY 1, 2),
  p AS (SELECT shot, part, takes, mechanical_kills, least(1.0, sum(exp(lgamma(takes + 2) - lgamma(j + 1) - lgamma(takes + 2 - j) + j * ln(0.75) + (takes + 1 - j) * ln(0.25)))) AS p
    FROM (SELECT *, unnest(generate_series(0, mechanical_kills)) AS j FROM b) GROUP BY 1, 2, 3, 4),
  f AS (SELECT *, row_number() OVER (PARTITION BY shot ORDER BY part) AS n FROM p WHERE p >= 0.9)
  SELECT shot, takes, mechanical_kills, round(p, 6) AS doom_probability FROM f WHERE n = 1""")
def doomed_stream(spark, sf_dir):
    from ..streaming.watch import doomed_from_files

    return doomed_from_files(spark, sf_dir).withColumn("doom_probability", F.round("doom_probability", 6))


from . import catalogue_text  # noqa: E402, F401  (registers more)
