"""More registered queries: texts, labels, cards and small set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import report
from ..functions import kernels, text
from ..operators import judge, labels
from .catalogue import _RANK, _ranked, query

_CONV = "SELECT conv_id, turn, concat(substr(coalesce(text, ''), 1, 200), ' <a> & \"b\" ''c'': [d], e;f=g \\h') AS t FROM conversations"


def _conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return df.select("conv_id", "turn", F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 200), F.lit(" <a> & \"b\" 'c': [d], e;f=g \\h")).alias("t"))


@query(sql=rf"""SELECT conv_id, turn, regexp_replace(t, '([\\'':,\[\];=])', '\\\1', 'g') AS drawtext, regexp_replace(t, '([\\'':,\[\];])', '\\\1', 'g') AS lavfi,
  replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html FROM ({_CONV})""")
def escaped_texts(spark, sf_dir):
    t = F.col("t")
    return _conversations(spark, sf_dir).select("conv_id", "turn", text.drawtext_escape(t).alias("drawtext"), text.lavfi_escape(t).alias("lavfi"), text.html_escape(t).alias("html"))


_MONEY = "SELECT clip, engine, prompt_tokens / 7919.0::DOUBLE AS v, CASE WHEN calls % 3 > 0 THEN completion_tokens / 977.0::DOUBLE END AS per FROM fx_usage"
_USD = "concat('$', CASE WHEN {0} >= 0.1 THEN printf('%.2f', {0}) ELSE printf('%.3f', {0}) END)"


@query("fx_usage", f"""SELECT clip, engine, {_USD.format('v')} AS usd, concat('spent ', {_USD.format('v')}, ': ', CASE WHEN per IS NULL THEN 'no usable takes' ELSE concat({_USD.format('per')}, ' per usable take') END) AS phrase FROM ({_MONEY})""")
def money_texts(usage):
    from ..operators.cost import cost_phrase

    v, per = F.col("prompt_tokens") / F.lit(7919.0), F.when(F.col("calls") % 3 > 0, F.col("completion_tokens") / F.lit(977.0))
    return usage.select("clip", "engine", text.usd(v).alias("usd"), cost_phrase(v, per).alias("phrase"))


@query(sql="""SELECT o_orderkey, concat(o_orderkey % 60001, '/', o_custkey % 7) AS ratio, CASE WHEN o_custkey % 7 > 0 THEN CAST(printf('%.3f', (o_orderkey % 60001) / (o_custkey % 7)::DOUBLE) AS DOUBLE) END AS fps,
    CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_custkey AS INT) END AS width, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey % 999 AS INT) END AS height FROM orders""")
def rates_and_sizes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    ratio = F.concat(F.col("o_orderkey") % 60001, F.lit("/"), F.col("o_custkey") % 7)
    size = F.concat("o_custkey", F.when(F.col("o_orderkey") % 4 < 3, "x").otherwise(" by "), F.col("o_orderkey") % 999)
    wh = text.size_wh(size)
    return o.select("o_orderkey", ratio.alias("ratio"), text.frame_rate(ratio).alias("fps"), wh["width"].alias("width"), wh["height"].alias("height"))


@query("fx_jobs", """SELECT job_seq, CASE WHEN job_seq % 5 > 0 THEN concat(shot, '=', job) END AS shot, CASE WHEN job_seq % 5 > 0 THEN CAST(job_seq % 5 AS INT) END AS k FROM fx_jobs""")
def want_pairs(jobs):
    pair = text.want_pair(F.concat("shot", F.lit("="), "job", F.lit("="), F.col("job_seq") % 5))
    return jobs.select("job_seq", pair["shot"].alias("shot"), pair["k"].alias("k"))


@query("fx_jobs", """SELECT job_seq, CASE WHEN job_seq % 6 = 0 THEN NULL WHEN state = 'done' AND job_seq % 6 < 3 THEN NULL ELSE state END AS state, job_seq % 3 = 0 AS id_ok FROM fx_jobs""")
def driver_lines(jobs):
    n = F.col("job_seq") % 6
    output = F.when(n >= 3, F.concat(F.lit(', "output": "'), "job", F.lit('"'))).otherwise("")
    line = F.when(n == 0, F.concat(F.lit("state: "), "state")).otherwise(F.concat(F.lit('{"state": "'), "state", F.lit('"'), output, F.lit("}")))
    ids = F.when(F.col("job_seq") % 3 == 0, F.concat(F.lit(" "), "job", F.lit("\n"))).when(F.col("job_seq") % 3 == 1, F.concat("job", F.lit("\n"), "job")).otherwise(F.lit(" \n"))
    return jobs.select("job_seq", text.poll_state(line).alias("state"), text.submit_id_ok(ids).alias("id_ok"))


@query("fx_reviews fx_defects", """+ d AS (SELECT clip, count(*) AS c, min(rule) AS r FROM fx_defects GROUP BY 1)
  SELECT t.clip, CASE WHEN verdict = 'kill' THEN 'kill' WHEN coalesce(c, 0) > 0 THEN 'needs review' ELSE 'passed' END AS label, substr(take_id, 8, 8) AS short_id, regexp_extract(coalesce(r, 'none'), '^([^.]*)', 1) AS family,
    coalesce(nullif(trim(regexp_replace(lower(t.shot || ' / ' || file), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'shot') AS slug FROM fx_reviews t LEFT JOIN d ON d.clip = t.clip""")
def labels_and_slugs(takes, defects):
    d = defects.groupBy("clip").agg(F.count(F.lit(1)).alias("c"), F.min("rule").alias("r"))
    name = F.concat("shot", F.lit(" / "), "file")
    return takes.join(d, "clip", "left").select(
        "clip", text.display_label(F.col("verdict"), F.coalesce("c", F.lit(0))).alias("label"), text.short_id(F.col("take_id")).alias("short_id"),
        text.family(F.coalesce("r", F.lit("none"))).alias("family"), text.slug(name).alias("slug"),
    )


@query("fx_reasons fx_defects", """+ r AS (SELECT clip, reason FROM fx_reasons UNION ALL SELECT clip, concat(rule, '.more of it') FROM fx_defects WHERE pos = 2 UNION ALL SELECT clip, 'black for 1.0s of 1.0s' FROM fx_defects WHERE pos = 1)
  SELECT r.clip, count(*) FILTER (NOT EXISTS (SELECT 1 FROM fx_defects d WHERE d.clip = r.clip AND starts_with(r.reason, d.rule))) AS untold FROM r GROUP BY 1""")
def card_reasons(reasons, defects):
    more = defects.where("pos = 2").select("clip", F.concat("rule", F.lit(".more of it")).alias("reason")).union(defects.where("pos = 1").select("clip", F.lit("black for 1.0s of 1.0s")))
    r = reasons.union(more).groupBy("clip").agg(F.collect_list("reason").alias("reasons"))
    rules = defects.groupBy("clip").agg(F.collect_set("rule").alias("rules"))
    none = F.array().cast("array<string>")
    return r.join(rules, "clip", "left").select("clip", F.size(text.untold(F.col("reasons"), F.coalesce("rules", none))).cast("long").alias("untold"))


@query("fx_takes fx_defects", """+ p AS (SELECT d.clip, list(100 * least(d.t, k.duration) / k.duration ORDER BY d.t) AS places FROM fx_defects d JOIN fx_takes k ON k.clip = d.clip GROUP BY 1),
  s AS (SELECT clip, places, 0 AS i, CAST([] AS DOUBLE[]) AS last, CAST([] AS INT[]) AS rows FROM p
    UNION ALL SELECT clip, places, i + 1, CASE WHEN f IS NULL THEN list_concat(last, [places[i + 1]]) ELSE list_concat(list_concat(last[1:f - 1], [places[i + 1]]), last[f + 1:]) END, list_concat(rows, [CAST(coalesce(f - 1, len(last)) AS INT)])
    FROM (SELECT *, nullif(list_position(list_transform(last, lambda x: places[i + 1] - x >= 1.8), true), 0) AS f FROM s WHERE i < len(places)))
  SELECT clip, round(places[len(places)], 6) AS last_place, array_to_string(rows, ',') AS rows FROM s WHERE i = len(places)""")
def timeline_rows(takes, defects):
    at = defects.join(takes.select("clip", "duration"), "clip").groupBy("clip").agg(F.array_sort(F.collect_list("t")).alias("t"), F.first("duration").alias("duration"))
    at = at.select("clip", F.transform("t", lambda t: report.percent(t, F.col("duration"))).alias("at"))
    return at.select("clip", F.round(F.element_at("at", -1), 6).alias("last_place"), F.array_join(report.dot_rows(F.col("at")).cast("array<string>"), ",").alias("rows"))


@query("fx_takes", """SELECT clip, rule, CASE rule WHEN 'a' THEN '' WHEN 'b' THEN prompt_text ELSE CAST(seed3 AS VARCHAR) END AS context FROM fx_takes, (SELECT 'a' AS rule UNION ALL SELECT 'b' UNION ALL SELECT 'c')
  WHERE rule = 'a' OR (rule = 'b' AND prompt_text IS NOT NULL) OR (rule = 'c' AND seed3 IS NOT NULL)""")
def rule_context(takes):
    rules = takes.sparkSession.createDataFrame([("a", None), ("b", "recipe.prompt_text"), ("c", "recipe.seeds.node")], "rule string, needs string")
    recipe = F.struct("prompt_text", F.struct(F.col("seed3").alias("node")).alias("seeds"))
    docs = takes.select("clip", F.parse_json(F.to_json(F.struct(recipe.alias("recipe")))).alias("doc"))
    return judge.needs_context(rules, docs)


_UNSURE = """+ a AS (SELECT DISTINCT clip, rule FROM fx_answers), u AS (SELECT clip, rule FROM fx_answers GROUP BY 1, 2 HAVING bool_or(pos % 5 = 0)),
  p AS (SELECT clip, rule FROM fx_answers GROUP BY 1, 2 HAVING bool_or(pos % 3 = 0)), s AS (SELECT clip, rule FROM fx_answers GROUP BY 1, 2 HAVING bool_or(pos % 7 = 0)), g AS (SELECT clip, rule FROM fx_answers GROUP BY 1, 2 HAVING bool_or(pos % 14 = 0))"""


def _some(answers, n):
    return answers.where(F.col("pos") % n == 0).select("clip", "rule").distinct()


@query("fx_answers", _UNSURE + " SELECT clip, rule FROM a EXCEPT SELECT clip, rule FROM p")
def unparsed_rules(answers):
    return judge.unparsed_rules(answers, _some(answers, 3))


@query("fx_answers", _UNSURE + """ SELECT clip, rule, 'uncertain' AS what FROM (SELECT * FROM u EXCEPT SELECT * FROM s)
  UNION ALL SELECT clip, rule, 'unparsed' FROM (SELECT * FROM (SELECT * FROM a EXCEPT SELECT * FROM p) EXCEPT SELECT * FROM s) UNION ALL SELECT clip, rule, 'unparsed' FROM g""")
def after_escalation(answers):
    unparsed = judge.unparsed_rules(answers, _some(answers, 3))
    left, still = judge.after_escalation(_some(answers, 5), unparsed, _some(answers, 7), _some(answers, 14))
    return left.withColumn("what", F.lit("uncertain")).unionByName(still.withColumn("what", F.lit("unparsed")))


@query("fx_answers", _UNSURE + " SELECT * FROM u UNION SELECT * FROM s")
def scrutiny_unsure(answers):
    return judge.all_unsure(_some(answers, 5), _some(answers, 7))


@query("fx_defects", """+ w AS (SELECT clip, rule, max((CAST(substr(rule, 6) AS INT) - 4.5) * severity) AS w FROM fx_defects GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY abs(w) DESC, rule) AS n FROM w) SELECT clip, string_agg(rule, ',' ORDER BY n) AS top FROM r WHERE n <= 5 GROUP BY 1""")
def top_weights(defects):
    w = (F.substring("rule", 6, 9).cast("int") - 4.5) * F.col("severity")
    per = defects.groupBy("clip", "rule").agg(F.max(w).alias("w")).groupBy("clip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "w")))).alias("weights"))
    return per.select("clip", F.array_join(F.transform(labels.top_weights(F.col("weights")), lambda e: e["key"]), ",").alias("top"))


@query("fx_reviews fx_defects fx_spans", f"""+ {_RANK}, p AS (SELECT clip, verdict IS NULL AND parent IS NOT NULL AND NOT landed AS pending FROM fx_reviews),
  b AS (SELECT rk.shot, count(*) AS n, count(*) FILTER (verdict = 'kill' AND NOT judged) AS k FROM rk JOIN p USING (clip) WHERE NOT pending AND shot IS NOT NULL GROUP BY 1),
  d AS (SELECT shot, sum(exp(lgamma(n + 2) - lgamma(j + 1) - lgamma(n + 2 - j) + j * ln(0.75) + (n + 1 - j) * ln(0.25))) AS p FROM (SELECT *, unnest(generate_series(0, k)) AS j FROM b) GROUP BY 1)
  SELECT count(*) FILTER (NOT pending) AS reviewed, count(*) FILTER (verdict = 'kill') AS killed, count(*) FILTER (NOT pending) - count(*) FILTER (verdict = 'kill') AS to_watch, count(*) FILTER (pending) AS pending,
    (SELECT coalesce(string_agg(shot, ',' ORDER BY shot), '') FROM d WHERE p >= 0.9) AS doomed FROM fx_reviews JOIN p USING (clip)""")
def report_totals(takes, defects, spans):
    ranks = _ranked(takes, defects, spans).select("clip", "rank_in_shot")
    df = takes.join(ranks, "clip", "left").withColumn("pending", F.expr("verdict is null and parent is not null and not landed"))
    return report.report_totals(df).withColumn("doomed", F.array_join("doomed", ","))


@query("fx_takes", """SELECT clip FROM (SELECT concat('/x.y/take-', clip, '.mp4') AS clip, clip % 3 AS s FROM fx_takes) WHERE s = 0""")
def takes_with_posters(takes):
    names = takes.select(F.concat(F.lit("/x.y/take-"), "clip").alias("stem"), (F.col("clip") % 3).alias("s"))
    stills = names.select(F.concat("stem", F.when(F.col("s") == 0, ".jpg").otherwise(".png")).alias("path"))
    return report.posters(names.select(F.concat("stem", F.lit(".mp4")).alias("clip")), stills)


@query("fx_frames", "SELECT clip, n, CAST(printf('%.2f', yavg / 7.0) AS DOUBLE) AS rounded, printf('%.1f', pts / 3.0 + 0.05) AS tenths FROM fx_frames")
def exact_rounding(frames_):
    return frames_.select("clip", "n", kernels.exact_round(F.col("yavg") / 7.0, 2).alias("rounded"), text.tenths(F.col("pts") / 3.0 + 0.05).alias("tenths"))
