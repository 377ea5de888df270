"""Normalized tables derived from the test tables, in both SQL dialects.

``clip`` is the key.  Values are multiples of 1/8 or 1/16, so that sums are
exact in any order.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Placeholders: {table}; ~S string type; ~H(x) SHA-256 of x in hex;
#: ~K the number in props; ~D(a, b) whole division.
TEMPLATES = {
    "fx_takes": """
      SELECT o_orderkey AS clip, concat('sha256:', ~H(CAST(o_orderkey AS ~S))) AS take_id,
        CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE concat('shot-', CAST(o_custkey % 100 AS ~S)) END AS shot,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 35 = 1 THEN 'sha256:gone'
             ELSE concat('sha256:', ~H(CAST(o_orderkey - 1 AS ~S))) END AS parent,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 6 END AS seed3,
        CAST(4 + o_orderkey % 9 AS DOUBLE) AS duration,
        (o_custkey % 50 = 7 OR o_orderpriority = '1-URGENT') AS mech_kill,
        concat('take-', CAST(o_orderkey AS ~S), '.mp4') AS file,
        CASE WHEN o_orderkey % 5 = 0 THEN concat('intent ', CAST(o_orderkey AS ~S))
             WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('patched ', CAST(o_orderkey AS ~S)) END AS prompt_text,
        o_orderkey % 11 = 3 AS stub, o_orderkey % 13 <> 5 AS landed
      FROM {orders}""",
    "fx_defects": """
      SELECT l_orderkey AS clip, concat('rule.', CAST(l_partkey % 10 AS ~S)) AS rule,
        l_quantity / CAST(8 AS DOUBLE) AS t, CAST(1 + l_linenumber % 5 AS INT) AS severity,
        CASE WHEN l_returnflag = 'N' THEN NULL
             ELSE (CAST(round(l_discount * 100) AS INT) % 4 + 1) / CAST(4 AS DOUBLE) END AS confidence,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos,
        concat('p', CAST(l_partkey AS ~S)) AS note, CAST(NULL AS DOUBLE) AS t_end
      FROM {lineitem}""",
    "fx_spans": """
      SELECT l_orderkey AS clip, CASE WHEN l_linestatus = 'F' THEN 'black' ELSE 'freeze' END AS kind,
        l_quantity / CAST(16 AS DOUBLE) AS s,
        CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN NULL
             ELSE l_quantity / CAST(16 AS DOUBLE) + l_linenumber / CAST(4 AS DOUBLE) END AS e
      FROM {lineitem} WHERE l_returnflag = 'A'""",
    "fx_usage": """
      SELECT l_orderkey AS clip, CASE WHEN l_returnflag = 'R' THEN 'strong'
          WHEN l_returnflag = 'A' AND l_linenumber = 7 THEN 'mystery' ELSE 'cheap' END AS engine,
        count(*) AS calls, CAST(sum(l_partkey) AS BIGINT) AS prompt_tokens, CAST(sum(l_suppkey) AS BIGINT) AS completion_tokens
      FROM {lineitem} GROUP BY 1, 2""",
    "fx_gold": "SELECT doc_id AS clip, CASE WHEN toxic = 1 OR quality = 0 THEN 'kill' ELSE 'pass' END AS label FROM {labels}",
    "fx_frames": """
      SELECT user_id AS clip, n, n * CAST(0.125 AS DOUBLE) AS pts,
        CAST(CAST(floor(value) AS INT) % 256 AS DOUBLE) AS yavg, CAST(CAST(floor(value * 7) AS INT) % 64 AS DOUBLE) AS ydif
      FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM {events}) x""",
    "fx_answers": """
      SELECT event_id - event_id % 30 AS clip, event_type AS rule, event_id % 3 AS sample, event_id AS pos, 1 + ~K % 2 AS q,
        CAST(floor(value) AS INT) % 2 = 0 AS yes,
        CASE WHEN ~K % 10 = 0 THEN NULL ELSE ~K / CAST(8 AS DOUBLE) END AS t, concat('e', CAST(event_id AS ~S)) AS note
      FROM {events}""",
    "fx_jobs": """
      SELECT event_id AS job_seq, concat('job-', CAST(~K AS ~S)) AS job, concat('shot-', CAST(user_id % 100 AS ~S)) AS shot,
        user_id, ts AS submitted, event_id AS clip,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('sha256:', ~H(CAST(event_id % 5000 AS ~S))) END AS parent,
        CASE CAST(floor(value) AS INT) % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'done' WHEN 2 THEN 'running' ELSE 'queued' END AS state
      FROM {events} WHERE event_type = 'purchase'""",
    "fx_replies": """
      SELECT conv_id AS clip, CAST(turn AS BIGINT) AS turn,
        CASE WHEN (conv_id + turn) % 11 = 0 THEN concat(coalesce(text, ''), ' no reply')
             WHEN (conv_id + turn) % 13 = 0 THEN '{"answers": [broken'
             WHEN (conv_id + turn) % 7 = 0 THEN '{"answers": [{"q": 1, "yes": true, "t": 1}], "defects": [{"t": 1, "severity": 2}]} and {more}'
             WHEN (conv_id + turn) % 17 = 0 THEN '{"answers": [{"q": 2.75, "yes": 1, "t": "0.0625", "note": null}, {"q": "4"}, {"q": "2.5"}], "defects": [{"t": "1.5", "severity": 2.75, "note": 7}]}'
        ELSE concat('```json {"answers": [{"q": ', CAST(turn + 1 AS ~S), ', "yes": ', CASE WHEN conv_id % 3 = 0 THEN 'true' WHEN conv_id % 3 = 1 THEN '"Yes"' ELSE '"no"' END,
             ', "t": ', CASE WHEN conv_id % 4 = 0 THEN 'null' ELSE CAST(conv_id % 64 / CAST(8 AS DOUBLE) AS ~S) END,
             ', "note": "n', CAST(conv_id AS ~S), '"}, {"q": "x", "yes": true}], "defects": [{"t": ', CAST(turn / CAST(4 AS DOUBLE) AS ~S),
             ', "severity": ', CAST(conv_id % 8 AS ~S), ', "note": "d"}, {"severity": 3}]} ```') END AS reply
      FROM {conversations}""",
    "fx_rules": """
      SELECT concat('rule.', CAST(p_partkey AS ~S)) AS rule, CAST(CASE WHEN p_partkey = 9 THEN NULL ELSE 4 END AS INT) AS fail_at
      FROM (SELECT 0 AS p_partkey UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5
            UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9) x""",
    "fx_prices": """
      SELECT 'cheap' AS engine, CAST(0.25 AS DOUBLE) AS input, CAST(0.75 AS DOUBLE) AS output
      UNION ALL SELECT 'strong', CAST(3 AS DOUBLE), CAST(15 AS DOUBLE)""",
    "fx_want": "SELECT concat('shot-', CAST(n_nationkey AS ~S)) AS shot, CAST(40 + 10 * n_nationkey AS INT) AS want FROM {nation}",
    # Kill reasons: mechanical ones, and rule kills of takes that lived to be judged.
    "fx_reasons": """
      SELECT clip, CASE WHEN clip % 4 = 0 THEN 'probe: no moov atom' WHEN clip % 2 = 0 THEN 'black for 3.0s of 5.0s' ELSE 'frozen for 4.0s of 6.0s' END AS reason
      FROM fx_takes WHERE mech_kill
      UNION ALL
      SELECT d.clip, concat(d.rule, ' severity ', CAST(d.severity AS ~S), ' at ', CAST(d.t AS ~S), 's: ', d.note) AS reason
      FROM fx_defects d JOIN fx_takes k ON k.clip = d.clip JOIN fx_rules r ON r.rule = d.rule
      WHERE NOT k.mech_kill AND d.severity >= r.fail_at AND (d.confidence IS NULL OR d.confidence >= 0.67)""",
    "fx_reviews": """
      SELECT t.clip, t.take_id, t.shot, t.parent, t.seed3, t.duration, t.file, t.prompt_text, t.landed, t.mech_kill, NOT t.mech_kill AS judged,
        CASE WHEN t.stub THEN NULL WHEN k.clip IS NOT NULL THEN 'kill' ELSE 'review' END AS verdict
      FROM fx_takes t LEFT JOIN (SELECT DISTINCT clip FROM fx_reasons) k ON k.clip = t.clip""",
}

_NEEDS = {k: re.findall(r"\b(fx_\w+)\b", v) for k, v in TEMPLATES.items()}
_TABLES = ("orders", "lineitem", "events", "labels", "conversations", "nation", "part", "customer", "pages", "documents")


def _dialect(sql: str, spark: bool) -> str:
    def sha(s: str) -> str:
        out, at = "", 0
        while (i := s.find("~H(", at)) >= 0:
            depth, j = 1, i + 3
            while depth:
                depth += {"(": 1, ")": -1}.get(s[j], 0)
                j += 1
            out += s[at:i] + (f"sha2({s[i + 3 : j - 1]}, 256)" if spark else f"sha256({s[i + 3 : j - 1]})")
            at = j
        return out + s[at:]

    number = "CAST(get_json_object(props, '$.k') AS INT)" if spark else "CAST(json_extract_string(props, '$.k') AS INT)"
    return sha(sql).replace("~S", "STRING" if spark else "VARCHAR").replace("~K", number)


def _order(names: list[str]) -> list[str]:
    """The names and what they need, needed ones first."""
    out: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            if m != n:
                add(m)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named tables as DataFrames."""
    made: dict[str, DataFrame] = {}
    for n in _order(list(names)):
        sql = _dialect(TEMPLATES[n], True)
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f"{{{t}}}" in sql}
        sql = sql.replace("{", "{{").replace("}", "}}")
        for t in used:
            sql = sql.replace("{{" + t + "}}", "{" + t + "}")
        for m in _NEEDS[n]:
            used[m] = made[m]
            sql = re.sub(rf"(FROM|JOIN) {m}\b", rf"\1 {{{m}}}", sql)
        made[n] = spark.sql(sql, **used)
    return [made[n] for n in names]


def ctes(*names: str) -> str:
    """``WITH RECURSIVE`` definitions of the named tables for DuckDB."""
    parts = [f"{n} AS ({reduce(lambda s, t: s.replace('{' + t + '}', t), _TABLES, _dialect(TEMPLATES[n], False))})" for n in _order(list(names))]
    return "WITH RECURSIVE " + ",\n".join(parts)
