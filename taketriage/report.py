"""Report and dossier, rendered from plans.

Cards are text columns, made where the rows are; the page is written a row at a
time in its order.  Only what a page holds once (totals, shots) is collected.
"""

from __future__ import annotations

import html
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from .functions.kernels import fixed
from .functions.text import display_label, family, file_name, html_escape, slug, time_label, untold, usd
from .operators import breaker, brief, cost
from .operators.cost import cost_phrase

_STYLE = (
    "body{font:14px sans-serif;margin:2em}.card{border:1px solid #bbb;padding:.6em;margin:.4em 0}.kill{border-color:#c33}.pending{border-style:dashed}.doomed{color:#c33}"
    ".bar{position:relative;background:#eee}.bar i{position:absolute}.span,.cut{top:0;height:100%}.black{background:#000}.freeze{background:#8bd}.cut{width:2px;background:#f80}"
    ".dot{min-width:6px;height:6px;background:#c33;border-radius:6px}video{max-width:320px}"
)
# fixed values: dots nearer than this many percent don't share a row; height of a row
NEAR, ROW = 1.8, 14
UNRANKED = 10**6


def percent(t: Column, duration: Column) -> Column:
    """Where a time lies on the timeline; what is past the end lies at the end."""
    return 100 * F.least(t, duration) / duration


def dot_rows(places: Column) -> Column:
    """Row of each of the ascending places of a timeline: the first row whose
    last dot isn't near."""

    def step(acc: Column, at: Column) -> Column:
        free = F.array_position(F.transform(acc["last"], lambda x: at - x >= NEAR), True).cast("int")
        row = F.when(free > 0, free).otherwise(F.size(acc["last"]) + 1)
        last = F.when(free > 0, F.transform(acc["last"], lambda x, i: F.when(i + 1 == row, at).otherwise(x))).otherwise(F.concat(acc["last"], F.array(at)))
        return F.struct(last.alias("last"), F.concat(acc["rows"], F.array(row - 1)).alias("rows"))

    start = F.struct(F.array().cast("array<double>").alias("last"), F.array().cast("array<int>").alias("rows"))
    return F.aggregate(places, start, step)["rows"]


def _or_none(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind))


def _bar(kind: str, start: Column, end: Column, duration: Column) -> Column:
    return F.concat(F.lit(f"<i class='span {kind}' style='left:"), fixed(100 * start / duration, 1), F.lit("%;width:"), fixed(100 * (end - start) / duration, 1), F.lit("%'></i>"))


def timeline(duration: Column) -> Column:
    """Spans, cuts and dots of a take's columns black, freeze, cuts, defects
    (ascending) and rows; '' without a duration."""
    black = F.transform("black", lambda s: _bar("black", s["start"], s["end"], duration))
    freeze = F.transform("freeze", lambda s: _bar("freeze", s["start"], F.coalesce(s["end"], duration), duration))
    cuts = F.transform("cuts", lambda t: F.concat(F.lit("<i class=cut style='left:"), fixed(100 * t / duration, 1), F.lit("%'></i>")))

    def dot(d: Column, i: Column) -> Column:
        at, end = percent(d["t"], duration), percent(F.coalesce(F.nullif(d["t_end"], F.lit(0.0)), d["t"]), duration)
        width = F.when(end > at, F.concat(F.lit(";width:"), fixed(end - at, 1), F.lit("%"))).otherwise("")
        told = html_escape(F.concat(time_label(d["t"], d["t_end"]), F.lit(" "), _told(d)))
        kind = html_escape(family(d["rule"]))
        return F.concat(
            F.lit("<i class='dot "), kind, F.lit("' style='left:"), fixed(at, 1), F.lit("%;top:"), (2 + F.get("rows", i) * ROW).cast("string"), F.lit("px"), width,
            F.lit("' data-t='"), d["t"].cast("string"), F.lit("' title='"), told, F.lit("'></i>"),
        )

    height = (16 + F.coalesce(F.array_max("rows"), F.lit(0)) * ROW).cast("string")
    marks = F.array_join(F.concat(black, freeze, cuts, F.transform("defects", dot)), "")
    return F.when(duration > 0, F.concat(F.lit("<div class=bar style='height:"), height, F.lit("px'>"), marks, F.lit("</div>"))).otherwise("")


def _told(d: Column) -> Column:
    return F.concat(d["rule"], F.lit(" ("), d["severity"].cast("string"), F.lit("): "), F.coalesce(d["note"], F.lit("")))


def details() -> Column:
    """Reasons and defects, a section for each family."""
    section = lambda name, lines: F.concat(F.lit("<b>"), html_escape(name), F.lit("</b><ul>"), F.array_join(lines, ""), F.lit("</ul>"))
    other = untold(F.col("reasons"), F.transform("defects", lambda d: d["rule"]))
    first = F.when(F.size(other) > 0, section(F.lit("mechanical"), F.transform(other, lambda x: F.concat(F.lit("<li>"), html_escape(x), F.lit("</li>"))))).otherwise("")
    names = F.array_sort(F.array_distinct(F.transform("defects", lambda d: family(d["rule"]))))
    line = lambda d: F.concat(F.lit("<li><a class=seek data-t='"), d["t"].cast("string"), F.lit("'>"), time_label(d["t"], d["t_end"]), F.lit("</a> "), html_escape(_told(d)), F.lit("</li>"))
    return F.concat(first, F.array_join(F.transform(names, lambda n: section(n, F.transform(F.filter("defects", lambda d: family(d["rule"]) == n), line))), ""))


def cards(docs: DataFrame, pending: DataFrame, posters: DataFrame, folder: str) -> DataFrame:
    """(shot, place, clip, card): the card of each take as text, in the order of a page.

    docs: typed takes; pending: clip of stubs without a clip; posters: clip of
    takes with a still beside them; folder: paths are told from there.
    """
    m = "review.mechanical"
    shot = F.coalesce(F.nullif("shot", F.lit("")), F.lit(brief.UNTAGGED))
    spans, defect = "array<struct<start:double,end:double>>", "array<struct<t:double,t_end:double,rule:string,severity:int,confidence:double,note:string>>"
    df = docs.join(pending.select("clip", F.lit(True).alias("pending")), "clip", "left").join(posters.select("clip", F.lit(True).alias("poster")), "clip", "left")
    df = df.select(
        "clip", shot.alias("shot"), F.coalesce("pending", F.lit(False)).alias("pending"), "poster", "regen", "output",
        F.col("review.verdict").alias("verdict"), F.col("review.rank_in_shot").alias("rank"), F.col("review.cost.total_usd").alias("total_usd"),
        F.col(f"{m}.probe.duration").alias("duration"), F.col(f"{m}.flicker_score").alias("flicker"), F.col(f"{m}.motion_smoothness").alias("smoothness"),
        _or_none(f"{m}.black_frames", spans).alias("black"), _or_none(f"{m}.freeze", spans).alias("freeze"), _or_none(f"{m}.scene_cuts", "array<double>").alias("cuts"),
        _or_none(f"{m}.kill_reasons", "array<string>").alias("reasons"), F.array_sort(_or_none("review.vlm.defects", defect)).alias("defects"),
    )
    df = df.withColumn("rows", dot_rows(F.when(F.col("duration") > 0, F.transform("defects", lambda d: percent(d["t"], F.col("duration")))).otherwise(F.array().cast("array<double>"))))
    name = html_escape(file_name(F.col("output.file"), F.col("clip")))
    path = F.col("clip")
    near = F.when(path.startswith(folder.rstrip("/") + "/"), F.substr(path, F.lit(len(folder.rstrip("/")) + 2))).otherwise(path)
    still = F.when(F.col("poster"), F.concat(F.lit(" poster='"), html_escape(F.regexp_replace(near, r"\.[^./]*$", ".jpg")), F.lit("'"))).otherwise("")
    stats = F.array_join(
        F.array_compact(
            F.array(
                F.concat(F.col("output.width").cast("string"), F.lit("x"), F.col("output.height").cast("string")),
                F.concat(F.col("output.frames").cast("string"), F.lit(" frames")),
                F.concat(F.lit("flicker "), fixed(F.col("flicker"), 3)),
                F.concat(F.lit("motion "), fixed(F.col("smoothness"), 3)),
                F.when(F.size("cuts") > 0, F.concat(F.size("cuts").cast("string"), F.lit(" cuts"))),
                F.when(F.size("defects") > 0, F.concat(F.size("defects").cast("string"), F.lit(" defects"))),
                usd(F.col("total_usd")),
            )
        ),
        " · ",
    )
    rank = F.when(F.col("rank") > 0, F.concat(F.lit("#"), F.col("rank").cast("string"), F.lit(" "))).otherwise("")
    label = display_label(F.col("verdict"), F.size("defects"))
    kind = F.when(F.col("verdict") == "kill", "card kill").otherwise("card")
    card = F.concat(
        F.lit("<div class='"), kind, F.lit("'><video src='"), html_escape(near), F.lit("'"), still, F.lit(" preload=metadata muted playsinline controls></video><p>"),
        rank, name, F.lit(" <em>"), label, F.lit("</em> "), html_escape(stats), F.lit("</p>"), timeline(F.col("duration")), details(), F.lit("</div>"),
    )
    where = F.concat_ws(" · ", F.lit("regen not landed"), F.concat(F.lit("job "), F.col("regen.job")), F.concat(F.lit("submitted "), F.col("regen.submitted")))
    stub = F.concat(F.lit("<div class='card pending'>"), name, F.lit(" <em>pending</em> "), html_escape(where), F.lit("</div>"))
    place = F.struct("pending", F.coalesce(F.nullif("rank", F.lit(0)), F.lit(UNRANKED)).alias("rank"), "clip")
    return df.select("shot", place.alias("place"), "clip", F.when(F.col("pending"), stub).otherwise(card).alias("card"))


def report_totals(takes: DataFrame) -> DataFrame:
    """One row: reviewed, killed, to_watch, pending, doomed (names).

    takes: all, with pending; a stub that hasn't landed isn't reviewed."""
    landed = takes.where("not pending")
    doomed = breaker.breaker_states(landed).where("doomed").agg(F.array_sort(F.collect_list("shot")).alias("doomed"))  # names of a page
    killed = F.count_if(F.col("verdict") == "kill")
    head = takes.agg(F.count_if(~F.col("pending")).alias("reviewed"), killed.alias("killed"), F.count_if("pending").alias("pending"))
    return head.select("reviewed", "killed", (F.col("reviewed") - F.col("killed")).alias("to_watch"), "pending").crossJoin(F.broadcast(doomed))  # two rows


def posters(docs: DataFrame, stills: DataFrame) -> DataFrame:
    """clip of the takes that have a still of their name (stills: path)."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    names = stills.where(F.col("path").endswith(".jpg")).select(stem("path").alias("stem")).distinct()
    return docs.select("clip", stem("clip").alias("stem")).join(names, "stem", "left_semi").select("clip")


def html_lines(docs: DataFrame, takes: DataFrame, stills: DataFrame, folder: str) -> Iterator[str]:
    """One static page; shots by name, cards by rank, pending ones last.

    docs: typed takes; takes: the same, flat, with pending.
    """
    landed = takes.where("not pending")
    by_shot = cost.cost_summary(landed).withColumn("phrase", cost_phrase(F.col("total_usd"), F.col("per_usable"))).collect()
    spent = {r["shot"]: r["phrase"] for r in by_shot}
    heads = {r["shot"]: r for r in brief.shot_rollup(takes).collect()}  # a row a shot
    total = report_totals(takes).first()
    yield f"<!doctype html><meta charset=utf-8><title>Takes</title><style>{_STYLE}</style>"
    line = f"<p>{total['reviewed']} takes reviewed, {total['killed']} killed, {total['to_watch']} to watch."
    if total["doomed"]:
        line += f" <b class=doomed>doomed: {html.escape(', '.join(total['doomed']))}</b>"
    if None in spent:
        line += f" {html.escape(spent[None].capitalize())}."
    yield line + (f" {total['pending']} regens pending.</p>" if total["pending"] else "</p>")
    shot = None
    rows = cards(docs, takes.where("pending"), posters(docs, stills), folder).withColumn("slug", slug(F.col("shot"))).orderBy("shot", "place")
    for c in rows.toLocalIterator():
        if c["shot"] != shot:
            shot, h = c["shot"], heads[c["shot"]]
            more = f" · {html.escape(spent[shot])}" if shot in spent else ""
            more += f" · {h['pending']} pending" if h["pending"] else ""
            more += " <span class=doomed>doomed</span>" if shot in total["doomed"] else ""
            yield f"<h2 id='{c['slug']}'>{html.escape(shot)} · {h['n_takes']} takes · {h['kills']} killed{more}</h2>"
        yield c["card"]


def write_html(docs: DataFrame, takes: DataFrame, stills: DataFrame, output: str) -> str:
    with open(output + ".tmp", "w") as f:
        for line in html_lines(docs, takes, stills, os.path.dirname(os.path.abspath(output))):
            f.write(line + "\n")
    os.replace(output + ".tmp", output)
    return output


def dossier(takes: DataFrame, defects: DataFrame, reasons: DataFrame, lineage: DataFrame | None = None) -> dict:
    """The nested dossier: totals, and by shot its yields, reasons, rules,
    survivors and lineage.  Rows come grouped; only shots and rules are held."""
    roll = brief.shot_rollup(takes)
    total = brief.totals(roll).first()
    rnd = lambda x, n: None if x is None else round(x, n)
    shots = {
        r["shot"]: {"shot": r["shot"], "n_takes": r["n_takes"], "pending": r["pending"], "kills": r["kills"], "yield": rnd(r["yield"], 3),
                    "kill_reasons": {"mechanical": {}, "rule": {}}, "rules": {}, "survivors": []}
        for r in roll.orderBy("shot").collect()
    }
    for r in brief.kill_histogram(takes, reasons).orderBy("shot", F.desc("count"), "class").collect():
        shots[r["shot"]]["kill_reasons"][r["side"]][r["class"]] = r["count"]
    for r in brief.rule_stats(takes, defects).orderBy("shot", F.desc("count"), "rule").collect():
        shots[r["shot"]]["rules"][r["rule"]] = {
            "count": r["count"], "takes_affected": r["takes_affected"], "mean_severity": rnd(r["mean_severity"], 2), "mean_confidence": rnd(r["mean_confidence"], 2),
            "example": {"file": r["worst_file"], "t": r["worst_t"], "note": r["worst_note"]},
        }
    for r in brief.survivors(takes, defects).toLocalIterator():
        shots[r["shot"]]["survivors"].append({k: r[k] for k in ("file", "take_id", "rank_in_shot", "verdict", "defects")})
    for r in lineage.collect() if lineage is not None else []:
        if r["shot"] in shots:
            shots[r["shot"]]["lineage"] = {"reruns": r["reruns"], "max_depth": r["max_depth"]}
    return {"n_takes": total["n_takes"], "kills": total["kills"], "pending": total["pending"], "yield": rnd(total["yield"], 3), "shots": list(shots.values())}


def dossier_text(doc: dict) -> str:
    pct = lambda y: "n/a" if y is None else f"{100 * y:.1f}%"
    out = [f"{doc['n_takes']} takes, {doc['kills']} killed, yield {pct(doc['yield'])}"]
    for s in doc["shots"]:
        out += ["", f"{s['shot']}: {s['n_takes']} takes, {s['kills']} killed, {s['pending']} pending, yield {pct(s['yield'])}"]
        for side, hist in s["kill_reasons"].items():
            if hist:
                out.append(f"  {side} kills: " + ", ".join(f"{k} x{n}" for k, n in hist.items()))
        for rule, r in s["rules"].items():
            sure = "" if r["mean_confidence"] is None else f", confidence {r['mean_confidence']}"
            out.append(f"  {rule}: {r['count']} in {r['takes_affected']} takes, severity {r['mean_severity']}{sure}; worst {r['example']['file']} at {r['example']['t']}s: {r['example']['note']}")
        if s["survivors"]:
            out.append("  survivors: " + ", ".join(x["file"] for x in s["survivors"]))
    return "\n".join(out)
