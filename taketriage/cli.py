"""Command line: each command is a thin call of the engine.

Exit codes: 0 fine, 1 nothing to do or a check failed, 2 an error, 3 killed.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import __version__, report as report_, review as review_, schema
from .functions.kernels import mutated_seeds
from .functions.text import drawtext_escape, plain_path, want_pair
from .operators import cost, judge, labels, ledger, lineage, rank
from .plans.session import cut, session
from .sources import external, sidecars, sinks

HISTORY, LEDGER, CALIBRATION = "judge-history.json", "ledger.json", "calibration.json"
KEY = "TAKETRIAGE_VLM_KEY"


def _takes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = cut(sidecars.find_takes(spark, root))
    takes = sidecars.flat(docs)
    there = sidecars.snapshot(spark, root).select(F.col("path").alias("clip"), F.lit(True).alias("there"))
    takes = takes.join(there, "clip", "left").withColumn(
        "pending", F.col("verdict").isNull() & (F.col("regen") | F.col("parent").isNotNull()) & F.col("there").isNull()
    )
    return docs, takes, sidecars.defects(docs)


def _judging(a) -> review_.Judging | None:
    """The judges that the options name."""
    if not a.vlm:
        return None
    judge_of = lambda url, model: external.HttpJudge(url, model, os.environ.get(KEY))
    strong = judge_of(a.vlm_strong, a.vlm_strong_model or a.vlm_model) if a.vlm_strong else None
    rules = sidecars.load_rubric(a.rubric) if a.rubric else sidecars.DEFAULT_RUBRIC
    calibration = sinks.load_json(a.calibration) if a.calibration else None
    return review_.Judging(judge_of(a.vlm, a.vlm_model), a.vlm_model, rules, a.samples, strong, a.vlm_strong_model or a.vlm_model, calibration)


def _prices(a) -> dict | None:
    return sidecars.load_prices(a.prices) if getattr(a, "prices", None) else None


def _need(rows: list, what: str) -> None:
    if not rows:
        raise LookupError(what)


def cmd_review(a, spark) -> int:
    df = review_.listing(review_.review(spark, a.paths, a.shot, a.force, _judging(a), _prices(a)))
    head = df.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("verdict") == "kill").alias("killed")).first().asDict()
    if not head["reviewed"]:
        raise LookupError("no clips found")
    if a.ndjson:
        for r in review_.event_lines(df).toLocalIterator():
            print(r["line"], flush=True)
        print(json.dumps(head))
    elif a.json:
        print(json.dumps(head | {"takes": [json.loads(r["json"]) for r in df.toLocalIterator()]}, indent=2))
    else:
        print(f"reviewed {head['reviewed']} takes, killed {head['killed']}")
        for r in df.toLocalIterator():
            print(f"  {r['verdict']:8} #{r['rank_in_shot']}  {r['file']:40} {'; '.join(r['kill_reasons'])}")
    return 0


def cmd_verdict(a, spark) -> int:
    if not Path(a.clip).is_file():
        print(f"no such clip: {a.clip}", file=sys.stderr)
        return 2
    row = cut(review_.review(spark, [a.clip], a.shot, a.force, _judging(a)))
    print(review_.event_lines(row).first()["line"])
    return 3 if row.first()["verdict"] == "kill" else 0


def cmd_gold(a, spark) -> int:
    if a.action == "add":
        found = sidecars.find_clips(spark, a.paths).select(F.col("path").alias("clip"))
        ids = external.extract(found, external.hash_file, "id")
        known = review_.opened(found).select("clip", F.col("take_id").alias("own"))
        rows = cut(ids.join(known, "clip").select("clip", F.coalesce("own", "id").alias("take_id")))
        if not sinks.patch_sidecars(sidecars.label_patches(rows, a.label)):
            raise LookupError("no clips found")
        done = [r["clip"] for r in rows.orderBy("clip").toLocalIterator()]
        print(json.dumps({"labeled": done, "label": a.label}, indent=2) if a.json else "\n".join(f"{a.label}  {c}" for c in done))
        return 0
    rows = [r.asDict() for r in sidecars.gold(sidecars.find_takes(spark, (a.paths or ["."])[0])).toLocalIterator()]
    print(json.dumps({"gold": rows}, indent=2) if a.json else "\n".join([*(f"{r['label']:5} {r['clip']}" for r in rows), f"{len(rows)} labeled takes"]))
    return 0


def _scored(spark, root):
    docs, takes, defects = _takes(spark, root)
    judged = takes.where("judged")
    gold = sidecars.gold(docs).join(judged.select("clip"), "clip", "left_semi")
    return gold, judge.kill_scores(judged, defects).join(gold, "clip"), defects


def cmd_calibrate(a, spark) -> int:
    _, scored, _ = _scored(spark, a.dir)
    r = labels.conformal(scored, a.alpha).first().asDict()
    if not r["n_pass"]:
        raise LookupError("no labelled passes with a judge's review")
    if r["kill_recall"] is not None:
        r["kill_recall"] = round(r["kill_recall"], 3)
    sinks.save_json(sinks.load_json(a.output, {}) | {k: v for k, v in r.items() if v is not None or k == "lambda"}, a.output)
    print(json.dumps(r))
    return 1 if r["lambda"] is None else 0


def cmd_fit(a, spark) -> int:
    gold, _, defects = _scored(spark, a.dir)
    r = labels.fit_weights(gold, labels.rule_features(defects)).first().asDict()
    sinks.save_json(sinks.load_json(a.output, {}) | r, a.output)
    top = sorted(r["weights"].items(), key=lambda x: -abs(x[1]))[:5]
    print(json.dumps({"n_fit": r["n_fit"], "fit_accuracy": r["fit_accuracy"], "top": top}))
    return 0


def cmd_judge_check(a, spark) -> int:
    """The judges asked anew about the labelled clips; sidecars stay as they are."""
    judging = _judging(a)
    if judging is None:
        print("judge-check needs --vlm", file=sys.stderr)
        return 2
    docs = cut(sidecars.find_takes(spark, a.dir))
    gold = cut(sidecars.gold(docs))
    there = sidecars.snapshot(spark, a.dir).select(F.col("path").alias("clip"))
    predicted = review_.predicted(docs.join(gold.select("clip"), "clip", "left_semi").join(there, "clip", "left_semi"), judging)
    r = labels.judge_agreement(gold, predicted, there).first().asDict()
    if not r["n"]:
        raise RuntimeError("no labelled clips")
    r = {"engine": a.vlm_model, "samples": a.samples} | r | {"agreement": round(r["agreement"], 3), "kappa": round(r["kappa"], 3), "created": sinks.now()}
    previous = sinks.append_history(a.history or os.path.join(a.dir, HISTORY), r)
    print(json.dumps(r | {"previous": previous}))
    if a.fail_below is not None and r["kappa"] < a.fail_below:
        print(f"kappa {r['kappa']:.2f} below --fail-below {a.fail_below}", file=sys.stderr)
        return 1
    return 0


def write_report(spark, folder: str, output: str) -> DataFrame:
    docs, takes, _ = _takes(spark, folder)
    stills = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jpg").load(folder).select(plain_path(F.col("path")).alias("path"))
    report_.write_html(docs, takes, stills, output)
    return takes.where("not pending")


def cmd_report(a, spark) -> int:
    takes = write_report(spark, a.dir, a.output)
    print(json.dumps({"report": os.path.abspath(a.output), "cost": cost.cost_doc(takes)}) if a.json else a.output)
    return 0


def cmd_brief(a, spark) -> int:
    docs, takes, defects = _takes(spark, a.dir)
    if takes.isEmpty():
        return 1
    chains = lineage.lineage_by_shot(takes)
    doc = report_.dossier(takes, defects, sidecars.kill_reasons(docs), chains)
    print(json.dumps(doc, indent=2) if a.json else report_.dossier_text(doc))
    return 0


def cmd_schema(a, spark) -> int:
    print(schema.published(a.name))
    return 0


def cmd_assemble(a, spark) -> int:
    docs, takes, defects = _takes(spark, a.dir)
    size = None
    if a.scale:
        try:
            size = tuple(map(int, a.scale.lower().split("x")))
        except ValueError:
            size = ()
        if len(size) != 2:
            print(f"bad --scale {a.scale!r}, want WxH", file=sys.stderr)
            return 2
    there = takes.where("there")
    picks = cut(rank.with_slates(rank.top_takes(there, a.alts), rank.top_rules(defects)))
    listed = rank.parse_shot_list(sidecars.shot_list(spark, a.shots)) if a.shots else None
    order = cut(rank.cut_list(picks, listed, a.fps or rank.DEFAULT_FPS))
    first = order.join(docs.select("clip", "output"), "clip").orderBy("n").select("output.fps", "output.width", "output.height").first()
    if first is None:
        raise LookupError("no surviving take to cut")
    fps = a.fps or first["fps"] or rank.DEFAULT_FPS
    size = size or ((first["width"], first["height"]) if first["width"] and first["height"] else rank.DEFAULT_SIZE)
    rows = rank.cut_list(picks, listed, fps).withColumnRenamed("clip", "file")
    csv = a.csv or os.path.splitext(a.output)[0] + ".csv"
    sinks.write_cut_csv(rows, csv)
    # the cut is one film, so one process joins it; its list is as long as it has shots
    segments = [r.asDict() for r in rows.join(picks.select(F.col("clip").alias("file"), drawtext_escape(F.col("slate")).alias("slate")), "file").orderBy("n").toLocalIterator()]
    slated = external.encode_cut([s | {"file": sinks.local(s["file"]), "slate": None if a.no_slate else s["slate"]} for s in segments], a.output, fps, size)
    done = {"output": a.output, "csv": csv, "fps": fps, "width": size[0], "height": size[1], "slated": slated, "shots": sorted({s["shot"] for s in segments}), "duration": segments[-1]["record_out"], "segments": segments}
    print(json.dumps(done, indent=2) if a.json else f"cut {len(segments)} takes from {len(done['shots'])} shots into {a.output}\nwrote {csv}")
    return 0


def cmd_regen(a, spark) -> int:
    if not Path(a.clip).is_file():
        print(f"not a file: {a.clip}", file=sys.stderr)
        return 2
    clip = os.path.abspath(a.clip)
    row = review_.opened(spark.createDataFrame([(clip,)], "clip string"))
    seeds = row.select(mutated_seeds(F.col("recipe.seeds"), F.coalesce("take_id", F.lit("")), F.lit(time.time_ns())).alias("s")).first()["s"]
    driver = external.Driver(a.driver)
    job = external.resubmit(driver, clip, seeds, a.out_dir, a.shot)
    if a.wait:
        job |= {k: v for k, v in driver.wait(job["job"], a.interval, a.timeout).items() if k in ("state", "output", "error") and v}
    print(json.dumps(job, indent=2) if a.json else f"submitted job {job['job']}; new take lands at {job['clip']}")
    return 1 if job.get("state") == "error" else 0


def wants(spark, pairs: list[str]) -> dict[str, int]:
    """The --want pairs; an error names the first that isn't one."""
    rows = spark.createDataFrame([(p,) for p in pairs], "pair string").select("pair", want_pair(F.col("pair")).alias("w")).collect()
    for r in rows:
        if r["w"] is None:
            raise ValueError(f"bad --want {r['pair']!r}, want SHOT=K with K >= 1")
    return {r["w"]["shot"]: r["w"]["k"] for r in rows}


def judge_refusal(a, spark) -> str | None:
    """Why an unattended loop may not start, by the first history there is."""
    path = next((p for p in (os.path.join(a.dir, HISTORY), HISTORY) if os.path.exists(p)), None)
    runs = (sinks.load_json(path).get("runs") if path else None) or []
    frame = spark.createDataFrame([(i, r.get("kappa"), r.get("created")) for i, r in enumerate(runs)], "seq int, kappa double, created string")
    gate = labels.judge_gate(frame, a.min_kappa).first()
    return None if gate["ok"] else gate["why"]


def cmd_watch(a, spark) -> int:
    from .streaming import resubmit, watch as w

    if not os.path.isdir(a.dir):
        print(f"not a directory: {a.dir}", file=sys.stderr)
        return 2
    want = wants(spark, a.want or [])
    if not a.regen and (a.dry_run or want):
        print(f"{'--dry-run' if a.dry_run else '--want'} needs --regen", file=sys.stderr)
        return 2
    if a.regen and not a.dry_run and not a.allow_unchecked_judge and (why := judge_refusal(a, spark)):
        print(f"refusing to start --regen: {why}", file=sys.stderr)
        return 2

    def say(doc: dict, text: str) -> None:
        print(json.dumps(doc) if a.json else f"{time.strftime('%H:%M:%S')}  {text}", flush=True)

    def doomed(state: dict) -> None:
        worst = state["worst"] + sidecars.SUFFIX if state["worst"] else ""
        doc = {"event": "doomed", "shot": state["shot"], "takes": state["takes"], "mechanical_kills": state["mechanical_kills"], "doom_probability": round(state["doom_probability"], 4), "worst_sidecar": worst}
        say(doc, f"DOOMED   {state['shot']}: {state['mechanical_kills']} mechanical kills in {state['takes']} takes")
        if a.on_doomed:
            external.run_hook(a.on_doomed, state["shot"], worst)

    root = os.path.abspath(a.dir)
    judging, prices = _judging(a), _prices(a)
    monitor = w.Monitor(doomed)
    sender = resubmit.Resubmission(spark, root, a.regen, os.path.join(root, LEDGER), want, a.regen_rate, dry_run=a.dry_run) if a.regen else None

    def reviewed(clips: DataFrame) -> DataFrame:
        return review_.opened(clips.select("clip")).where("review.verdict is not null")

    def review(clips: DataFrame) -> DataFrame:
        paths = [r["clip"] for r in clips.select("clip").collect()]  # a batch is bounded
        return review_.review(spark, paths, a.shot, False, judging, prices, a.audit_rate) if paths else clips.where("false")

    def after(rows: DataFrame) -> None:
        if "verdict" in rows.columns and not rows.isEmpty():
            docs, takes, _ = _takes(spark, root)
            review_.priced_and_ranked(takes.select("clip"), None, judging and judging.calibration)
            names = takes
            told = monitor_states(names, rows)
            for r in told.orderBy("clip").toLocalIterator():
                line = json.loads(r["line"]) | {"shot_doomed": r["doomed"]}
                say(line, f"{line['verdict']:8} {os.path.relpath(line['clip'], root)} {'; '.join(line['kill_reasons'])}")
            monitor.look(names)
            if a.report:
                write_report(spark, root, a.report)
        if sender:
            kills = rows.where("verdict = 'kill'").select("clip") if "verdict" in rows.columns else None
            for e in sender.tick(kills):
                say(e, f"REGEN    {e['action']} {os.path.relpath(e['parent'], root)} {e.get('reason') or e.get('error') or e.get('job') or ''}")

    query = w.watch(
        w.settled_clips(spark, root, a.settle if a.settle is not None else max(a.interval, 1.0)),
        review,
        lambda doc: None,
        a.checkpoint or tempfile.mkdtemp(prefix="watch-"),
        reviewed=reviewed,
        after=after,
        processingTime=f"{a.interval} seconds",
    )
    if not a.json:
        print(f"watching {a.dir} every {a.interval:g}s; ctrl-c to stop", flush=True)
    try:
        while not query.awaitTermination(1):
            # a poll without clips makes no batch: kills that wait are swept here
            if sender and not query.status["isTriggerActive"] and not a.dry_run:
                for e in sender.tick():
                    say(e, f"REGEN    {e['action']} {os.path.relpath(e['parent'], root)}")
                time.sleep(a.interval)
    except KeyboardInterrupt:
        query.stop()
    return 0


def monitor_states(takes: DataFrame, rows: DataFrame) -> DataFrame:
    """(clip, line, doomed) of reviewed rows, with ranks as they are now."""
    from .operators.breaker import breaker_states

    doomed = breaker_states(takes).where("doomed").select("shot", F.lit(True).alias("doomed"))
    now = rows.drop("rank_in_shot").join(takes.select("clip", "rank_in_shot"), "clip", "left")
    return review_.event_lines(now).join(now.select("clip", "shot"), "clip").join(doomed, "shot", "left").select("clip", "line", F.coalesce("doomed", F.lit(False)).alias("doomed"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="taketriage")
    sub = p.add_subparsers(dest="cmd", required=True)

    def add(name, fn, *args):
        s = sub.add_parser(name)
        s.set_defaults(fn=fn)
        for names, kw in args:
            s.add_argument(*names.split(), **kw)

    flag, here = {"action": "store_true"}, ("dir", {"nargs": "?", "default": "."})
    number, whole = {"type": float}, {"type": int}
    json_, prices = ("--json", flag), ("--prices", {"metavar": "FILE"})
    judges = [
        ("--vlm", {"metavar": "URL", "help": f"chat-completions endpoint; the key is read from {KEY}"}), ("--vlm-model", {"default": "qwen3-vl"}), ("--rubric", {"metavar": "FILE"}),
        ("--samples", whole | {"default": 1}), ("--vlm-strong", {"metavar": "URL"}), ("--vlm-strong-model", {}), ("--calibration", {"metavar": "FILE"}),
    ]
    p.add_argument("--version", action="version", version=__version__)
    add("review", cmd_review, ("paths", {"nargs": "+"}), ("--shot", {}), ("--force", flag), *judges, prices, json_, ("--ndjson", flag))
    add("verdict", cmd_verdict, ("clip", {}), ("--shot", {}), ("--force", flag), *judges)
    add("gold", cmd_gold, ("action", {"choices": ["add", "list"]}), ("paths", {"nargs": "*"}), ("--label", {"choices": schema.LABELS}), json_)
    add("calibrate", cmd_calibrate, here, ("--alpha", number | {"default": labels.DEFAULT_ALPHA}), ("-o --output", {"default": CALIBRATION}), json_)
    add("fit", cmd_fit, here, ("-o --output", {"default": CALIBRATION}), json_)
    add("judge-check", cmd_judge_check, here, *judges, ("--history", {}), ("--fail-below", number), json_)
    add("schema", cmd_schema, ("name", {"choices": ["take", "calibration", "judge-history"]}))
    add("report", cmd_report, here, ("-o --output", {"default": "report.html"}), json_)
    add("brief", cmd_brief, here, json_)
    add(
        "assemble", cmd_assemble, here, ("-o --output", {"default": "cut.mp4"}), ("--shots", {"metavar": "FILE"}), ("--alts", whole | {"default": 0}), ("--fps", number),
        ("--scale", {"metavar": "WxH"}), ("--csv", {"metavar": "FILE"}), ("--no-slate", flag), json_,
    )
    add(
        "regen", cmd_regen, ("clip", {}), ("--driver", {"required": True}), ("--out-dir", {}), ("--shot", {}), ("--wait", flag),
        ("--interval", number | {"default": external.WAIT_INTERVAL}), ("--timeout", number | {"default": external.WAIT_TIMEOUT}), json_,
    )
    add(
        "watch", cmd_watch, ("dir", {}), ("--interval", number | {"default": 5.0}), ("--settle", number), ("--shot", {}), ("--report", {"metavar": "FILE"}), *judges, prices, json_,
        ("--on-doomed", {"metavar": "CMD"}), ("--regen", {"metavar": "DRIVER"}), ("--want", {"action": "append", "metavar": "SHOT=K"}), ("--dry-run", flag),
        ("--regen-rate", whole | {"default": ledger.REGEN_RATE}), ("--min-kappa", number | {"default": labels.MIN_KAPPA}), ("--allow-unchecked-judge", flag),
        ("--audit-rate", number | {"default": review_.AUDIT_RATE}), ("--checkpoint", {"metavar": "DIR"}),
    )
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.fn(a, spark or session())
    except LookupError as e:
        print(e, file=sys.stderr)
        return 1
    except (RuntimeError, ValueError, OSError, PySparkException) as e:
        print(str(e).split("\n")[0], file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
