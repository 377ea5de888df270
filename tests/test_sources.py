"""Sources, sinks, judge passes, streaming and the command line on files."""

import io
import json
import os
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from taketriage import cli
from taketriage.operators import judge, labels, ledger, rank, screening
from taketriage.sources import sidecars, sinks


def take(n, shot="shot-a", verdict="review", parent=None, defects=(), reasons=(), gold=None, vlm=True, **more):
    return {
        "take_id": f"sha256:{n:02x}",
        "shot": shot,
        "parent": parent,
        "output": {"file": f"t{n}.mp4"},
        "recipe": {"seeds": {"3": n}, "prompt_text": "a river", "workflow": {"keep": [1, {"x": None}]}},
        "review": {
            "mechanical": {"probe": {"duration": 4.0}, "black_frames": [], "freeze": [{"start": 1.0, "end": None}], "kill_reasons": list(reasons)},
            "vlm": {"engine": "cheap", "defects": list(defects), "usage": {"calls": 2, "prompt_tokens": 1_000_000, "completion_tokens": 0}} if vlm else None,
            "verdict": verdict,
            "rank_in_shot": n,
            "cost": {"vlm_usd": 0.25, "total_usd": 0.25},
        },
        "gold": gold and {"label": gold, "labeled": "now"},
        "x_unknown": {"stays": True},
    } | more


@pytest.fixture(scope="module")
def batch(tmp_path_factory):
    root = tmp_path_factory.mktemp("batch")
    (root / "sub").mkdir()
    d = {"t": 1.0, "rule": "hand.x", "severity": 4, "confidence": 0.8, "note": "odd"}
    docs = {
        "t1.mp4": take(1, verdict="kill", reasons=["black for 3.0s of 4.0s"], vlm=False, gold="kill"),
        "t2.mp4": take(2, verdict="kill", parent="sha256:01", defects=[d], reasons=["hand.x severity 4 at 1.0s: odd"], gold="kill"),
        "t3.mp4": take(3, parent="sha256:02", defects=[d | {"severity": 2}], gold="pass"),
        "sub/t4.mp4": take(4, shot=None, gold="pass"),
    }
    for name, doc in docs.items():
        (root / name).write_bytes(b"clip " + name.encode())
        (root / (name + ".take.json")).write_text(json.dumps(doc))
    (root / "notes.txt").write_text("x")
    return root


def test_scans(spark, batch, tmp_path):
    takes = sidecars.find_takes(spark, str(batch))
    assert takes.count() == 4
    doc = json.loads(takes.where(F.col("clip").endswith("t1.mp4")).select(F.to_json("doc")).first()[0])
    assert doc == take(1, verdict="kill", reasons=["black for 3.0s of 4.0s"], vlm=False, gold="kill")
    found = [os.path.basename(r["path"]) for r in sidecars.find_clips(spark, [str(batch)]).collect()]
    assert sorted(found) == ["t1.mp4", "t2.mp4", "t3.mp4", "t4.mp4"]
    assert sidecars.snapshot(spark, str(batch)).count() == 4
    assert [r["label"] for r in sidecars.gold(takes).orderBy("clip").collect()].count("kill") == 2
    assert sidecars.usage(takes).agg(F.sum("calls")).first()[0] == 6
    assert {r["kind"] for r in sidecars.spans(takes).collect()} == {"freeze"}
    ids = sidecars.hashed(spark, str(batch)).collect()
    assert all(r["take_id"].startswith("sha256:") for r in ids) and len({r["take_id"] for r in ids}) == 4


def test_lineage_index_is_permissive_and_flat(spark, batch, tmp_path):
    for name, text in (("a", '{"take_id": "x", "shot": "1"}'), ("b", '{"take_id": "x", "shot": "2"}'), ("c", "{junk"), ("d", '{"shot": "3"}')):
        (tmp_path / f"{name}.mp4.take.json").write_text(text)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.mp4.take.json").write_text('{"take_id": "y"}')
    rows = sidecars.lineage_index(spark, str(tmp_path)).collect()
    assert [(r["take_id"], r["shot"]) for r in rows] == [("x", "2")]
    with pytest.raises(Exception):
        sidecars.find_takes(spark, str(tmp_path)).collect()
    assert sidecars.find_takes(spark, str(tmp_path), permissive=True).count() == 4


def test_export_keeps_unknown_keys(spark, batch, tmp_path):
    docs = sidecars.find_takes(spark, str(batch)).select(F.concat(F.lit(f"{tmp_path}/"), F.regexp_extract("clip", "([^/]*)$", 1)).alias("clip"), F.to_json("doc").alias("json"))
    assert sinks.export_sidecars(docs) == 4
    assert json.loads((tmp_path / "t3.mp4.take.json").read_text())["x_unknown"] == {"stays": True}


def test_rubric_and_prices(tmp_path, spark):
    good = tmp_path / "r.yaml"
    good.write_text("rules:\n  a:\n    fail_at: 4\n    questions:\n      - ask: is it?\n")
    rules, questions = sidecars.rubric_frames(spark, sidecars.load_rubric(str(good)))
    assert questions.first()["severity"] == 3 and rules.first()["fail_at"] == 4
    for text in ('{"rules": {"a": {}}}', '{"a": {"questions": [{"severity": 3}]}}', "[]"):
        bad = tmp_path / "b.json"
        bad.write_text(text)
        with pytest.raises(ValueError):
            sidecars.load_rubric(str(bad))
    prices = tmp_path / "p.json"
    prices.write_text('{"models": {"m": {"input": "x", "output": 1}}}')
    with pytest.raises(ValueError):
        sidecars.load_prices(str(prices))


class StubJudge:
    """Says what it's told for the question in the message."""

    def __init__(self, replies):
        self.replies = replies

    def __call__(self, messages, temperature=0.0):
        text = messages[1]["content"][0]["text"]
        key = next(k for k in self.replies if k in text)
        return self.replies[key], {"prompt_tokens": 10, "completion_tokens": 1}


def one_frame(path, times):
    return [(times[0], "anBlZw==")]


def test_screen_escalate_scrutinize(spark):
    rules, questions = sidecars.rubric_frames(
        spark, {"a": {"fail_at": 4, "questions": [{"ask": "AAA?", "severity": 4}]}, "b": {"fail_at": 4, "questions": [{"ask": "BBB?", "severity": 5}]}, "c": {"fail_at": None, "needs": "recipe.prompt_text", "questions": [{"ask": "CCC {prompt}?"}]}}
    )
    takes = spark.createDataFrame([("c1", '{"recipe": {"prompt_text": "p"}}', None, "review"), ("c2", "{}", "x", "review")], "clip string, json string, parent string, verdict string").withColumn("doc", F.parse_json("json"))
    context = judge.needs_context(rules, takes)
    rows = screening.asks(takes, rules, questions, context, samples=3)
    times = spark.createDataFrame([("c1", [0.5, 1.0]), ("c2", [])], "clip string, times array<double>")
    assert sorted((r["clip"], r["rule"], r["samples"]) for r in rows.collect()) == [("c1", "a", 3), ("c1", "b", 3), ("c1", "c", 3), ("c2", "a", 3), ("c2", "b", 3)]
    yes, no = '{"answers": [{"q": 1, "yes": true, "note": "n"}]}', '{"answers": []}'
    block = screening.screened(rows, times, questions, StubJudge({"AAA": yes, "BBB": "no json", "CCC p?": no}), one_frame)
    assert sorted((r["clip"], r["rule"], r["t"], r["confidence"]) for r in block.defects.collect()) == [("c1", "a", 0.5, 1.0), ("c2", "a", 0.0, 1.0)]
    assert {r["rule"] for r in block.unparsed.collect()} == {"b"} and block.uncertain.count() == 0
    assert block.usage.agg(F.sum("calls")).first()[0] == 15
    after, used, subset = screening.escalated(block, rows, times, rules, questions, StubJudge({"BBB": yes}), one_frame)
    assert sorted((r["clip"], r["rule"]) for r in after.defects.collect()) == [("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b")]
    assert after.unparsed.count() == 0 and used.agg(F.sum("calls")).first()[0] == 2 and subset.count() == 2
    assert judge.rule_kills(after.defects, rules).count() == 4
    parents = spark.createDataFrame([("c2", "b"), ("c1", "a")], "clip string, rule string")
    extra, used, subset = screening.scrutinized(takes, rows, times, parents, rules, questions, StubJudge({"BBB": no}), StubJudge({"BBB": yes}), one_frame)
    assert [(r["clip"], r["rule"]) for r in extra.defects.collect()] == [("c2", "b")] and used.first()["calls"] == 1
    with pytest.raises(Exception, match="no frame"):
        screening.screened(rows, times, questions, StubJudge({}), lambda path, at: [])


def test_review_predicates(spark):
    takes = spark.createDataFrame([("a", "i1", "kill", False), ("b", "i2", "review", True), ("c", "i3", None, False)], "clip string, take_id string, verdict string, judged boolean")
    assert [r["clip"] for r in screening.pending_judgement(takes).collect()] == ["c"]
    assert sorted(r["clip"] for r in screening.pending_judgement(takes, True).collect()) == ["b", "c"]
    clips = spark.createDataFrame([("a", "i1"), ("b", "new"), ("c", "i3")], "clip string, take_id string")
    assert sorted(r["clip"] for r in screening.needs_review(clips, takes).collect()) == ["b", "c"]


def test_rerank_touches_only_changed_shots(spark):
    t = spark.createDataFrame([("a", "s", "review", 3, 0, 1), ("b", "s", "review", 1, 0, 2), ("c", "u", "review", 9, 0, 7)], "clip string, shot string, verdict string, severity_sum long, n_findings long, rank_in_shot int")
    t = t.withColumns({"flicker": F.lit(0.0), "smoothness": F.lit(0.0)})
    got = rank.rerank(t, t.where("clip = 'b'")).collect()
    assert {r["clip"]: r["rank_in_shot"] for r in got} == {"a": 2, "b": 1}


def test_settled_table(spark):
    before = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 10.0)], "clip string, size long, mtime double")
    now = spark.createDataFrame([("a", 1, 10.0), ("b", 2, 11.0), ("c", 1, 1.0)], "clip string, size long, mtime double")
    assert [r["clip"] for r in ledger.settled(before, now, 5, 20.0).collect()] == ["a"]


def test_patched_documents():
    doc = {"x": 1, "output": {"file": "a", "y": 2}, "review": {"verdict": "kill", "mine": 3, "mechanical": {"probe": {}, "kill_reasons": ["z"]}}}
    got = sinks.patched(doc, {"set": {"shot": "s"}, "output": {"fps": 8.0}, "review": {"verdict": "review"}, "reasons": []})
    assert got == {"x": 1, "shot": "s", "output": {"file": "a", "y": 2, "fps": 8.0}, "review": {"verdict": "review", "mine": 3, "mechanical": {"probe": {}, "kill_reasons": []}}}
    assert sinks.patched(doc, {"fresh": {"mechanical": {"a": 1}}, "review": {"verdict": "kill"}})["review"] == {"mechanical": {"a": 1}, "verdict": "kill"}
    assert sinks.patched({"review": None}, {"set": {"gold": {"label": "pass"}}}) == {"review": None, "gold": {"label": "pass"}, "output": {}}


def run(spark, *argv):
    out = io.StringIO()
    with redirect_stdout(out):
        code = cli.main([str(a) for a in argv], spark)
    return code, out.getvalue()


def test_commands(spark, batch, tmp_path):
    code, text = run(spark, "brief", batch, "--json")
    doc = json.loads(text)
    assert code == 0 and (doc["n_takes"], doc["kills"], doc["yield"]) == (4, 2, 0.5)
    a = next(s for s in doc["shots"] if s["shot"] == "shot-a")
    assert (a["n_takes"], a["kills"], a["yield"]) == (3, 2, 0.333) and a["kill_reasons"] == {"mechanical": {"black": 1}, "rule": {"hand.x": 1}}
    assert a["rules"]["hand.x"]["mean_severity"] == 3.0 and a["lineage"] == {"reruns": 2, "max_depth": 2}
    assert "shot-a: 3 takes, 2 killed" in run(spark, "brief", batch)[1]
    code, text = run(spark, "calibrate", batch, "--alpha", "0.5", "-o", tmp_path / "c.json")
    assert code == 0 and json.loads(text)["n_pass"] == 2
    assert run(spark, "calibrate", batch, "-o", tmp_path / "c.json")[0] == 1
    assert run(spark, "fit", batch, "-o", tmp_path / "c.json")[0] == 2  # three judged labels only
    assert json.loads(run(spark, "schema", "take")[1])["title"] == "take"
    assert "4 labeled takes" in run(spark, "gold", "list", batch)[1]


def test_labels_are_checked(spark):
    clips = spark.createDataFrame([("a", "sha256:00")], "clip string, take_id string")
    assert json.loads(sidecars.label_patches(clips, "pass").first()["patch"])["set"]["gold"]["label"] == "pass"
    with pytest.raises(ValueError):
        sidecars.label_patches(clips, "maybe")
    assert labels.valid_gold(spark.createDataFrame([("a", "x"), ("b", "pass")], "clip string, label string")).count() == 1
