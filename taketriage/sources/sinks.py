"""Sinks: event lines, envelopes, cut lists, sidecar export, run files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.lineage import LINEAGE_CAP
from ..plans.session import importable

SUFFIX = ".take.json"

CUT_COLUMNS = ("n", "record_in", "record_out", "tc_in", "shot", "rank", "verdict", "take_id", "file")


def event_lines(takes: DataFrame, reasons: DataFrame) -> DataFrame:
    """``line``: one JSON object for each reviewed take."""
    why = reasons.groupBy("clip").agg(F.array_sort(F.collect_list("reason")).alias("kill_reasons"))
    rank = [F.col("rank_in_shot")] if "rank_in_shot" in takes.columns else []
    df = takes.join(why, "clip", "left").withColumn("kill_reasons", F.coalesce("kill_reasons", F.array().cast("array<string>")))
    return df.select(F.to_json(F.struct(F.col("file").alias("clip"), "shot", "verdict", *rank, "kill_reasons")).alias("line"))


def summary_line(takes: DataFrame) -> DataFrame:
    """The line that ends a run; it has no clip."""
    return takes.agg(F.count("verdict").alias("reviewed"), F.count_if(F.col("verdict") == "kill").alias("killed")).select(F.to_json(F.struct("reviewed", "killed")).alias("line"))


def write_cut_csv(cut: DataFrame, path: str) -> None:
    """One CSV file with a header, as edit software wants it; the cut is small."""
    df = cut.withColumns({c: F.lit(None).cast("string") for c in CUT_COLUMNS if c not in cut.columns})
    df.select(*CUT_COLUMNS).coalesce(1).sortWithinPartitions("n").write.mode("overwrite").option("header", True).csv(path)


def envelope(kind: str, rows: DataFrame, **counts: int) -> str:
    """The JSON envelope of a command: its counts and its rows."""
    return json.dumps(counts | {kind: [json.loads(r) for r in rows.toJSON().toLocalIterator()]}, indent=2)


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def load_sidecar(clip: str) -> dict:
    """A clip's sidecar, or the empty skeleton of one."""
    path = Path(local(clip) + SUFFIX)
    if path.exists():
        return json.loads(path.read_text())
    return dict.fromkeys(("take_id", "shot", "parent", "created")) | {"output": {"file": path.name.removesuffix(SUFFIX)}, "recipe": None, "review": None}


def change_sidecar(clip: str, change: Callable[[dict], dict]) -> str:
    """Rewrites a sidecar by rename; keys that ``change`` leaves alone stay."""
    return save_json(change(load_sidecar(clip)), local(clip) + SUFFIX)


def _each(rows: DataFrame, save: Callable[[str, str], object], column: str) -> int:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for clip, text in zip(pdf["clip"], pdf[column], strict=True):
                save(clip, text)
            yield pd.DataFrame({"n": [len(pdf)]})

    importable(rows.sparkSession)
    return int(rows.select("clip", column).mapInPandas(run, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0)


def export_sidecars(docs: DataFrame) -> int:
    """Writes (clip, json) rows as sidecars, each by rename; returns how many.

    Unknown keys are kept, as ``json`` is the whole document.
    """
    return _each(docs, lambda clip, text: save_json(json.loads(text), local(clip) + SUFFIX), "json")


def patched(doc: dict, patch: dict) -> dict:
    """A sidecar with the patch's blocks: ``set`` at the top, ``output`` and
    ``review`` key by key (or a ``fresh`` review), ``reasons`` of the kill."""
    out = doc | patch.get("set", {}) | {"output": (doc.get("output") or {}) | patch.get("output", {})}
    review = (patch.get("fresh") or doc.get("review") or {}) | patch.get("review", {})
    if "reasons" in patch:
        review["mechanical"] = (review.get("mechanical") or {}) | {"kill_reasons": patch["reasons"]}
    return out | {"review": review or None}


def patch_sidecars(patches: DataFrame) -> int:
    """Changes the sidecars of (clip, patch) rows where they lie."""
    return _each(patches, lambda clip, text: change_sidecar(clip, lambda doc: patched(doc, json.loads(text))), "patch")


def save_json(doc: dict, path: str) -> str:
    tmp = Path(path + ".tmp")
    tmp.write_text(json.dumps(doc, indent=2) + "\n")
    tmp.replace(path)
    return path


def load_json(path: str, default: dict | None = None) -> dict:
    p = Path(path)
    if not p.exists() and default is not None:
        return default
    return json.loads(p.read_text())


def fresh_ledger() -> dict:
    caps = {"lineage": LINEAGE_CAP, "attempts": None, "spend_usd": None}
    return {"version": 1, "created": now(), "updated": None, "want_default": 1, "want": {}, "caps": caps, "attempts": 0, "spend_usd": 0.0, "shots": {}, "jobs": {}}


def load_ledger(path: str) -> dict:
    """A run's state, or a fresh one's."""
    return load_json(path, fresh_ledger())


def save_ledger(doc: dict, path: str) -> str:
    return save_json(doc | {"updated": now()}, path)


def append_history(path: str, record: dict) -> dict | None:
    """Adds a judge-check run; returns the one before."""
    history = load_json(path, {"runs": []})
    previous = history["runs"][-1] if history["runs"] else None
    history["runs"].append(record)
    save_json(history, path)
    return previous
