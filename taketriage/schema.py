"""Published shape of a take: a typed core with an open tail.

The core is typed columns; the whole document stays beside it as a variant, so
that keys nobody knows survive a rewrite.
"""

from __future__ import annotations

import json

from pyspark.sql import types as T

SPAN = "struct<start:double,end:double>"
DEFECT = "struct<t:double,t_end:double,rule:string,severity:int,confidence:double,note:string>"
COUNTS = "struct<calls:long,prompt_tokens:long,completion_tokens:long>"
USAGE = f"struct<calls:long,prompt_tokens:long,completion_tokens:long,rules:map<string,{COUNTS}>>"
JUDGE = f"""struct<engine:string,samples:int,defects:array<{DEFECT}>,skipped:array<string>,unparsed:array<string>,
 uncertain:array<string>,escalated:array<string>,strong_engine:string,usage:{USAGE},strong_usage:{USAGE},root_prompt:boolean,scrutinized:array<string>>"""
PROBE = "struct<duration:double,fps:double,width:long,height:long,frames:long,errors:array<string>>"
MECHANICAL = f"""struct<probe:{PROBE},black_frames:array<{SPAN}>,freeze:array<{SPAN}>,scene_cuts:array<double>,flicker_score:double,
 motion_smoothness:double,candidate_frames:array<double>,kill_reasons:array<string>>"""
REVIEW = f"""struct<mechanical:{MECHANICAL},vlm:{JUDGE},scrutiny:{JUDGE},audit:struct<rate:double>,verdict:string,rank_in_shot:int,
 cost:struct<vlm_usd:double,clip_usd:double,total_usd:double,unpriced_models:array<string>>>"""
RECIPE = "struct<seeds:map<string,long>,models:array<struct<file:string,sha256:string>>,loras:array<struct<file:string,strength:double>>,prompt_text:string>"
TAKE = f"""take_id string, shot string, parent string, created string,
 output struct<file:string,fps:double,frames:long,width:long,height:long>, recipe {RECIPE}, review {REVIEW},
 gold struct<label:string,labeled:string>, regen struct<driver:string,job:string,submitted:string>"""

VERDICTS, LABELS = ("keep", "kill", "review"), ("pass", "kill")
JOB_STATES, SHOT_STATES = ("queued", "running", "done", "error"), ("active", "complete", "blocked", "doomed")


def take_type() -> T.StructType:
    return T._parse_datatype_string(TAKE.replace("\n", " "))


def _json_schema(t: T.DataType) -> dict:
    """JSON Schema of a type; objects admit unknown keys and null everywhere."""
    if isinstance(t, T.StructType):
        return {"type": ["object", "null"], "properties": {f.name: _json_schema(f.dataType) for f in t.fields}, "additionalProperties": True}
    if isinstance(t, T.ArrayType):
        return {"type": ["array", "null"], "items": _json_schema(t.elementType)}
    if isinstance(t, T.MapType):
        return {"type": ["object", "null"], "additionalProperties": _json_schema(t.valueType)}
    names = {T.StringType: "string", T.BooleanType: "boolean", T.LongType: "integer", T.IntegerType: "integer", T.DoubleType: "number"}
    return {"type": [names[type(t)], "null"]}


_CALIBRATION = "alpha double, lambda double, n_pass long, n_kill long, kill_recall double, needed long, created string, weights map<string,double>, bias double, n_fit long, fit_accuracy double"
_HISTORY = "runs array<struct<engine:string,samples:int,n:long,missing_clips:long,agreement:double,kappa:double,false_kills:long,missed_kills:long,created:string>>"


def published(name: str) -> str:
    """The JSON Schema text of ``take``, ``calibration`` or ``judge-history``."""
    text = {"take": TAKE.replace("\n", " "), "calibration": _CALIBRATION, "judge-history": _HISTORY}[name]
    out = {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": name} | _json_schema(T._parse_datatype_string(text))
    out["type"] = "object"
    if name == "take":
        out["required"] = ["output"]
        props = out["properties"]
        props["output"] = props["output"] | {"type": "object", "required": ["file"]}
        props["take_id"]["pattern"] = "^[a-z0-9_-]+:[0-9a-f]+$"
    return json.dumps(out, indent=2)
