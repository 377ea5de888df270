"""Column functions for paths, labels, reasons and judge replies."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .kernels import exact_round, fixed

# fixed values: clip extensions, compared in lower case
VIDEO_EXTS = (".mp4", ".mov", ".webm", ".mkv", ".avi")
# fixed values: how a kill reason of a rule, and a calibrated one, begins
RULE_KILL = r"^(\S+) severity \d+ at "
CALIBRATED = "calibrated kill score"

NOTE_CHARS = 300


def null_if_blank(x: Column) -> Column:
    return F.when(x != "", x)


def plain_path(path: Column) -> Column:
    """A local file's path without its scheme, which listings write differently."""
    return F.regexp_replace(path, "^file:(//)?", "")


def is_video(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(*VIDEO_EXTS)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    """Name of the folder that holds ``path``; null at the top."""
    return null_if_blank(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1))


def sidecar_path(clip: Column) -> Column:
    return F.concat(clip, F.lit(".take.json"))


def file_name(output_file: Column, clip: Column) -> Column:
    return F.coalesce(null_if_blank(output_file), basename(clip))


def shot_for(shot: Column, path: Column, override: str | None = None) -> Column:
    """A shot already set stays; then the override, then the folder's name."""
    return F.coalesce(null_if_blank(shot), null_if_blank(F.lit(override or "")), parent_dir(path))


def short_id(take_id: Column) -> Column:
    return F.coalesce(F.substring(F.regexp_replace(null_if_blank(take_id), r"^[^:]*:", ""), 1, 8), F.lit("unhashed"))


def time_label(t: Column, t_end: Column | None = None) -> Column:
    """``1.0s`` or ``1.0-2.5s``; a zero or missing end is no end."""
    at = t.cast("string")
    if t_end is None:
        return F.concat(at, F.lit("s"))
    return F.when(F.coalesce(t_end, F.lit(0.0)) != 0, F.concat(at, F.lit("-"), t_end.cast("string"), F.lit("s"))).otherwise(
        F.concat(at, F.lit("s"))
    )


def tenths(x: Column) -> Column:
    return fixed(x, 1)


def rule_reason(rule: Column, severity: Column, t: Column, t_end: Column, note: Column) -> Column:
    return F.concat(rule, F.lit(" severity "), severity.cast("string"), F.lit(" at "), time_label(t, t_end), F.lit(": "), note)


def kill_side(reason: Column) -> Column:
    ruled = (F.regexp_extract(reason, RULE_KILL, 1) != "") | reason.startswith(CALIBRATED)
    return F.when(ruled, "rule").otherwise("mechanical")


def kill_class(reason: Column) -> Column:
    rule = F.regexp_extract(reason, RULE_KILL, 1)
    word = F.regexp_extract(reason, r"^\s*(\S+)", 1)
    return (
        F.when(rule != "", rule)
        .when(reason.startswith(CALIBRATED), "calibrated")
        .otherwise(F.rtrim(F.when(word == "", "unknown").otherwise(word), F.lit(":")))
    )


def family(rule: Column) -> Column:
    return F.substring_index(rule, ".", 1)


def slate(shot: Column, take_id: Column, verdict: Column, rule: Column) -> Column:
    return F.concat_ws(
        "  ",
        F.coalesce(null_if_blank(shot), F.lit("untagged")),
        short_id(take_id),
        F.coalesce(null_if_blank(verdict), F.lit("unreviewed")),
        F.when(verdict == "review", rule),
    )


def display_label(verdict: Column, n_defects: Column) -> Column:
    return F.when(verdict == "kill", "kill").when(n_defects > 0, "needs review").otherwise("passed")


def untold(reasons: Column, rules: Column) -> Column:
    """The reasons that no defect of these rules tells."""
    return F.filter(reasons, lambda x: ~F.exists(rules, lambda r: x.startswith(r)))


def slug(shot: Column) -> Column:
    s = F.regexp_replace(F.lower(shot), "[^a-z0-9]+", "-")
    return F.coalesce(null_if_blank(F.regexp_replace(s, "^-+|-+$", "")), F.lit("shot"))


def timecode(seconds: Column, fps: Column) -> Column:
    """HH:MM:SS:FF at the frame rate."""
    frames, rate = F.rint(seconds * fps).cast("long"), F.rint(fps).cast("long")
    s = F.floor(frames / rate).cast("long")
    return F.format_string("%02d:%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60, frames % rate)


def drawtext_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\':,\[\];=])", r"\\$1")


def usd(v: Column) -> Column:
    return F.concat(F.lit("$"), F.when(v >= 0.1, fixed(v, 2)).otherwise(fixed(v, 3)))


def frame_rate(ratio: Column) -> Column:
    """``30000/1001`` as frames a second, 3 decimals; null if undefined."""
    part = lambda i: F.try_element_at(F.split(ratio, "/"), F.lit(i))
    return exact_round(F.try_divide(part(1).try_cast("double"), F.coalesce(part(2).try_cast("double"), F.lit(1.0))), 3)


def size_wh(text: Column) -> Column:
    """``1280x720`` as a struct; null where it isn't one."""
    side = lambda i: F.regexp_extract(text, r"^(\d+)x(\d+)$", i).try_cast("int")
    return F.when(text.rlike(r"^\d+x\d+$"), F.struct(side(1).alias("width"), side(2).alias("height")))


def want_pair(text: Column) -> Column:
    """``SHOT=K`` split at the last ``=``; null unless K is a whole number above 0."""
    k = F.regexp_extract(text, r"^(.+)=(\d+)$", 2).try_cast("int")
    return F.when(k >= 1, F.struct(F.regexp_extract(text, r"^(.+)=(\d+)$", 1).alias("shot"), k.alias("k")))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def lavfi_escape(path: Column) -> Column:
    return F.regexp_replace(path, r"([\\':,\[\];])", r"\\$1")


def utc_stamp(ts: Column | None = None) -> Column:
    return F.date_format(ts if ts is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def numbered(asks: Column) -> Column:
    """The numbered question lines of a judge's message."""
    return F.array_join(F.transform(asks, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q)), "\n")


def submit_id_ok(text: Column) -> Column:
    """One line, white space around it left out of account."""
    line = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    return F.coalesce(line.rlike(r"\A[^\n]+\z"), F.lit(False))


def poll_state(text: Column) -> Column:
    """The state a driver's status line tells, or null if the line breaks the contract."""
    doc = F.try_parse_json(text)
    state = F.try_variant_get(doc, "$.state", "string")
    output = F.try_variant_get(doc, "$.output", "string")
    ok = state.isin("queued", "running", "done", "error") & ((state != "done") | (F.coalesce(output, F.lit("")) != ""))
    return F.when(ok, state)


def _reply(text: Column, key: str) -> Column:
    """The elements of the list ``key`` of the outermost object in a reply.

    What stands between the first and the last brace must be one whole
    document: as the first of a list's elements, it leaves the second its place.
    """
    doc = F.try_parse_json(F.concat(F.lit("["), F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(", 7]")))
    whole = F.try_variant_get(doc, "$[1]", "int") == 7
    return F.when(whole, F.try_variant_get(doc, f"$[0].{key}", "array<variant>"))


def _field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _whole(v: Column, name: str) -> Column:
    """A field as a whole number: a number cut off, a text of digits, true as 1."""
    raw = F.to_json(F.try_variant_get(v, f"$.{name}", "variant"))
    digits = F.regexp_extract(raw, r'^"\s*([+-]?[0-9]+)\s*"$', 1).try_cast("int")
    number = raw.try_cast("double")
    return F.when(raw == "true", 1).when(raw == "false", 0).otherwise(F.coalesce(digits, F.when(F.abs(number) < 2**31, number.cast("int"))))


def _seconds(v: Column, name: str) -> Column:
    raw = F.to_json(F.try_variant_get(v, f"$.{name}", "variant"))
    return exact_round(F.when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(_field(v, name, "double")), 3)


def _said(v: Column, name: str) -> Column:
    """A field as text; '' when it's missing."""
    raw = F.to_json(F.try_variant_get(v, f"$.{name}", "variant"))
    word = F.when(raw == "null", "None").when(raw == "true", "True").when(raw == "false", "False")
    return F.coalesce(word, _field(v, name, "string"), raw, F.lit(""))


def parse_answers(text: Column) -> Column:
    """array<struct<q,yes,t,note>> of a checklist reply; null if unparsable.

    ``q`` must be a whole number; ``yes`` may be a boolean or such a word;
    ``t`` may be missing.
    """

    def one(v: Column) -> Column:
        return F.struct(
            _whole(v, "q").alias("q"),
            F.lower(F.trim(_said(v, "yes"))).isin("yes", "true", "1").alias("yes"),
            _seconds(v, "t").alias("t"),
            F.substring(_said(v, "note"), 1, NOTE_CHARS).alias("note"),
        )

    return F.filter(F.transform(_reply(text, "answers"), one), lambda a: a["q"].isNotNull())


def clamp_severity(x: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), x))


def parse_defects(text: Column) -> Column:
    """array<struct<t,severity,note>> of a defect reply; null if unparsable."""

    def one(v: Column) -> Column:
        severity = _whole(v, "severity")
        return F.struct(
            _seconds(v, "t").alias("t"),
            clamp_severity(severity).alias("severity"),
            severity.isNotNull().alias("ok"),
            F.substring(_said(v, "note"), 1, NOTE_CHARS).alias("note"),
        )

    made = F.filter(F.transform(_reply(text, "defects"), one), lambda d: d["ok"] & d["t"].isNotNull())
    return F.transform(made, lambda d: F.struct(d["t"].alias("t"), d["severity"].alias("severity"), d["note"].alias("note")))
