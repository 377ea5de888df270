"""Sources: clip listings, take sidecars, labels, rubrics, prices, run files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import is_video, plain_path, utc_stamp
from ..operators.judge import DEFAULT_RULES
from ..schema import TAKE

SUFFIX = ".take.json"


def clips(paths: DataFrame, column: str = "path") -> DataFrame:
    """Distinct paths of clips, by extension in any case.  Order is left to
    the reader: a global sort is worth it only when rows are shown."""
    return paths.select(F.col(column).alias("path")).where(is_video(F.col("path"))).distinct()


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """path, size, mtime of every clip under ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(plain_path(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).where(is_video(F.col("path")))


def find_clips(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Clips of folders (recursively), globs and single paths."""
    out = None
    for p in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select(plain_path(F.col("path")).alias("path"))
        out = files if out is None else out.unionByName(files)
    return clips(out).orderBy("path")


def hashed(spark: SparkSession, root: str) -> DataFrame:
    """clip, take_id of every clip, read in pieces where it lies."""
    from .external import extract, hash_file

    files = snapshot(spark, root).select(F.col("path").alias("clip"))
    return extract(files, hash_file, "take_id")


def _texts(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*{SUFFIX}")
    path = F.regexp_replace(plain_path(F.col("_metadata.file_path")), r"\.take\.json$", "")
    return files.text(root, wholetext=True).select(path.alias("clip"), "value")


def typed(texts: DataFrame) -> DataFrame:
    """clip, the typed core, and ``doc``, the whole document as a variant."""
    core = F.from_json("value", TAKE.replace("\n", " "))
    return texts.select("clip", F.try_parse_json("value").alias("doc"), core.alias("t")).select("clip", "t.*", "doc")


def find_takes(spark: SparkSession, root: str, permissive: bool = False) -> DataFrame:
    """All sidecars under ``root``; a malformed one is an error, unless permissive."""
    texts = _texts(spark, root, True)
    if permissive:
        texts = texts.where(F.try_parse_json("value").isNotNull())
    else:
        texts = texts.withColumn("value", F.to_json(F.parse_json("value")))
    return typed(texts)


def lineage_index(spark: SparkSession, folder: str) -> DataFrame:
    """take_id -> document of one folder, not below it; junk and documents
    without an id are skipped, the last file name wins."""
    texts = _texts(spark, folder, False).where(F.try_parse_json("value").isNotNull())
    texts = texts.withColumn("take_id", F.get_json_object("value", "$.take_id")).where("take_id is not null")
    last = texts.groupBy("take_id").agg(F.max_by(F.struct("clip", "value"), "clip").alias("x"))
    return typed(last.select("x.*"))


def with_sidecars(clip_rows: DataFrame, takes: DataFrame) -> DataFrame:
    """Clips with their take, or its empty skeleton."""
    return clip_rows.join(takes, "clip", "left").withColumn(
        "output", F.coalesce("output", F.struct(F.regexp_extract("clip", "([^/]*)$", 1).alias("file"), *[F.lit(None).cast(k).alias(n) for n, k in (("fps", "double"), ("frames", "long"), ("width", "long"), ("height", "long"))]))
    )


def gold(takes: DataFrame) -> DataFrame:
    """clip, label, by clip."""
    return takes.where(F.col("gold.label").isin("pass", "kill")).select("clip", F.col("gold.label").alias("label")).orderBy("clip")


def label_patches(clip_rows: DataFrame, label: str) -> DataFrame:
    """(clip, patch): what a person's label changes in sidecars (sinks.patch_sidecars).

    clip_rows: clip, take_id of its contents, which a sidecar without one gets.
    """
    if label not in ("pass", "kill"):
        raise ValueError(f"label must be pass or kill, not {label!r}")
    gold = F.struct(F.lit(label).alias("label"), utc_stamp().alias("labeled")).alias("gold")
    return clip_rows.select("clip", F.to_json(F.struct(F.struct("take_id", gold).alias("set"))).alias("patch"))


def shot_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, value of a shot list's lines."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.split("value", "\n")).alias("pos", "value"))


#: Names, severities and thresholds are fixed values (judge.DEFAULT_RULES).
_ASKS = {
    "anatomy.hands": ("Does a hand have fewer or more than five fingers, or fingers that melt together?", "Does a hand bend, turn or hold in a way no hand can?"),
    "anatomy.faces": ("Is a face misshapen: features out of place, missing or doubled?", "Do a face's features drift or change from frame to frame?"),
    "anatomy.limbs": ("Is there an arm or leg too many, or one missing that should be seen?", "Does a limb bend or stretch in a way no joint allows?"),
    "artifact.morphing": ("Does one thing turn into another without cause?", "Do surfaces boil, smear or crawl where they should be still?"),
    "physics.contact": ("Do solid things pass through each other?", "Does something hang in the air, or move, without anything that holds or moves it?"),
    "physics.motion": ("Does something move against gravity or inertia?", "Does motion jump, stall or reverse without cause?"),
    "continuity.objects": ("Does a thing appear or vanish without cause?", "Does a thing change its number, size, color or shape between frames?"),
    "environment.stability": ("Does the background warp, or change its layout, without a move of the camera?", "Do light or weather change without cause?"),
    "text.legibility": ("Is there writing that should be legible and isn't?", "Do letters change from frame to frame?", "Is a word or logo misspelled or made up?"),
    "adherence.prompt": ("Is something missing that this direction asks for? {prompt}", "Does something contradict this direction? {prompt}"),
}
DEFAULT_RUBRIC = {
    name: {"questions": [{"ask": a, "severity": s} for a, s in zip(_ASKS[name], severities, strict=True)]} | ({"fail_at": fail_at} if fail_at else {}) | ({"needs": needs} if needs else {})
    for name, (severities, fail_at, needs) in DEFAULT_RULES.items()
}


def load_rubric(path: str) -> dict[str, dict]:
    """Rules of a JSON or YAML file, with or without a ``rules`` wrapper."""
    raw = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        doc = yaml.safe_load(raw)
    else:
        doc = json.loads(raw)
    rules = doc.get("rules", doc) if isinstance(doc, dict) else None
    if not isinstance(rules, dict):
        raise ValueError(f"{path}: a map of rules is expected")
    for name, rule in rules.items():
        questions = rule.get("questions") if isinstance(rule, dict) else None
        if not isinstance(rule, dict) or not (rule.get("prompt") or questions):
            raise ValueError(f"{path}: rule {name!r} has neither a prompt nor questions")
        if any(not isinstance(q, dict) or not q.get("ask") for q in questions or []):
            raise ValueError(f"{path}: a question of rule {name!r} lacks 'ask'")
    return rules


def rubric_frames(spark: SparkSession, rules: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """(rules: rule, fail_at, needs, prompt), (questions: rule, q, severity, ask)."""
    heads = [(n, r.get("fail_at"), r.get("needs"), r.get("prompt")) for n, r in rules.items()]
    asks = [(n, i, int(q.get("severity", 3)), q["ask"]) for n, r in rules.items() for i, q in enumerate(r.get("questions") or [], 1)]
    return (
        spark.createDataFrame(heads, "rule string, fail_at int, needs string, prompt string"),
        spark.createDataFrame(asks, "rule string, q int, severity int, ask string"),
    )


def load_prices(path: str) -> dict:
    doc = json.loads(Path(path).read_text())
    models = doc.get("models") if isinstance(doc, dict) else None
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v >= 0
    if not isinstance(models, dict) or not all(isinstance(m, dict) and all(number(m.get(k)) for k in ("input", "output")) for m in models.values()):
        raise ValueError(f"{path}: models must map names to input and output prices")
    if doc.get("clip") is not None and not number(doc["clip"]):
        raise ValueError(f"{path}: clip must be a price")
    return doc


def prices_frame(spark: SparkSession, doc: dict) -> DataFrame:
    return spark.createDataFrame([(n, float(m["input"]), float(m["output"])) for n, m in doc["models"].items()], "engine string, input double, output double")


def defects(takes: DataFrame, block: str = "vlm") -> DataFrame:
    """The normalized defects of a judge block."""
    return takes.select("clip", F.posexplode(f"review.{block}.defects").alias("pos", "d")).select("clip", "pos", "d.*")


def spans(takes: DataFrame) -> DataFrame:
    m = "review.mechanical"
    tag = lambda c, kind: F.transform(F.coalesce(F.col(c), F.array()), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("s"), s["end"].alias("e")))
    return takes.select("clip", F.inline(F.concat(tag(f"{m}.black_frames", "black"), tag(f"{m}.freeze", "freeze"))))


def kill_reasons(takes: DataFrame) -> DataFrame:
    return takes.select("clip", F.explode("review.mechanical.kill_reasons").alias("reason"))


def usage(takes: DataFrame) -> DataFrame:
    """clip, engine, calls and tokens of every judge block, strong ones too."""
    def part(block: str, engine: str, used: str) -> Column:
        b = F.col(f"review.{block}")
        return F.struct(b[engine].alias("engine"), b[used]["calls"].alias("calls"), b[used]["prompt_tokens"].alias("prompt_tokens"), b[used]["completion_tokens"].alias("completion_tokens"))

    parts = [part(b, e, u) for b in ("vlm", "scrutiny") for e, u in (("engine", "usage"), ("strong_engine", "strong_usage"))]
    return takes.select("clip", F.inline(F.array(*parts))).where("calls > 0")


def flat(takes: DataFrame) -> DataFrame:
    """The columns that the operators take, from typed takes."""
    return takes.select(
        "clip", "take_id", F.nullif("shot", F.lit("")).alias("shot"), "parent",
        F.coalesce(F.nullif("output.file", F.lit("")), F.regexp_extract("clip", "([^/]*)$", 1)).alias("file"),
        F.col("review.verdict").alias("verdict"), F.col("review.vlm").isNotNull().alias("judged"), F.col("review.rank_in_shot").alias("rank_in_shot"),
        F.col("review.mechanical.probe.duration").alias("duration"), F.col("review.mechanical.flicker_score").alias("flicker"),
        F.col("review.mechanical.motion_smoothness").alias("smoothness"), F.size(F.coalesce("review.mechanical.scene_cuts", F.array())).alias("n_cuts"),
        F.col("review.cost.total_usd").alias("total_usd"), F.col("recipe.seeds").alias("seeds"), F.col("recipe.prompt_text").alias("prompt_text"),
        F.col("recipe.models.file").alias("models"),
        F.when(F.col("recipe.loras").isNotNull(), F.map_from_entries(F.transform(F.filter("recipe.loras", lambda x: x["file"].isNotNull()), lambda x: F.struct(x["file"], x["strength"])))).alias("loras"),
        F.col("regen").isNotNull().alias("regen"), F.col("regen.job").alias("job"), F.col("regen.submitted").alias("submitted"), F.col("regen.driver").alias("driver"),
        F.col("review.mechanical.kill_reasons").alias("reasons"), "doc",
    )
