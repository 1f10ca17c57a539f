"""Scans of files: discovery and identity, telemetry CSV, annotations, row caches.

A scan keeps every row it can place; what it cannot is split off by ``quarantine`` with
the reason, never lost.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import found, located

_ANY = {"**/": "(?:.*/)?", "**": ".*", "*": ".*", "?": "."}


def _like(glob: str) -> str:
    """A regular expression for the glob; a star also matches a slash."""
    if glob.startswith("/") or ".." in glob.split("/"):
        raise ValueError(f"{glob!r} leaves the root")
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "(?i)^" + "".join(_ANY.get(p) or re.sub(r"([^\w/])", r"\\\1", p) for p in parts) + "$"


def listing(spark: SparkSession, root: str, glob: str = "**") -> DataFrame:
    """path, name (below ``root``), stem and bytes of the files that the glob matches
    without regard to case, empty ones too. Contents are not read. No match gives no rows."""
    below = root.rstrip("/") + "/"
    top = located(root)[1].rstrip("/") + "/"
    rows = [(below + path.removeprefix(top), path.removeprefix(top), size) for path, size in found(root)]
    stem = F.regexp_replace(F.substring_index("name", "/", -1), r"(?<=.)\.[^.]*$", "")
    made = spark.createDataFrame(rows, "path string, name string, bytes long")
    return made.select("path", "name", stem.alias("stem"), "bytes").where(F.col("name").rlike(_like(glob)))


def extensions(files: DataFrame) -> DataFrame:
    """extension (lower case, empty without one), files and bytes."""
    ext = F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def identifier(stem: Column, rule: str) -> Column:
    """``filename_stem``, or ``regex:`` and a pattern with the group ``video_id`` that the
    stem must match from its start; null where it does not."""
    if rule == "filename_stem":
        return stem
    if not rule.startswith("regex:"):
        raise ValueError(f"unknown rule {rule!r}")
    pattern = re.compile(rule.removeprefix("regex:"))
    if "video_id" not in pattern.groupindex:
        raise ValueError("the pattern has no group video_id")
    java = re.sub(r"\(\?P<\w+>", "(", pattern.pattern)
    return F.nullif(F.regexp_extract(stem, f"^(?:{java})", pattern.groupindex["video_id"]), F.lit(""))


def pairs(videos: DataFrame, telemetry: DataFrame, rule: str = "filename_stem", mapping: DataFrame | None = None) -> DataFrame:
    """video_id, video and telemetry (null without one) by equal identifiers, or by the
    rows (video, telemetry) of ``mapping``, which name files below the roots. A telemetry
    identifier that occurs twice is an error."""
    left = videos.select(identifier(F.col("stem"), rule).alias("video_id"), F.col("path").alias("video"), "name")
    right = telemetry.select(identifier(F.col("stem"), rule).alias("_id"), F.col("path").alias("telemetry"), F.col("name").alias("_name"))
    if mapping is not None:
        rows = mapping.select(F.col("video").alias("name"), F.col("telemetry").alias("_name"))
        return left.join(rows, "name", "left").join(right.drop("_id"), "_name", "left").select("video_id", "video", "telemetry")
    twice = right.where("_id is not null").groupBy("_id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"telemetry {twice[0]!r} occurs {twice[1]} times")
    return left.join(right, F.col("video_id") == F.col("_id"), "left").select("video_id", "video", "telemetry")


def telemetry_csv(spark: SparkSession, path: str, timestamp: str, fields: Mapping[str, str]) -> DataFrame:
    """file, stamp and the fields (new name -> column of the file), all text, of UTF-8
    files with a header, which a byte order mark may precede. Missing columns are an
    error; empty values are null."""
    rows = spark.read.option("header", "true").option("enforceSchema", "false").csv(path)
    missing = sorted({timestamp, *fields.values()} - set(rows.columns))
    if missing:
        raise ValueError(f"columns not in {path}: {', '.join(missing)}")
    column = lambda name: F.col("`" + name.replace("`", "``") + "`")
    return rows.select(F.col("_metadata.file_path").alias("file"), column(timestamp).alias("stamp"), *(column(c).alias(n) for n, c in fields.items()))


def quarantine(rows: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows for which all conditions hold, and the others as ``row`` (JSON) with
    ``errors``, the names of the conditions that are false or null."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))).cast("array<string>")
    bad = rows.select(F.to_json(F.struct(*rows.columns)).alias("row"), failed.alias("errors")).where(F.size("errors") > 0)
    return rows.where(F.size(failed) == 0), bad


_IMAGE = (
    "video_id string, frame_index long, date_time string, source struct<video: string, frame_no: long>, "
    "meta struct<gps_latitude: double, gps_longitude: double, altitude: double, speed: double, "
    "gimbal_pitch: double, gimbal_heading: double, compass_heading: double>"
)


def image_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frames of JSON documents {"images": [...]}: video_id and frame_index, from the
    source where the item has none, date_time and the fields of meta; and quarantined
    items without identity."""
    items = spark.read.schema(f"images array<struct<{', '.join(re.sub(r'^(\w+) ', r'\1: ', p) for p in re.split(r', (?![^<]*>)', _IMAGE))}>>").json(path, multiLine=True)
    one = items.select(F.explode("images").alias("i"))
    frames = one.select(F.coalesce("i.video_id", "i.source.video").alias("video_id"), F.coalesce("i.frame_index", "i.source.frame_no").alias("frame_index"), "i.date_time", "i.meta.*")
    return quarantine(frames, {"video_id": ~F.col("video_id").isin("", "None"), "frame_index": F.col("frame_index").isNotNull()})


def captions(spark: SparkSession, path: str, split: str, root: str = "ERA_caption") -> DataFrame:
    """key (split and name of the video), video_id, category (the name without its number)
    and captions, of a JSON document with a list of videos. Of repeated names, the last."""
    item = "struct<video_id: string, annotation: struct<English_caption: array<string>>>"
    rows = spark.read.schema(f"`{root}` array<{item}>").json(path, multiLine=True).select(F.posexplode(root).alias("at", "i"))
    last = rows.groupBy(F.col("i.video_id").alias("video_id")).agg(F.max_by("i.annotation.English_caption", "at").alias("captions"))
    return last.select(F.concat_ws("__", F.lit(split), "video_id").alias("key"), "video_id", F.regexp_replace("video_id", r"_\d+\.mp4$", "").alias("category"), "captions")


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, track, category and box centre of headerless CSV lines
    ``frame, track, x, y, width, height, score, category, ...``. Lines with fewer values
    and boxes of score 0 are left out."""
    v = F.split(F.trim("value"), ",")
    at = lambda i: v[i].cast("double")
    lines = spark.read.text(path).where(F.size(v) >= 8).where(at(6) != 0)
    return lines.select(F.col("_metadata.file_path").alias("file"), at(0).cast("long").alias("frame"), at(1).cast("long").alias("track"), at(7).cast("int").alias("category"), (at(2) + at(4) / 2).alias("cx"), (at(3) + at(5) / 2).alias("cy"))


def cached_rows(spark: SparkSession, path: str, schema: str, key: Sequence[str]) -> DataFrame:
    """Of each key, the last line that is JSON and has all of the columns. Lines count in
    the order of the file, files in the order of their last change."""
    place = [F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_path", "file_block_start")]
    lines = spark.read.text(path).select("value", *place).withColumn("line", F.monotonically_increasing_id())
    rows = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    whole = rows.where(" and ".join(f"r.`{n}` is not null" for n in names))
    order = F.struct("file_modification_time", "file_path", "file_block_start", "line")
    return whole.groupBy(*(F.col(f"r.{k}").alias(k) for k in key)).agg(F.max_by("r", order).alias("r")).select("r.*")


def append_rows(rows: DataFrame, path: str) -> None:
    """Adds rows to an NDJSON cache."""
    rows.write.mode("append").json(path)


def nulls(rows: DataFrame) -> DataFrame:
    """column, type, n and null_share (null without rows) of every column, in one pass."""
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    facts = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count("*").alias("n"), F.avg(name(c).isNull().cast("double")).alias("null_share")) for c, t in rows.dtypes]
    return rows.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def joined(features: DataFrame, vectors: DataFrame, key: Sequence[str] = ("video_id", "t_start")) -> tuple[DataFrame, DataFrame]:
    """Features that have a vector, and those that have none."""
    return features.join(vectors, list(key)), features.join(vectors, list(key), "left_anti")


def synthetic(spark: SparkSession, centres: DataFrame, n: int, noise: float = 0.05, seed: int = 1, vector_col: str = "embedding") -> DataFrame:
    """``n`` unit vectors: a centre, chosen at random among those numbered ``k`` from 0,
    plus normal noise, with a flag and a small count to filter by. Equal seeds and partitions give equal rows."""
    numbered = centres.select(F.col("k").cast("long").alias("_k"), F.col(vector_col).cast("array<double>").alias("_c"))
    total = numbered.count()
    rows = spark.range(n).withColumns({"_k": F.floor(F.rand(seed) * total).cast("long"), "flag": F.rand(seed + 1) < 0.3, "crowd": F.floor(-F.log(1 - F.rand(seed + 2)) * 2).cast("int"), "_s": F.xxhash64(F.lit(seed), "id")})
    unit = lambda i, salt: (F.pmod(F.xxhash64("_s", i, F.lit(salt)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    normal = lambda i: F.sqrt(-2 * F.log(unit(i, 1))) * F.cos(unit(i, 2) * 6.283185307179586)
    moved = rows.join(numbered, "_k").withColumn("_v", F.transform("_c", lambda c, i: c + noise * normal(i)))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return moved.withColumn("_n", norm).select("id", F.transform("_v", lambda x: x / F.col("_n")).alias(vector_col), "flag", "crowd")
