"""Dataset manifests: what a dataset's files hold, read on the driver and turned into
column expressions. Matrices and caption lists that go with them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import truthy
from .formats import register

# Fixed values.
SCHEMA_VERSION = 1
TYPES = ("continuous", "integer", "categorical", "boolean", "circular_deg")
ABSOLUTE_CLOCKS = ("unix_ms", "unix_s", "iso8601")
CLOCKS = (*ABSOLUTE_CLOCKS, "relative_s")
ANCHORS = ("container_creation_time", "filename", "manifest_csv")
PARTIAL = ("drop_partial", "pad_last")
STRATEGIES = ("filename_stem", "manifest_csv")
CANONICAL = (
    "event_category", "split", "video_id", "latitude", "longitude", "altitude_m", "velocity_mps", "roll", "pitch", "yaw",
    "yaw_rate", "gimbal_pitch", "gimbal_heading", "compass_heading", "person_count", "vehicle_count", "bus_count", "is_night",
)
HEADINGS = ("yaw", "gimbal_heading", "compass_heading")
#: What a canonical field must say of itself.
TOLD = {"altitude_m": ("reference", ("AGL", "MSL", "WGS84")), "velocity_mps": ("kind", ("ground_speed", "air_speed"))}
#: How values of a type meet between samples and in a window, and the filter they take.
BETWEEN = {"circular_deg": "circular", "categorical": "locf"}
WITHIN = {"circular_deg": "circular_mean", "categorical": "mode"}
KINDS = dict(zip(TYPES, ("float", "integer", "keyword", "boolean", "circular"), strict=True))


@dataclass(frozen=True)
class Field:
    name: str
    source: str
    type: str = "continuous"
    scale: float = 1.0
    offset: float = 0.0
    unit: str | None = None
    interpolation: str = "linear"
    aggregation: str = "median"

    def value(self) -> Column:
        """The field from the text of its source column: empty or unreadable is null; an
        integer is cut toward zero; an angle lies in [0, 360)."""
        text = F.nullif(F.trim(F.col("`" + self.source.replace("`", "``") + "`").cast("string")), F.lit(""))
        if self.type == "categorical":
            return text.alias(self.name)
        if self.type == "boolean":
            return truthy(text).alias(self.name)
        number = text.try_cast("double") * self.scale + self.offset
        number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
        if self.type == "integer":
            # a cast of a double cuts its fraction off
            return number.cast("long").alias(self.name)
        return (F.pmod(number, F.lit(360.0)) if self.type == "circular_deg" else number).alias(self.name)


@dataclass(frozen=True)
class Manifest:
    dataset: str
    display_name: str
    videos_glob: str
    video_id_from: str
    pairing: str
    telemetry_glob: str | None
    telemetry_id_from: str
    pairs_csv: str | None
    clock: str
    anchor: str | None
    anchor_regex: str | None
    anchor_format: str | None
    timezone: str
    offset_s: float
    max_gap_s: float
    size_s: float
    stride_s: float
    frames: int
    partial: str
    timestamp: str
    fields: tuple[Field, ...] = ()
    extra: tuple[Field, ...] = ()
    media: bool = True
    fail_on_video_error: bool = True
    hash: str = ""

    @property
    def absolute(self) -> bool:
        return self.clock in ABSOLUTE_CLOCKS

    def project(self, rows: DataFrame) -> DataFrame:
        """stamp and all fields of telemetry rows, canonical ones first."""
        return rows.select(F.col("`" + self.timestamp.replace("`", "``") + "`").alias("stamp"), *(f.value() for f in (*self.fields, *self.extra)))

    def registry(self) -> dict[str, str]:
        """The kind of filter that each field takes."""
        return {f.name: KINDS[f.type] for f in (*self.fields, *self.extra)}

    def columns(self) -> dict[str, str]:
        """For each field the column of its file; one column may serve several."""
        return {f.name: f.source for f in (*self.fields, *self.extra)}


class ManifestError(ValueError):
    """All that is wrong with a manifest, a line each."""

    def __init__(self, faults: list[str]):
        super().__init__("\n".join(faults))
        self.faults = faults


class _Told:
    """Values of a manifest by their path, and what is wrong with them."""

    def __init__(self, values: Any):
        self.values, self.faults = values, []

    def get(self, path: str, kind: type = str, default: Any = None, among: tuple = (), need: bool = False) -> Any:
        at = self.values
        for part in path.split("."):
            at = at.get(part) if isinstance(at, Mapping) else None
        if at is None or at == "":
            if need:
                self.faults.append(f"{path} is missing")
            return default
        try:
            at = at if kind is dict and isinstance(at, Mapping) else kind(at)
        except (TypeError, ValueError):
            self.faults.append(f"{path} is no {kind.__name__}: {at!r}")
            return default
        if among and at not in among:
            self.faults.append(f"{path} is none of {', '.join(among)}: {at!r}")
        return at

    def relative(self, path: str, need: bool = False) -> str | None:
        value = self.get(path, need=need)
        if value is not None and (re.match(r"[A-Za-z]:[/\\]|[/\\]", value) or ".." in re.split(r"[/\\]", value)):
            self.faults.append(f"{path} leaves the data's root: {value!r}")
        return value

    def check(self, right: bool, fault: str) -> None:
        if not right:
            self.faults.append(fault)


def _field(told: _Told, group: str, name: str) -> Field:
    at = f"telemetry.{group}.{name}"
    type_ = told.get(f"{at}.type", default="continuous", among=TYPES)
    for key, fixed, usual in (("interpolation", BETWEEN, "linear"), ("aggregation", WITHIN, "median")):
        own = told.get(f"{at}.{key}")
        told.check(own is None or type_ not in fixed or own == fixed[type_], f"{at}.{key} of type {type_} can't be {own}")
    if group == "fields":
        told.check(name in CANONICAL, f"{at}: such a field belongs under telemetry.extra")
        told.check(name not in HEADINGS or type_ == "circular_deg", f"{at} is a heading: its type is circular_deg")
        if name in TOLD:
            told.get(f"{at}.{TOLD[name][0]}", among=TOLD[name][1], need=True)
    between = BETWEEN.get(type_) or told.get(f"{at}.interpolation", default="linear")
    within = WITHIN.get(type_) or told.get(f"{at}.aggregation", default="median")
    return Field(name, told.get(f"{at}.source", need=True) or "", type_, told.get(f"{at}.scale", float, 1.0), told.get(f"{at}.offset", float, 0.0), told.get(f"{at}.unit"), between, within)


def parsed(values: Any, text: str = "") -> Manifest:
    """A manifest from its values; an error tells all that is missing, of no known kind or
    against another value."""
    told = _Told(values)
    told.check(told.get("schema_version", int, 0) == SCHEMA_VERSION, f"schema_version is not {SCHEMA_VERSION}")
    dataset = told.get("dataset_id", need=True) or ""
    told.check(bool(re.fullmatch(r"[a-zA-Z0-9][a-zA-Z0-9_.-]*", dataset)), f"dataset_id is no name: {dataset!r}")
    clock = told.get("time_alignment.telemetry_clock", among=CLOCKS, need=True)
    anchor = told.get("time_alignment.video_start_time_from")
    told.check(clock not in ABSOLUTE_CLOCKS or anchor in ANCHORS, f"a clock {clock} needs time_alignment.video_start_time_from")
    size, stride, frames = told.get("window.size_s", float, 0.0), told.get("window.stride_s", float, 0.0), told.get("window.frames_per_item", int, 0)
    told.check(min(size, stride, frames) > 0, "window needs size_s, stride_s and frames_per_item above 0")
    gap = told.get("time_alignment.max_gap_s", float, 1.0)
    told.check(gap > 0, "time_alignment.max_gap_s is not above 0")
    strategy = told.get("pairing.strategy", default="filename_stem", among=STRATEGIES)
    pairs = told.relative("pairing.manifest_csv", need=strategy == "manifest_csv")
    fields, extra = (tuple(_field(told, g, n) for n in told.get(f"telemetry.{g}", dict, {})) for g in ("fields", "extra"))
    made = Manifest(
        dataset,
        told.get("display_name", default=dataset),
        told.relative("source.videos_glob", need=True) or "",
        told.get("source.video_id_from", default="filename_stem"),
        strategy,
        told.relative("pairing.telemetry_glob"),
        told.get("pairing.telemetry_id_from", default="filename_stem"),
        pairs,
        clock or "",
        anchor,
        told.get("time_alignment.filename_time_regex"),
        told.get("time_alignment.filename_time_format"),
        told.get("time_alignment.timezone", default="UTC"),
        told.get("time_alignment.offset_s", float, 0.0),
        gap,
        size,
        stride,
        frames,
        told.get("window.partial_window_policy", default="drop_partial", among=PARTIAL),
        told.get("telemetry.timestamp_column", default="timestamp"),
        fields,
        extra,
        told.get("media.enabled", bool, True),
        told.get("policy.fail_on_video_error", bool, True),
        hashlib.sha256(text.encode()).hexdigest() if text else "",
    )
    if told.faults:
        raise ManifestError(told.faults)
    return made


def load(spark: SparkSession, path: str) -> Manifest:
    """The manifest of a YAML file, from any store that Spark reads."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    return parsed(yaml.safe_load(text), text)


def caption_pairs(spark: SparkSession, path: str) -> DataFrame:
    """video_id and caption of a JSON list of {video_id or video, caption}, a pair each."""
    rows = spark.read.schema("video_id string, video string, caption string").json(path, multiLine=True)
    return rows.select(F.coalesce("video_id", "video").alias("video_id"), "caption").where("video_id is not null")


def matrix_rows(spark: SparkSession, path: str) -> DataFrame:
    """position and vector of each row of two-dimensional .npy files (the source ``matrix``);
    of several files, numbered apart, with the file."""
    register(spark)
    return spark.read.format("matrix").option("path", path).load()


def matrix_with_ids(spark: SparkSession, path: str, ids: DataFrame, position: str = "position") -> DataFrame:
    """The rows of the matrix with the row of ``ids`` at the same position; an error where
    their numbers differ."""
    rows = matrix_rows(spark, path).select("position", "vector")
    n, m = ids.count(), rows.count()
    if n != m:
        raise ValueError(f"{m} vectors, {n} ids")
    return ids.join(rows, ids[position] == rows["position"]).drop(rows["position"])
