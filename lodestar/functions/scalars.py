"""Scalar expressions: angles, identifiers, time spans, statistics of normal tests."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def circular_interpolate(left, right, fraction) -> Column:
    """Between two angles in degrees along the shorter arc, in [0, 360)."""
    turn = (_c(right) - _c(left) + 180) % F.lit(360.0)
    # not pmod, which takes a remainder just below 0 for 0: half a turn the other way
    turn = F.when(turn < 0, turn + 360).otherwise(turn) - 180
    return F.pmod(_c(left) + _c(fraction) * turn + 360, F.lit(360.0))


def circular_mean(angle) -> Column:
    """Aggregate: mean direction in degrees, [0, 360); null without a direction."""
    east, north = F.avg(F.cos(F.radians(_c(angle)))), F.avg(F.sin(F.radians(_c(angle))))
    mean = F.pmod(F.degrees(F.atan2(north, east)), F.lit(360.0))
    flat = F.sqrt(east * east + north * north) < 1e-12
    return F.when(flat, None).when(mean >= 360, F.lit(0.0)).otherwise(mean)


def segment_id(dataset, video, start, end) -> Column:
    """``dataset:video:start_ms:end_ms``, milliseconds rounded half to even."""
    ms = lambda t: F.bround(_c(t) * 1000, 0).cast("long").cast("string")
    return F.concat_ws(":", _c(dataset), _c(video), ms(start), ms(end))


def uuid5(namespace: uuid.UUID, name) -> Column:
    """The version-5 UUID of a name, as text."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), _c(name).cast("binary")))
    variant = F.substring(F.conv(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)).cast("string"), 10, 16), 1, 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.lower(variant), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def clock_text(seconds) -> Column:
    """h:mm:ss of whole seconds."""
    s = F.floor(_c(seconds)).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def temporal_iou(start_a, end_a, start_b, end_b) -> Column:
    """Overlap over union of two spans; 0 if the union is empty."""
    both = F.greatest(F.lit(0.0), F.least(_c(end_a), _c(end_b)) - F.greatest(_c(start_a), _c(start_b)))
    union = (_c(end_a) - _c(start_a)) + (_c(end_b) - _c(start_b)) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def frame_support(start, end, fps, frames) -> tuple[Column, Column]:
    """1-based first and last frame of a span in seconds, clamped to the video."""
    first = F.greatest(F.lit(1), F.least(_c(frames), F.floor(_c(start) * _c(fps)).cast("int") + 1))
    last = F.greatest(first, F.least(_c(frames), F.ceil(_c(end) * _c(fps)).cast("int")))
    return first, last


def overlap_fraction(start_a, end_a, start_b, end_b) -> Column:
    return F.greatest(F.lit(0.0), F.least(_c(end_a), _c(end_b)) - F.greatest(_c(start_a), _c(start_b)))


def folded(text) -> Column:
    """NFKC and case folding: no built-in does this, so an Arrow function."""

    @F.pandas_udf("string")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield column.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    return fold(_c(text))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection on the error function."""
    import math

    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def minimum_detectable_effect(n, deviation, power: float = 0.8, alpha: float = 0.05) -> Column:
    """The least mean difference that a paired test of n pairs finds; infinite for n <= 0."""
    z = normal_quantile(1 - alpha / 2) + normal_quantile(power)
    return F.when(_c(n) > 0, F.lit(z) * _c(deviation) / F.sqrt(_c(n))).otherwise(F.lit(float("inf")))


def truthy(text) -> Column:
    """Vocabulary of boolean cells: 1, true, yes, on; empty is null."""
    t = F.lower(F.trim(_c(text)))
    return F.when(t != "", t.isin("1", "true", "yes", "on"))


def json_field(document: Column | str, path: str, kind: str, default: object = None) -> Column:
    """A field of a JSON text, cast; ``default`` where it is missing or of another kind."""
    found = F.get_json_object(F.col(document) if isinstance(document, str) else document, f"$.{path}").try_cast(kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def not_nan(value: Column) -> Column:
    """The value, null in place of NaN."""
    return F.when(~F.isnan(value), value)


def spaced_indices(n: Column, wanted: int) -> Column:
    """About ``wanted`` indices spread evenly over 0 to n - 1, both ends among them, each
    once; halves round to the even one. No rows give no index."""
    steps = max(1, wanted - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda i: F.bround(i * (n - 1) / F.lit(steps), 0).cast("long"))
    return F.when(n > 0, F.array_sort(F.array_distinct(spread))).otherwise(F.array().cast("array<bigint>"))


def anchor(name: Column, pattern: str, form: str) -> Column:
    """The time that a file's name holds: group 1 of ``pattern`` read by ``form``, in
    seconds since 1970 (UTC); null where there is none."""
    return F.unix_timestamp(F.try_to_timestamp(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), F.lit(form)))


def from_minute(minute: Column, milliseconds: Column) -> Column:
    """Seconds since 1970 of a time that is given to the minute, and milliseconds after it."""
    return F.unix_seconds(F.date_trunc("minute", minute.cast("timestamp"))) + milliseconds / F.lit(1000.0)


def category_of(text: Column, categories: list[tuple[str, str]], other: str = "other") -> Column:
    """The category of the first of (part, category) whose part stands in the text."""
    out = F.lit(other)
    for part, category in reversed(categories):
        out = F.when(F.contains(F.lower(text), F.lit(part)), F.lit(category)).otherwise(out)
    return out
