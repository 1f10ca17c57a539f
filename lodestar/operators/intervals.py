"""Interval operators: merging, flags to intervals, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import temporal_iou
from . import series


def merged(rows: DataFrame, key: str, gap: float, score: Column | None = None, least: float | None = None, cell: float | None = None) -> DataFrame:
    """Islands of (t_start, t_end) per key: a row joins while it begins at most ``gap``
    after the furthest end so far. Output: key, t_start, t_end, score (the best), n.
    With ``cell``, tasks order spans of that length apart where a series is long."""
    rows = rows.withColumn("_score", F.lit(None).cast("double") if score is None else score)
    if least is not None:
        rows = rows.where(F.col("_score") >= least)
    order, cell = ["t_start", "t_end", "_score"], series.needed(rows, key, cell)
    rows = series.furthest(series.cut(rows, key, "t_start", cell), "t_end", order, "_reach", cell)
    rows = rows.withColumn("_new", F.coalesce((F.col("t_start") - F.col("_reach") > gap).cast("int"), F.lit(1)))
    islands = series.counted(rows, "_new", order, "_island", cell)
    return islands.groupBy(key, "_island").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.max("_score").alias("score"), F.count("*").alias("n")).drop("_island")


def flagged(frames: DataFrame, key: str, frame_col: str, fps: float, gap_s: float = 2.0, least_s: float = 1.0, cell: float | None = None) -> DataFrame:
    """Intervals of the frames in which something holds (``frames`` lists these only): a
    gap of more than int(gap_s * fps) frames ends one; an interval ends a frame after its
    last one; shorter ones than ``least_s`` go. ``cell``: frames that a task orders."""
    cell = series.needed(frames, key, cell)
    rows = series.cut(frames.select(key, frame_col).distinct(), key, frame_col, cell)
    rows = series.previous(rows, frame_col, [], "_before", cell)
    rows = rows.withColumn("_new", F.coalesce((F.col(frame_col) - F.col("_before") > int(gap_s * fps) + 1).cast("int"), F.lit(1)))
    islands = series.counted(rows, "_new", [frame_col], "_island", cell)
    made = islands.groupBy(key, "_island").agg((F.min(frame_col) / fps).alias("t_start"), ((F.max(frame_col) + 1) / fps).alias("t_end"))
    return made.where(F.col("t_end") - F.col("t_start") >= least_s).drop("_island")


def _celled(rows: DataFrame, cell: float, start: str, end: str) -> DataFrame:
    return rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / cell).cast("long"), F.floor(F.col(end) / cell).cast("long"))))


def overlaps(a: DataFrame, b: DataFrame, key: str, cell: float, least: float = 0.0, names: tuple[str, str, str, str] = ("a_start", "a_end", "b_start", "b_end")) -> DataFrame:
    """Pairs of rows of one key whose spans overlap by ``least`` at least (by more than
    nothing, if 0): an equi-join on key and time cells; a pair counts in the first cell
    that both touch, so it comes once."""
    sa, ea, sb, eb = names
    pairs = _celled(a, cell, sa, ea).join(_celled(b, cell, sb, eb), [key, "_cell"])
    first = F.floor(F.greatest(sa, sb) / cell).cast("long")
    both = F.least(ea, eb) - F.greatest(sa, sb)
    return pairs.where((F.col("_cell") == first) & ((both >= least) if least > 0 else (both > 0))).withColumn("overlap", both).drop("_cell")


def intersections(a: DataFrame, b: DataFrame, key: str, cell: float, least: float = 1.0) -> DataFrame:
    """The common spans of two interval sets: key, t_start, t_end."""
    left = a.select(key, F.col("t_start").alias("a_start"), F.col("t_end").alias("a_end"))
    right = b.select(key, F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    return overlaps(left, right, key, cell, least).select(key, F.greatest("a_start", "b_start").alias("t_start"), F.least("a_end", "b_end").alias("t_end"))


def best_windows(spans: DataFrame, windows: DataFrame, key: str, id_col: str, cell: float, score_col: str = "score") -> DataFrame:
    """For each span (t_start, t_end) the best of the windows that overlap it: its id and
    score; ties go to the smaller id."""
    left = spans.select(key, F.col("t_start").alias("a_start"), F.col("t_end").alias("a_end"))
    right = windows.select(key, F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"), id_col, F.col(score_col).alias("_score"))
    met = overlaps(left, right, key, cell)
    best = met.groupBy(key, "a_start", "a_end").agg(F.min(F.struct((-F.col("_score")).alias("s"), F.col(id_col).alias("i"))).alias("m"))
    return best.select(key, F.col("a_start").alias("t_start"), F.col("a_end").alias("t_end"), F.col("m.i").alias(id_col), (-F.col("m.s")).alias("score"))


def iou_pairs(found: DataFrame, truth: DataFrame, key: str, cell: float, least: float = 0.5) -> DataFrame:
    """Pairs of a found and a true span with an IoU of ``least`` at least; both carry an
    id (found_id, truth_id)."""
    left = found.select(key, "found_id", F.col("t_start").alias("a_start"), F.col("t_end").alias("a_end"))
    right = truth.select(key, "truth_id", F.col("t_start").alias("b_start"), F.col("t_end").alias("b_end"))
    met = overlaps(left, right, key, cell).withColumn("iou", temporal_iou("a_start", "a_end", "b_start", "b_end"))
    return met.where(F.col("iou") >= least).select(key, "found_id", "truth_id", "iou")


def displacement(tracks: DataFrame, key: list[str], frame_col: str, step: int, least: float, most: float = float("inf")) -> DataFrame:
    """Frames in which a track has moved between ``least`` and ``most`` since ``step``
    frames before: an equi-join of the track with itself, so that gaps find nothing."""
    now = tracks.select(*key, F.col(frame_col).alias("_f"), F.col("cx").alias("x1"), F.col("cy").alias("y1"))
    old = tracks.select(*key, (F.col(frame_col) + step).alias("_f"), F.col("cx").alias("x0"), F.col("cy").alias("y0"))
    moved = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    return now.join(old, [*key, "_f"]).withColumn("moved", moved).where(F.col("moved").between(least, most)).select(*key, F.col("_f").alias(frame_col), "moved")
