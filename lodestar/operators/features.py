"""Features of windows and groups, profiles with their flags, contracts, positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..sources.folders import written
from . import blocks, series


def window_features(frames: DataFrame, keys: Sequence[str], counts: Sequence[str], brightness: str, motion: str, night_below: float = 60.0) -> DataFrame:
    """Per window the median of each count (cut to a whole number), mean brightness,
    whether it is dark, and mean motion."""
    medians = [F.median(c).cast("int").alias(c) for c in counts]
    light = F.avg(brightness)
    return frames.groupBy(*keys).agg(*medians, light.alias("brightness"), (light < night_below).alias("is_night"), F.avg(motion).alias("motion"))


def motion_features(rows: DataFrame, key: str, order: str, linear: Sequence[str], turning: str, cell: float | None = None) -> DataFrame:
    """Per key the median length of the linear parts and the 95th percentile of absolute
    steps of ``turning``. ``cell`` is the span of ``order`` that one task sorts."""
    speed = F.sqrt(sum((F.col(c) * F.col(c) for c in linear), F.lit(0.0)))
    cell = series.needed(rows, key, cell)
    own = series.previous(series.cut(rows, key, order, cell), turning, [order], "_before", cell)
    made = own.select(key, speed.alias("_speed"), F.abs(F.col(turning) - F.col("_before")).alias("_step"))
    return made.groupBy(key).agg(F.median("_speed").alias("speed"), F.percentile("_step", 0.95).alias("turn_p95"))


def class_counts(boxes: Column, classes: Mapping[str, Sequence]) -> list[Column]:
    """How many of the classes in the array stand for each name."""
    among = lambda members: lambda x: x.isin(*members)
    return [F.size(F.filter(boxes, among(members))).alias(name) for name, members in classes.items()]


def frame_stats(rows: DataFrame, keys: Sequence[str], frame: str, counted: Mapping[str, Column], flags: Mapping[str, Column]) -> DataFrame:
    """Per group the mean number of rows of each kind over the frames that have any, whether
    any row has each flag, and the last frame."""
    per_frame = rows.groupBy(*keys, frame).agg(*(F.count_if(c).alias(n) for n, c in counted.items()), *(F.bool_or(c).alias(n) for n, c in flags.items()))
    means = [F.coalesce(F.avg(F.when(F.col(n) > 0, F.col(n))), F.lit(0.0)).alias(n) for n in counted]
    return per_frame.groupBy(*keys).agg(*means, *(F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in flags), F.max(frame).alias("frames"))


def spread(rows: DataFrame, keys: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Range of the values of a group, and whether it exceeds the threshold."""
    return rows.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("spread")).withColumn("wide", F.col("spread") > threshold)


def count_contract(rows: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Groups whose number of rows is not that of ``expected`` (key, n): found and n, null
    where one side lacks the group."""
    found = rows.groupBy(key).agg(F.count("*").alias("found"))
    return found.join(expected.select(key, "n"), key, "full").where(~F.col("found").eqNullSafe(F.col("n")))


def fullest(rows: DataFrame, member: str, keys: Sequence[str] = ()) -> DataFrame:
    """Of each group the member with the most rows; ties go to the smaller one."""
    counts = rows.groupBy(*keys, member).agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), member)).alias("_b"))
    return best.select(*keys, F.col(f"_b.{member}").alias(member), (-F.col("_b.n")).alias("n"))


def distribution(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Every label of a group with its number and share, and whether it is the most common
    one (ties: the smaller label)."""
    counts = rows.groupBy(key, label).agg(F.count("*").alias("n"))
    own = Window.partitionBy(key)
    first = F.row_number().over(own.orderBy(F.desc("n"), label)) == 1
    return counts.select(key, label, "n", (F.col("n") / F.sum("n").over(own)).alias("share"), first.alias("most_common"))


def flags(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that hold, as an array; a null is no."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))).cast("array<string>")


def differing(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows that only one of two inventories has, with the side."""
    sides = [a.exceptAll(b).withColumn("side", F.lit(n)) for n, a, b in (("found", found, manifest.select(found.columns)), ("manifest", manifest.select(found.columns), found))]
    return sides[0].union(sides[1])


def positions(rows: DataFrame, key: str | Sequence[str], out: str = "position") -> DataFrame:
    """Rows, with all their columns, and their place from 0 in the order of ``key`` (one
    column or several; where one value is very common, name more, so that its rows can be
    dealt to several tasks). The ordered rows are written once, each with its range and its
    place there; what stands before a range is added to it, a row per range. Equal rows
    stand in any order. An empty table gives no rows."""
    order = [key] if isinstance(key, str) else list(key)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = written(ordered.withColumns({"_part": F.spark_partition_id(), "_at": place}), "positions")
    # a row per range of keys
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = made.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    return made.join(F.broadcast(starts), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def units(rows: DataFrame, key: str, order: Sequence[str], unit: str, cell: float | None = None) -> DataFrame:
    """Runs of consecutive rows with the same ``unit``: key, unit, number of the run from
    1, rows, first and last of the first order column, whose span of ``cell`` one task
    sorts. Rows that ``order`` leaves equal stand by unit."""
    cell = series.needed(rows, key, cell)
    told = series.cut(rows.withColumn("_unit", F.struct(F.col(unit).alias("u"))), key, order[0], cell)
    known = series.previous(told, "_unit", list(order), "_before", cell)
    begun = known.withColumn("_new", (~F.col("_unit").eqNullSafe(F.col("_before"))).cast("long"))
    numbered = series.counted(begun, "_new", [*order, "_unit"], "run", cell)
    return numbered.groupBy(key, unit, "run").agg(F.count("*").alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def overlap_check(a: DataFrame, b: DataFrame, key: str, time_a: str, time_b: str) -> DataFrame:
    """Per key the common part of both time ranges, and whether there is any."""
    ra = a.groupBy(key).agg(F.min(time_a).alias("_a0"), F.max(time_a).alias("_a1"))
    rb = b.groupBy(key).agg(F.min(time_b).alias("_b0"), F.max(time_b).alias("_b1"))
    both = F.greatest(F.lit(0.0), F.least("_a1", "_b1") - F.greatest("_a0", "_b0"))
    return ra.join(rb, key).select(key, both.alias("common"), ((F.col("_a1") >= F.col("_b0")) & (F.col("_b1") >= F.col("_a0"))).alias("overlaps"))


def grid(rows: DataFrame, axes: Sequence[str], name: Column, out: str = "setting") -> DataFrame:
    """All combinations of the values that each column of ``axes`` has, nulls left out; of
    those with the same name, one. Settings are few: each axis is one array."""
    made = rows.agg(*(F.collect_set(a).alias(a) for a in axes))
    for axis in axes:
        made = made.withColumn(axis, F.explode(axis))
    return made.withColumn(out, name).dropDuplicates([out])


def best_first(rows: DataFrame, score: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``n`` rows with the highest score, those without one last."""
    return rows.orderBy(F.desc_nulls_last(score), *ties).limit(n)


def preferred_first(rows: DataFrame, name: str, preferred: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` names: preferred ones in their order, then the others sorted."""
    names = rows.select(name).distinct()
    place = F.array_position(F.array(*map(F.lit, preferred)), F.col(name))
    return names.orderBy(F.when(place > 0, place).otherwise(len(preferred) + 1), name).limit(n)


def vector_rows(rows: DataFrame, counts: Sequence[str], booleans: Sequence[str]) -> DataFrame:
    """Rows as a vector table takes them: counts without a value are 0, flags 0 or 1."""
    made = {c: F.coalesce(c, F.lit(0)) for c in counts} | {b: F.coalesce(F.col(b).cast("int"), F.lit(0)) for b in booleans}
    return rows.withColumns(made)


def aligned(pairs: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    """For each row the row whose ``right`` vector is nearest its ``left`` one (cosine; the
    first of equal ones), the cosine of its own pair, and whether it is its own nearest.
    Blocks of both sides meet as matrices, and only what may be a row's nearest leaves a task;
    vectors that are empty or hold NaN or an infinity meet all others one by one. Null
    vectors, and those with a null component, are nobody's nearest unless nothing else is."""
    a, b = pairs.select(F.col(id_col).alias("_a"), left), pairs.select(F.col(id_col).alias("_b"), right)
    whole = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull()), F.lit(False))
    finite = lambda c: (F.size(c) > 0) & F.forall(c, lambda x: F.abs(x) < float("inf"))
    plain, odd = (lambda c: whole(c) & finite(c)), (lambda c: whole(c) & ~finite(c))
    found = blocks.nearest(b.where(plain(right)), a.where(plain(left)).select(F.col("_a").alias("query_id"), F.col(left).alias("query")), 1, id_col="_b", vector_col=right)
    own = F.lit(None).cast("double").alias("own")
    # odd vectors are few
    met = [a.crossJoin(F.broadcast(b.where(odd(right)))), F.broadcast(a.where(odd(left))).crossJoin(b)]
    every = found.select(F.col("query_id").alias("_a"), (1 - F.col("dist")).alias("_c"), "_b", own)
    for m in met:
        every = every.union(m.select("_a", cosine(left, right).alias("_c"), "_b", own))
    none = F.lit(None).cast("double")
    # one row: the smallest id is the nearest where no cosine is known
    every = every.union(a.crossJoin(F.broadcast(b.agg(F.min("_b").alias("_b")))).select("_a", none, "_b", own))
    every = every.union(pairs.select(F.col(id_col), none, F.lit(None).cast(pairs.schema[id_col].dataType), cosine(left, right)))
    best = every.groupBy("_a").agg(F.max(F.struct("_c", (-F.col("_b")).alias("_b"))).alias("m"), F.max("own").alias("own"))
    return best.select(F.col("_a").alias(id_col), (-F.col("m._b")).alias("nearest"), "own", (-F.col("m._b") == F.col("_a")).alias("aligned"))
