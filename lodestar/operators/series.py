"""Running values along series of any length.

A series is cut into cells of time, which tasks order apart; one row per cell then carries
a total, a maximum or a last value across the cuts. Without a cell length, a series is one
cell. Null keys are a series of their own; null times stand before all others, NaN after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows that one task orders: series of fewer need no cells.
LONG = 1_000_000
#: The series of a row, never null itself, and its cell.
SERIES, CELL = "_series", "_cell"


def needed(rows: DataFrame, key: str, cell: float | None) -> float | None:
    """``cell`` if some series has more than ``LONG`` rows, else None: cells cost joins
    with what they carry, which only long series are worth. Counts are summed in each task
    before they meet."""
    if cell is None:
        return None
    longest = rows.groupBy(key).count().agg(F.max("count")).first()[0]
    return cell if (longest or 0) > LONG else None


def cut(rows: DataFrame, key: str, time: str, cell: float | None) -> DataFrame:
    """``rows`` with their series and cell."""
    at = F.lit(0).cast("long")
    if cell is not None:
        t = F.col(time).cast("double")
        at = F.when(F.isnan(t), F.lit(2**63 - 1)).otherwise(F.coalesce(F.floor(t / cell), F.lit(-(2**63))))
    return rows.withColumns({SERIES: F.struct(key), CELL: at})


def inside(*order: str | Column) -> WindowSpec:
    """The rows of one cell, in order."""
    return Window.partitionBy(SERIES, CELL).orderBy(*order)


def carried(rows: DataFrame, own: Column, name: str, over: Callable) -> DataFrame:
    """``rows`` with ``over`` the values ``own`` of all cells before theirs; null in the
    first cell of a series."""
    before = Window.partitionBy(SERIES).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(SERIES, CELL).agg(own.alias("_own"))
    return rows.join(cells.select(SERIES, CELL, over("_own").over(before).alias(name)), [SERIES, CELL])


def furthest(rows: DataFrame, value: str, order: list[str], name: str, cell: float | None) -> DataFrame:
    """The greatest ``value`` of all rows before."""
    if cell is not None:
        rows = carried(rows, F.max(value), "_edge", F.max)
    here = F.max(value).over(inside(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(name, here) if cell is None else rows.withColumn(name, F.greatest(here, "_edge")).drop("_edge")


def previous(rows: DataFrame, value: str, order: list[str], name: str, cell: float | None) -> DataFrame:
    """``value`` of the row before; rows that ``order`` leaves equal stand by it."""
    spec = inside(*order, value)
    here = F.lag(value).over(spec)
    if cell is None:
        return rows.withColumn(name, here)
    last = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v")))["v"]
    rows = carried(rows, last, "_edge", F.last)
    return rows.withColumn(name, F.when(F.row_number().over(spec) == 1, F.col("_edge")).otherwise(here)).drop("_edge")


def counted(rows: DataFrame, flag: str, order: list[str | Column], name: str, cell: float | None) -> DataFrame:
    """The sum of ``flag`` up to and with the row."""
    rows = rows.withColumn(name, F.sum(flag).over(inside(*order).rowsBetween(Window.unboundedPreceding, 0)))
    if cell is None:
        return rows
    return carried(rows, F.sum(flag), "_edge", F.sum).withColumn(name, F.col(name) + F.coalesce("_edge", F.lit(0))).drop("_edge")
