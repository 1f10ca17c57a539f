"""Filters: a request's values become predicates, predicates become one Column.

A predicate never accepts a null. Empty values (None, empty text, empty list) are no
filter; False and 0 are. Fields beyond the registry are an error.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("float", "integer", "keyword", "boolean", "circular")


@dataclass(frozen=True)
class Predicate:
    field: str
    kind: str  # "equals" or "range"
    value: Any = None
    low: float | None = None
    high: float | None = None
    wrap: bool = False


def _bounds(value: Any) -> tuple[Any, Any, bool]:
    if isinstance(value, Mapping):
        return value.get("min"), value.get("max"), bool(value.get("wrap"))
    if isinstance(value, (tuple, list)):
        if len(value) != 2:
            raise ValueError("a range has two bounds")
        return value[0], value[1], False
    return value, value, False


def predicates(registry: Mapping[str, str], *requests: Mapping[str, Any]) -> list[Predicate]:
    """Predicates for requests (a later one wins) over fields of the registry, which
    gives the kind of each. Circular bounds lie in [0, 360); a range whose low bound is
    above its high one runs through 0."""
    merged: dict[str, Any] = {}
    for request in requests:
        merged |= request or {}
    out = []
    for field, value in merged.items():
        if value is None or (isinstance(value, (str, list, tuple, Mapping)) and not value):
            continue
        if field not in registry:
            raise ValueError(f"{field} can't be filtered")
        kind = registry[field]
        if kind not in KINDS:
            raise ValueError(f"{kind} is no kind of field")
        if kind in ("keyword", "boolean"):
            out.append(Predicate(field, "equals", value))
            continue
        low, high, wrap = _bounds(value)
        if low is None and high is None:
            continue
        if kind == "circular":
            for b in (low, high):
                if b is not None and not 0 <= b < 360:
                    raise ValueError("bounds of an angle lie in [0, 360)")
            wrap = low is not None and high is not None and (wrap or low > high)
        elif low is not None and high is not None and low > high:
            raise ValueError(f"the range of {field} is empty")
        out.append(Predicate(field, "range", None, low, high, wrap and kind == "circular"))
    return out


def condition(found: list[Predicate], columns: Mapping[str, Column] | None = None) -> Column:
    """All predicates together; fields may map to other columns or expressions."""

    def one(p: Predicate) -> Column:
        c = (columns or {}).get(p.field, F.col(p.field))
        if p.kind == "equals":
            return c.isin(*p.value) if isinstance(p.value, (list, tuple, set)) else c == F.lit(p.value)
        parts = [c >= p.low] if p.low is not None else []
        parts += [c <= p.high] if p.high is not None else []
        if p.wrap:
            return (c >= p.low) | (c <= p.high)
        return reduce(Column.__and__, parts)

    return reduce(Column.__and__, map(one, found), F.lit(True))


def apply(df: DataFrame, registry: Mapping[str, str], *requests: Mapping[str, Any], columns: Mapping[str, Column] | None = None) -> DataFrame:
    found = predicates(registry, *requests)
    return df.where(condition(found, columns)) if found else df


def correct(df: DataFrame, found: list[Predicate], columns: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: whether every row satisfies all predicates (true for no rows)."""
    return df.agg(F.coalesce(F.bool_and(F.coalesce(condition(found, columns), F.lit(False))), F.lit(True)).alias("filter_correct"))


def within_cap(df: DataFrame, cap: int) -> DataFrame:
    """``df``, or an error if it has more than ``cap`` rows (counted no further)."""
    if df.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} candidates")
    return df


def records_match(df: DataFrame, rules: list[tuple[str, str, Any]]) -> DataFrame:
    """Rows that satisfy all (field, operator, value) rules."""
    operators = {">=": Column.__ge__, "<=": Column.__le__, ">": Column.__gt__, "<": Column.__lt__, "=": Column.__eq__}
    for field, operator, value in rules:
        if operator not in operators:
            raise ValueError(f"{operator} is no operator")
        df = df.where(operators[operator](F.col(field), F.lit(value)))
    return df
