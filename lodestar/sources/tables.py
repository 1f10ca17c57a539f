"""Tables as sources and sinks: read-only SQL by name, partitions that replace themselves."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Statements that a read-only query may not hold.
_FORBIDDEN = ("insert", "update", "delete", "drop", "truncate", "alter", "create", "rename", "optimize", "kill")
#: Others that write.
_MORE = ("merge", "grant", "revoke")
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def read_only(text: str) -> str:
    """The text of one SELECT or WITH statement, or an error. Words within quotes and
    comments don't count."""
    bare = _QUOTED.sub(" ", text).strip().rstrip(";")
    words = re.findall(r"\w+", bare.lower())
    if not words or words[0] not in ("select", "with") or ";" in bare or set(words) & {*_FORBIDDEN, *_MORE}:
        raise ValueError("one SELECT or WITH statement is allowed")
    return text.strip().rstrip(";")


def query(spark: SparkSession, text: str, tables: Mapping[str, DataFrame], **values) -> DataFrame:
    """A read-only statement in which {name} stands for a table and :name for a value."""
    return spark.sql(read_only(text), args=values or None, **tables)


def replace(rows: DataFrame, path: str, by: list[str]) -> None:
    """Writes the partitions that ``rows`` has; each replaces what it held, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
