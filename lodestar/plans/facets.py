"""What a dataset can be filtered by: fields with their kinds, values and bounds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of a field that a schema lists; a field with more tells that it has more.
VALUES = 1000


def filter_schema(rows: DataFrame, registry: Mapping[str, str], always: Sequence[str] = (), values: int = VALUES) -> DataFrame:
    """A row per field that the registry names and some row has (or that ``always``
    names): field, kind, low and high of numbers, the distinct non-null values of keywords
    and flags in order, whether there are more than ``values`` of them, and whether ranges
    may run through the end (angles).

    One pass: bounds and the first values are gathered in each task before they meet;
    values beyond the limit are counted as the table gives them, not kept."""
    known = [f for f in registry if f in rows.columns]
    numbers = [f for f in known if registry[f] not in ("keyword", "boolean")]
    words = [f for f in known if f not in numbers]
    low = F.array(*(F.struct(F.lit(f).alias("field"), F.min(f).cast("double").alias("low"), F.max(f).cast("double").alias("high")) for f in numbers)).cast("array<struct<field: string, low: double, high: double>>")
    bounds = rows.agg(low.alias("a")).select(F.explode("a").alias("e")).select("e.*").where("low is not null")
    made = bounds.select("field", "low", "high", F.lit(None).cast("array<string>").alias("values"), F.lit(False).alias("more"))
    if words:
        long = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in words))).alias("e")).select("e.*").where("value is not null")
        # distinct values first: a field's values meet once each
        each = long.distinct().withColumn("_at", F.row_number().over(Window.partitionBy("field").orderBy("value"))).where(F.col("_at") <= values + 1)
        listed = each.groupBy("field").agg(F.sort_array(F.collect_list("value")).alias("v"), F.count("*").alias("n"))
        none = F.lit(None).cast("double")
        made = made.unionByName(listed.select("field", none.alias("low"), none.alias("high"), F.slice("v", 1, values).alias("values"), (F.col("n") > values).alias("more")))
    kinds = rows.sparkSession.createDataFrame([(f, registry[f], f in always) for f in known] or [("", "", False)], "field string, kind string, always boolean").where("field <> ''")
    met = kinds.join(made, "field", "left").where("always or low is not null or size(values) > 0")
    return met.select("field", "kind", "low", "high", F.coalesce("values", F.array().cast("array<string>")).alias("values"), F.coalesce("more", F.lit(False)).alias("more"), (F.col("kind") == "circular").alias("wrap"))
