"""Checks and repairs of tables: units, one-to-one merges, differences, rankings, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metadata import duplicates


def unit_repair(rows: DataFrame, by: str, col: str, limit: float, divisor: float) -> DataFrame:
    """Values of a group in which one exceeds ``limit`` are in the smaller unit: all are
    divided. The groups' maxima are aggregated before they meet the rows."""
    most = rows.groupBy(F.col(by).alias("_by")).agg((F.max(col) > limit).alias("_small"))
    joined = rows.join(most, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.withColumn(col, F.when(F.col("_small"), F.col(col) / divisor).otherwise(F.col(col))).drop("_by", "_small")


def one_to_one(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """A left join of tables in which each key occurs once at most, or an error."""
    for name, side in (("left", left), ("right", right)):
        if n := duplicates(side, key).first()[0]:
            raise ValueError(f"{n} keys of the {name} table occur more than once")
    return left.join(right, key, "left")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """only_left and only_right: rows, with their number of repeats, that the other table
    lacks. Both are counted in one aggregation; nulls equal each other."""
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    net = both.groupBy(*left.columns).agg(F.sum("_n").alias("_n"))
    over = lambda sign: F.coalesce(F.sum(F.greatest(F.lit(0).cast("long"), F.col("_n") * sign)), F.lit(0))
    return net.agg(over(1).alias("only_left"), over(-1).alias("only_right"))


def compared(a: DataFrame, b: DataFrame, by: str, id_col: str, score: str = "dist") -> DataFrame:
    """Two rankings position by position, per query: n, how many positions hold the same
    row, and the largest difference of scores."""
    left = a.select(by, "rank", F.col(id_col).alias("_a"), F.col(score).alias("_s"))
    right = b.select(by, "rank", F.col(id_col).alias("_b"), F.col(score).alias("_t"))
    met = left.join(right, [by, "rank"], "full")
    return met.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("_a") == F.col("_b")).alias("same"), F.max(F.abs(F.col("_s") - F.col("_t"))).alias("largest"))


def count_stats(rows: DataFrame, by: list[str], count: str, present: float = 1) -> DataFrame:
    """Per group of frames: median, greatest and 90th percentile of a count, and the share
    of frames with ``present`` at least. Nulls don't count; without values, null."""
    return rows.groupBy(*by).agg(F.median(count).alias("median"), F.max(count).alias("most"), F.percentile(count, F.lit(0.9)).alias("p90"), F.avg((F.col(count) >= present).cast("double")).alias("persistence"))


def frame_sums(counts: Column) -> Column:
    """Sums over the classes of a map class -> counts by frame; shorter arrays count as 0
    beyond their end."""
    values = F.map_values(counts)
    n = F.coalesce(F.array_max(F.transform(values, F.size)), F.lit(0))
    frames = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(frames, lambda i: F.aggregate(values, F.lit(0.0), lambda s, v: s + F.coalesce(F.get(v, i).cast("double"), F.lit(0.0))))


def worst(rows: DataFrame, metric: str, key: str, n: int) -> DataFrame:
    """The n rows of the least metric; ties go to the smaller key."""
    return rows.where(F.col(metric).isNotNull()).orderBy(metric, key).limit(n)
