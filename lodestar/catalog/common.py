"""What the query modules share: tables, rounding, samples on a timeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to six places; never a negative zero."""
    rounded = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def collect(queries: dict, oracles: dict, sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        queries[f.__name__] = f
        if sql is not None:
            oracles[f.__name__] = sql
        return f

    return add


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples: seconds since the first of January 2024, an angle, a flag."""
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(1e6)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", seconds.alias("time_s"), (F.col("value") * 10 % 360).alias("angle"), F.col("event_type").isin("click", "purchase").alias("flag"), F.floor("value").cast("int").alias("whole"))


#: The same in SQL.
SAMPLES = "ev AS (SELECT event_id, user_id, event_type, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6 AS time_s, value * 10 % 360 AS angle, event_type IN ('click', 'purchase') AS flag, CAST(floor(value) AS INTEGER) AS whole FROM events)"


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("user_id").agg(F.max("time_s").alias("duration"))


DURATIONS = "dur AS (SELECT user_id, max(time_s) AS duration FROM ev GROUP BY user_id)"
SIZE, STRIDE, GAP = 86400.0, 43200.0, 43200.0
WINDOWS = f"w AS (SELECT user_id, i * {STRIDE} AS t_start, least(i * {STRIDE} + {SIZE}, duration) AS t_end FROM (SELECT user_id, duration, unnest(range(0, CAST(ceil(duration / {STRIDE}) AS BIGINT))) AS i FROM dur WHERE duration > 0))"
