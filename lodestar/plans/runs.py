"""Versioned runs of a segment table: stage, verify, activate, collect garbage.

A table lies under ``root/name/run_id=.../``; chunks are partitions below it, written by
dynamic overwrite, so that a repeated chunk replaces itself. The active run of a dataset
is the newest row of a small pointer table, which is only appended to: readers resolve
it once and see one run throughout.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import not_nan

# Fixed values.
STATES = ("created", "preflight_passed", "ingesting", "validating", "completed", "failed", "aborted")
PROTECTED = STATES[:4]
#: States that a run may go to from each: forward by one, or to an end; a failed one again.
NEXT = {s: (STATES[i + 1], "failed", "aborted") for i, s in enumerate(STATES[:4])} | {"failed": ("ingesting", "aborted")}
#: Namespace of run ids that follow from a dataset and its content.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "lodestar/runs")
_LEDGER = "dataset string, run_id string, status string, started timestamp, finished timestamp"
_POINTER = "dataset string, run_id string, sequence long"


def run_id(dataset: str, content: str) -> str:
    return str(uuid.uuid5(NAMESPACE, f"{dataset}:{content}"))


class Runs:
    """Runs of one table under ``root`` (a folder that all executors share)."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.path = spark, root.rstrip("/"), f"{root.rstrip('/')}/{name}"

    def write_chunk(self, rows: DataFrame, dataset: str, run: str, keys: tuple[str, ...] = ("video_id", "chunk_index")) -> None:
        """Writes chunks of a run; what an earlier attempt left of these goes."""
        if run == self.active(dataset):
            raise ValueError("the active run can't be changed")
        made = rows.withColumns({"dataset": F.lit(dataset), "run_id": F.lit(run)})
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "run_id", *keys).parquet(self.path)

    def rows(self, dataset: str, run: str | None = None) -> DataFrame:
        """The rows of a run, of the active one by default."""
        run = run or self.active(dataset)
        if run is None:
            raise ValueError(f"{dataset} has no active run")
        return self.spark.read.parquet(self.path).where((F.col("dataset") == dataset) & (F.col("run_id") == run))

    def verify(self, dataset: str, run: str, expected: DataFrame, keys: tuple[str, ...] = ("video_id", "chunk_index"), unique: str | None = None) -> DataFrame:
        """Chunks whose number of rows (n in ``expected``) or unique ids are wrong."""
        own = self.rows(dataset, run)
        facts = own.groupBy(*keys).agg(F.count("*").alias("found"), (F.countDistinct(unique) if unique else F.count("*")).alias("distinct"))
        both = expected.select(*keys, "n").join(facts, list(keys), "full")
        return both.where(~(F.col("n").eqNullSafe(F.col("found")) & F.col("found").eqNullSafe(F.col("distinct"))))

    def activate(self, dataset: str, run: str, expected: DataFrame, **options) -> None:
        """Makes a verified run the active one; readers of the old run go on undisturbed."""
        if not self.verify(dataset, run, expected, **options).isEmpty():
            raise ValueError("the run is not complete")
        last = self._pointers().where(F.col("dataset") == dataset).agg(F.max("sequence")).first()[0]
        row = self.spark.createDataFrame([(dataset, run, 1 + (last or 0))], _POINTER)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/_active")

    def delete(self, dataset: str, run: str) -> int:
        """Removes a run and returns how many rows it had; the active one is refused."""
        if run == self.active(dataset):
            raise ValueError("the active run can't be deleted")
        n = self.rows(dataset, run).count()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/dataset={dataset}/run_id={run}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return n

    def replace_registry(self, dataset: str, run: str, fields: DataFrame) -> None:
        """The fields (field, kind, unit) that a run can be filtered by, in place of those
        that it had."""
        made = fields.withColumns({"dataset": F.lit(dataset), "run_id": F.lit(run)})
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "run_id").parquet(f"{self.root}/_fields")

    def registry(self, dataset: str, run: str) -> dict[str, str]:
        rows = self.spark.read.parquet(f"{self.root}/_fields").where((F.col("dataset") == dataset) & (F.col("run_id") == run))
        return {r["field"]: r["kind"] for r in rows.select("field", "kind").collect()}

    def _pointers(self) -> DataFrame:
        try:
            return self.spark.read.schema(_POINTER).parquet(f"{self.root}/_active")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], _POINTER)

    def active(self, dataset: str) -> str | None:
        row = self._pointers().where(F.col("dataset") == dataset).agg(F.max_by("run_id", "sequence")).first()
        return row[0]


def advanced(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """The ledger with the states that ``changes`` (dataset, run_id, to) ask for; a change
    that ``NEXT`` does not allow is an error when the rows are read."""
    asked = ledger.join(changes, ["dataset", "run_id"], "left")
    allowed = F.lit(False)
    for state, after in NEXT.items():
        allowed = allowed | ((F.col("status") == state) & F.col("to").isin(*after))
    wrong = F.raise_error(F.concat(F.lit("no way from "), "status", F.lit(" to "), "to")).cast("string")
    return asked.withColumn("status", F.when(F.col("to").isNull(), F.col("status")).when(allowed, F.col("to")).otherwise(wrong)).drop("to")


def from_legacy(rows: DataFrame, run: str, numbers: list[str]) -> DataFrame:
    """Rows of a table without runs as rows of ``run``: NaN in ``numbers`` becomes null."""
    return rows.withColumns({c: not_nan(F.col(c)) for c in numbers} | {"run_id": F.lit(run)})


def metadata_chunk(segments: DataFrame, run: str, dataset: str) -> dict[str, DataFrame]:
    """The four tables of a chunk, from its segments: videos, segments, their counts and
    their telemetry, each with its key once."""
    keyed = segments.withColumns({"run_id": F.lit(run), "dataset": F.lit(dataset)})
    own = lambda prefix: [c for c in segments.columns if c.startswith(prefix)]
    videos = keyed.groupBy("run_id", "dataset", "video_id").agg(F.max("t_end").alias("duration"))
    once = keyed.dropDuplicates(["segment_id"])
    return {
        "videos": videos,
        "segments": once.select("run_id", "dataset", "segment_id", "video_id", "t_start", "t_end"),
        "counts": once.select("run_id", "segment_id", *own("n_")),
        "telemetry": once.select("run_id", "segment_id", *own("tel_")),
    }


def garbage(ledger: DataFrame, now: datetime | Column, keep: int, least_hours: float) -> DataFrame:
    """Runs (dataset, run_id, status, started, finished, is_active) that may go: ended
    ones older than ``least_hours`` that are neither active nor among the ``keep`` newest
    completed runs of their dataset."""
    anchor = F.coalesce("finished", "started")
    rank = F.row_number().over(Window.partitionBy("dataset", F.col("status") == "completed", "is_active").orderBy(F.desc(anchor), "run_id"))
    kept = F.col("is_active") | ((F.col("status") == "completed") & (rank <= keep))
    limit = (F.lit(now) if isinstance(now, datetime) else now) - F.lit(timedelta(hours=least_hours))
    marked = ledger.withColumn("is_active", F.coalesce("is_active", F.lit(False))).withColumn("_kept", kept)
    return marked.where(~F.col("_kept") & F.col("status").isin("completed", "failed", "aborted") & (anchor <= limit)).drop("_kept")


def resumable(ledger: DataFrame) -> DataFrame:
    """The latest unfinished run of each dataset."""
    open_ = ledger.where(F.col("status").isin(*PROTECTED, "failed"))
    return open_.groupBy("dataset").agg(F.max_by("run_id", F.struct("started", "run_id")).alias("run_id"))


def pending(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return items.join(done, key, "left_anti")
