"""Tables from before runs as a run: copies of seven tables, and their chunks as
committed, made visible by one version."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import not_nan
from .snapshots import Change, Snapshots

#: The tables of a dataset before runs; vectors by their number of dimensions besides.
TABLES = ("videos", "segments", "metadata", "telemetry", "groundtruth")
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "lodestar/legacy")
HASH = "legacy-migration"


def legacy_run_id(dataset: str, content: str | None) -> str:
    """Equal for equal content: a second migration finds the first."""
    return str(uuid.uuid5(NAMESPACE, f"{dataset}:{content or 'unknown'}"))


def copies(tables: Mapping[str, DataFrame], vectors: Mapping[int, DataFrame], dataset: str, run: str, numbers: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The run's tables from those of the dataset. Metadata and telemetry have no dataset
    of their own: they follow the segments. NaN in ``numbers`` of vector rows is null.
    ``chunks`` has a row per video that has segments, with their number."""
    own = {n: tables[n].where(F.col("dataset_id") == dataset) for n in ("videos", "segments", "groundtruth")}
    run_id = F.lit(run).alias("run_id")
    of_segments = own["segments"].select("segment_id")
    follow = {n: tables[n].join(of_segments, "segment_id") for n in ("metadata", "telemetry")}
    made = {
        "run_videos": own["videos"].select(run_id, "*"),
        "run_segments": own["segments"].select(run_id, "*", F.lit(0).alias("chunk_index")),
        "run_metadata": follow["metadata"].select(run_id, "*"),
        "run_telemetry": follow["telemetry"].select(run_id, "*", F.lit("{}").alias("extra")),
        "run_groundtruth": own["groundtruth"].select(run_id, "*"),
    }
    for dim, rows in vectors.items():
        mine = rows.where(F.col("dataset_id") == dataset)
        made[f"run_vectors_{dim}"] = mine.select(run_id, F.lit(0).alias("chunk_index"), *(not_nan(F.col(c)).alias(c) if c in numbers else F.col(c) for c in mine.columns))
    counts = own["segments"].groupBy("dataset_id", "video_id").agg(F.count("segment_id").alias("expected"))
    known = own["videos"].select("dataset_id", "video_id", F.coalesce("source_uri", F.lit("")).alias("video_path"), F.coalesce("duration_s", F.lit(0.0)).alias("chunk_end_s"))
    made["chunks"] = known.join(counts, ["dataset_id", "video_id"]).select(run_id, "dataset_id", "video_id", "video_path", F.lit(0).alias("chunk_index"), F.lit(0.0).alias("chunk_start_s"), "chunk_end_s", "expected", F.lit("committed").alias("status"), F.lit(HASH).alias("chunk_hash"))
    return made


def migrate(log: Snapshots, tables: Mapping[str, DataFrame], vectors: Mapping[int, DataFrame], dataset: str, content: str | None, numbers: tuple[str, ...] = ()) -> tuple[str, dict[str, int]]:
    """Copies a dataset's tables into a run of the log, all in one version, and returns
    the run and its rows by table. A run that is there already stays as it is."""
    run = legacy_run_id(dataset, content)
    if run not in log.fact("legacy", {}):
        staged = {n: log.stage(rows, n) for n, rows in copies(tables, vectors, dataset, run, numbers).items()}
        counts = {n: log.folder(f).count() for n, f in staged.items()}

        def change(base: int) -> Change:
            known = log.fact("legacy", {}, base)
            return Change() if run in known else Change({n: [f] for n, f in staged.items()}, facts={"legacy": known | {run: counts}})

        log.update(change)
    return run, log.fact("legacy")[run]
