"""Ingest of runs in chunks, each exactly once.

A chunk is pending, writing, committed or failed; a run has the states of ``runs``. Both
are kept in the same log as the tables, so a chunk's rows, its state and the active run
change together or not at all. A writer begins chunks under a token, writes their rows
where no reader sees them, and commits: the rows are counted as written, and only chunks
that are still ``writing`` under its token are taken. So a resumed run skips what is
committed, an attempt that broke off leaves nothing to see, and of two writers of a chunk
one commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs
from .snapshots import Change, Snapshots

# Fixed values.
CHUNK_STATES = ("pending", "writing", "committed", "failed")
#: Folders of chunk states before they are rewritten as one.
FOLDERS = 24
_CHUNKS = "_chunks"


class Ledger:
    """Runs below ``root``; ``keys`` name a chunk in all tables."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str] = ("video_id", "chunk_index")):
        self.spark, self.keys, self.log = spark, list(keys), Snapshots(spark, root)

    # runs

    def run(self, run: str, version: int | None = None) -> dict[str, Any]:
        found = self.log.fact("runs", {}, version).get(run)
        if found is None:
            raise ValueError(f"there is no run {run}")
        return found

    def active(self, dataset: str, version: int | None = None) -> str | None:
        return self.log.fact("active", {}, version).get(dataset)

    def create(self, run: str, dataset: str, chunks: DataFrame) -> None:
        """A run with its chunks (keys, expected): a second call finds it made."""
        made = chunks.select(*self.keys, F.col("expected").cast("long").alias("expected")).dropDuplicates(self.keys)
        folder = self.log.stage(self._moved(made, run, "pending", None, 0), "chunks")

        def change(base: int) -> Change:
            known = self.log.fact("runs", {}, base)
            if run in known:
                return Change()
            told = {"dataset": dataset, "status": "created", "started": _now(), "finished": None}
            return Change({_CHUNKS: [folder]}, facts={"runs": known | {run: told}})

        self.log.update(change)

    def advance(self, run: str, to: str) -> None:
        """Moves a run to another state, if its state allows that."""

        def change(base: int) -> Change:
            known = self.log.fact("runs", {}, base)
            own = self.run(run, base)
            if to not in runs.NEXT.get(own["status"], ()):
                raise ValueError(f"no way from {own['status']} to {to}")
            ended = _now() if to in ("completed", "failed", "aborted") else None
            return Change(facts={"runs": known | {run: own | {"status": to, "finished": ended}}})

        self.log.update(change)

    # chunks

    def _moved(self, chunks: DataFrame, run: str, status: str, token: str | None, sequence: int) -> DataFrame:
        return chunks.select(F.lit(run).alias("run_id"), *self.keys, "expected", F.lit(status).alias("status"), F.lit(token).cast("string").alias("token"), F.lit(sequence).cast("long").alias("sequence"))

    def chunks(self, run: str, version: int | None = None) -> DataFrame:
        """Each chunk of a run with its state: keys, expected, status, token."""
        told = self.log.read(_CHUNKS, version)
        if told is None:
            raise ValueError(f"there is no run {run}")
        last = F.max_by(F.struct("expected", "status", "token"), "sequence").alias("s")
        return told.where(F.col("run_id") == run).groupBy(*self.keys).agg(last).select(*self.keys, "s.*")

    def _told(self, base: int, moved: DataFrame) -> Change:
        """The change that adds chunk states; many folders of them become one."""
        name = self.log.stage(moved, "chunks")
        folders = self.log.state(base)["tables"].get(_CHUNKS, [])
        if len(folders) < FOLDERS:
            return Change({_CHUNKS: [name]})
        last = F.max_by(F.struct("expected", "status", "token", "sequence"), "sequence").alias("s")
        whole = self.log.read(_CHUNKS, base).groupBy("run_id", *self.keys).agg(last).select("run_id", *self.keys, "s.*")
        return Change({_CHUNKS: [self.log.stage(whole, "chunks"), name]}, {_CHUNKS: ["*"]})

    def begin(self, run: str, some: DataFrame | None = None, take_over: bool = False) -> tuple[str, DataFrame]:
        """A token, and the chunks (keys, expected) that its holder may write: of ``some``
        (all by default) those pending or failed; with ``take_over`` also those that
        another writer, known to be gone, has begun. Committed chunks are skipped. A chunk
        of the active run can't be begun."""
        token = uuid.uuid4().hex
        free = ["pending", "failed", *(["writing"] if take_over else [])]

        def change(base: int) -> Change:
            if self.active(self.run(run, base)["dataset"], base) == run:
                raise ValueError("the active run can't be changed")
            open_ = self.chunks(run, base).where(F.col("status").isin(*free))
            if some is not None:
                open_ = open_.join(some.select(*self.keys).distinct(), self.keys, "left_semi")
            return self._told(base, self._moved(open_, run, "writing", token, base + 1))

        version = self.log.update(change)
        return token, self._held(run, token, version).select(*self.keys, "expected")

    def _held(self, run: str, token: str, version: int) -> DataFrame:
        return self.chunks(run, version).where((F.col("status") == "writing") & (F.col("token") == token))

    def commit(self, run: str, token: str, tables: Mapping[str, DataFrame], counted: Sequence[str] | None = None) -> dict[str, int]:
        """Commits the token's chunks: {"committed": n, "failed": n}. Each table of
        ``counted`` (all by default) must hold ``expected`` rows of a chunk, else the chunk
        is failed and none of its rows can be read. Rows of other chunks are left out, and
        chunks whose token has changed hands meanwhile."""
        staged = {name: self.log.stage(self._scoped(rows, run), name) for name, rows in tables.items()}
        needed = list(tables if counted is None else counted)
        told: dict[str, int] = {}

        def change(base: int) -> Change:
            held = self._held(run, token, base)
            checked = held.select(*self.keys, "expected")
            for name in needed:
                found = self.log.folder(staged[name]).groupBy(*self.keys).agg(F.count("*").alias(f"_{name}"))
                checked = checked.join(found, self.keys, "left")
            right = F.lit(True)
            for name in needed:
                right = right & (F.coalesce(f"_{name}", F.lit(0)) == F.col("expected"))
            moved = checked.select(*self.keys, "expected", F.when(right, "committed").otherwise("failed").alias("status"))
            moved = moved.select(F.lit(run).alias("run_id"), *self.keys, "expected", "status", F.lit(token).alias("token"), F.lit(base + 1).cast("long").alias("sequence"))
            states = self._told(base, moved)
            good = self.log.folder(states.add[_CHUNKS][-1]).where("status = 'committed'").select(*self.keys)
            n = self.log.folder(states.add[_CHUNKS][-1]).groupBy("status").count().collect()
            told.clear()
            told.update({"committed": 0, "failed": 0} | {r.status: r["count"] for r in n})
            add = {}
            for name, folder in staged.items():
                own = self.log.folder(folder)
                # rows of chunks that failed or went to another writer are written away from the rest
                strange = not own.select(*self.keys).distinct().join(good, self.keys, "left_anti").isEmpty()
                add[name] = [self.log.stage(own.join(good, self.keys, "left_semi"), name) if strange else folder]
            return Change(states.add | (add if told["committed"] else {}), states.drop)

        self.log.update(change)
        return told

    def _scoped(self, rows: DataFrame, run: str) -> DataFrame:
        return rows.withColumn("run_id", F.lit(run))

    # readers

    def rows(self, table: str, dataset: str | None = None, run: str | None = None, version: int | None = None) -> DataFrame:
        """The committed rows of a run, of the dataset's active one by default; all of one
        version, which is resolved here."""
        version = self.log.version() if version is None else version
        run = run if run is not None else self.active(dataset, version)
        if run is None:
            raise ValueError(f"{dataset} has no active run")
        found = self.log.read(table, version)
        if found is None:
            raise ValueError(f"there is no table {table}")
        return found.where(F.col("run_id") == run)

    def finalize(self, run: str, tables: Sequence[str], unique: Mapping[str, str] | None = None) -> dict[str, Any]:
        """Checks a run as a whole and makes it the active one: all chunks committed, each
        table as many rows as expected, no value of a ``unique`` column (table: column)
        twice. Otherwise it is failed, and what was active stays. State, end and pointer
        change in one version."""
        self.advance(run, "validating")
        errors: dict[str, Any] = {}
        facts = self.chunks(run).agg(F.count_if(F.col("status") != "committed").alias("open"), F.coalesce(F.sum("expected"), F.lit(0)).alias("expected")).first()
        if facts.open:
            errors["incomplete_chunks"] = facts.open
        for name in tables:
            found = self.log.read(name)
            n = 0 if found is None else found.where(F.col("run_id") == run).count()
            if n != facts.expected:
                errors[name] = {"expected": facts.expected, "actual": n}
        for name, column in (unique or {}).items():
            found = self.log.read(name)
            twice = 0 if found is None else found.where(F.col("run_id") == run).groupBy(column).count().where("count > 1").count()
            if twice:
                errors[f"duplicates in {name}"] = twice
        if errors:
            self.advance(run, "failed")
            return {"status": "failed", "active_changed": False, "errors": errors}

        def change(base: int) -> Change:
            known, own = self.log.fact("runs", {}, base), self.run(run, base)
            if own["status"] != "validating":
                raise ValueError(f"no way from {own['status']} to completed")
            return Change(facts={"runs": known | {run: own | {"status": "completed", "finished": _now()}}, "active": self.log.fact("active", {}, base) | {own["dataset"]: run}})

        self.log.update(change)
        return {"status": "completed", "active_changed": True, "errors": {}}


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()
