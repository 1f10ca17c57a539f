"""Samples of long series across batches, chunks and restarts.

The last sample of a series lies in the state store; a sample that comes before it is an
error. Results go to a table of a snapshot log: the batch's rows are written to a new
folder and then committed with the attempt and number of the batch, so a batch that comes
again replaces itself, and an attempt from a new checkpoint replaces what others left.
Neither the sizes of batches nor where an attempt broke off change the rows.

Series are dealt to groups by hash. A call of Python serves the rows that a batch brings of
a group, and the state of a group holds its series, so calls don't grow with the series.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, DataType, DoubleType, IntegralType, LongType, StringType, StructField, StructType

from ..plans.snapshots import Change, Snapshots

#: Seconds that event times lie ahead of the samples' own: Spark drops what lies at or
#: before its first watermark, the begin of 1970.
_AHEAD = 4_000_000_000
#: Groups of series. A checkpoint holds states by group: another number needs a new one.
_GROUPS = 1024
_GROUP, _SERIES = "series_group", "series_name"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def exactly_once(stream: DataFrame, log: Snapshots, table: str, checkpoint: str) -> None:
    """Drains the stream into a table of the log, each batch once."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        # the id of the checkpoint is that of the attempt
        attempt = json.loads(Snapshots(spark, checkpoint).store.read("metadata"))["id"]
        folder = log.stage(batch, table)

        def change(base: int) -> Change:
            seen = log.fact("streams", {}, base)
            last = seen.get(table, {})
            told = {"streams": seen | {table: {"attempt": attempt, "batch": number, "folder": folder}}}
            if last.get("attempt") != attempt:
                return Change({table: [folder]}, {table: ["*"]}, told)
            if number < last["batch"]:
                return Change()
            return Change({table: [folder]}, {table: [last["folder"]] if number == last["batch"] else []}, told)

        log.update(change)

    before = spark.conf.get(_PROVIDER, None)
    # a query keeps the settings of its start
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    query.awaitTermination()


def _name(key: str, kind: DataType) -> Column:
    """A key as text, which pandas leaves as it is: integers beside nulls would be floats."""
    return F.hex(key) if isinstance(kind, BinaryType) else F.col(key).cast("string")


def _key(name: str, kind: DataType) -> Column:
    return F.unhex(name) if isinstance(kind, BinaryType) else F.col(name).cast(kind)


def _dealt(stream: DataFrame, key: str) -> DataFrame:
    """The stream with the group and the name of each row's series; null keys are a group
    of their own, -1."""
    kind, none = stream.schema[key].dataType, F.col(key).isNull()
    group = F.when(none, F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(_GROUPS)).cast("int"))
    return stream.withColumns({_GROUP: group, _SERIES: F.when(none, F.lit("")).otherwise(_name(key, kind))})


def _numbers(column: pd.Series) -> np.ndarray:
    found = column.to_numpy()
    return found if found.dtype.kind in "iuf" else found.astype("float64")


class _Batch:
    """A group's rows of a batch by series and time, null times first, equal ones by value.

    ``begins`` and ``ends`` are the first and last row of each of the ``names``."""

    def __init__(self, parts: Iterator[pd.DataFrame], columns: list[str], time: str, value: str):
        rows = pd.concat(list(parts), ignore_index=True)
        rows.columns = columns
        codes, names = pd.factorize(rows[_SERIES])
        t, v = _numbers(rows[time]), _numbers(rows[value])
        order = np.lexsort((v, ~np.isnan(v), t, ~np.isnan(t), codes))
        self.rows, self.names, self.codes = rows.iloc[order], list(names), codes[order]
        self.t, self.v = t[order].astype("float64"), v[order].astype("float64")
        self.first = np.append(True, self.codes[1:] != self.codes[:-1])
        self.begins = np.flatnonzero(self.first)
        self.ends = np.append(self.begins[1:], len(rows)) - 1

    def check(self, last: np.ndarray) -> None:
        """An error if a series' first sample is older than its ``last`` one before."""
        first = self.t[self.begins]
        for i in np.flatnonzero(~np.isnan(last) & (np.isnan(first) | (first < last)))[:1]:
            raise ValueError(f"series {self.names[i]} brings a sample at {first[i]}, older than one at {last[i]} before it")

    def before(self, of: np.ndarray, last: np.ndarray) -> np.ndarray:
        """What stands before each row in its series, which for the first is its ``last``."""
        out = np.append(np.nan, of[:-1])
        out[self.begins] = last
        return out


class _Previous(StatefulProcessor):
    def __init__(self, sent: list[str], columns: list[str], time: str, value: str):
        self.sent, self.columns, self.time, self.value = sent, columns, time, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "name string, t double, v double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = _Batch(rows, self.sent, self.time, self.value)
        state = {row[0]: row for row in self.last.get()}
        last = [state.get(name, (name, np.nan, np.nan)) for name in got.names]
        got.check(np.array([row[1] for row in last], dtype="float64"))
        previous = got.before(got.v, np.array([row[2] for row in last], dtype="float64"))
        state |= {row[0]: row for row in zip(got.names, got.t[got.ends].tolist(), got.v[got.ends].tolist(), strict=True)}
        self.last.put(list(state.values()))
        yield got.rows[self.columns].assign(previous=previous)

    def close(self) -> None:
        pass


def with_previous(stream: DataFrame, folder: str, checkpoint: str, key: str, time: str, value: str) -> DataFrame:
    """Drains samples into a table below ``folder``, each with the ``value`` of the sample
    before it in its series (``previous``), which an earlier batch may have brought.

    Samples of one time stand by value, those of an earlier batch first. A sample older
    than one that an earlier batch brought of its series is an error. Null keys are a
    series; null times come before all others. ``time`` and ``value`` are numbers."""
    fields = stream.schema.fields
    whole = {f.name for f in fields if isinstance(f.dataType, IntegralType)} - {time, value}
    sent = _dealt(stream, key).withColumns({n: F.col(n).cast("string") for n in whole})
    text = StructType([StructField(f.name, StringType() if f.name in whole else f.dataType) for f in fields])
    out = StructType([*text.fields, StructField("previous", DoubleType())])
    made = sent.groupBy(_GROUP).transformWithStateInPandas(_Previous(sent.columns, stream.columns, time, value), out, "Append", "None")
    made = made.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in fields if f.name in whole})
    log = Snapshots(stream.sparkSession, folder)
    exactly_once(made, log, "previous", checkpoint)
    found = log.read("previous")
    return stream.sparkSession.createDataFrame([], made.schema) if found is None else found


class _Windows(StatefulProcessor):
    """Windows of series that hold samples, with the values at both ends."""

    def __init__(self, sent: list[str], key: str, time: str, value: str, size: float, gap: float):
        self.sent, self.key, self.time, self.value, self.size, self.gap = sent, key, time, value, size, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "name string, t double, v double, at long, head double, open boolean, n long")

    def _between(self, edge: np.ndarray, t0: np.ndarray, v0: np.ndarray, t1: np.ndarray, v1: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            near = (edge - t0 <= self.gap) & (t1 - edge <= self.gap)
            return np.where(t1 == edge, v1, np.where(near, v0 + (v1 - v0) * (edge - t0) / (t1 - t0), np.nan))

    def _due(self, at: int) -> int:
        return math.ceil(((at + 1) * self.size + self.gap + _AHEAD) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = _Batch(rows, self.sent, self.time, self.value)
        state = {row[0]: row for row in self.last.get()}
        held = [state.get(name, (name, np.nan, np.nan, 0, np.nan, False, 0)) for name in got.names]
        t, v, at, head, open_, n = (np.array(c, dtype=d) for c, d in zip(list(zip(*held, strict=True))[1:], ("f8", "f8", "i8", "f8", "?", "i8"), strict=True))
        got.check(t)
        if np.isnan(got.t).any():
            raise ValueError(f"series {got.names[got.codes[np.isnan(got.t)][0]]} brings a sample without time")
        now = np.floor(got.t / self.size).astype("int64")
        starts = np.append(True, now[1:] != now[:-1])
        starts[got.begins] = ~open_ | (now[got.begins] != at)
        # rows with which a window starts or, at the begin of a series, goes on
        w = np.flatnonzero(starts | got.first)
        new, first, of = starts[w], got.first[w], got.codes[w]
        around = got.before(got.t, t)[w], got.before(got.v, v)[w], got.t[w], got.v[w]
        ats = now[w]
        heads = np.where(new, self._between(ats * self.size, *around), head[of])
        ns = np.diff(np.append(w, len(now))) + np.where(new, 0, n[of])
        # the window before each of them, which ends if a new one starts
        was = np.where(first, at[of], np.roll(ats, 1))
        ended = pd.DataFrame({
            self.key: np.array(got.names, dtype=object)[of],
            "t_start": was * self.size,
            "head": np.where(first, head[of], np.roll(heads, 1)),
            "tail": self._between((was + 1) * self.size, *around),
            "n": np.where(first, n[of], np.roll(ns, 1)),
        })[new & (~first | open_[of])]
        left = np.flatnonzero(np.append(first[1:], True))
        now_held = zip(got.names, got.t[got.ends].tolist(), got.v[got.ends].tolist(), ats[left].tolist(), heads[left].tolist(), [True] * len(left), ns[left].tolist(), strict=True)
        state |= {row[0]: row for row in now_held}
        self.last.put(list(state.values()))
        due, set_ = {self._due(a) for a in {row[3] for row in state.values() if row[5]}}, set(self.handle.listTimers())
        for timer in set_ - due:
            self.handle.deleteTimer(timer)
        for timer in due - set_:
            self.handle.registerTimer(timer)
        yield self._told(key, ended)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # no sample within the gap: the windows end without a value there
        state = list(self.last.get())
        over = {a for a in {row[3] for row in state if row[5]} if self._due(a) <= expiredTimerInfo.getExpiryTimeInMs()}
        made = [(name, at * self.size, head, None, n) for name, _, _, at, head, open_, n in state if open_ and at in over]
        self.last.put([(*row[:4], None, False, 0) if row[5] and row[3] in over else row for row in state])
        yield self._told(key, pd.DataFrame(made, columns=[self.key, "t_start", "head", "tail", "n"]))

    def _told(self, key: tuple, out: pd.DataFrame) -> pd.DataFrame:
        out = out.astype({"t_start": "float64", "head": "float64", "tail": "float64", "n": "int64"})
        return out.assign(**{self.key: None}) if key[0] < 0 else out

    def close(self) -> None:
        pass


def window_edges(stream: DataFrame, folder: str, checkpoint: str, key: str, time: str, value: str, size: float, gap: float, late: str = "0 seconds") -> DataFrame:
    """A row per series and window of ``size`` seconds that holds samples: key, t_start,
    the value at its begin (``head``) and end (``tail``), and its number of samples.

    A value at an edge is that of a sample there, or lies on the line between the last
    sample before and the first one after, if each is at most ``gap`` away, else null: the
    neighbours may come in other batches. A window is told when the next one begins, or
    by a timer when the watermark (``late`` behind the newest sample) is ``gap`` beyond its
    end. A sample older than one of its series before it is an error, as is a null time."""
    spark = stream.sparkSession
    kind = stream.schema[key].dataType
    out = StructType([StructField(key, StringType()), *(StructField(n, DoubleType()) for n in ("t_start", "head", "tail")), StructField("n", LongType())])
    timed = _dealt(stream, key).select(_GROUP, _SERIES, F.col(time).cast("double").alias(time), F.col(value).cast("double").alias(value), F.timestamp_micros(((F.col(time) + _AHEAD) * 1e6).cast("long")).alias("_event")).withWatermark("_event", late)
    made = timed.groupBy(_GROUP).transformWithStateInPandas(_Windows(timed.columns, key, time, value, size, gap), out, "Append", "EventTime")
    made = made.withColumn(key, _key(key, kind))
    log = Snapshots(spark, folder)
    exactly_once(made, log, "windows", checkpoint)
    found = log.read("windows")
    return spark.createDataFrame([], made.schema) if found is None else found
