"""One text file per value of a column, of any size: tasks write parts, which are then put
together piece by piece. No task sorts or holds a whole file."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folders import new_folder
from .formats import located

#: Rows of a part, about, and bytes that a task holds of one.
PART_ROWS, PIECE = 1 << 20, 4 << 20
#: How Spark names the folder of a null or an empty text.
_NONE = "__HIVE_DEFAULT_PARTITION__"


def write_text(rows: DataFrame, folder: str, by: str, value: str = "value", order: str | None = None) -> None:
    """Writes ``value`` as lines to ``folder``/``by``=.../part-00000-....txt, one file for
    each value of ``by``, in the order of ``order`` if that is told. Parts are ranges of
    the order, written where they are sorted; a task per file then appends them."""
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // PART_ROWS))
    keys = [by, *([order] if order else [])]
    # without an order, parts are rows as they lie
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if order else rows
    scratch, run = new_folder(spark, "parts"), uuid.uuid4().hex
    # a null value is an empty line
    lines = dealt.select(F.col(by).cast("string").alias("k"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("v"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, store, inner = TaskContext.get(), *located(scratch)
        store.create_dir(inner, recursive=True)
        number, made, open_ = task.partitionId(), {}, {}
        for batch in batches:
            for kind in batch.column(0).unique().to_pylist():
                own = batch.column(1).filter(pc.equal(batch.column(0), kind) if kind is not None else batch.column(0).is_null())
                if kind not in open_:
                    # another attempt of the task has files of its own
                    made[kind] = f"{number:06d}-{task.taskAttemptId()}-{len(made)}"
                    open_[kind] = store.open_output_stream(posixpath.join(inner, made[kind]))
                open_[kind].write("".join(f"{line}\n" for line in own.to_pylist()).encode())
        for out in open_.values():
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), pa.array([number] * len(made), pa.int64()), pa.array(list(made.values()), pa.string())], names=["k", "number", "name"])

    # a row per part and value
    written = spark.createDataFrame(lines.mapInArrow(write, "k string, number long, name string").collect(), "k string, number long, name string")
    files = written.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("number", "name")))["name"].alias("names"))
    shown = lambda c: F.when(c.isNull() | (c == ""), F.lit(_NONE)).otherwise(_escaped(c))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = located(scratch)
                target = posixpath.join(located(folder)[1], f"{by}={place}")
                store.create_dir(target, recursive=True)
                hidden = posixpath.join(target, f"_{uuid.uuid4().hex}")
                with store.open_output_stream(hidden) as out:
                    for name in names:
                        with store.open_input_stream(posixpath.join(inner, name)) as src:
                            while piece := src.read(PIECE):
                                out.write(piece)
                store.move(hidden, posixpath.join(target, f"part-00000-{run}.txt"))
                yield pa.RecordBatch.from_pydict({"k": [place]})

    count = files.count()
    files.select(shown(F.col("k")).alias("k"), "names").groupBy("k").agg(F.flatten(F.collect_list("names")).alias("names")).repartition(max(1, count), "k").mapInArrow(join, "k string").count()


def _escaped(c: Column) -> Column:
    """A value as Spark writes it in a folder's name."""
    for mark in "%\"#'*/:=?\\{[]^":
        c = F.replace(c, F.lit(mark), F.lit(f"%{ord(mark):02X}"))
    return c
