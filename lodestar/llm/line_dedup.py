"""Line dedup over levelled sorted runs of line hashes.

A run has a row per line key: its 128-bit hash, the number of documents of its batch that
hold it and, where no earlier run holds the key, the document that keeps the line. Runs
are tables bucketed and sorted by hash, all alike, so a batch meets them, and two runs meet
each other, bucket by bucket without an exchange of the runs. A new batch is merge-joined
with the runs: the keys that none of them holds are its new lines, the others add to their
counts; then it is a run of its own. ``fanout`` runs of a level are compacted into one of
the next, so there are few runs however many batches came.

Batches are taken from the largest document ids down: the document that brings a line is
then the one that keeps it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import Scratch, fresh, materialize, numbered, quoted, small_batches
from .textbytes import column, mix, passes, segment_hashes

LEAST_CHARS, LEAST_DOCS = 20, 3
BATCHES, FANOUT = 6, 2
#: Stands for a null id: below all others, so it keeps a line only from no one.
NO_ID = np.iinfo(np.int64).min

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[32] = _SPACE[9:14] = True
_OTHER = np.random.default_rng(12).permutation(256).astype(np.uint8)
_KEY = ["h1", "h2"]


class Lines:
    """The lines of texts: bounds, document, and the hash of those keys that have
    ``least`` code points (``long``)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, least: int):
        breaks = np.flatnonzero(buf == 10)
        self.start = np.sort(np.concatenate([offs[:-1], breaks + 1]))
        self.end = np.sort(np.concatenate([breaks, offs[1:]]))
        self.count = 1 + np.diff(np.searchsorted(breaks, offs))
        self.doc = np.repeat(np.arange(len(offs) - 1), self.count)
        solid = np.flatnonzero(~_SPACE[buf])
        lo, hi = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        some = hi > lo
        first, last = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        first[some], last[some] = solid[lo[some]], solid[hi[some] - 1] + 1
        # code points begin where no continuation byte stands
        heads = np.append(0, np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64))
        self.long = np.flatnonzero(heads[last] - heads[first] >= least)
        low = _LOWER[buf]
        a, b = first[self.long], last[self.long]
        self.h1 = segment_hashes(low, a, b)
        self.h2 = mix(segment_hashes(_OTHER[low], a, b) ^ np.uint64(0x632BE59BD9B4E019))

    def kept(self, buf: np.ndarray, offs: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts without the lines ``gone``, the others joined by \\n."""
        stay = ~gone
        seen = np.cumsum(stay) - stay
        base = seen[np.append(0, np.cumsum(self.count))[:-1]] if len(self.count) else seen[:0]
        later = seen > base[self.doc]
        edge = np.zeros(len(buf) + 1, np.int32)
        np.add.at(edge, (self.start - later)[stay], 1)
        np.add.at(edge, self.end[stay], -1)
        mask = np.cumsum(edge[:-1]) > 0
        return buf[mask], np.append(0, np.cumsum(mask))[offs]


def entries(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h1, h2) of every long line key of a document, once a row of ``docs``; null
    ids as ``NO_ID``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = column(batch, "text")
            ids = batch.column(0).to_numpy()
            for lo, hi in passes(offs):
                found = Lines(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], least_chars)
                doc = found.doc[found.long]
                order = np.lexsort((found.h2, found.h1, doc))
                doc, h1, h2 = doc[order], found.h1[order], found.h2[order]
                new = np.ones(len(doc), bool)
                new[1:] = (np.diff(doc) > 0) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][doc[new]]), pa.array(h1[new].view(np.int64)), pa.array(h2[new].view(np.int64))], names=["doc_id", *_KEY])

    rows = small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, h1 long, h2 long")


class LineRuns:
    """Levelled runs below ``folder``: rows (h1, h2, docs, keeper), bucketed by the key.
    ``buckets`` is that of the session's shuffles, so a batch is dealt as runs are."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _save(self, rows: DataFrame, level: int) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.select(*_KEY, "docs", "keeper").write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return self.spark.table(name)

    def _merge(self, names: list[str]) -> DataFrame:
        """A row per key of some runs. Two meet as they lie; more are dealt once more (a
        union of bucketed tables doesn't keep their buckets, whatever its plan says)."""
        if len(names) == 2:
            a, b = self.spark.table(names[0]), self.spark.table(names[1]).withColumnsRenamed({"docs": "_docs", "keeper": "_keeper"})
            docs = F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))
            return a.join(b, _KEY, "full").select(*_KEY, docs.alias("docs"), F.greatest("keeper", "_keeper").alias("keeper"))
        runs = self.spark.table(names[0])
        for name in names[1:]:
            runs = runs.union(self.spark.table(name))
        return runs.repartition(self.buckets, *_KEY).groupBy(*_KEY).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge-joins a batch (h1, h2, docs, keeper), a row per key, with the runs, makes
        it a run, and returns its rows whose keys no run held before."""
        met = batch.withColumn("held", F.lit(False))
        for name in [n for level in self.levels for n in level]:
            run = self.spark.table(name).select(*_KEY, F.lit(True).alias("_in"))
            met = met.join(run, _KEY, "left").withColumn("held", F.col("held") | F.col("_in").isNotNull()).drop("_in")
        run = self._save(met.withColumn("keeper", F.when(~F.col("held"), F.col("keeper"))), 0)
        self._compact()
        return run.where("keeper is not null")

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            # older runs stay in their files until the folder goes: readers may hold them
            full, self.levels[level] = self.levels[level], []
            self._save(self._merge(full), level + 1)
            self._forget(full)
            level += 1

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def merged(self) -> DataFrame:
        """A row per key over all runs."""
        return self._merge([n for level in self.levels for n in level])

    def close(self) -> None:
        for level in self.levels:
            self._forget(level)
        self.levels = []


def _batches(found: DataFrame, scratch: Scratch, batches: int) -> DataFrame:
    """``found`` with a batch number, from the largest ids down."""
    cuts = found.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = F.lit(0)
    for cut in sorted(set(cuts)):
        batch = batch + (F.col("doc_id") <= cut).cast("int")
    path = f"{scratch.folder}/entries"
    found.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    return scratch.spark.read.schema("doc_id long, h1 long, h2 long, batch int").parquet(path)


def repeated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lines) of the documents that lose lines: hashes of the keys which at least
    ``least_docs`` documents hold, where another one keeps them. Null ids are one document,
    ``NO_ID``."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        found = scratch.table(entries(docs, least_chars, id_col, text_col), "found")
        dealt = _batches(found, scratch, batches)
        runs = LineRuns(spark, scratch.folder, fanout=fanout)
        try:
            for i in range(batches):
                # ids first: a line of very many documents then is one row a task below
                once = dealt.where(F.col("batch") == i).select("doc_id", *_KEY).distinct()
                runs.add(once.groupBy(*_KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper")))
            # written apart from its buckets, so that the join below may split a common key
            often = scratch.table(runs.merged().where(F.col("docs") >= least_docs).select(*_KEY, "keeper"), "often")
        finally:
            runs.close()
        lost = found.join(often, _KEY).where("doc_id < keeper").select("doc_id", F.struct(*_KEY).alias("key"))
        return materialize(lost.groupBy("doc_id").agg(F.collect_set("key").alias("lines")), "lost")


def deduplicate(docs: DataFrame, keep: list[str] | None = None, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (all), n_lines before dropping, n_dropped, and the text
    that is left, as ``kept``; the three under longer names where ``keep`` has them.

    Texts are split at \\n. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its
    ends, A-Z lower-cased. Keys of at least ``least_chars`` code points that at least
    ``least_docs`` documents hold lose all their lines except in the largest id that holds
    them. A null or empty text is one empty line. Rows of one id are one document: all of
    them keep or lose a line; rows without an id too, and any id is larger. Lines are told
    by 128 bits of hash. An empty table gives no rows.
    """
    own = list(docs.columns) if keep is None else keep
    n_lines, n_dropped, kept = names = [fresh(n, own) for n in ("n_lines", "n_dropped", "kept")]
    lost = repeated(docs, least_chars, least_docs, batches, fanout, id_col, text_col)
    key, text, lines = fresh("_key", docs.columns), fresh("_text", docs.columns), fresh("_lines", docs.columns)
    rows = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), text: F.col(text_col).cast("string")})
    met = rows.join(lost.select(F.col("doc_id").alias(key), F.col("lines").alias(lines)), key, "left")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = column(batch, "text")
            at = batch.schema.get_field_index("lines")
            for lo, hi in passes(offs):
                part, bounds = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                found = Lines(part, bounds, least_chars)
                gone = np.zeros(len(found.start), bool)
                gone[found.long] = _among(found, batch.column(at).slice(lo, hi - lo))
                left, ends = found.kept(part, bounds, gone)
                told = pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(left)])
                dropped = np.bincount(found.doc[gone], minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(own)], pa.array(found.count.astype(np.int64)), pa.array(dropped.astype(np.int64)), told], names=[*own, *names])

    fields = [docs.schema[n] for n in own] + [StructField(n_lines, LongType()), StructField(n_dropped, LongType()), StructField(kept, StringType())]
    return numbered(small_batches(met), own, text=quoted([text])[0], lines=quoted([lines])[0]).mapInArrow(drop, StructType(fields))


def _among(found: Lines, lists: pa.Array) -> np.ndarray:
    """Which long lines are in their document's list of (h1, h2)."""
    flat = lists.flatten()
    count = np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0))).astype(np.int64)
    doc = np.concatenate([np.repeat(np.arange(len(lists)), count), found.doc[found.long]])
    own = [np.asarray(flat.field(k)).view(np.uint64) for k in _KEY]
    h1, h2 = np.concatenate([own[0], found.h1]), np.concatenate([own[1], found.h2])
    line = np.arange(len(doc)) >= len(own[0])
    order = np.lexsort((line, h2, h1, doc))
    new = np.ones(len(order), bool)
    d, a, b = doc[order], h1[order], h2[order]
    new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    # a list's entry sorts before the lines that it names
    listed = ~line[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else np.zeros(0, bool)
    out = np.zeros(len(order), bool)
    out[order] = listed
    return out[len(own[0]) :]
