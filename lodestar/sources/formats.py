"""File formats as Spark data sources: ``spark.read.format(name)`` after ``register``.

* ``telemetry``: CSV with a header; options path, timestamp, fields (JSON, new name ->
  column of the file). file, stamp and the fields as text.
* ``tracks``: headerless lines of boxes; option path.
* ``matrix``: two-dimensional .npy files; options path, and first and last (excluded), the
  positions to read. file, position, vector.

Files are found by the reader and cut into ranges, a task each: lines of text belong to
the range that holds their first byte, rows of a matrix are read by their place. Filters are
not pushed into the sources: Spark 4.1 keeps a pushed filter with the relation, so that
another use of the same DataFrame would lose rows. Ranges of positions are options instead.
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.csv
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of its lines that are laid out as objects at once.
RANGE_BYTES, PIECE_BYTES = 32 << 20, 256 << 10


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path there."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def found(path: str, ending: str = "") -> list[tuple[str, int]]:
    """Files (path, bytes) at or below a path, sorted; hidden ones and those of another
    ending are left out."""
    store, inner = located(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"there is no {path}")
    every = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
    some = [f for f in every if f.type == fs.FileType.File and not posixpath.basename(f.path).startswith(("_", ".")) and f.path.lower().endswith(ending)]
    return sorted((f.path, f.size) for f in some)


@dataclass
class Range(InputPartition):
    file: str
    first: int
    last: int


class _Reader(DataSourceReader):
    """Ranges of files."""

    ending = ""

    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the option path is missing")
        self.step = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return [Range(path, lo, min(size, lo + self.step)) for path, size in found(self.path, self.ending) for lo in range(0, size, self.step)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from self._batches(partition)

    def _lines(self, p: Range) -> bytes:
        """Whole lines whose first bytes lie in the range."""
        store, _ = located(self.path)
        with store.open_input_file(p.file) as src:
            # the byte before tells whether a line begins with the range
            src.seek(max(0, p.first - 1))
            raw = src.read(p.last - max(0, p.first - 1))
            if p.first:
                cut = raw.find(b"\n")
                raw = raw[cut + 1 :] if cut >= 0 else b""
            if not raw:
                return b""
            # the last line may end beyond the range
            while not raw.endswith(b"\n"):
                more = src.read(1 << 16)
                if not more:
                    break
                end = more.find(b"\n")
                raw += more if end < 0 else more[: end + 1]
            return raw


class _Telemetry(_Reader):
    ending = ".csv"

    def __init__(self, options):
        super().__init__(options)
        self.timestamp = options.get("timestamp")
        self.fields: dict[str, str] = json.loads(options.get("fields", "{}"))

    def _batches(self, p: Range) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        with store.open_input_stream(p.file) as src:
            head = src.read(1 << 16)
            while b"\n" not in head and (more := src.read(1 << 16)):
                head += more
        names = pyarrow.csv.read_csv(io.BytesIO(head[: head.find(b"\n") + 1 or None].removeprefix(b"\xef\xbb\xbf")), read_options=pyarrow.csv.ReadOptions(autogenerate_column_names=True), convert_options=pyarrow.csv.ConvertOptions(column_types={f"f{i}": pa.string() for i in range(10_000)})).to_pylist()
        header = list(names[0].values()) if names else []
        missing = sorted({self.timestamp, *self.fields.values()} - set(header))
        if missing:
            raise ValueError(f"columns not in {p.file}: {', '.join(map(str, missing))}")
        raw = self._lines(p)
        if p.first == 0:
            raw = raw[raw.find(b"\n") + 1 :] if b"\n" in raw else b""
        if not raw.strip():
            return
        options = pyarrow.csv.ConvertOptions(column_types={n: pa.string() for n in header}, strings_can_be_null=True, null_values=[""], include_columns=[self.timestamp, *self.fields.values()])
        with pyarrow.csv.open_csv(io.BytesIO(raw), read_options=pyarrow.csv.ReadOptions(column_names=header), convert_options=options) as rows:
            for batch in rows:
                yield pa.RecordBatch.from_arrays([pa.array([p.file] * batch.num_rows), *batch.columns], names=["file", "stamp", *self.fields])


class _Tracks(_Reader):
    def _batches(self, p: Range) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(self._lines(p)):
            rows = [line.strip().split(b",") for line in piece.splitlines()]
            values = np.array([[_number(x) for x in r[:8]] for r in rows if len(r) >= 8], float).reshape(-1, 8)
            # lines without readable numbers are no boxes, nor are those of score 0
            values = values[np.isfinite(values).all(1) & (values[:, 6] != 0)]
            whole_numbers = [values[:, i].astype(np.int64) for i in (0, 1, 7)]
            yield pa.RecordBatch.from_arrays([pa.array([p.file] * len(values)), *map(pa.array, whole_numbers[:2]), pa.array(whole_numbers[2].astype(np.int32)), pa.array(values[:, 2] + values[:, 4] / 2), pa.array(values[:, 3] + values[:, 5] / 2)], names=["file", "frame", "track", "category", "cx", "cy"])


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Whole lines of about ``PIECE_BYTES``: lines as objects take many times their bytes."""
    lo = 0
    while lo < len(raw):
        cut = raw.find(b"\n", lo + PIECE_BYTES)
        hi = len(raw) if cut < 0 else cut + 1
        yield raw[lo:hi]
        lo = hi


def _number(raw: bytes) -> float:
    try:
        return float(raw)
    except ValueError:
        return float("nan")


class _Matrix(_Reader):
    ending = ".npy"

    def __init__(self, options):
        super().__init__(options)
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def _head(self, file: str) -> tuple[tuple[int, ...], np.dtype, int]:
        store, _ = located(self.path)
        with store.open_input_file(file) as src:
            version = np.lib.format.read_magic(src)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, fortran, kind = read(src)
            if len(shape) != 2 or fortran or kind.kind not in "fiu":
                raise ValueError(f"{file} is no table of numbers in rows")
            return shape, kind, src.tell()

    def partitions(self) -> list[Range]:
        out = []
        for file, _ in found(self.path, self.ending):
            (n, width), kind, _ = self._head(file)
            step, last = max(1, self.step // max(1, width * kind.itemsize)), min(n, self.last)
            out += [Range(file, lo, min(last, lo + step)) for lo in range(self.first, last, step)]
        return out or [Range("", 0, 0)]

    def _batches(self, p: Range) -> Iterator[pa.RecordBatch]:
        (_, width), kind, begin = self._head(p.file)
        store, _ = located(self.path)
        with store.open_input_file(p.file) as src:
            src.seek(begin + p.first * width * kind.itemsize)
            rows = np.frombuffer(src.read((p.last - p.first) * width * kind.itemsize), kind).astype(np.float64)
        at = pa.array(np.arange(p.last - p.first + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays([pa.array([p.file] * (p.last - p.first)), pa.array(np.arange(p.first, p.last)), pa.ListArray.from_arrays(at, pa.array(rows))], names=["file", "position", "vector"])


class Telemetry(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telemetry"

    def schema(self) -> str:
        names = json.loads(self.options.get("fields", "{}"))
        return ", ".join(["file string", "stamp string", *(f"`{n}` string" for n in names)])

    def reader(self, schema) -> DataSourceReader:
        return _Telemetry(self.options)


class Tracks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracks"

    def schema(self) -> str:
        return "file string, frame long, track long, category int, cx double, cy double"

    def reader(self, schema) -> DataSourceReader:
        return _Tracks(self.options)


class Matrix(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "file string, position long, vector array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Matrix(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (Telemetry, Tracks, Matrix):
        spark.dataSource.register(source)
