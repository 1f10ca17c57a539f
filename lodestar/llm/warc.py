"""WARC archives: writing captures, and assembling them again from their records.

A capture is a transaction of three records: request, response (or revisit) and
metadata. Request and metadata name the response in ``WARC-Concurrent-To``; reading
joins the three through these identifiers and emits one nested row per capture.

Of captures with equal payloads of at least ``least`` bytes, the one with the largest
id is written as response, with its payload, and the others as revisits, which repeat
its digest and name its record in ``WARC-Refers-To``; rows that repeat the largest id are
responses all. Smaller payloads are always responses. Each record is a gzip member of its
own, and a file is closed at ``FILE_BYTES``. Payloads stay in their partitions while the
digests that repeat are few enough for a broadcast.

Records are named after their row's number, so the table is read twice and must give its
rows in the same order, as files do.

Null payloads are empty. Null ids are kept (smaller than any other). Null URLs are
written as none; line ends in a URL are percent-encoded. Repeated rows are captures of
their own. Empty tables give no captures. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checked, materialize, new_path, open_mapped, small_batches, write_file

LEAST = 1000
#: Compressed bytes at which a file is closed, and payload bytes in a batch of records.
FILE_BYTES, BATCH_BYTES = 256 << 20, 8 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _name(row: int, which: int) -> str:
    """The id of a row's request (0), response (1) or metadata record (2)."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(b'%d %d' % (row, which)).digest(), version=4)}>"


def _record(kind: str, own: str, date: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _line(url: str | None) -> str | None:
    return url.replace("\r", "%0D").replace("\n", "%0A") if url else None


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes a capture for each row and returns the folder of the archives."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "row": F.monotonically_increasing_id()})
    equal = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max(F.struct("id", "url", "row")).alias("origin"), F.count("*").alias("n"))
    # written, so that a shuffled join reads both its sides as dealt, and splits a hot digest
    equal = materialize(equal.where("n > 1").select("digest", "origin"), "equal")
    older = F.col("origin").isNotNull() & ~F.col("id").eqNullSafe(F.col("origin.id"))
    made = rows.join(checked(equal, equal.count()), "digest", "left").select("id", "url", "payload", "digest", "row", F.when(older, F.col("origin.row")).alias("origin"), F.col("origin.url").alias("origin_url"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), []

        def captures() -> Iterator[bytes]:
            for batch in batches:
                for page, url, payload, digest, row, origin, origin_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload, url = payload.encode(), _line(url)
                    request, response, metadata = (_name(row, k) for k in range(3))
                    target = ("WARC-Target-URI", url)
                    yield _record("request", request, date, [target, ("WARC-Concurrent-To", response), ("Content-Type", "application/http; msgtype=request")], f"GET {url or '/'} HTTP/1.1\r\n\r\n".encode())
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    common = [target, ("WARC-Payload-Digest", _base32(digest)), ("Content-Type", "application/http; msgtype=response")]
                    if origin is not None:
                        yield _record("revisit", response, date, [*common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _name(origin, 1)), ("WARC-Refers-To-Target-URI", _line(origin_url)), ("WARC-Refers-To-Date", date)], http)
                    else:
                        yield _record("response", response, date, common, http + payload)
                    fields = "" if page is None else f"page-id: {page}\r\n"
                    yield _record("metadata", metadata, date, [target, ("WARC-Concurrent-To", response), ("Content-Type", "application/warc-fields")], fields.encode())

        stream = captures()
        first = next(stream, None)
        while first is not None:
            size, last = 0, first
            path = f"part-{part:05d}-{len(done):03d}.warc.gz"

            def until_full() -> Iterator[bytes]:
                nonlocal size, last
                while last is not None:
                    size += len(last)
                    yield last
                    last = next(stream, None)
                    if size >= FILE_BYTES:
                        return

            write_file(f"{folder}/{path}", until_full())
            done.append((path, size))
            first = last
        yield pa.RecordBatch.from_pydict({"file": pa.array([p for p, _ in done], pa.string()), "bytes": pa.array([s for _, s in done], pa.int64())})

    made.mapInArrow(save, "file string, bytes long").write.parquet(f"{folder}/manifest.parquet")
    return folder


_RECORD = "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, page_id long, payload_bytes long, payload_digest string, payload binary"


def _parse(stream, payloads: bool) -> Iterator[tuple]:
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record begins here")
        head = {}
        while (line := stream.readline().strip()):
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        kind, page, size, digest, payload = head["warc-type"], None, None, None, None
        if kind in ("response", "revisit"):
            http, _, body = block.partition(b"\r\n\r\n")
            if kind == "response":
                size, digest, payload = len(body), hashlib.sha1(body).hexdigest(), body if payloads else None
            else:
                size = next((int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            told = head.get("warc-payload-digest", "")
            if told.startswith("sha1:"):
                told = base64.b32decode(told[5:]).hex()
                if digest is not None and told != digest:
                    raise ValueError(f"the payload of {head['warc-record-id']} is damaged")
                digest = told
        elif kind == "metadata":
            page = next((int(x.partition(b":")[2]) for x in block.split(b"\r\n") if x.startswith(b"page-id:")), None)
        yield kind, head["warc-record-id"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), page, size, digest, payload


def records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the archives in ``folder``."""
    names = [x.split(" ")[0] for x in _RECORD.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split(" ")[1]]) for n, x in zip(names, _RECORD.split(", "), strict=True)])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_mapped(f"{folder}/{file}") as path, gzip.open(path) as stream:
                    for row in _parse(stream, payloads):
                        rows.append(row)
                        size += len(row[-1] or b"") + 256
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names=names)

    manifest = spark.read.schema("file string, bytes long").parquet(f"{folder}/manifest.parquet")
    # one file a task: dealt in turn from one partition, a row per file
    return manifest.select("file").coalesce(1).repartition(max(1, manifest.count())).mapInArrow(load, _RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, uri, page_id, request, response (with its
    type) and metadata (an array, in the order of ids). Records that belong to no
    response give no row; a capture without request or metadata has null or an empty
    array there."""
    part = F.struct("record_id", "uri", "date")
    request = found.where("type = 'request'").groupBy(F.col("concurrent_to").alias("to")).agg(F.min(part).alias("request"))
    metadata = found.where("type = 'metadata'").groupBy(F.col("concurrent_to").alias("to")).agg(F.sort_array(F.collect_list(F.struct("record_id", "page_id"))).alias("metadata"))
    response = found.where("type in ('response', 'revisit')").select(F.col("record_id").alias("to"), "uri", F.struct("type", "record_id", "date", "refers_to", "payload_bytes", "payload_digest", "payload").alias("response"))
    joined = response.join(request, "to", "left").join(metadata, "to", "left")
    return joined.select(F.col("to").alias("record_id"), "uri", F.get(F.col("metadata.page_id"), F.lit(0)).alias("page_id"), "request", "response", F.coalesce("metadata", F.array().cast("array<struct<record_id:string,page_id:bigint>>")).alias("metadata"))


def resolve(assembled: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and, for revisits, the page of
    the capture whose record they name (refers_to; null where it isn't there)."""
    flat = assembled.select("record_id", "page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("origin"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    named = flat.where("record_type = 'response'").select(F.col("record_id").alias("origin"), F.col("page_id").alias("refers_to"))
    revisits = flat.where("record_type = 'revisit'").join(named, "origin", "left")
    return flat.where("record_type = 'response'").select(*names, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select(*names, "refers_to"))
