"""Profiles of files that nobody has described: encodings and delimiters of CSV files,
layouts of annotation files. Tasks read the files; what they hold is judged by tables of
rules over what was seen in them."""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listing
from .formats import located

# Encodings in the order of their trial, delimiters, marks of layouts.
ENCODINGS = ("utf-8-sig", "utf-8", "latin-1")
DELIMITERS = ",;\t|"
CAPTION_KEYS = ("caption", "captions", "text", "description")
ANNOTATIONS = ("json", "xml", "txt", "csv")
#: Characters that tell the delimiter, rows that tell columns, characters of a head.
SAMPLE_CHARS, SAMPLE_ROWS, HEAD_CHARS = 32_768, 1000, 200_000
#: Files of a layout that are looked at: the first ones and as many at random.
SAMPLE_FILES = 100
_PIECE = 1 << 20


def encoding_of(store, path: str) -> str:
    """The first encoding that takes the whole file, read piece by piece; a mark at its
    begin tells UTF-8 with one."""
    for name in ENCODINGS:
        decoder = codecs.getincrementaldecoder("utf-8" if name == "utf-8-sig" else name)("strict")
        with store.open_input_stream(path) as src:
            piece = src.read(_PIECE)
            if name == "utf-8-sig" and not piece.startswith(codecs.BOM_UTF8):
                continue
            try:
                while piece:
                    decoder.decode(piece)
                    piece = src.read(_PIECE)
                decoder.decode(b"", True)
                return name
            except UnicodeDecodeError:
                continue
    return ENCODINGS[-1]


def delimiter_of(text: str) -> str:
    """The delimiter that cuts most lines of the text into the same number of values, at
    least two; of equal ones that with more values, then the first. Quoted ones don't count."""
    lines = [x for x in text.splitlines()[:SAMPLE_ROWS] if x.strip()]
    best = (0.0, 0, ",")
    for mark in DELIMITERS:
        sizes = Counter(len(r) for r in csv.reader(lines, delimiter=mark))
        size, n = max(sizes.items(), key=lambda x: (x[1], x[0]), default=(1, 0))
        if size > 1 and (n / len(lines), size) > best[:2]:
            best = (n / len(lines), size, mark)
    return best[2]


def _kind(values: list[str]) -> str:
    """boolean, long, double or string: what all values are."""
    some = [v.strip() for v in values if v.strip()]
    for name, pattern in (("boolean", r"(?i)true|false"), ("long", r"[+-]?\d{1,18}"), ("double", r"(?i)[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|[+-]?inf")):
        if some and all(re.fullmatch(pattern, v) for v in some):
            return name
    return "string"


def csv_profiles(spark: SparkSession, root: str) -> DataFrame:
    """For every CSV file below ``root``: name, encoding, delimiter, rows (sampled), and its
    columns with type and share of empty values among these. A file without lines has no
    columns."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = located(path)
                encoding = encoding_of(store, inner)
                with store.open_input_stream(inner) as src, io.TextIOWrapper(src, encoding, newline="") as text:
                    head = text.read(SAMPLE_CHARS)
                    mark = delimiter_of(head)
                    # the sampled rows may reach beyond the head
                    rows = csv.reader(_lines(head, text), delimiter=mark)
                    header = next(rows, [])
                    sample = [r for _, r in zip(range(SAMPLE_ROWS), (r for r in rows if r), strict=False)]
                columns = [[r[i] if i < len(r) else "" for r in sample] for i in range(len(header))]
                facts = [{"column": h, "type": _kind(c), "null_share": sum(not v for v in c) / len(c) if c else None} for h, c in zip(header, columns, strict=True)]
                yield pa.RecordBatch.from_pydict({"name": [name], "encoding": [encoding], "delimiter": [mark], "rows": [len(sample)], "columns": pa.array([facts], pa.list_(pa.struct([("column", pa.string()), ("type", pa.string()), ("null_share", pa.float64())])))})

    files = listing(spark, root, "**/*.csv").select("path", "name")
    dealt = files.repartition(max(1, min(1024, files.count())), "path")
    return dealt.mapInArrow(look, "name string, encoding string, delimiter string, rows long, columns array<struct<column: string, type: string, null_share: double>>")


def _lines(head: str, rest: io.TextIOWrapper) -> Iterator[str]:
    whole = head.splitlines(keepends=True)
    if whole and not whole[-1].endswith(("\n", "\r")):
        whole[-1] += rest.readline()
    yield from whole
    yield from rest


def json_head(text: str) -> tuple[str, list[str], str]:
    """Of a JSON text, or its begin: object, list or empty for neither; the keys of the
    object, or of a list's first object; and what the first value is (object, list of
    text, list, other)."""
    first = text.lstrip()[:1]
    kind = {"{": "object", "[": "list"}.get(first, "")
    level = {"object": 1, "list": 2}.get(kind)
    keys: list[str] = []
    depth, begun, value = 0, False, ""
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"(\s*:)?|[{}\[\]]', text):
        mark = m.group(0)
        if mark in ("{", "["):
            depth += 1
            if kind == "object" and depth == 2 and not value:
                value = "object" if mark == "{" else "list"
            begun = begun or (kind == "list" and depth == 2 and mark == "{")
        elif mark in ("}", "]"):
            depth -= 1
            if kind == "list" and begun and depth == 1:
                break
        elif m.group(2) and depth == level:
            keys.append(m.group(1))
        elif kind == "object" and depth == 2 and value == "list":
            value = "list of text"
        elif kind == "object" and depth == 1 and not value:
            value = "other"
    return kind, keys, value


#: What a layout looks like, tried in this order, over suffix, json, keys, value, tag,
#: objects, commas and words (values of the first line cut at commas or spaces).
_RULES = [
    ("COCO-json", "suffix = 'json' and json = 'object' and size(array_intersect(keys, array('images', 'annotations', 'categories'))) = 3"),
    ("caption-json (list)", "suffix = 'json' and json = 'list' and arrays_overlap(keys, array({captions}))"),
    ("json (list)", "suffix = 'json' and json = 'list' and size(keys) > 0"),
    ("caption-json (id to list)", "suffix = 'json' and json = 'object' and value = 'list of text'"),
    ("json (object)", "suffix = 'json' and json = 'object'"),
    ("json", "suffix = 'json'"),
    ("PascalVOC-xml", "suffix = 'xml' and (tag = 'annotation' or objects)"),
    ("xml", "suffix = 'xml' and tag <> ''"),
    ("MOT-csv", "suffix in ('txt', 'csv') and commas in (9, 10)"),
    ("csv", "suffix in ('txt', 'csv') and commas > 1"),
    ("YOLO-txt", "suffix in ('txt', 'csv') and words = 5"),
    ("txt", "suffix in ('txt', 'csv') and words > 0"),
]


def _layout() -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, rule in _RULES:
        out = out.when(F.expr(rule.format(captions=", ".join(f"'{k}'" for k in CAPTION_KEYS))), F.lit(name))
    return out.otherwise(F.lit("unknown"))


def layouts(spark: SparkSession, root: str, sample: int = SAMPLE_FILES, seed: int = 1) -> DataFrame:
    """name, layout and has_fps of annotation files: the first ``sample`` of each suffix in
    the order of their names, and as many others at random (by hash). Heads of
    ``HEAD_CHARS`` are read, so files may be of any size."""
    own = listing(spark, root).withColumn("suffix", F.lower(F.regexp_extract("name", r"\.([^./]+)$", 1))).where(F.col("suffix").isin(*ANNOTATIONS)).select("path", "name", "suffix")
    found = None
    for suffix in ANNOTATIONS:
        of = own.where(F.col("suffix") == suffix)
        first = of.orderBy("name").limit(sample)
        other = of.orderBy(F.xxhash64("name", F.lit(seed)), "name").limit(2 * sample).join(first.select("name"), "name", "left_anti").limit(sample).select(first.columns)
        found = first.union(other) if found is None else found.union(first).union(other)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, suffix in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, inner = located(path)
                with store.open_input_stream(inner) as src:
                    text = src.read(4 * HEAD_CHARS).decode("utf-8", "ignore")[:HEAD_CHARS].removeprefix("﻿")
                kind, keys, value = json_head(text) if suffix == "json" else ("", [], "")
                tag = re.search(r"<([A-Za-z_][\w.-]*)", re.sub(r"<[?!][^>]*>", "", text)) if suffix == "xml" else None
                line = next(iter(text.splitlines()), "")
                yield pa.RecordBatch.from_pydict({"name": [name], "suffix": [suffix], "json": [kind], "keys": pa.array([keys], pa.list_(pa.string())), "value": [value], "tag": [tag.group(1) if tag else ""], "objects": ["<object" in text], "commas": [len(line.split(","))], "words": [len(line.split())], "has_fps": ['"fps"' in text and suffix == "json"]})

    seen = found.repartition(8, "path").mapInArrow(look, "name string, suffix string, json string, keys array<string>, value string, tag string, objects boolean, commas long, words long, has_fps boolean")
    return seen.select("name", _layout().alias("layout"), "has_fps")


def unmatched(left: DataFrame, right: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` stems of ``left`` (listings) that ``right`` lacks; none if a side is
    empty, as there is nothing to compare then."""
    if left.isEmpty() or right.isEmpty():
        return left.select("stem").limit(0)
    return left.select("stem").distinct().join(right.select("stem"), "stem", "left_anti").orderBy("stem").limit(n)
