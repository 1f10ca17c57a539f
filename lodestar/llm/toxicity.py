"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text
is cut at blanks into windows of about ``WINDOW`` bytes; each window is compressed
with either dictionary, and the bytes that the toxic one saves are the window's gain.
A document's numbers of windows above calibrated gains, beside its number of windows,
give its score. Half of the labelled documents train the dictionaries; the other half
calibrates: it chooses the gains, one after another, and weighs the numbers.

In windows this short, the language that both kinds of text share would drown the
difference. Both dictionaries therefore begin with one part trained on ordinary text,
and end with a part trained on what leans to their own kind: words with a sequence of
``GRAM`` bytes that stands in significantly more documents of that kind than of the
other.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import numbered, quoted, small_batches
from .textbytes import column, passes

WINDOW = 64
GRAM = 5
LEAST_RATIO = 4
SHARED_BYTES, OWN_BYTES, PART_BYTES = 16384, 2048, 4096
#: Gains in bytes that may become thresholds, and thresholds at most.
GAINS, THRESHOLDS = range(1, 17), 5
#: What a fit reads about: whole labelled documents of each kind, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 3000, 24 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 13, 32]] = True


def _windows(buf: np.ndarray, offs: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and sizes of the windows, and each document's first
    window (n + 1 bounds). A window ends at the first blank after ``WINDOW`` bytes, or
    after twice as many; the blank belongs to both neighbours."""
    low = _LOWER[buf]
    blank = np.flatnonzero(_GAP[low])
    size = np.diff(offs)
    number = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), number)
    mark = offs[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * WINDOW
    if len(blank):
        near = blank[np.minimum(np.searchsorted(blank, mark), len(blank) - 1)]
        cut = np.where((near >= mark) & (near < mark + WINDOW), near, mark)
    else:
        cut = mark
    first = mark == offs[doc]
    cut[first] = mark[first]
    keep = (cut < offs[doc + 1]) if len(doc) else np.zeros(0, bool)
    cut, doc = cut[keep], doc[keep]
    end = np.append(cut[1:], offs[-1])
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    end = np.where(last, offs[doc + 1], np.minimum(end + 1, offs[doc + 1])) if len(doc) else end[:0]
    real = end > cut
    return low.tobytes(), cut[real], (end - cut)[real], np.searchsorted(doc[real], np.arange(len(size) + 1))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    # raw content: without entropy tables, literals cost whole bytes and a match shows
    parameters = zstandard.ZstdCompressionParameters.from_level(9, min_match=6, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def _sizes(compressor: zstandard.ZstdCompressor, raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    segments = np.stack([start, size], 1).astype("<u8").tobytes()
    packed = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(raw, segments), threads=1)
    return np.fromiter(map(len, packed), np.int64, len(start))


def _train(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary trained on the samples, and before it the most
    frequent samples that training left out; of too few samples, just these."""
    try:
        content = zstandard.train_dictionary(size, samples, k=max(GRAM * 4, 16), d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        content = b""
    for sample, _ in Counter(samples).most_common():
        if len(content) + len(sample) <= size and sample not in content:
            content = sample + content
    return content


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of bytes and in how many texts they stand."""
    found = []
    for t in texts:
        b = np.frombuffer(b" " + t + b" ", np.uint8).astype(np.uint64)
        if len(b) >= GRAM:
            found.append(np.unique(functools.reduce(lambda a, i: (a << np.uint64(8)) | b[i : len(b) - GRAM + 1 + i], range(GRAM), np.zeros(len(b) - GRAM + 1, np.uint64))))
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _leaning(own: list[bytes], other: list[bytes]) -> set[bytes]:
    """Sequences in ``LEAST_RATIO`` times as large a share of the first kind's texts, and
    significantly so: G test at 0.05 over all sequences (Bonferroni)."""
    gram, a = _grams(own)
    gram2, b2 = _grams(other)
    at = np.searchsorted(gram2, gram)
    b = np.zeros(len(gram))
    if len(gram2):
        same = gram2[np.minimum(at, len(gram2) - 1)] == gram
        b[same] = b2[at[same]]
    n, m = max(1, len(own)), max(1, len(other))
    expect = (a + b) * n / (n + m)
    rest = (a + b) - expect
    g = 2 * (a * np.log(a / expect) + np.where(b > 0, b * np.log(np.maximum(b, 1) / rest), 0))
    lean = (a / n > LEAST_RATIO * b / m) & (g > 2 * np.log(20 * max(2, len(gram))))
    return {int(x).to_bytes(GRAM, "big") for x in gram[lean]}


def _own(texts: list[bytes], leaning: set[bytes]) -> list[bytes]:
    """The leaning parts of each text's distinct words, a sample each: from the first
    to the last byte of overlapping sequences, blanks around a word included."""
    out = []
    for t in texts:
        for word in dict.fromkeys(t.split()):
            w, begin, end = b" " + word + b" ", -1, -1
            for i in range(len(w) + 1 - GRAM):
                if w[i : i + GRAM] in leaning:
                    if i > end:
                        if begin >= 0:
                            out.append(w[begin:end])
                        begin = i
                    end = i + GRAM
            if begin >= 0:
                out.append(w[begin:end])
    return out


def _design(counts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    n = np.maximum(windows, 1)[:, None]
    return np.hstack([np.ones((len(windows), 1)), np.log1p(counts), np.log1p(200.0 * counts / n), np.log(n)])


def _above(gain: np.ndarray, bounds: np.ndarray, thresholds: tuple[int, ...]) -> np.ndarray:
    """Each document's windows that gain as much, for each threshold."""
    sums = np.zeros((len(gain) + 1, len(thresholds)), np.int64)
    np.cumsum(gain[:, None] >= np.array(thresholds), axis=0, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    #: Gains in bytes from which a window counts.
    thresholds: tuple[int, ...]
    weights: np.ndarray

    def gains(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each window's gain, and each document's first window (n + 1 bounds)."""
        raw, start, size, bounds = _windows(buf, offs)
        by = _compressors(self.ordinary, self.toxic)
        return _sizes(by[0], raw, start, size) - _sizes(by[1], raw, start, size) if len(start) else np.zeros(0, np.int64), bounds

    def counts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gain, bounds = self.gains(buf, offs)
        return _above(gain, bounds, self.thresholds), np.diff(bounds)

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = np.clip(_design(*self.counts(buf, offs)) @ self.weights, -30, 30)
        return 1 / (1 + np.exp(-z))


@functools.lru_cache(maxsize=2)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    return _compressor(ordinary), _compressor(toxic)


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 0.05) -> np.ndarray:
    """Weights by Newton's method; the second kind weighs ``prior`` in all."""
    w = np.zeros(x.shape[1])
    each = np.where(y > 0, prior / max(1, (y > 0).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (each * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _calibrated(gain: np.ndarray, bounds: np.ndarray, y: np.ndarray, prior: float) -> tuple[tuple[int, ...], np.ndarray]:
    """Thresholds and weights: the gain that raises the likelihood most joins, as long as
    it raises it by more than the two weights that it brings (Akaike's criterion)."""
    chosen: tuple[int, ...] = ()
    weights, best = np.zeros(0), -np.inf
    each = np.where(y > 0, prior / max(1, (y > 0).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    while len(chosen) < THRESHOLDS:
        tried = []
        for g in GAINS:
            if g not in chosen:
                more = tuple(sorted((*chosen, g)))
                x = _design(_above(gain, bounds, more), np.diff(bounds))
                w = _logistic(x, y, prior)
                z = np.clip(x @ w, -30, 30)
                tried.append(((each * (y * z - np.log1p(np.exp(z)))).sum() - 2 * len(more), more, w))
        top = max(tried, key=lambda t: (t[0], [-g for g in t[1]]))
        if top[0] <= best:
            break
        best, chosen, weights = top
    return chosen, weights


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)


def fit(toxic: list[str], ordinary: list[str], prior: float | None = None) -> Model:
    """A model from texts of the two kinds, of which ``prior`` is the toxic share where
    they come from (their own share, if not given). Without a toxic or an ordinary text every
    score is near the kind that there is (0 if there is none)."""
    # equal texts would count as independent documents
    kinds = [[_LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes() for t in dict.fromkeys(k) if t] for k in (toxic, ordinary)]
    train, check = [k[::2] for k in kinds], [k[1::2] for k in kinds]
    # parts of even size: a very long text holds most sequences of its language
    parts = [[t[i : i + PART_BYTES] for t in k for i in range(0, len(t), PART_BYTES)] for k in train]
    lean = _leaning(parts[0], parts[1]), _leaning(parts[1], parts[0])
    shared = _train([t[i : i + 512] for t in train[1] for i in range(0, len(t), 512)], SHARED_BYTES)
    own = [_train(_own(train[k], lean[k]), OWN_BYTES) for k in (0, 1)]
    model = Model(shared + own[1] or b" ", shared + own[0] or b" ", (1,), np.zeros(0))
    if not all(check):
        model.weights = np.array([5.0 if kinds[0] else -5.0, 0.0, 0.0, 0.0])
        return model
    share = len(kinds[0]) / (len(kinds[0]) + len(kinds[1])) if prior is None else prior
    y = np.repeat([1.0, 0.0], [len(c) for c in check])
    model.thresholds, model.weights = _calibrated(*model.gains(*_buffer([*check[0], *check[1]])), y, min(0.9, max(0.1, share)))
    return model


def crc_of_id(col: str):
    return F.crc32(F.col(col).cast("string").cast("binary"))


def fit_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled documents whose crc32(id as text) mod 5 isn't 0: of each kind
    a sample by hash, of distinct whole texts, about ``SAMPLE`` of them and
    ``SAMPLE_BYTES``. A document with several labels counts once for each; labels other
    than 0 and 1, and those without an id, count for none."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and _id is not null").where(crc_of_id("_id") % 5 != 0).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where("text != ''")
    sizes = marks.groupBy("toxic").count()
    size = {r[0]: r[1] for r in sizes.collect()}
    rank = lambda *of: F.pmod(F.xxhash64(*of, F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(SAMPLE / max(1, size.get(1, 1)))).otherwise(F.lit(SAMPLE / max(1, size.get(0, 1))))
    # about two samples of ids, whatever the number of labels
    chosen = marks.where(rank("_id") < share)
    met = texts.join(F.broadcast(chosen), "_id").select("toxic", "text").distinct()
    found = met.groupBy("toxic").agg(F.count("*"), F.sum(F.octet_length("text"))).collect()
    fits = {r[0]: min(1.0, SAMPLE / r[1], SAMPLE_BYTES / r[2]) for r in found}
    fraction = F.when(F.col("toxic") == 1, F.lit(fits.get(1, 1.0))).otherwise(F.lit(fits.get(0, 1.0)))
    rows = met.where(rank("text") < fraction).collect() if min(fits.values(), default=1.0) < 1 else met.collect()
    rows.sort(key=lambda r: (hashlib.md5(r.text.encode()).digest(), r.toxic))
    prior = size.get(1, 0) / max(1, sum(size.values()))
    return fit([r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0], prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, below: float | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``score`` in place of any such column; with
    ``below``, only the documents that score less, without the score.

    The score is that of the whole text; a null or empty text has no window and scores
    as such. Equal texts score alike. An empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if below is not None or c.lower() != "score"]
    rows = numbered(small_batches(docs), keep, text=F.col(text_col).cast("string"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = column(batch, "text")
            for lo, hi in passes(offs):
                p = model.score(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                part = pa.RecordBatch.from_arrays(batch.slice(lo, hi - lo).columns[: len(keep)], names=keep)
                if below is not None:
                    yield part.filter(pa.array(p < below))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*keep, "score"])

    made = [] if below is not None else [StructField("score", DoubleType())]
    return rows.mapInArrow(judge, StructType([*docs.select(*quoted(keep)).schema.fields, *made]))
