"""Language identification by a convolutional network over bytes.

A text is cut into windows of ``WINDOW`` bytes. Filters of several widths slide over a
window's bytes, each keeps its largest response, and a softmax layer turns these into
probabilities. A document's probabilities are the mean over all its windows, weighted by
the bytes in them.

A filter of width w is w tables of 256 weights, one for each byte under it. Training
(NumPy, Adam) works on these; for prediction, pairs of tables are added up to tables of
byte pairs, so that a position costs one or two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import checked, numbered, quoted, small_batches
from .textbytes import column, passes

WINDOW, WIDTHS, FILTERS = 64, (2, 3, 4), 16
#: What a fit reads about: whole labelled documents of a language and bytes of their texts,
#: and documents of all languages.
SAMPLE, SAMPLE_BYTES, SAMPLE_ALL = 1500, 16 << 20, 60_000
STEPS, BATCH, RATE = 700, 256, 0.02
#: Windows that one pass of the prediction takes.
_PASS = 1024
UNKNOWN = "und"


def _windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows padded with zeros, the bytes in each, and each document's bounds."""
    size = np.diff(offs)
    number = -(-size // WINDOW)
    bounds = np.append(0, np.cumsum(number))
    flat = np.zeros(int(bounds[-1]) * WINDOW, np.uint8)
    own = np.zeros(len(flat) + 1, np.int8)
    np.add.at(own, bounds[:-1] * WINDOW, 1)
    np.add.at(own, bounds[:-1] * WINDOW + size, -1)
    flat[np.cumsum(own[:-1], dtype=np.int8) > 0] = buf
    filled = np.full(int(bounds[-1]), WINDOW, np.int64)
    some = number > 0
    filled[bounds[1:][some] - 1] = (size - (number - 1) * WINDOW)[some]
    return flat.reshape(-1, WINDOW), filled, bounds


@dataclass
class Network:
    languages: list[str]
    #: For each width, tables (width, 256, FILTERS) and a bias for each filter.
    tables: list[np.ndarray]
    bias: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray

    def prepare(self) -> list[list[np.ndarray]]:
        """Tables of byte pairs: width 2 is one, width 3 one and a table, width 4 two."""
        out = []
        for t in self.tables:
            steps = [(t[i][:, None] + t[i + 1][None]).reshape(-1, FILTERS).astype(np.float32) if i + 1 < len(t) else t[i].astype(np.float32) for i in range(0, len(t), 2)]
            out.append(steps)
        return out

    def windows(self, x: np.ndarray, ready: list[list[np.ndarray]]) -> np.ndarray:
        """Probabilities of each window."""
        out = np.zeros((len(x), len(self.languages)), np.float32)
        for lo in range(0, len(x), _PASS):
            part = x[lo : lo + _PASS]
            pair = (part[:, :-1].astype(np.int32) << 8) | part[:, 1:]
            best = []
            for t, steps, bias in zip(self.tables, ready, self.bias, strict=True):
                width, span = len(t), WINDOW - len(t) + 1
                got = None
                for i, table in zip(range(0, width, 2), steps, strict=True):
                    at = pair[:, i : i + span] if i + 1 < width else part[:, i : i + span]
                    add = table.take(at, axis=0)
                    got = add if got is None else np.add(got, add, out=got)
                best.append(np.maximum(got.max(1) + bias, 0))
            z = np.hstack(best) @ self.weights + self.offset
            z = np.exp(z - z.max(1, keepdims=True))
            out[lo : lo + _PASS] = z / z.sum(1, keepdims=True)
        return out


def fit(texts: list[str], languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """A network from labelled texts; languages count alike, however many texts they
    have. Empty texts teach nothing; without any text every document is unknown."""
    rng = np.random.default_rng(seed)
    known = sorted({lang for t, lang in zip(texts, languages, strict=True) if t})
    width = sum(len(known) > 0 for _ in WIDTHS) * FILTERS
    net = Network(known, [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.1, (width or len(WIDTHS) * FILTERS, len(known))), np.zeros(len(known)))
    if len(known) < 2:
        return net
    by = []
    for lang in known:
        own = [t.encode() for t, x in zip(texts, languages, strict=True) if x == lang and t]
        by.append((np.frombuffer(b"".join(own), np.uint8), np.append(0, np.cumsum([len(t) for t in own]))))
    params = [*net.tables, *net.bias, net.weights, net.offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    each = -(-BATCH // len(known))
    y = np.repeat(np.arange(len(known)), each)
    rows = np.arange(len(y))
    for step in range(1, steps + 1):
        x = np.zeros((len(y), WINDOW), np.uint8)
        for i, (flat, offs) in enumerate(by):
            doc = rng.integers(0, len(offs) - 1, each)
            # window starts as in prediction: multiples of the window's size
            start = offs[doc] + rng.integers(0, -(-(offs[doc + 1] - offs[doc]) // WINDOW)) * WINDOW
            at = start[:, None] + np.arange(WINDOW)
            inside = at < offs[doc + 1][:, None]
            x[i * each : (i + 1) * each] = np.where(inside, flat[np.minimum(at, len(flat) - 1)], 0)
        place, hidden = [], []
        for t, b in zip(net.tables, net.bias, strict=True):
            span = WINDOW - len(t) + 1
            h = sum(t[j].take(x[:, j : j + span], axis=0) for j in range(len(t)))
            top = h.argmax(1)
            place.append(top)
            hidden.append(np.take_along_axis(h, top[:, None], 1)[:, 0] + b)
        raw = np.hstack(hidden)
        a = np.maximum(raw, 0)
        z = a @ net.weights + net.offset
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p.copy()
        d[rows, y] -= 1
        d /= len(y)
        back = (d @ net.weights.T) * (raw > 0)
        grads = []
        for i, (t, top) in enumerate(zip(net.tables, place, strict=True)):
            g, own = np.zeros_like(t), back[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(len(t)):
                np.add.at(g[j], (x[rows[:, None], top + j], np.arange(FILTERS)[None]), own)
            grads.append(g)
        grads += [back[:, i * FILTERS : (i + 1) * FILTERS].sum(0) for i in range(len(WIDTHS))]
        grads += [a.T @ d + 1e-4 * net.weights, d.sum(0)]
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """A network from documents with a language whose crc32(id as text) mod 4 isn't 2: of
    each language a sample by hash, of distinct whole texts, about ``SAMPLE`` of them and
    ``SAMPLE_BYTES``, fewer where many languages would exceed ``SAMPLE_ALL``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text != ''")
    rows = rows.where(~held_out("id"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    kinds = sizes.count()
    if not kinds:
        return fit([], [])
    shares = sizes.select("lang", F.least(F.lit(min(SAMPLE, SAMPLE_ALL / kinds)) / F.col("n"), F.lit(SAMPLE_BYTES * min(1.0, SAMPLE_ALL / SAMPLE / kinds)) / F.col("bytes")).alias("share"))
    mark = F.xxhash64("text", F.lit(17))
    chosen = rows.join(checked(shares, kinds), "lang").where(F.pmod(mark, F.lit(1 << 30)) / float(1 << 30) < F.col("share")).select("text", "lang", mark.alias("h")).distinct()
    # bounded by the shares, up to chance: equal texts are one row
    got = chosen.collect()
    got.sort(key=lambda r: (r.h, r.lang, r.text))
    return fit([r.text for r in got], [r.lang for r in got])


def held_out(col: str):
    """Whether crc32(id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, net: Network, text_col: str = "text", keep: list[str] | None = None, least: float | None = None) -> DataFrame:
    """``keep`` (all columns by default) with ``lang_pred`` and ``score`` in place of any
    such columns; with ``least``, only the documents with a known language and at least
    this score, without these columns.

    Every byte of the text counts. Null texts and texts without letters are ``und`` with
    score 0. Equal texts score alike. An empty table gives no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if least is not None or c.lower() not in ("lang_pred", "score")]
    rows = numbered(small_batches(docs), keep, text=F.col(text_col).cast("string"), letters=F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    names = np.array([*net.languages, UNKNOWN], object)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = net.prepare()
        for batch in batches:
            buf, offs = column(batch, "text")
            real = batch.column(batch.schema.get_field_index("letters")).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in passes(offs):
                known = real[lo:hi] & (len(net.languages) > 0)
                n = hi - lo
                mean = np.zeros((n, len(names)))
                if known.any():
                    x, filled, bounds = _windows(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    sums = np.zeros((len(x) + 1, len(net.languages)))
                    np.cumsum(net.windows(x, ready) * filled[:, None], axis=0, out=sums[1:])
                    total = np.maximum(1, np.diff(offs[lo : hi + 1]))
                    mean[:, :-1] = (sums[bounds[1:]] - sums[bounds[:-1]]) / total[:, None]
                which = np.where(known, mean.argmax(1), len(names) - 1)
                score = np.where(known, np.clip(mean.max(1), 0, 1), 0.0)
                part = pa.RecordBatch.from_arrays(batch.slice(lo, n).columns[: len(keep)], names=keep)
                if least is not None:
                    yield part.filter(pa.array(known & (score >= least)))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[which].tolist(), pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    made = [] if least is not None else [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return rows.mapInArrow(judge, StructType([*docs.select(*quoted(keep)).schema.fields, *made]))
