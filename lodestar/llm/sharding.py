"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows of each partition go to each target follows the law that a uniform random
permutation would give: a row of the matrix is a multivariate hypergeometric draw. A
partition permutes its rows, sends the drawn numbers to the targets, and each target
permutes what it got. All permutations of all rows are equally likely, and the targets'
sizes are exact.

The matrix is never in one place: partitions are halved again and again, each halving
draws what its left half gets from a seed of its own, and a task follows the halvings
down to its partition. The driver knows one count per partition. A shard is cut into
several targets, so that a task never holds a whole shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .shared import fresh, materialize, numbered, quoted, small_batches

#: Rows of a target, and bytes of text in it on the average; more, if there would be over
#: MAX_TARGETS: a target's sort then spills.
BLOCK_ROWS, BLOCK_BYTES, MAX_TARGETS = 16_384, 32 << 20, 1 << 16


def _rise(x: float, by: float) -> float:
    """log((x + by)! / x!), by Stirling's series on the quotient: a difference of two
    log-factorials would lose the last digits of large numbers."""
    if min(x, x + by) < 1000:
        return math.lgamma(x + by + 1) - math.lgamma(x + 1)
    y = x + by
    return (x + 0.5) * math.log1p(by / x) + by * math.log(y) - by + (1 / y - 1 / x) / 12 - (1 / y**3 - 1 / x**3) / 360


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn from ``good`` and ``bad`` are good, at any size: by
    ratio of uniforms (Stadlober 1990), a rejection from a table mountain hat."""
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mean = n * (good / total)
    variance = mean * (bad / total) * ((total - n) / (total - 1))
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(variance + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u = 1 - rng.random()
        k = math.floor(mean + 0.5 + width * (rng.random() - 0.5) / u)
        if k < low or k > high:
            continue
        d = k - mode
        # log of the probability of k over that of the mode
        ratio = -(_rise(mode, d) + _rise(good - mode, -d) + _rise(n - mode, -d) + _rise(bad - n + mode, d))
        if 2 * math.log(u) <= ratio:
            return k


def _draw(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows go to each target, of which ``room`` are free."""
    total, rest, out = int(room.sum()), n, np.zeros(len(room), np.int64)
    for i, own in enumerate(room.tolist()):
        out[i] = rest if own == total else hypergeometric(rng, own, total - own, rest)
        rest, total = rest - int(out[i]), total - own
        if not rest:
            break
    return out


class Deal:
    """The matrix, row by row: partitions with ``counts`` rows, targets with ``room``."""

    def __init__(self, counts: list[int], room: list[int], seed: int):
        self.before, self.room, self.seed = np.append(0, np.cumsum(counts)).astype(np.int64), np.array(room, np.int64), seed
        self._left: dict[tuple[int, int], np.ndarray] = {}

    def row(self, p: int) -> np.ndarray:
        lo, hi, room = 0, len(self.before) - 1, self.room
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if (lo, hi) not in self._left:
                if len(self._left) > 256:
                    self._left.clear()
                self._left[lo, hi] = _draw(np.random.default_rng([self.seed, lo, hi]), room, int(self.before[mid] - self.before[lo]))
            left = self._left[lo, hi]
            lo, hi, room = (lo, mid, left) if p < mid else (mid, hi, room - left)
        return room

    def place(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of the partition its target, and a key by which the target
        permutes what it gets."""
        rng = np.random.default_rng([self.seed, p])
        n = int(self.before[p + 1] - self.before[p])
        target = np.repeat(np.arange(len(self.room)), self.row(p))[rng.permutation(n)]
        return target, rng.integers(np.iinfo(np.int64).min, np.iinfo(np.int64).max, n)


def targets(rows: int, shards: int, block_rows: int = BLOCK_ROWS) -> tuple[list[int], list[int], list[int]]:
    """Room, shard and first slot of each target: shards differ by one row at most."""
    block_rows = max(1, block_rows, -(-rows // MAX_TARGETS))
    room, shard, base = [], [], []
    for s in range(shards):
        own = rows // shards + (s < rows % shards)
        parts = max(1, -(-own // block_rows))
        sizes = [own // parts + (i < own % parts) for i in range(parts)]
        room += sizes
        shard += [s] * parts
        base += np.append(0, np.cumsum(sizes[:-1])).astype(int).tolist()
    return room, shard, base


def shuffle(docs: DataFrame, shards: int = 8, seed: int = 20240229, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (from 0) and ``slot`` (gapless from
    0 within the shard); columns of ``docs`` with these names, in any case, are replaced.

    Rows are shuffled as they are: nulls, empty texts and repeated rows each keep a slot
    of their own. Shards may be empty if there are fewer rows; an empty table gives none.
    Equal stored input and seed give the same places.
    """
    docs = small_batches(docs).select(*quoted([c for c in docs.columns if c.lower() not in ("shard", "slot")]))
    keep = docs.columns
    part, place = fresh("_part", keep), fresh("_place", keep)
    # written with their places: a task that runs again finds the same rows there
    placed = docs.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    stored = materialize(placed, "numbered")
    texts = [c for c, f in zip(quoted(keep), docs.schema, strict=True) if isinstance(f.dataType, StringType | BinaryType)]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0).cast("long"))
    # a row per partition
    counts = sorted((r[0], r[1], r[2]) for r in stored.groupBy(part).agg(F.count("*"), F.sum(size)).collect())
    rows, total = sum(n for _, n, _ in counts), sum(b for _, _, b in counts)
    number = {p: i for i, (p, _, _) in enumerate(counts)}
    fit = min(block_rows, max(1, rows * BLOCK_BYTES // max(1, total)))
    room, shard, base = (np.array(x, np.int64) for x in targets(rows, shards, fit))
    deal = Deal([n for _, n, _ in counts], room.tolist(), seed)
    to_name, base_name, key_name = (fresh(n, keep) for n in ("_to", "_base", "_key"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, target, key = None, None, None
        for batch in batches:
            own, at = (batch.column(len(keep) + i).to_numpy() for i in range(2))
            to, by = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for p in np.unique(own).tolist():
                if p != known:
                    known, (target, key) = p, deal.place(number[p])
                mine = own == p
                to[mine], by[mine] = target[at[mine]], key[at[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(shard[to].astype(np.int32)), pa.array(to), pa.array(base[to]), pa.array(by)], names=[*keep, "shard", to_name, base_name, key_name])

    made = [StructField("shard", IntegerType()), *(StructField(n, LongType()) for n in (to_name, base_name, key_name))]
    sent = numbered(stored, keep, part=F.col(part), place=F.col(place)).mapInArrow(send, StructType([*docs.schema.fields, *made]))
    # a target a task: hashed, several could meet in one; its sizes are exact, so a row's
    # number in its sorted partition is its place
    dealt = sent.repartitionById(max(1, len(room)), F.col(to_name).cast("int")).sortWithinPartitions(key_name)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("slot", F.col(base_name) + row).select(*quoted(keep), "shard", "slot")
