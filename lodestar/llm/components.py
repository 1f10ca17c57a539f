"""Connected components of an edge table, by alternating star contractions.

Each round joins every edge with the least neighbour of its node; least neighbours
are a grouped minimum, aggregated before the exchange, so a node with very many
edges costs one row a task. They are written before the join, which then reads both
its sides as they were dealt and is split where one node has very many edges. Rounds
end when the edges no longer change; each is written to the shared folder, so lineage
stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, materialize


def _star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """One contraction: edges (u, v), u > v, linked to the least node seen from u."""
    both = edges.union(edges.select("v", "u"))
    least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u > v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return small.where("u > v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch | None = None, limit: int = 60) -> DataFrame:
    """For edges (u, v) of any orderable type: every node that has an edge to another
    node (``node``) with the least node of its component (``root``). Loops, repeated
    edges and nulls add nothing; no edges give no rows. Tables on the way go to
    ``scratch``, if given, the result with them."""
    pair = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    with Scratch(edges.sparkSession) as rounds:
        now, seen = rounds.table(pair, "edges"), None
        for _ in range(limit):
            mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if mark == seen or not mark[0]:
                break
            seen, now = mark, rounds.table(_star(now, rounds), "edges")
        else:
            raise RuntimeError("components did not settle")
        out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        return scratch.table(out, "components") if scratch else materialize(out, "components")
