"""One search request from its text to its hits, with diagnostics.

The active run is resolved once; the text is planned into soft constraints; explicit
filters win over planned ones on the same field and are never relaxed. The search is one
job: candidates and relaxation passes are counted by an observation of the rows that it
scans, and only a pass beyond the first takes a second one. The k hits come to the driver.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..operators import intervals, predicates, search
from . import answers, planning
from .runs import Runs

PARSERS = ("none", "rules", "response")
RELAXATIONS = ("off", "diagnose_only", "auto_soft")


@dataclass(frozen=True)
class Planned:
    """A soft constraint of a parser: a value as filters take it."""

    field: str
    value: Any
    source: str
    confidence: float


@dataclass(frozen=True)
class Request:
    query: list[float]
    top_k: int = 10
    text: str = ""
    filters: Mapping[str, Any] = field(default_factory=dict)
    parser: str = "none"
    #: The answer of a language model, for the parser ``response``.
    answer: str | None = None
    strategy: str = "prefilter"
    least: int = 1
    relaxation: str = "off"
    semantic_only: bool = False
    #: Hits of one key whose spans are at most so far apart become one.
    merge_gap: float | None = None
    #: Hits that are fetched before merging, if that is more than top_k.
    wide: int = 200


@dataclass(frozen=True)
class Store:
    """What a request searches: rows with vectors and all fields that the registry names
    with their kinds, the rules of the planner, and the run that the rows belong to."""

    rows: DataFrame
    registry: Mapping[str, str]
    rules: DataFrame | None = None
    id_col: str = "vec_id"
    vector_col: str = "embedding"
    run_id: str | None = None

    @staticmethod
    def active(runs: Runs, dataset: str, registry: Mapping[str, str], **options) -> Store:
        """The active run of a dataset, resolved now: later activations don't change it."""
        run = runs.active(dataset)
        return Store(runs.rows(dataset, run), registry, run_id=run, **options)


def parsed_answer(spark: SparkSession, raw: str, registry: Mapping[str, str], known: set[str]) -> tuple[list[Planned], str | None]:
    """The constraints of one answer, and the reason if it has none to give."""
    row = answers.checked(spark.createDataFrame([(0, raw)], "query_id int, raw string"), registry, known).first()
    shown = {"eq": lambda c: c.text if c.flag is None else c.flag, "gte": lambda c: {"min": c.low}, "lte": lambda c: {"max": c.high}, "range": lambda c: [c.low, c.high]}
    return [Planned(c.field, shown[c.operator](c), "llm_parser", c.confidence) for c in row.constraints], row.failure


def planned(spark: SparkSession, request: Request, store: Store) -> tuple[list[Planned], dict[str, Any]]:
    """Soft constraints of the text and what the planner tells: parser, reason of a failure
    (the text then stays unparsed), fields that the data lacks."""
    if request.parser not in PARSERS:
        raise ValueError(f"{request.parser} is no parser")
    known = {f for f in store.registry if f in store.rows.columns}
    told: dict[str, Any] = {"parser": request.parser, "failure": None, "dropped": []}
    if request.parser == "none" or (request.parser == "rules" and store.rules is None):
        return [], told
    if request.parser == "response":
        found, failure = parsed_answer(spark, request.answer or "", store.registry, known)
        return found, told | ({"parser": "none", "failure": failure} if failure else {})
    one = spark.createDataFrame([(0, request.text)], "query_id int, text string")
    # a row per concept of one text
    found = planning.most_specific(planning.matched(one, store.rules)).groupBy("field").agg(F.max("least").alias("least")).orderBy("field").collect()
    told["dropped"] = [r.field for r in found if r.field not in known]
    value = lambda r: True if store.registry[r.field] == "boolean" else {"min": r.least}
    return [Planned(r.field, value(r), "rules_parser", planning.RULES_CONFIDENCE) for r in found if r.field in known], told


def merged_filters(soft: list[Planned], explicit: Mapping[str, Any]) -> dict[str, Any]:
    """Planned filters with explicit ones in their place on the same field."""
    return {p.field: p.value for p in soft} | dict(explicit)


def _constraints(request: Request, soft: list[Planned], registry: Mapping[str, str]) -> list[planning.Constraint]:
    explicit = predicates.predicates(registry, request.filters)
    out = [planning.Constraint(p.field, predicates.condition([p]), "explicit_request", hard=True) for p in explicit]
    for p in soft:
        if p.field not in request.filters:
            out += [planning.Constraint(q.field, predicates.condition([q]), p.source, p.confidence) for q in predicates.predicates(registry, {p.field: p.value})]
    return out


#: Seconds after which counts that a search did not tell are counted apart.
PATIENCE_S = 5.0


def _told(passed: Observation, patience: float) -> dict[str, int] | None:
    """What was observed; None if nothing is: a plan that Spark found to be empty has lost
    its observation, and waiting for it would never end."""
    future, until = passed._jo.future(), time.monotonic() + patience
    while not future.isCompleted():
        if time.monotonic() > until:
            return None
        time.sleep(0.01)
    return passed.get


def run(spark: SparkSession, request: Request, store: Store, key_col: str | None = None, **options) -> tuple[DataFrame, dict[str, Any]]:
    """The hits in their order (all columns but the vector, dist and rank; or merged spans)
    and the diagnostics: run, plan, passes with their counts, the pass taken, candidates,
    hits, whether and why there are fewer than asked for, and whether all satisfy the
    filters."""
    if request.relaxation not in RELAXATIONS:
        raise ValueError(f"{request.relaxation} is no kind of relaxation")
    soft, told = planned(spark, request, store)
    constraints = _constraints(request, soft, store.registry)
    # hits never exceed top_k, so more can't be enough
    policy = planning.Relaxation(request.least if request.least <= request.top_k else 1 << 62, semantic_only=request.semantic_only)
    steps = dict(planning.ladder(constraints, policy))
    told_passes = request.relaxation != "off"
    counted = steps if told_passes else {1: steps[1]}
    fetch = max(request.wide, request.top_k) if request.merge_gap is not None else request.top_k
    if request.merge_gap is not None and key_col is None:
        raise ValueError("merging needs the column that spans belong to")

    def hits_of(rows: DataFrame, kept: Column) -> list:
        found = search.search(rows, request.query, fetch, request.strategy, kept, id_col=store.id_col, vector_col=store.vector_col, **options)
        # as many rows as were asked for
        return found.drop(store.vector_col).withColumn("_ok", F.coalesce(kept, F.lit(False))).collect()

    # what no pass keeps is filtered at the scan, unless the filter comes after the search
    base = store.rows if request.strategy == "postfilter" else store.rows.where(planning.all_of(counted[max(counted)]))
    passed = Observation()
    counts = [F.count_if(planning.all_of(kept)).alias(f"p{n}") for n, kept in counted.items()]
    found = hits_of(base.observe(passed, *counts), planning.all_of(steps[1]))
    seen = _told(passed, PATIENCE_S if found else 0.2)
    if seen is None:
        seen = base.agg(*counts).first().asDict()
    matching = {n: seen[f"p{n}"] for n in counted}
    passes = [{"pass": n, "kept": len(kept), "matching": matching[n], "enough": matching[n] >= policy.least} for n, kept in counted.items()]
    best = next((p["pass"] for p in passes if p["enough"]), max(counted))
    taken = best if request.relaxation == "auto_soft" else 1
    if taken != 1:
        found = hits_of(base, planning.all_of(steps[taken]))
    schema = StructType([*store.rows.drop(store.vector_col).schema.fields, StructField("dist", DoubleType())])
    correct = all(r["_ok"] for r in found)
    hits = spark.createDataFrame([tuple(r[n] for n in schema.names) for r in found], schema)
    if request.merge_gap is not None:
        spans = intervals.merged(hits, key_col, request.merge_gap, 1 - F.col("dist"))
        hits = spans.orderBy(F.desc("score"), key_col, "t_start").limit(request.top_k)
        rows = [tuple(r) for r in hits.collect()]
    else:
        rows = [tuple(r[n] for n in hits.columns) for r in found]
    made = spark.createDataFrame([(*r, i + 1) for i, r in enumerate(rows)], StructType([*hits.schema.fields, StructField("rank", IntegerType())]))
    candidates = matching[taken]
    short = len(rows) < request.top_k
    reason = None if not short else "candidate_shortage" if candidates < request.top_k else "merged" if request.merge_gap is not None else "filter_loss"
    diagnostics = {
        "run_id": store.run_id,
        "plan": told,
        "filters": merged_filters(soft, request.filters),
        "passes": passes if told_passes else [],
        "selected_pass": best if told_passes else None,
        "applied_pass": taken,
        "candidate_count": candidates,
        "returned_count": len(rows),
        "underfilled": short,
        "underfilled_reason": reason,
        "filter_correct": correct,
    }
    return made, diagnostics
