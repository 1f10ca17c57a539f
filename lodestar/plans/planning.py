"""Planning of a query: concepts in its text become soft constraints, constraints become
filters, and filters are relaxed in passes until enough rows match.

Concepts and synonyms are tables, so that one query or a table of queries is planned by
joins. All passes of the relaxation are counted in one scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import folded

#: Confidence of constraints that come from rules.
RULES_CONFIDENCE = 0.9
#: Soft constraints below this confidence go in the second and third pass.
LOW_CONFIDENCE = 0.7

# Concept, family, field, specificity, and the words that name it.
CONCEPTS = (
    ("vehicle", "vehicle", "vehicle_count", 1, ("araç", "araçlar", "taşıt", "taşıtlar", "otomobil", "otomobiller", "araba", "arabalar", "vehicle", "vehicles", "car", "cars", "automobile", "automobiles")),
    ("bus", "vehicle", "bus_count", 2, ("otobüs", "otobüsler", "bus", "buses")),
    ("truck", "vehicle", "vehicle_count", 2, ("kamyon", "kamyonlar", "kamyonet", "kamyonetler", "truck", "trucks")),
    ("person", "person", "person_count", 1, ("insan", "insanlar", "kişi", "kişiler", "yaya", "yayalar", "adam", "adamlar", "person", "people", "pedestrian", "pedestrians")),
    ("night", "lighting", "is_night", 1, ("gece", "night", "nighttime")),
)


# Fixed value: a number before a concept, and the word after it.
AT_LEAST = r"(?:en az|at least)\s+(\d+)\s+(\S+)"


# What a text says, in two languages, and the condition that it means.
SAID = (
    (r"otobüs|\bbus(es)?\b", "bus_count", ">=", 1),
    (r"kamyon|\btrucks?\b", "truck_count", ">=", 1),
    (r"araba|araç|otomobil|\bcars?\b|\bvehicles?\b", "car_count", ">=", 1),
    (r"insan|adam|yaya|kişi|\bperson\b|\bpeople\b|\bpedestrians?\b", "person_count", ">=", 1),
    (r"gece|\bnight\b", "is_night", "=", 1),
    (r"gündüz|\bday(time)?\b", "is_night", "=", 0),
    (r"kalabalık|\bcrowd(ed)?\b", "person_count", ">=", 10),
)
#: Thresholds that a text names, after those.
COUNTED = (
    (r"en az (\d+) (?:araba|araç)|at least (\d+) cars?", "car_count"),
    (r"en az (\d+) (?:kişi|yaya)|at least (\d+) (?:people|persons?|pedestrians?)", "person_count"),
)


def said(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """The conditions that each text means, whatever its case: query, place (their order),
    field, operator, value. Several on one field all hold. Texts without any have no row."""
    text = F.col(text_col)
    any_case = lambda p: f"(?iU)(?:{p})"
    hits = [F.when(text.rlike(any_case(p)), F.struct(F.lit(field).alias("field"), F.lit(op).alias("operator"), F.lit(value).cast("long").alias("value"))) for p, field, op, value in SAID]
    for p, field in COUNTED:
        number = F.coalesce(*(F.nullif(F.regexp_extract(text, any_case(p), i), F.lit("")) for i in (1, 2))).try_cast("long")
        hits.append(F.when(number.isNotNull(), F.struct(F.lit(field).alias("field"), F.lit(">=").alias("operator"), number.alias("value"))))
    return queries.select(id_col, F.posexplode(F.array_compact(F.array(*hits))).alias("place", "c")).select(id_col, "place", "c.*")


def concepts(spark: SparkSession) -> DataFrame:
    """A row per synonym: concept, family, field, specificity, word."""
    rows = [(c, f, field, s, w) for c, f, field, s, words in CONCEPTS for w in words]
    return spark.createDataFrame(rows, "concept string, family string, field string, specificity int, word string")


def matched(queries: DataFrame, rules: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """Concepts whose words stand in each query as whole words: query, concept, family,
    field, specificity, least (1, or the number after "at least" before such a word)."""
    queries = queries.select(id_col, folded(text_col).alias("_text"))
    text = F.col("_text")
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    own = queries.select(id_col, F.explode(words).alias("word"))
    # the rules are a table of fixed size
    hit = own.join(F.broadcast(rules), "word").select(id_col, "concept", "family", "field", "specificity").distinct()
    groups = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(AT_LEAST), F.lit(i)).alias(n) for i, n in ((1, "least"), (2, "tail"))))
    numbers = queries.select(id_col, F.explode(groups).alias("g")).select(id_col, F.col("g.least").try_cast("int").alias("least"), "g.tail")
    counted = numbers.join(F.broadcast(rules.select("concept", "word")), F.col("tail").contains(F.col("word"))).groupBy(id_col, "concept").agg(F.max("least").alias("least"))
    return hit.join(counted, [id_col, "concept"], "left").withColumn("least", F.coalesce("least", F.lit(1)))


def most_specific(found: DataFrame, by: Sequence[str] = ("query_id", "family")) -> DataFrame:
    """Within a family only the most specific concepts stay; ties all do."""
    best = F.rank().over(Window.partitionBy(*by).orderBy(F.desc("specificity")))
    return found.withColumn("_r", best).where("_r = 1").drop("_r")


def covered(constraints: DataFrame, registry: DataFrame, field: str = "field") -> DataFrame:
    """All constraints, with whether the registry has their field."""
    known = registry.select(field).distinct().withColumn("covered", F.lit(True))
    return constraints.join(known, field, "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def tightest(constraints: DataFrame, by: Sequence[str] = ("query_id", "field")) -> DataFrame:
    """One range for each field: the greatest low and the least high bound."""
    return constraints.groupBy(*by).agg(F.max("low").alias("low"), F.min("high").alias("high"))


@dataclass(frozen=True)
class Constraint:
    """A condition, where it comes from (explicit_request, trusted_telemetry,
    detector_derived, rules_parser, llm_parser), and whether it may be dropped."""

    name: str
    condition: Column
    source: str
    confidence: float = 1.0
    hard: bool = False

    @property
    def relaxable(self) -> bool:
        return not self.hard and self.source != "explicit_request"


@dataclass(frozen=True)
class Relaxation:
    least: int = 1
    passes: int = 5
    semantic_only: bool = False


def ladder(constraints: Sequence[Constraint], policy: Relaxation = Relaxation()) -> list[tuple[int, list[Constraint]]]:
    """The constraints that each pass keeps: all; without uncertain detector values;
    without uncertain parser values; hard ones only; what the user asked for only."""
    hard = [c for c in constraints if not c.relaxable]
    soft = [c for c in constraints if c.relaxable]
    steps = [(1, [*hard, *soft])]
    sources = ((2, ("detector_derived",)), (3, ("rules_parser", "llm_parser")))
    for number, which in sources:
        soft = [c for c in soft if not (c.source in which and c.confidence < LOW_CONFIDENCE)]
        steps.append((number, [*hard, *soft]))
    steps.append((4, hard))
    if policy.semantic_only:
        steps.append((5, [c for c in hard if c.source == "explicit_request"]))
    return [s for s in steps if s[0] <= policy.passes]


def all_of(kept: Sequence[Constraint]) -> Column:
    return reduce(Column.__and__, (F.coalesce(c.condition, F.lit(False)) for c in kept), F.lit(True))


def relaxation_counts(rows: DataFrame, constraints: Sequence[Constraint], policy: Relaxation = Relaxation()) -> DataFrame:
    """A row per pass: pass, matching rows, enough; and whether it is the pass to take,
    the first with enough rows, or else the last. One scan counts all passes."""
    steps = ladder(constraints, policy)
    counted = rows.agg(F.array(*(F.struct(F.lit(n).alias("pass"), F.lit(len(kept)).alias("kept"), F.count_if(all_of(kept)).alias("matching")) for n, kept in steps)).alias("p"))
    long = counted.select(F.explode("p").alias("e")).select("e.*").withColumn("enough", F.col("matching") >= policy.least)
    everything = Window.partitionBy(F.lit(1))  # a row per pass
    first = F.min(F.when(F.col("enough"), F.col("pass"))).over(everything)
    return long.withColumn("selected", F.col("pass") == F.coalesce(first, F.max("pass").over(everything)))


def relaxed(rows: DataFrame, constraints: Sequence[Constraint], policy: Relaxation = Relaxation()) -> tuple[DataFrame, int]:
    """Rows that satisfy the pass to take, and its number."""
    chosen = relaxation_counts(rows, constraints, policy).where("selected").select("pass").first()[0]
    return rows.where(all_of(dict(ladder(constraints, policy))[chosen])), chosen


def needs_rerank(margin: Column, returned: Column, least_margin: float = 0.05, least: int = 2) -> Column:
    """Whether the best hit's lead is too small to trust."""
    return (returned >= least) & (margin < least_margin)
