"""Answers of a language model, checked where they lie: JSON as variants, constraints
against a table of rules. Whatever an answer holds, it gives constraints or a reason why it
has none; it never raises."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE = 0.6
_NUMBERS = ("float", "integer", "circular")
#: Which values (shape) an operator takes on a field of each kind.
RULES = [(k, o, s) for k in _NUMBERS for o, s in (("gte", "number"), ("lte", "number"), ("range", "pair"))] + [("keyword", "eq", "text"), ("boolean", "eq", "flag")]
_CONSTRAINT = "struct<field: string, operator: string, low: double, high: double, text: string, flag: boolean, confidence: double>"


def _get(v: str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, F.lit(path), kind)


def _is(v: Column, what: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(what), F.lit(False))


def checked(answers: DataFrame, registry: Mapping[str, str], known: Collection[str]) -> DataFrame:
    """For answers (query_id, raw): query_id, failure (null if there is none) and
    constraints. A constraint on a field outside the registry, an operator or value that
    its kind doesn't take, a range of two bounds in the wrong order, or a confidence that is
    no number fails the answer; fields that the data lacks (not in ``known``) are left out;
    an answer without constraints is fine."""
    spark = answers.sparkSession
    fields = spark.createDataFrame([(f, k, f in known) for f, k in registry.items()] or [(None, None, False)], "field string, kind string, there boolean")
    rules = spark.createDataFrame(RULES, "kind string, operator string, shape string")
    told = answers.select("query_id", F.try_parse_json("raw").alias("v")).withColumn("all", _get("v", "$.constraints", "variant")).withColumn("list", _get("v", "$.constraints", "array<variant>"))
    whole = F.when(F.col("v").isNull(), "the answer is no JSON").when(~_is(F.col("v"), "OBJECT"), "the answer is no object").when(F.col("all").isNotNull() & F.col("list").isNull(), "constraints are no list")
    each = told.select("query_id", whole.alias("whole"), F.posexplode_outer("list").alias("at", "c"))
    read = each.select(
        "query_id",
        "whole",
        "at",
        (F.col("at").isNotNull() & ~_is(F.col("c"), "OBJECT")).alias("odd"),
        _get("c", "$.field", "string").alias("field"),
        _get("c", "$.operator", "string").alias("operator"),
        _get("c", "$.value", "variant").alias("value"),
        _get("c", "$.confidence", "variant").alias("_c"),
        _get("c", "$.confidence", "double").alias("confidence"),
    )
    number = F.when(~_is(F.col("value"), "BOOLEAN"), _get("value", "$", "double"))
    pair = _get("value", "$", "array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    text = F.when(_is(F.col("value"), "STRING"), _get("value", "$", "string"))
    flag = F.when(_is(F.col("value"), "BOOLEAN"), _get("value", "$", "boolean"))
    # a row per field of the registry, and a handful of rules
    met = read.join(F.broadcast(fields), "field", "left").join(F.broadcast(rules), ["kind", "operator"], "left")
    low, high = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
    ordered = (F.col("kind") == "circular") | (low <= high)
    fits = F.when(F.col("shape") == "number", finite(number)).when(F.col("shape") == "pair", (F.size(pair) == 2) & finite(low) & finite(high) & ordered).when(F.col("shape") == "text", text.isNotNull()).when(F.col("shape") == "flag", flag.isNotNull())
    name = F.coalesce(F.col("field"), F.lit("null"))
    wrong = (
        F.when(F.col("whole").isNotNull(), F.col("whole"))
        .when(F.col("at").isNull(), F.lit(None).cast("string"))
        .when(F.col("odd"), F.lit("a constraint is no object"))
        .when(F.col("kind").isNull(), F.concat(name, F.lit(" is no field")))
        .when(~F.col("there"), F.lit(None).cast("string"))
        .when(F.col("shape").isNull(), F.concat(name, F.lit(" doesn't take "), F.coalesce(F.col("operator"), F.lit("no operator"))))
        .when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("the value of "), name, F.lit(" is none for "), F.col("operator")))
        .when(F.col("_c").isNotNull() & ~F.coalesce(finite(F.col("confidence")), F.lit(False)), F.concat(F.lit("the confidence of "), name, F.lit(" is no number")))
    )
    least = F.when(F.col("shape") == "pair", low).when(F.col("operator") == "gte", number)
    most = F.when(F.col("shape") == "pair", high).when(F.col("operator") == "lte", number)
    made = F.struct("field", "operator", least.alias("low"), most.alias("high"), text.alias("text"), flag.alias("flag"), F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence")).cast(_CONSTRAINT)
    rows = met.select("query_id", "at", wrong.alias("wrong"), F.when(F.col("there"), made).alias("made"))
    # an answer's constraints are few: they stand in one row
    out = rows.groupBy("query_id").agg(F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.coalesce("at", F.lit(-1)))).alias("failure"), F.sort_array(F.collect_list(F.when(F.col("made").isNotNull(), F.struct("at", "made")))).alias("m"))
    none = F.array().cast(f"array<{_CONSTRAINT}>")
    return out.select("query_id", "failure", F.when(F.col("failure").isNull(), F.transform("m", lambda x: x["made"])).otherwise(none).alias("constraints"))
