"""Quality checks of answers, their scores, and the report over many answers.

A check is a row ``check_type, score, passed``; the checks of many answers form one long table
with an answer's key beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    BAND_ADVICE,
    CHECK_ADVICE,
    HIGH_SCORE,
    MEDIUM_SCORE,
    NO_ISSUE_ADVICE,
    NULL_SHARE_LIMIT,
    RECORD_TOLERANCE,
    RESPONSE_STYLES,
    SOURCE_COLUMNS,
    TECHNICAL_COLUMNS,
)
from ..functions.text import issue_advice
from ..session import shared_dir
from .profile import mean_null_share
from .questions import with_intent, with_second_opinion

CHECK = ["check_type", "score", "passed"]


# --- single checks ------------------------------------------------------------------------

def source_check(spark: SparkSession, source: str, columns: list[str]) -> DataFrame:
    """Whether a result has any column that its source would give. Looks at names only."""
    matched = bool(set(columns) & set(SOURCE_COLUMNS[source]))
    return spark.range(1).select(
        F.lit("data_source_consistency").alias("check_type"),
        F.lit(1.0 if matched else 0.5).alias("score"),
        F.lit(matched).alias("passed"),
    )


def unknown_brands(result: DataFrame, sales: DataFrame, specs: DataFrame) -> DataFrame:
    """Brands of a result that neither the sales nor the specification table has."""
    known = sales.select("brand").union(specs.select("brand")).distinct()
    return result.select("brand").distinct().join(known, "brand", "left_anti")


def cross_reference(result: DataFrame, sales: DataFrame, specs: DataFrame,
                    expected: DataFrame | None = None) -> DataFrame:
    """One row: brands known, record count near the recorded one, score and pass.

    ``expected`` is an integrity record with ``sales_records``.
    """
    return cross_references({"": result}, sales, specs, expected).drop("answer")


def cross_references(results: dict[str, DataFrame], sales: DataFrame, specs: DataFrame,
                     expected: DataFrame | None = None) -> DataFrame:
    """The cross reference of several results, by ``answer``.

    Each table is read once, for its rows per brand; a few rows per brand then answer for all
    results. A brand without a name is unknown wherever it stands.
    """
    counted = _tally(sales, "sales").unionAll(_tally(specs, "specs"))
    return _references(_with_results(counted, results, expected), results)


def _tally(df: DataFrame, name: str, answer: str | None = None, brand: str | None = "brand") -> DataFrame:
    """Rows and null cells per brand, or of the whole table where ``brand`` is none."""
    nulls = [F.col(c).isNull().cast("bigint") for c in df.columns] if answer is not None else []
    counts = [F.count(F.lit(1)).alias("n"), F.sum(sum(nulls, F.lit(0))).cast("bigint").alias("n_nulls")]
    counted = df.groupBy(brand).agg(*counts) if brand else df.agg(*counts)
    return counted.select(F.lit(answer).alias("answer"), F.lit(name).alias("what"),
                          (F.col(brand) if brand else F.lit(None)).cast("string").alias("brand"), "n", "n_nulls")


def _with_results(counted: DataFrame, results: dict[str, DataFrame], expected: DataFrame | None) -> DataFrame:
    """The tallies of the tables, of what was recorded, and of each result: one pass over each."""
    if expected is not None:
        counted = counted.unionAll(expected.select(
            F.lit(None).cast("string"), F.lit("expected"), F.lit(None).cast("string"),
            F.col("sales_records").cast("bigint"), F.lit(None).cast("bigint")))
    for answer, result in results.items():
        counted = counted.unionAll(
            _tally(result, "result", answer) if "brand" in result.columns else _tally(result, "other", answer, None))
    return counted


def _references(counted: DataFrame, answers) -> DataFrame:
    """The cross references from tallies per brand."""
    def of(name: str) -> Column:
        return F.sum(F.when(F.col("what") == name, F.col("n")))

    per_brand = counted.groupBy("brand").agg(
        *(of(name).alias(name) for name in ("sales", "specs", "expected")),
        # at most the number of results
        F.collect_set(F.when(F.col("what") == "result", F.col("answer"))).alias("answers"))
    known = F.col("brand").isNotNull() & (F.col("sales").isNotNull() | F.col("specs").isNotNull())

    def unknown(answer: str) -> Column:
        return F.count_if(F.array_contains("answers", answer) & ~known)

    row = per_brand.agg(
        F.coalesce(F.sum("sales"), F.lit(0)).alias("sales_records"),
        F.coalesce(F.sum("specs"), F.lit(0)).alias("specs_records"),
        F.sum("expected").alias("recorded"),
        F.array(*(F.struct(F.lit(a).alias("answer"), unknown(a).alias("unknown_brands"))
                  for a in answers)).alias("found"),
    )
    recorded = F.coalesce("recorded", "sales_records")
    filled = (F.col("sales_records") > 0) & (F.col("specs_records") > 0)
    return (
        row.select("*", F.inline("found"))
        .withColumn("brand_consistency", F.col("unknown_brands") == 0)
        .withColumn("record_integrity",
                    F.abs(F.col("sales_records") - recorded) <= recorded * RECORD_TOLERANCE)
        .select(
            "answer",
            F.lit("cross_reference").alias("check_type"),
            "brand_consistency", "record_integrity", "sales_records", "specs_records",
            F.when(filled, F.least(
                F.when(F.col("brand_consistency"), 0.8).otherwise(0.4)
                + F.when(F.col("record_integrity"), 0.2).otherwise(0.0),
                F.lit(1.0))).otherwise(0.5).alias("score"),
            (filled & F.col("brand_consistency") & F.col("record_integrity")).alias("passed"),
        )
    )


def answer_tallies(results: dict[str, DataFrame], tables, expected: DataFrame | None = None) -> DataFrame:
    """What the checks of several answers need of the data, as a small written table: rows per brand
    of the tables, and rows and null cells per brand of each result.

    Each result is read once. Specifications that are not stored are a projection of the sales
    rows, so these rows stand for both: a brand is in one where it is in the other, and no row is
    in neither.
    """
    counted = _tally(tables.sales_only, "sales")
    if tables.has_stored("specs_only"):
        counted = counted.unionAll(_tally(tables.specs_only, "specs"))
    counted = _with_results(counted, results, expected)
    folder = shared_dir(counted.sparkSession, "tallies")
    counted.coalesce(1).write.parquet(folder)
    counted = counted.sparkSession.read.schema(counted.schema).parquet(folder)
    if tables.has_stored("specs_only"):
        return counted
    return counted.unionAll(counted.filter("what = 'sales'").withColumn("what", F.lit("specs")))


def answer_checks(answers: dict, tables, expected: DataFrame | None = None,
                  compat: bool = False) -> DataFrame:
    """The checks of several answers that do not depend on the question's words.

    ``answers`` are pairs of spec and result by name; the rows are ``answer`` and a check each. The
    data is read here, once for each answer; what is returned reads the tallies only.
    """
    from ..plans.run import source_name
    from ..plans.spec import QuerySpec

    specs = {name: QuerySpec.of(spec) for name, (spec, _) in answers.items()}
    results = {name: result for name, (_, result) in answers.items()}
    counted = answer_tallies(results, tables, expected)
    # what is known of an answer by its names and types
    known = F.array(*(F.struct(
        F.lit(name).alias("answer"), F.lit(len(result.columns)).alias("width"),
        F.lit(has_required_columns(result.columns, specs[name].intent)).alias("required"),
        F.lit(_has_numbers(result)).alias("numeric")) for name, result in results.items()))
    totals = counted.filter(F.col("answer").isNotNull()).groupBy("answer").agg(
        F.sum("n").alias("record_count"), F.sum("n_nulls").alias("n_nulls"))
    facts = counted.sparkSession.range(1).select(F.inline(known)).join(totals, "answer", "left").select(
        "answer", "required", "numeric", F.coalesce("record_count", F.lit(0)).alias("record_count"),
        (F.col("n_nulls") / F.nullif(F.col("record_count") * F.col("width"), F.lit(0))).alias("null_share"))
    out = _references(counted, results).select("answer", *CHECK)
    out = out.unionByName(_completeness(facts, F.col("required"), F.col("numeric"), ("answer",)).select("answer", *CHECK))
    for name, result in results.items():
        check = source_check(result.sparkSession, source_name(specs[name], compat), result.columns)
        out = out.unionByName(check.select(F.lit(name).alias("answer"), *CHECK))
    return out


def intent_check(questions: DataFrame, text: str = "text",
                 submitted: str = "submitted_intent") -> DataFrame:
    """Add the check of the submitted intent against the classifier and the second opinion."""
    out = with_second_opinion(
        with_intent(questions, text).withColumnRenamed("intent", "reclassified_intent"), text)
    match = F.col(submitted) == F.col("reclassified_intent")
    both = match & (F.col(submitted) == F.col("expected_intent"))
    return (
        out.withColumn("check_type", F.lit("intent_accuracy"))
        .withColumn("score", F.when(both, 1.0).when(match, 0.7).otherwise(0.3))
        .withColumn("passed", match)
    )


def has_required_columns(columns: list[str], intent: str) -> bool:
    """Whether a result has the columns that an answer of that intent needs."""
    have = set(columns)
    if intent == "sales":
        return {"sales", "brand"} <= have
    if intent == "specification":
        return "model" in have or bool(have & {"fuel", "transmission", "cc"})
    return len(columns) > 1


def _has_numbers(result: DataFrame) -> bool:
    return any(isinstance(f.dataType, T.NumericType) for f in result.schema.fields)


def completeness(result: DataFrame, intent: str = "general") -> DataFrame:
    """One row: the completeness check of a result. Rows and nulls are counted in one pass."""
    shares = result.agg(
        F.count(F.lit(1)).alias("record_count"),
        mean_null_share(result.columns).alias("null_share"),
    )
    return _completeness(shares, F.lit(has_required_columns(result.columns, intent)), F.lit(_has_numbers(result)))


def _completeness(shares: DataFrame, required: Column, numeric: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """The check from ``record_count`` and ``null_share``."""
    filled = F.col("record_count") > 0
    few_nulls = F.col("null_share") < NULL_SHARE_LIMIT
    score = (
        F.lit(0.4) + F.when(required, 0.3).otherwise(0.0)
        + F.when(few_nulls, 0.2).otherwise(0.0) + F.when(numeric, 0.1).otherwise(0.0)
    )
    # tenths are added up; rounding keeps 0.7 from falling below itself
    score = F.round(F.when(filled, score).otherwise(0.0), 6)
    return shares.select(
        *keys,
        F.lit("result_completeness").alias("check_type"),
        "record_count",
        required.alias("has_required_columns"),
        (1.0 - F.col("null_share")).alias("data_quality_score"),
        numeric.alias("has_numeric_data"),
        score.alias("score"),
        (score >= 0.7).alias("passed"),
    )


def response_style(result: DataFrame, intent: str = "general",
                   operation: str = "query") -> DataFrame:
    """One row: the number of rows, and the style of an answer of that size and kind."""
    wide, technical, brief, versus, balanced = RESPONSE_STYLES
    n, n_columns = F.col("record_count"), len(result.columns)
    has_technical = bool(set(result.columns) & set(TECHNICAL_COLUMNS))
    style = (
        F.when((F.lit(n_columns) > 8) & (n > 50), wide)
        .when(F.lit(has_technical and intent == "specification"), technical)
        .when(n < 10, brief)
        .when(F.lit(operation == "comparison"), versus)
        .otherwise(balanced)
    )
    return result.agg(F.count(F.lit(1)).alias("record_count")).withColumn("response_style", style)


# --- from checks to scores and advice -----------------------------------------------------

def assess(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Per answer: the mean score, the checks, and the advice that follows from them."""
    scored = checks.groupBy(*keys).agg(
        # rounded, so that a mean of tenths does not depend on the order they are added in
        F.round(F.avg("score"), 9).alias("accuracy_score"),
        # one entry per kind of check
        F.sort_array(F.collect_list(F.struct(*CHECK))).alias("checks"),
    )
    return scored.withColumn("recommendations", advice(F.col("checks"), F.col("accuracy_score")))


def advice(checks: Column, accuracy: Column) -> Column:
    """Advice for failed checks, in the order of the checks, plus one line for the score band."""
    def failed(kind: str) -> Column:
        return F.exists(checks, lambda c: (c["check_type"] == kind) & ~c["passed"])

    per_check = [F.when(failed(kind), F.lit(line)) for kind, line in CHECK_ADVICE.items()]
    band = None
    for bound, line in BAND_ADVICE:
        low = accuracy < bound
        band = F.when(low, line) if band is None else band.when(low, line)
    return F.array_compact(F.array(*per_check, band))


def issue_recommendations(issues: Column) -> Column:
    """Advice for a list of issue texts; one default line where no rule fits any of them."""
    found = F.array_compact(F.transform(issues, issue_advice))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_ISSUE_ADVICE)))


def validate(spec, question: str, result: DataFrame, tables, expected: DataFrame | None = None,
             timestamp: Column | None = None, compat: bool = False) -> DataFrame:
    """One row: the four checks of one answer with score and advice."""
    from ..plans.spec import QuerySpec

    spec = QuerySpec.of(spec)
    asked = result.sparkSession.range(1).select(F.lit(question).alias("text"),
                                                F.lit(spec.intent).alias("submitted_intent"))
    checks = answer_checks({"": (spec, result)}, tables, expected, compat).drop("answer")
    checks = checks.unionByName(intent_check(asked).select(*CHECK))
    stamp = F.current_timestamp() if timestamp is None else timestamp
    return (
        assess(checks.withColumn("query", F.lit(question)), ["query"])
        .withColumn("timestamp", stamp).withColumn("intent", F.lit(spec.intent))
    )


# --- the report ---------------------------------------------------------------------------

def report_summary(results: DataFrame) -> DataFrame:
    """One row: answers, mean score, first and last time."""
    return results.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.round(F.avg("accuracy_score"), 6).alias("average_score"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def report_by_intent(results: DataFrame) -> DataFrame:
    return results.groupBy(F.initcap(F.coalesce("intent", F.lit("unknown"))).alias("intent")).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg("accuracy_score"), 6).alias("average_score"),
    )


def report_messages(results: DataFrame, column: str = "recommendations", k: int = 10) -> DataFrame:
    """The k most frequent messages of answers below the high score; equal counts by text."""
    return (
        results.filter(F.col("accuracy_score") < HIGH_SCORE)
        .select(F.explode(column).alias("message"))
        .groupBy("message").agg(F.count(F.lit(1)).alias("n_queries"))
        .orderBy(F.desc("n_queries"), "message").limit(k)
    )


def report_bands(results: DataFrame) -> DataFrame:
    """One row: answers of high, medium and low score."""
    score = F.col("accuracy_score")
    return results.agg(
        F.count_if(score >= HIGH_SCORE).alias("high"),
        F.count_if((score >= MEDIUM_SCORE) & (score < HIGH_SCORE)).alias("medium"),
        F.count_if(score < MEDIUM_SCORE).alias("low"),
    )
