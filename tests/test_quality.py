"""Texts, checks, scores and the report."""

import pytest
from pyspark.sql import functions as F

from saleslens.functions import text as tx
from saleslens.operators import quality, questions
from saleslens.operators.totals import with_totals
from saleslens.plans.tables import SalesTables


@pytest.mark.parametrize("text, language, intent", [
    ("Berapa total penjualan HINO?", "id", "sales"),
    ("Compare HINO vs FAW sales", "en", "sales"),
    ("from where", "en", "specification"),
    ("Model forecast sales", "en", "prediction"),
    ("売上の比較", "ja", "general"),
    ("Wie viele?", "de", "general"),
    ("CUÁNTOS", "es", "general"),
    ("analisis", "id", "general"),
    ("Hello", "en", "general"),
    ("will it?", "en", "prediction"),
    ("model trend", "en", "general"),
])
def test_texts(spark, text, language, intent):
    df = spark.createDataFrame([(text,)], "text string")
    row = questions.with_intent(questions.with_language(df)).first()
    assert (row.language, row.intent) == (language, intent)


def test_whole_words_only(spark):
    df = spark.createDataFrame([("from where",), ("fr engine",)], "text string")
    found = [r.intent for r in questions.with_intent(df, whole_words=True).collect()]
    assert found == ["general", "specification"]


def test_intent_check(spark):
    rows = [("total sales", "sales"), ("average growth", "sales"), ("total sales", "general")]
    df = quality.intent_check(spark.createDataFrame(rows, "text string, submitted_intent string"))
    assert [(r.score, r.passed) for r in df.collect()] == [(1.0, True), (0.7, True), (0.3, False)]


def test_cross_reference(spark, make_fact):
    tables = SalesTables(make_fact({}, {"month": "feb"}))
    known, odd = make_fact({}), make_fact({"brand": "ODD"})

    def check(result, expected=None):
        return quality.cross_reference(result, tables.sales_only, tables.specs_only, expected).first()

    assert (check(known).score, check(known).passed) == (1.0, True)
    assert (check(odd).score, check(odd).passed) == (pytest.approx(0.6), False)
    far = spark.createDataFrame([(100,)], "sales_records bigint")
    assert (check(known, far).score, check(known, far).record_integrity) == (0.8, False)
    empty = tables.sales_only.filter("false")
    row = quality.cross_reference(known, empty, tables.specs_only).first()
    assert (row.score, row.passed) == (0.5, False)
    assert check(known.select("model")).brand_consistency


def test_completeness(spark, make_fact):
    def score(df, intent):
        row = quality.completeness(df, intent).first()
        return row.score, row.passed

    fact = make_fact({})
    assert score(fact, "sales") == (1.0, True)
    assert score(fact.filter("false"), "sales") == (0.0, False)
    assert score(fact.select("brand"), "sales") == (0.6, False)
    assert score(fact.select("model"), "specification") == (0.9, True)
    nulls = fact.select(F.lit(None).cast("string").alias("a"), "brand")
    assert score(nulls, "general") == (0.7, True)


def test_scores_and_advice(spark):
    def checks(key, *scores):
        kinds = ["data_source_consistency", "cross_reference", "intent_accuracy", "result_completeness"]
        return [(key, k, s, s >= 0.7) for k, s in zip(kinds, scores)]

    rows = checks(1, 1.0, 0.8, 1.0, 0.8) + checks(2, 0.5, 0.4, 0.3, 0.0) + checks(3, 1.0, 0.8, 0.7, 0.3)
    df = spark.createDataFrame(rows, "k int, check_type string, score double, passed boolean")
    got = {r.k: r for r in quality.assess(df, ["k"]).collect()}
    assert got[1].accuracy_score == 0.9 and got[1].recommendations == []
    assert len(got[2].recommendations) == 5 and got[2].recommendations[0].startswith("Consider reviewing")
    assert got[3].accuracy_score == 0.7
    assert [m.split()[0] for m in got[3].recommendations] == ["Add", "Minor"]


def test_issue_rules(spark):
    rows = [(["No fuel data found", "odd"],), (["odd"],), ([],), (["Negative sales", "Empty model"],)]
    df = spark.createDataFrame(rows, "issues array<string>")
    got = [r[0] for r in df.select(quality.issue_recommendations(F.col("issues"))).collect()]
    assert [len(g) for g in got] == [1, 1, 1, 2]
    assert got[1] == got[2] == ["Data accuracy is within acceptable parameters"]
    assert df.select(tx.issue_advice(F.lit("data found"))).first()[0] is None


def test_validate_one_answer(make_fact):
    from saleslens.plans.run import run

    tables = SalesTables(make_fact({}, {"month": "feb"}))
    spec = {"intent": "sales", "brands": ["HINO"]}
    row = quality.validate(spec, "total sales of HINO", run(spec, tables), tables).first()
    assert (row.accuracy_score, len(row.checks), row.recommendations) == (1.0, 4, [])
    assert (row.query, row.intent) == ("total sales of HINO", "sales")


def test_report(spark):
    rows = [(0.95, "sales", ["a"]), (0.9, "sales", ["b"]), (0.8, "general", ["c", "a"]),
            (0.7, None, ["c"]), (0.5, "general", [])]
    df = spark.createDataFrame(rows, "accuracy_score double, intent string, recommendations array<string>")
    bands = quality.report_bands(df).first()
    assert (bands.high, bands.medium, bands.low) == (2, 2, 1)
    assert [(r.message, r.n_queries) for r in quality.report_messages(df).collect()] == [("c", 2), ("a", 1)]
    assert {r.intent: r.n_queries for r in quality.report_by_intent(df).collect()} == {
        "Sales": 2, "General": 2, "Unknown": 1}


def test_response_style(make_fact):
    fact = make_fact({})
    styles = [
        (fact.unionAll(make_fact(*[{}] * 50)), "general", "query", "comprehensive_business_analysis"),
        (fact.select("model", "cc"), "specification", "query", "technical_deep_dive"),
        (fact.select("brand"), "sales", "comparison", "focused_executive_summary"),
        (make_fact(*[{}] * 10).select("brand"), "sales", "comparison", "competitive_market_analysis"),
        (make_fact(*[{}] * 10).select("brand"), "sales", "query", "balanced_business_insights"),
    ]
    for df, intent, operation, style in styles:
        assert quality.response_style(df, intent, operation).first().response_style == style


def test_source_check(spark):
    assert quality.source_check(spark, "summary", ["month", "x"]).first().score == 1.0
    row = quality.source_check(spark, "detailed", ["x"]).first()
    assert (row.score, row.passed) == (0.5, False)


def test_master_has_nulls_on_totals_only(make_fact):
    master = with_totals(make_fact({}))
    row = quality.completeness(master).first()
    assert row.data_quality_score == pytest.approx(1 - 5 / (2 * 23))


def test_top_values_fall_back_to_counting(spark):
    from saleslens.operators import profile

    rows = spark.range(3000).selectExpr("CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS STRING) AS model")
    for tracked in (2, 50, 10_000):  # too few items to prove the second value, or all of them
        got = [(r.value, r.n_rows) for r in profile.top_values(rows, "model", 2, tracked).collect()]
        assert got == [("7", 1000 + 1), ("1", 1)]
    assert profile.top_values(rows.limit(0), "model").count() == 0


def test_sketches_merge_and_leave_nulls_out(spark, make_fact):
    from saleslens.operators import profile

    detail = make_fact(*({"model": f"M{k % 7}" if k % 5 else None, "year": 2000 + k % 3, "brand": f"B{k % 2}"} for k in range(60)))
    sketched = profile.sketches(detail)
    assert sketched.count() == 6
    assert profile.merged_distinct_counts(sketched, ["model", "month"]).first()[:] == (7, 1)
    assert profile.merged_distinct_counts(sketched.filter("year = 1"), ["model"]).first()[:] == (0,)


def test_an_answer_is_read_once(spark, make_fact):
    from saleslens.operators import quality
    from saleslens.plans.run import run
    from saleslens.plans.tables import SalesTables

    tables = SalesTables(make_fact({"sales": 3}, {"sales": 4, "brand": "FAW"}))
    reads = spark.sparkContext.accumulator(0)
    spec = {"operation": "comparison"}
    result = run(spec, tables)

    def counted(batches):
        for batch in batches:
            reads.add(len(batch))
            yield batch

    checks = quality.answer_checks({"one": (spec, result.mapInPandas(counted, result.schema))}, tables)
    assert {r.check_type for r in checks.collect()} == {"cross_reference", "result_completeness", "data_source_consistency"}
    checks.count()
    assert reads.value == result.count()
