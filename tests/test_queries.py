"""Structured queries, views and profiles on hand-made facts."""

import pytest
from pyspark.sql import functions as F

from saleslens.operators import filters, profile, ranking, shapes, views
from saleslens.operators.totals import totals, with_totals
from saleslens.plans.run import in_month_order, run, source_name
from saleslens.plans.spec import QuerySpec
from saleslens.plans.tables import SalesTables


@pytest.fixture(scope="module")
def tables(make_fact):
    return SalesTables(make_fact(
        {"model": "A (AT)", "sales": 5, "vr_id": "V2", "cc": "2500", "fuel": "Diesel", "system": "FF"},
        {"model": "A (AT)", "sales": 1, "vr_id": "V1", "cc": "3000", "month": "apr", "tank": None},
        {"model": "B", "sales": 6, "brand": "FAW", "month": "feb", "segment": "Bus"},
        {"model": "C", "sales": 9, "brand": "FAW", "year": 2023, "sales_type": "import_cbu"},
        {"model": None, "sales": 50, "brand": "FAW", "year": 2023, "fuel": None},
    ))


def result(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_totals_agree_with_detail_and_do_not_pile_up(tables):
    total = tables.totals
    assert total.agg(F.sum("sales")).first()[0] == tables.detail.agg(F.sum("sales")).first()[0]
    again = totals(with_totals(tables.detail))
    assert sorted(map(str, again.collect())) == sorted(map(str, total.collect()))
    row = total.filter("brand = 'HINO'").first()
    assert (row.segment, row.month, row.vr_id, row.cc, row.tank, row.row_index) == (
        "TOTAL HINO", "all", "TOTAL_HINO_2024_wholesales", "", None, -1)


def test_comparison_doubles_only_in_compat(tables):
    plain = {(r.brand, r.sales_type, r.year): r.sales
             for r in views.brand_comparison(tables.master).collect()}
    doubled = {(r.brand, r.sales_type, r.year): r.sales
               for r in views.brand_comparison(tables.master, compat=True).collect()}
    assert doubled == {k: 2 * v for k, v in plain.items()}


def test_grouping_sets_equal_the_union(tables):
    by_union = views.monthly(tables.master)
    by_sets = views.monthly_by_grouping_sets(tables.detail).select(by_union.columns)
    assert sorted(map(str, by_sets.collect())) == sorted(map(str, by_union.collect()))


def test_ranking_ties_and_first_values(tables):
    rows = run({"operation": "model_specs"}, tables).orderBy("rank").collect()
    assert [(r.rank, r.model, r.sales) for r in rows] == [(1, "C", 9), (2, "A (AT)", 6), (3, "B", 6)]
    assert (rows[1].vr_id, rows[1].cc, rows[1].tank) == ("V1", "3000", "")
    compat = run({"operation": "model_specs"}, tables, compat=True).orderBy("rank").first()
    assert (compat.model, compat.sales) == ("TOTAL FAW", 65)


def test_first_value_skips_nulls(make_fact):
    df = make_fact({"vr_id": "V1", "tank": None}, {"vr_id": "V2", "tank": "70"}, {"vr_id": "V3", "tank": "80"})
    assert df.agg(ranking.first_value("tank", "vr_id")).first()[0] == "70"


@pytest.mark.parametrize("spec, plain, compat", [
    ({}, "summary", "summary"),
    ({"intent": "specification"}, "detailed", "detailed"),
    ({"operation": "technical_analysis"}, "detailed", "detailed"),
    ({"operation": "model_specs"}, "detailed", "master"),
    ({"analysis_type": "model_ranking"}, "detailed", "master"),
    ({"analysis_type": "technical_specs"}, "detailed", "detailed"),
    ({"months": ["jan"]}, "detailed", "summary"),
    ({"months": ["all"]}, "summary", "summary"),
    ({"analysis_type": "trend"}, "detailed", "summary"),
    ({"segments": ["Bus"]}, "detailed", "summary"),
    ({"segments": ["TOTAL:"]}, "summary", "summary"),
])
def test_routing(spec, plain, compat):
    spec = QuerySpec.of(spec)
    assert (source_name(spec), source_name(spec, compat=True)) == (plain, compat)


def test_spec_reading():
    spec = QuerySpec.of('{"brands": "HINO", "years": 2024, "aggregation": [], "title": "x",'
                        ' "technical_filters": {"fuel": "Diesel"}, "months": null}')
    assert (spec.brands, spec.years, spec.aggregation, spec.months) == (["HINO"], [2024], "sum", [])
    assert spec.technical_filters == {"fuel": ["Diesel"]}
    with pytest.raises(ValueError):
        QuerySpec(aggregation="median")


def test_patterns_regex_or_literal(tables):
    for literal, found in ((False, 0), (True, 6)):
        got = run({"model": ["a (at)"]}, tables, literal=literal).agg(F.sum("sales")).first()[0]
        assert (got or 0) == found
    df = filters.keep_matching(tables.detail, "model", ["^b$"])
    assert [r.model for r in df.collect()] == ["B"]


def test_absent_and_empty_filters(tables):
    assert filters.keep_in(tables.detail, "colour", ["red"]).count() == 5
    assert filters.keep_in(tables.detail, "brand", []).count() == 5
    with pytest.raises(ValueError):
        filters.keep_in(tables.detail, "colour", ["red"], strict=True)
    assert filters.keep_in(tables.detail, "ff_fr", ["FF"]).count() == 1


def test_long_in_lists_change_nothing(tables):
    df = filters.keep_in(tables.detail, "year", [*range(20_000)])
    assert df.count() == 5 and df.columns == tables.detail.columns


def test_case_folds_beyond_ascii(make_fact):
    df = filters.keep_matching(make_fact({"model": "CAMIÓN"}, {"model": "x"}), "model", ["camión"])
    assert df.count() == 1


def test_null_keys_make_no_group(tables):
    by_model = run({"operation": "technical_analysis", "technical_filters": {"model": []}}, tables)
    assert {r.model for r in by_model.collect()} == {"A (AT)", "B", "C"}
    assert run({"analysis_type": "technical_specs"}, tables).agg(F.sum("total_sales")).first()[0] == 20


def test_average_and_its_synonym(tables):
    for name in ("avg", "mean"):
        df = run({"operation": "comparison", "aggregation": name, "intent": "specification"}, tables)
        assert result(df, "brand", "sales_type", "year", "sales")[-1] == ("HINO", "wholesales", 2024, 3.0)


def test_trend_in_month_order(tables):
    df = in_month_order(run({"analysis_type": "trend", "brands": ["HINO"]}, tables))
    assert [(r.month, r.sales) for r in df.collect()] == [("jan", 5), ("apr", 1)]


def test_monthly_table_answers_only_when_stored(tables):
    spec = {"analysis_type": "trend"}
    stored = SalesTables(tables.detail, monthly=views.monthly(tables.master))
    columns = ("month", "brand", "sales_type", "sales")
    assert result(run(spec, stored), *columns) == result(run(spec, tables), *columns)
    averaged = {**spec, "aggregation": "avg"}
    assert result(run(averaged, stored), *columns) == result(run(averaged, tables), *columns)


def test_integrity_of_an_empty_table(make_fact):
    row = views.integrity_record(make_fact()).first()
    assert (row.master_records, row.specs_coverage, row.data_integrity_check) == (0, 0.0, True)


def test_profiles(tables):
    counts = {(r.dimension, r.value): r.n_rows for r in profile.distribution(tables.detail, ["fuel", "ff_fr"]).collect()}
    assert counts[("fuel", "Diesel")] == 1 and counts[("fuel", "")] == 3
    assert profile.distinct_counts(tables.detail, ["model"]).first()[0] == 3
    assert profile.distinct_counts(tables.detail, ["model"], approximate=True).first()[0] == 3
    bare = profile.result_stats(tables.detail.select("model")).first()
    assert (bare.total_sales, bare.record_count, bare.brands) == (0.0, 5, [])
    assert profile.null_share(tables.detail.select("model", "fuel")).first()[0] == pytest.approx(0.2)


def test_shapes(tables):
    share = {r.brand: r.share for r in shapes.share(tables.detail).collect()}
    assert share == {"HINO": round(6 / 71, 6), "FAW": round(65 / 71, 6)}
    cells = shapes.for_chart(tables.detail, "heatmap").filter("brand = 'HINO'").first()
    assert (cells.jan, cells.apr, cells.feb) == (5, 1, None)
    assert result(shapes.for_chart(tables.detail.select("brand", "sales"), "sunburst"), "brand", "sales") == [
        ("FAW", 65), ("HINO", 6)]
    assert shapes.share(tables.detail.filter("false")).count() == 0


def test_samples_repeat(tables):
    first, again = (ranking.sample_rows(tables.detail, 3, seed=1).collect() for _ in range(2))
    assert first == again and len(first) == 3
    assert ranking.sample_rows(tables.detail, 20).count() == 5
