"""The registered queries: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.constants import DISTRIBUTION_COLUMNS, MONTHS, SALES_TYPES
from saleslens.functions import scalars as sc
from saleslens.operators import filters, profile, quality, questions, ranking, reshape, shapes
from saleslens.operators import sheet, views
from saleslens.operators.totals import TOTAL_KEYS, totals, with_totals
from saleslens.plans.build import detail_from_sheets, detail_from_workbooks, run_record, stage
from saleslens.plans.run import run
from saleslens.plans.tables import SalesTables
from saleslens.session import shared_dir, written
from saleslens.sources import warehouse
from saleslens.sources.workbooks import (
    decode_csv,
    decode_workbooks,
    list_workbooks,
    path_keys,
    read_listed,
    relative_path,
    unreadable,
)
from saleslens.streaming.update import update, update_stream

from . import facts

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _spec(name: str, spec: dict, **options) -> None:
    """Register a structured query over the fact table."""
    rounded = spec.get("aggregation") in ("avg", "mean")

    def query(spark, sf_dir):
        out = run(spec, facts.tables(spark, sf_dir), **options)
        return out.withColumn("sales", F.round("sales", 6)) if rounded else out

    REGISTRY[name] = query


# --- sheets -------------------------------------------------------------------------------

def _file_brands(spark, sf_dir):
    """Brands whose workbooks are expected; brands that end in 7 are not."""
    brand = facts.file_brand(F.col("p_brand"))
    return (
        facts.read(spark, sf_dir, "part").select(brand.alias("brand")).distinct()
        .filter(~F.col("brand").endswith("7"))
    )


def _all_file_brands(spark, sf_dir):
    """All brands as workbooks name them. They are written, so that Spark knows how few they are: by the
    length of ``part`` alone it would shuffle the sheets to meet them."""
    brands = facts.read(spark, sf_dir, "part").select(facts.file_brand(F.col("p_brand")).alias("brand")).distinct()
    return written(brands, shared_dir(spark, "brands"))


@register
def ingest_path_keys(spark, sf_dir):
    key = F.col("p_partkey")
    brand = F.lower(facts.file_brand(F.col("p_brand")))
    year = F.concat(F.lit("20"), F.lpad((key % 30).cast("string"), 2, "0"))
    path = (
        F.when(key % 6 == 0, F.concat(F.lit("x"), year, F.lit("/"), brand, F.lit(".xlsx")))
        .when(key % 6 == 1, F.concat(year, F.lit("-"), brand, F.lit(".xlsx")))
        .when(key % 6 == 2, F.concat(year, F.lit("/"), brand, F.lit(".xlsx/old")))
        .otherwise(F.concat(year, F.lit("/"), brand, F.lit(".xlsx")))
    )
    files = facts.read(spark, sf_dir, "part").select(key.alias("file_id"), path.alias("path"))
    return path_keys(files, _file_brands(spark, sf_dir)).select("file_id", "path", "year", "brand")


@register
def ingest_header_row(spark, sf_dir):
    return sheet.header_rows(facts.sheet_cells(spark, sf_dir)).select(
        "path", "header_row", "has_mark")


@register
def ingest_month_columns(spark, sf_dir):
    return sheet.month_columns(facts.sheet_cells(spark, sf_dir))


@register
def ingest_vehicle_rows(spark, sf_dir):
    rows = sheet.vehicle_rows(facts.sheet_cells(spark, sf_dir))
    return rows.select("path", "row_idx", sc.strip(sheet.cell(0)).alias("vr_id"))


@register
def ingest_project(spark, sf_dir):
    return sheet.project_columns(sheet.vehicle_rows(facts.sheet_cells(spark, sf_dir)))


@register
def unpivot_sales(spark, sf_dir):
    wide = facts.wide(spark, sf_dir).select("vr_id", "year", *reshape.MONTH_COLUMNS)
    return reshape.unpivot_months(wide)


@register
def clean_sales(spark, sf_dir):
    wide = facts.wide(spark, sf_dir).select("vr_id", "year", *reshape.MONTH_COLUMNS)
    return reshape.clean_sales(reshape.unpivot_months(wide))


@register
def zero_fill(spark, sf_dir):
    wide = facts.wide(spark, sf_dir).select("vr_id", "model", "year", *reshape.MONTH_COLUMNS)
    return reshape.to_long(wide)


@register
def ingest_rejects(spark, sf_dir):
    wide = facts.wide(spark, sf_dir).select("vr_id", "year", *reshape.MONTH_COLUMNS)
    return reshape.rejects(wide)


@register
def ingest_detail(spark, sf_dir):
    """Sheets to fact rows by way of a staging table, as for workbooks."""
    staged = stage(facts.sheet_cells(spark, sf_dir), shared_dir(spark, "sheets"))
    return detail_from_sheets(staged, brands=_all_file_brands(spark, sf_dir))


@register
def ingest_workbooks(spark, sf_dir):
    """One small workbook per vehicle and year, decoded to fact rows; damaged ones give none."""
    sheets = decode_workbooks(facts.workbooks(spark, sf_dir))
    staged = stage(sheets, shared_dir(spark, "sheets"))
    return detail_from_sheets(staged, brands=_all_file_brands(spark, sf_dir))


@register
def ingest_csv(spark, sf_dir):
    """The same vehicles as CSV files, with blank lines, split records and cells too many."""
    sheets = decode_csv(facts.csv_files(spark, sf_dir))
    staged = stage(sheets, shared_dir(spark, "sheets"))
    return detail_from_sheets(staged, brands=_all_file_brands(spark, sf_dir))


@register
def ingest_problems(spark, sf_dir):
    """The files that could not be read, and whether each comes with a reason."""
    sheets = decode_workbooks(facts.workbooks(spark, sf_dir))
    return unreadable(sheets).select("path", (F.length("reason") > 0).alias("has_reason"))


@register
def run_metadata(spark, sf_dir):
    """What a build over the sheets, and over workbooks that are cut off, reports about itself."""
    sheets = stage(facts.sheet_cells(spark, sf_dir), shared_dir(spark, "sheets"))
    n_files = sheets.select("path").distinct().count()
    detail = detail_from_sheets(sheets, brands=_all_file_brands(spark, sf_dir), n_files=n_files)
    # what the record is counted from, so that TOTAL rows do not read the sheets again
    detail = written(detail.select(*TOTAL_KEYS, "sales", "is_summary"), shared_dir(spark, "counted"))
    damaged = stage(decode_workbooks(facts.damaged_workbooks(spark, sf_dir)), shared_dir(spark, "damaged"))
    record = run_record(with_totals(detail), sheets.unionByName(damaged), "2025-01-01T00:00:00", n_files=n_files)
    problems = F.transform("problems", lambda p: F.concat_ws(" ", p["path"], p["reason"]))
    return record.withColumn("brands_processed", F.array_join("brands_processed", ",")).withColumn(
        "problems", F.array_join(problems, ","))


# --- totals and views ---------------------------------------------------------------------

@register
def summary_totals(spark, sf_dir):
    return totals(facts.detail(spark, sf_dir))


@register
def master_with_totals(spark, sf_dir):
    return facts.master(spark, sf_dir)


@register
def view_summary(spark, sf_dir):
    return views.summary(facts.master(spark, sf_dir))


@register
def view_detailed(spark, sf_dir):
    return views.detailed(facts.master(spark, sf_dir))


@register
def view_monthly(spark, sf_dir):
    return views.monthly(facts.master(spark, sf_dir))


@register
def master_grouping_sets(spark, sf_dir):
    return views.monthly_by_grouping_sets(facts.detail(spark, sf_dir))


@register
def view_brand_comparison(spark, sf_dir):
    return views.brand_comparison(facts.master(spark, sf_dir))


@register
def view_brand_comparison_compat(spark, sf_dir):
    return views.brand_comparison(facts.master(spark, sf_dir), compat=True)


@register
def view_specs_only(spark, sf_dir):
    return views.specs_only(facts.master(spark, sf_dir))


@register
def view_sales_only(spark, sf_dir):
    return views.sales_only(facts.master(spark, sf_dir))


@register
def integrity_record(spark, sf_dir):
    record = views.integrity_record(facts.master(spark, sf_dir), "2025-01-01T00:00:00")
    return (
        record.withColumn("specs_coverage", F.round("specs_coverage", 6))
        .withColumn("brands_covered", F.array_join("brands_covered", ","))
        .withColumn("sales_types", F.array_join("sales_types", ","))
    )


@register
def processing_summary(spark, sf_dir):
    row = views.processing_summary(facts.detail(spark, sf_dir))
    return row.withColumn("years", F.array_join(F.col("years").cast("array<string>"), ","))


@register
def processing_by_brand(spark, sf_dir):
    return views.processing_by_brand(facts.detail(spark, sf_dir))


@register
def sink_roundtrip(spark, sf_dir):
    """Write the tables, read them back, and answer from what was read."""
    root = shared_dir(spark, "sink")
    stored = warehouse.save(spark, facts.detail(spark, sf_dir), root)
    warehouse.write_record(
        views.integrity_record(stored.master, "2025-01-01T00:00:00", stored.specs_only), root, "integrity")
    recorded = warehouse.read_record(spark, root, "integrity").select(
        F.lit("recorded").alias("brand"), F.lit("rows").alias("sales_type"),
        F.lit(None).cast("int").alias("year"), F.col("master_records").alias("sales"))
    return stored.brand_comparison.unionByName(recorded)


@register
def export_roundtrip(spark, sf_dir):
    """All seven tables as files of their own, read back: rows and sales of each."""
    root = shared_dir(spark, "export")
    warehouse.export(facts.tables(spark, sf_dir), root)
    out = None
    for name, df in warehouse.import_exported(spark, root).items():
        sales = F.sum("sales") if "sales" in df.columns else F.lit(None)
        row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("brand").alias("brands"),
                     sales.cast("bigint").alias("sales")).withColumn("table_name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def _odd_detail(spark, sf_dir):
    """Facts with null segments and months, some without sales, and brands that look like numbers.

    They are written and asked, so the lines are summed once for both.
    """
    key = F.substring("vr_id", 3, 8).cast("int")
    units = written(facts.shipped(spark, sf_dir), shared_dir(spark, "units"))
    return facts.detail(spark, sf_dir, units).withColumns({
        "brand": F.when(key % 5 == 0, F.concat(F.lit("00"), (key % 3).cast("string"))).otherwise(F.col("brand")),
        "segment": F.when(key % 7 > 0, F.col("segment")),
        "month": F.when(key % 11 > 0, F.col("month")),
    })


def _derived(detail):
    """Tables derived from facts: of these, what is asked by month and segment, in one pass for all
    questions."""
    asked = detail.select(*views.MONTHLY_KEYS, "sales")
    return SalesTables(written(asked, shared_dir(detail.sparkSession, "derived")))


@register
def stored_equals_derived(spark, sf_dir):
    """The same questions of written and of derived tables, over facts with null segments and
    months and with brands that look like numbers."""
    detail = _odd_detail(spark, sf_dir)
    stored = warehouse.save(spark, detail, shared_dir(spark, "stored"))
    out = None
    for source, tables in (("stored", stored), ("derived", _derived(detail))):
        for name, spec in (("trend", {"analysis_type": "trend"}), ("default", {"months": ["jan", "jul"]}),
                           ("years", {"years": [1997], "segments": ["ECONOMY"]})):
            row = run(spec, tables).select(F.lit(source).alias("source"), F.lit(name).alias("question"),
                                           "brand", "sales_type", "month", "sales")
            out = row if out is None else out.unionByName(row)
    return out


@register
def stored_aggregates(spark, sf_dir):
    """All five aggregations by month and segment, from the stored roll-up and from facts; some
    facts have no figure."""
    key = F.substring("vr_id", 3, 8).cast("int")
    detail = _odd_detail(spark, sf_dir).withColumn("sales", F.when(key % 13 > 0, F.col("sales")))
    stored = warehouse.save(spark, detail, shared_dir(spark, "stored"))
    out = None
    for source, tables in (("stored", stored), ("derived", _derived(detail))):
        for name in ("sum", "avg", "count", "min", "max"):
            spec = {"aggregation": name, "months": ["jan", "jul"], "segments": ["ECONOMY", "PROMO"]}
            row = run(spec, tables).select(
                F.lit(source).alias("source"), F.lit(name).alias("question"), "brand", "sales_type", "month",
                F.round(F.col("sales").cast("double"), 6).alias("sales"))
            out = row if out is None else out.unionByName(row)
    return out


# --- filters ------------------------------------------------------------------------------

def _by_brand(df):
    return df.groupBy("brand").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.sum("sales").cast("bigint").alias("sales"))


@register
def filter_in(spark, sf_dir):
    df = filters.keep_in(facts.detail(spark, sf_dir), "brand", ["Brand#11", "Brand#22", "Brand#5"])
    return _by_brand(filters.keep_in(df, "sales_type", ["wholesales", "import_cbu"]))


@register
def filter_month(spark, sf_dir):
    return _by_brand(filters.keep_in(facts.detail(spark, sf_dir), "month", ["jan", "jun", "dec"]))


@register
def filter_segment(spark, sf_dir):
    return _by_brand(filters.keep_in(facts.detail(spark, sf_dir), "segment", ["ECONOMY", "PROMO"]))


@register
def filter_year(spark, sf_dir):
    return _by_brand(filters.keep_in(facts.detail(spark, sf_dir), "year", [1996, 1999]))


@register
def filter_model_regex(spark, sf_dir):
    return _by_brand(filters.keep_matching(
        facts.detail(spark, sf_dir), "model", ["^RED", "widget$"]))


@register
def filter_tech_exact(spark, sf_dir):
    df = filters.keep_in(facts.detail(spark, sf_dir), "fuel", ["Diesel", "Hybrid"])
    return _by_brand(filters.keep_in(df, "ff_fr", ["FF"]))


@register
def filter_tech_contains(spark, sf_dir):
    df = filters.keep_matching(facts.detail(spark, sf_dir), "ps_hp", ["10hp", "85"])
    return _by_brand(filters.keep_matching(df, "dimension", ["x1[57]"]))


@register
def filter_total(spark, sf_dir):
    df = facts.master(spark, sf_dir)
    return _by_brand(df.filter(filters.is_total_segment(F.col("segment"))))


_spec("filter_all", {
    "brands": ["Brand#11", "Brand#12", "Brand#13", "Brand#21"],
    "sales_types": ["wholesales", "retail_sales"], "months": ["jan", "feb", "mar"],
    "segments": ["ECONOMY", "STANDARD", "LARGE"], "years": [1996, 1997, 1998],
    "model": ["red", "new", "old"], "technical_filters": {"fuel": ["Diesel"], "cc": ["00"]},
    "intent": "specification",
})

# --- structured queries -------------------------------------------------------------------

_spec("route_ranking", {"operation": "model_specs", "intent": "specification"})
_spec("route_detailed", {"intent": "specification", "months": ["may"]})
_spec("route_summary", {"intent": "sales"})
_spec("route_summary_month", {"intent": "sales", "months": ["may"]})
_spec("route_summary_month_compat", {"intent": "sales", "months": ["all"], "years": [1998]},
      compat=True)
for _name in ("sum", "avg", "count", "min", "max"):
    _spec(f"agg_{_name}", {"aggregation": _name, "intent": "specification"})
_spec("query_default", {"brands": ["Brand#11", "Brand#22"], "years": [1996, 1997]})
_spec("query_comparison", {"operation": "comparison", "sales_types": ["retail_sales"]})
_spec("query_trend", {"analysis_type": "trend", "brands": ["Brand#11"]})
_spec("query_trend_compat", {"analysis_type": "trend"}, compat=True)
_spec("query_technical_analysis",
      {"operation": "technical_analysis",
       "technical_filters": {"fuel": ["Diesel"], "ff_fr": ["FF"]}})
_spec("query_technical_defaults", {"operation": "technical_analysis", "years": [1997]},
      default_tech_keys=True)
_spec("query_technical_specs", {"analysis_type": "technical_specs"})
_spec("query_model_ranking", {"operation": "model_specs", "years": [1997]})
_spec("query_model_ranking_compat", {"operation": "model_specs"}, compat=True)


@register
def query_brand_segment(spark, sf_dir):
    """A ranking of a table without models: by brand and segment."""
    without = facts.detail(spark, sf_dir).drop("model")
    return run({"operation": "model_specs"}, SalesTables(without, detailed=without))


# --- profiles -----------------------------------------------------------------------------

@register
def distinct_counts(spark, sf_dir):
    return profile.distinct_counts(
        facts.detail(spark, sf_dir), ["brand", "model", "sales_type", "vr_id", "tank"])


@register
def distinct_counts_stored(spark, sf_dir):
    """Distinct values from the stored sketches, of all years and of two: whether each count is
    within four standard errors of the exact one, which is given beside it."""
    stored = warehouse.save(spark, facts.detail(spark, sf_dir), shared_dir(spark, "stored"))
    out = None
    for question, years in (("all", None), ("two years", [1996, 1997])):
        near = stored.distinct_counts(profile.SKETCHED, years).unpivot([], profile.SKETCHED, "dimension", "estimate")
        exact = stored.distinct_counts(profile.SKETCHED, years, exact=True).unpivot([], profile.SKETCHED, "dimension", "n")
        close = F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(1.0), 4 * profile.SKETCH_ERROR * F.col("n"))
        rows = exact.join(near, "dimension").select(F.lit(question).alias("question"), "dimension", "n", close.alias("is_close"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register
def top_values(spark, sf_dir):
    """The ten most frequent values of wide columns, found by sketches and counted exactly."""
    detail = facts.detail(spark, sf_dir)
    out = None
    for column in ("model", "cc", "vr_id"):
        rows = profile.top_values(detail, column, tracked=100 if column == "cc" else 2000)
        rows = rows.select(F.lit(column).alias("dimension"), "value", "n_rows")
        out = rows if out is None else out.unionByName(rows)
    return out


@register
def spec_distribution(spark, sf_dir):
    return profile.distribution(facts.detail(spark, sf_dir), DISTRIBUTION_COLUMNS)


@register
def result_stats(spark, sf_dir):
    result = run({"operation": "comparison"}, facts.tables(spark, sf_dir))
    row = profile.result_stats(result)
    return (
        row.withColumn("avg_sales", F.round("avg_sales", 6))
        .withColumn("brands", F.array_join("brands", ","))
        .withColumn("sales_types", F.array_join("sales_types", ","))
    )


@register
def headline(spark, sf_dir):
    return profile.headline(facts.tables(spark, sf_dir).primary)


@register
def brand_summary(spark, sf_dir):
    return profile.brand_summary(facts.tables(spark, sf_dir).primary)


@register
def brand_type_crosstab(spark, sf_dir):
    return profile.crosstab(facts.tables(spark, sf_dir).primary, SALES_TYPES)


@register
def catalogue(spark, sf_dir):
    return profile.catalogue(facts.master(spark, sf_dir))


@register
def quality_null_share(spark, sf_dir):
    row = profile.null_share(facts.tables(spark, sf_dir).summary)
    return row.withColumn("null_share", F.round("null_share", 6))


@register
def sample_rows(spark, sf_dir):
    summary = facts.tables(spark, sf_dir).summary.select(
        "vr_id", "brand", "year", "sales_type", "sales")
    return ranking.sample_rows(summary, 20, seed=7)


# --- lookups, shares, shapes --------------------------------------------------------------

@register
def month_names(spark, sf_dir):
    rows = shapes.line(facts.detail(spark, sf_dir))
    return rows.withColumn("name_id", sc.month_name_id(F.col("month"))).withColumn(
        "again", sc.month_name(F.col("month_no")))


@register
def market_share(spark, sf_dir):
    return shapes.share(facts.detail(spark, sf_dir))


@register
def market_share_by_vehicle(spark, sf_dir):
    return shapes.share(facts.detail(spark, sf_dir), "vr_id", digits=9)


@register
def shape_bar(spark, sf_dir):
    return shapes.bar(facts.detail(spark, sf_dir))


@register
def shape_line(spark, sf_dir):
    return shapes.line(facts.detail(spark, sf_dir))


@register
def shape_heatmap(spark, sf_dir):
    return shapes.heatmap(facts.detail(spark, sf_dir), MONTHS)


@register
def shape_default(spark, sf_dir):
    result = run({"analysis_type": "trend"}, facts.tables(spark, sf_dir))
    return shapes.for_chart(result, "scatter")


@register
def scalar_suite(spark, sf_dir):
    name, kind, key = F.col("p_name"), F.col("p_type"), F.col("p_partkey")
    text_number = F.when(key % 4 == 0, "n/a").when(key % 4 == 1, F.concat(
        F.lit(" "), F.col("p_size").cast("string"), F.lit(".75 "))).when(
        key % 4 == 2, "1_000").otherwise(F.col("p_size").cast("string"))
    number = sc.to_number(text_number)
    words = F.split(name, " ")
    record = F.to_json(F.struct(key.alias("k"), kind.alias("t")))
    return facts.read(spark, sf_dir, "part").select(
        key.alias("p_partkey"),
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.upper(name).alias("upper_name"),
        F.lower(kind).alias("lower_type"),
        F.initcap(name).alias("title_name"),
        sc.contains_any(name, ["red", "widget"]).alias("has_any"),
        sc.count_present(name, ["red", "widget", "e"]).alias("n_present"),
        name.endswith("plate").alias("ends_plate"),
        sc.snake_case(F.concat(kind, F.lit(" (CKD)"))).alias("snake"),
        F.try_element_at(words, F.lit(2)).alias("second_word"),
        F.try_element_at(words, F.lit(9)).alias("ninth_word"),
        F.col("p_brand").rlike(r"\d").alias("has_digit"),
        key.cast("string").rlike(r"^\d+$").alias("all_digits"),
        F.substring(name, 1, 3).alias("prefix"),
        F.length(name).alias("name_length"),
        F.coalesce(F.nullif(kind, F.lit("PROMO")), F.lit("none")).alias("defaulted"),
        number.alias("number"),
        number.cast("bigint").alias("whole"),
        F.concat_ws("_", F.lit("TOTAL"), F.col("p_brand"), key.cast("string")).alias("total_key"),
        F.round(F.col("p_retailprice") / 7, 2).alias("rounded"),
        F.least(F.abs(F.col("p_size") - 25), F.lit(10)).alias("capped_distance"),
        (F.when(F.col("p_size") > 10, 4).otherwise(0) + F.when(key % 2 == 0, 3).otherwise(0))
        .alias("points"),
        record.alias("record"),
        F.from_json(record, "k bigint, t string")["t"].alias("decoded"),
        sc.iso_timestamp(F.lit("2025-01-31 10:11:12.5").cast("timestamp")).alias("stamp"),
        sc.month_name((key % 12 + 1)).alias("month"),
        sc.month_number(sc.month_name(key % 12 + 1)).alias("month_no"),
        sc.matches_any(name, ["RED", "gear$"]).alias("matches"),
        sc.matches_any(name, ["D P"], literal=True).alias("matches_literal"),
    )


# --- texts --------------------------------------------------------------------------------

@register
def detect_language(spark, sf_dir):
    asked = questions.with_language(facts.questions(spark, sf_dir), picked="picked")
    return asked.select("query_id", "language", "final_language")


@register
def classify_intent(spark, sf_dir):
    asked = questions.with_intent(facts.questions(spark, sf_dir), scores=True)
    return asked.select("query_id", "specification_score", "sales_score", "prediction_score",
                        "intent")


@register
def classify_documents(spark, sf_dir):
    docs = facts.read(spark, sf_dir, "documents").select("doc_id", "text")
    return questions.classified(docs).select("doc_id", "language", "intent")


@register
def classify_conversations(spark, sf_dir):
    turns = facts.read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return questions.classified(turns, scores=True).drop("text")


# --- quality ------------------------------------------------------------------------------

@register
def quality_intent(spark, sf_dir):
    checked = quality.intent_check(facts.questions(spark, sf_dir))
    return checked.select("query_id", "submitted_intent", "reclassified_intent",
                          "expected_intent", "score", "passed")


@register
def validate_answers(spark, sf_dir):
    """The checks of four real answers: a ranking, a comparison, an empty one and a foreign one."""
    checks = quality.answer_checks(facts.asked(spark, sf_dir), facts.tables(spark, sf_dir),
                                   facts.recorded(spark, sf_dir))
    return checks.withColumn("score", F.round("score", 6))


@register
def quality_source(spark, sf_dir):
    """How many questions of the log got an answer from the right source, and what that scored."""
    checked = facts.checks(spark, sf_dir).filter("check_type = 'data_source_consistency'")
    return checked.groupBy("intent", "check_type", "score", "passed").agg(
        F.count(F.lit(1)).alias("n_queries"))


@register
def quality_brand_subset(spark, sf_dir):
    """Brands that suppliers' lines name but the sales tables lack: those ending in X."""
    tables = facts.tables(spark, sf_dir)
    key = F.col("p_partkey")
    named = facts.read(spark, sf_dir, "part").select(
        F.when(key % 50 == 0, F.concat("p_brand", F.lit("X"))).otherwise(F.col("p_brand"))
        .alias("brand"))
    return quality.unknown_brands(named, tables.sales_only, tables.specs_only)


@register
def quality_cross_reference(spark, sf_dir):
    tables = facts.tables(spark, sf_dir)
    result = run({"operation": "comparison"}, tables)
    row = quality.cross_reference(result, tables.sales_only, tables.specs_only,
                                  facts.recorded(spark, sf_dir))
    return row.withColumn("score", F.round("score", 6))


@register
def quality_completeness(spark, sf_dir):
    result = facts.master(spark, sf_dir)
    row = quality.completeness(result, "specification")
    return row.withColumn("data_quality_score", F.round("data_quality_score", 6))


@register
def response_style(spark, sf_dir):
    result = run({"analysis_type": "technical_specs"}, facts.tables(spark, sf_dir))
    return quality.response_style(result, "specification", "query")


@register
def quality_score(spark, sf_dir):
    return facts.answers(spark, sf_dir).select(
        "query_id", F.size("checks").alias("n_checks"),
        F.round("accuracy_score", 6).alias("accuracy_score"))


@register
def quality_recommend(spark, sf_dir):
    return facts.answers(spark, sf_dir).select(
        "query_id", F.explode("recommendations").alias("recommendation"))


@register
def quality_issue_rules(spark, sf_dir):
    advice = quality.issue_recommendations(F.col("issues"))
    return facts.questions(spark, sf_dir).select(
        "query_id", F.array_join(advice, " | ").alias("advice"))


@register
def report_summary(spark, sf_dir):
    return quality.report_summary(facts.answers(spark, sf_dir))


@register
def report_by_intent(spark, sf_dir):
    return quality.report_by_intent(facts.answers(spark, sf_dir))


@register
def report_recommendations(spark, sf_dir):
    return quality.report_messages(facts.answers(spark, sf_dir))


@register
def report_issues(spark, sf_dir):
    return quality.report_messages(facts.answers(spark, sf_dir), "issues")


@register
def report_bands(spark, sf_dir):
    return quality.report_bands(facts.answers(spark, sf_dir))


# --- incremental update -------------------------------------------------------------------

def _given_sheets(spark, sf_dir):
    """The sheet rows that all deliveries are taken from, computed once and written."""
    return stage(facts.sheet_cells(spark, sf_dir), shared_dir(spark, "given"))


def _delivery(sheets, whole: bool):
    """Sheet rows with the (year, brand) of their file. The first delivery of 1998 and later
    lacks its vehicles with an even key."""
    rows = sheets.withColumn(
        "year", F.split("path", "/")[0].cast("int")).withColumn(
        "brand", F.replace(F.split("path", "/")[1], F.lit(".xlsx"), F.lit("")))
    if whole:
        return rows.filter("year >= 1998")
    kept = (F.col("year") < 1998) | (F.col("row_idx") % 2 == 1) | (F.col("row_idx") < 20)
    return rows.filter(kept)


@register
def incremental_update(spark, sf_dir):
    """Three deliveries under the same names: the second replaces part of the first; in the third
    files of 1997 are gone and files of 1999 hold no vehicle any more."""
    landing, root = shared_dir(spark, "landing"), shared_dir(spark, "tables")
    brands, sheets = _all_file_brands(spark, sf_dir), _given_sheets(spark, sf_dir)

    def listing():
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet").load(landing)
        )
        return files.select(
            "path", "modificationTime",
            F.regexp_extract("path", "year=([^/]+)", 1).cast("int").alias("year"),
            F.regexp_extract("path", "brand=([^/]+)", 1).alias("brand"))

    def ingest(files):
        keys = files.select("year", "brand").distinct()
        rows = spark.read.parquet(landing).join(keys, ["year", "brand"], "left_semi")
        # one sheet for each year and brand
        return detail_from_sheets(rows.drop("year", "brand"), brands=brands, n_files=keys.count())

    for whole in (False, True):
        (
            _delivery(sheets, whole).hint("rebalance", F.col("year"), F.col("brand"))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("year", "brand").parquet(landing)
        )
        update(spark, listing(), root, ingest)
    gone = listing().filter(F.col("brand").endswith("3") & (F.col("year") == 1997))
    for row in gone.select("year", "brand").distinct().collect():
        warehouse.delete_folder(spark, f"{landing}/year={row.year}/brand={row.brand}")
    emptied = (F.col("year") == 1999) & F.col("brand").endswith("4") & (F.col("row_idx") < 20)
    (
        _delivery(sheets, True).filter(emptied)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("year", "brand").parquet(landing)
    )
    update(spark, listing(), root, ingest)
    return warehouse.load(spark, root).totals


@register
def ingest_folder(spark, sf_dir):
    """A folder of workbooks, of very different lengths, to the fact table."""
    landing = shared_dir(spark, "landing")
    facts.land_workbooks(facts.sheet_cells(spark, sf_dir), landing)
    return detail_from_workbooks(spark, landing, brands=_all_file_brands(spark, sf_dir))


@register
def incremental_workbooks(spark, sf_dir):
    """The deliveries of ``incremental_update`` as a folder of workbooks. Each update opens the
    files that changed, and no others."""
    landing, root = shared_dir(spark, "landing"), shared_dir(spark, "tables")
    brands, given = _all_file_brands(spark, sf_dir), _given_sheets(spark, sf_dir)

    def take():
        files = list_workbooks(spark, landing)
        listed = path_keys(files.withColumn("rel", relative_path(F.col("path"), landing)), brands, "rel")
        return update(spark, listed, root, ingest)

    def ingest(files):
        sheets = read_listed(spark, landing, files).withColumn("path", relative_path(F.col("path"), landing))
        return detail_from_sheets(stage(sheets, shared_dir(spark, "sheets")), brands=brands, n_files=files.count())

    for whole in (False, True):
        facts.land_workbooks(_delivery(given, whole), landing)
        take()
    gone = list_workbooks(spark, landing).filter(F.col("path").rlike(r"/1997/[^/]*3\.xlsx$"))
    for row in gone.select("path").collect():
        warehouse.delete_folder(spark, row.path)
    emptied = (F.col("year") == 1999) & F.col("brand").endswith("4") & (F.col("row_idx") < 20)
    facts.land_workbooks(_delivery(given, True).filter(emptied), landing)
    take()
    return warehouse.load(spark, root).totals


@register
def incremental_update_stream(spark, sf_dir):
    """The first two deliveries under new names, taken in by a streaming source. Each comes in two
    batches of files, so that every sheet is cut."""
    landing, root = shared_dir(spark, "arrivals"), shared_dir(spark, "tables")
    checkpoint = shared_dir(spark, "progress")
    brands, sheets = _all_file_brands(spark, sf_dir), _given_sheets(spark, sf_dir)
    schema = "path string, row_idx bigint, cells array<string>, first_cell string, year int, brand string"
    n = facts.files_of_delivery(spark, sf_dir)

    def ingest(rows):
        keys = rows.select("year", "brand").distinct()  # one sheet for each
        return detail_from_sheets(rows.select("path", "row_idx", "cells", "first_cell"), brands=brands, n_files=keys.count())

    for number, whole in enumerate((False, True)):
        (
            _delivery(sheets, whole).repartition(2 * n, "path", "row_idx")
            .write.mode("append").parquet(f"{landing}/delivery={number}")
        )
        arrivals = (
            spark.readStream.schema(schema).option("recursiveFileLookup", True)
            .option("maxFilesPerTrigger", n).parquet(landing)
            .withColumn("delivery", F.regexp_extract("_metadata.file_path", "delivery=([0-9]+)", 1))
            .withColumn("delivered_at", F.col("_metadata.file_modification_time"))
        )
        update_stream(arrivals, root, checkpoint, ingest).awaitTermination()
    return warehouse.load(spark, root).totals
