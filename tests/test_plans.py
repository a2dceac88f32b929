"""What the plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from saleslens.plans.run import run
from saleslens.plans.tables import SalesTables
from saleslens.sources import warehouse
from workload import facts
from workload.queries import REGISTRY

EAGER = {"ingest_detail", "run_metadata", "sink_roundtrip", "incremental_update", "incremental_update_stream",
         "ingest_workbooks", "ingest_csv", "export_roundtrip", "stored_equals_derived", "ingest_folder",
         "incremental_workbooks", "stored_aggregates", "distinct_counts_stored", "top_values"}
PYTHON = {"ingest_problems"}  # decodes workbooks
LAZY = sorted(set(REGISTRY) - EAGER - PYTHON)


def plan_of(df, formatted=False):
    execution = df._jdf.queryExecution()
    return execution.toString() if formatted else execution.executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("warehouse") / "tables")
    return warehouse.save(spark, facts.detail(spark, sf_dir), root)


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_pair_products(name, spark, sf_dir):
    plan = plan_of(REGISTRY[name](spark, sf_dir))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in plan, node


def test_filters_reach_the_scan(stored):
    plan = plan_of(run({"intent": "specification", "brands": ["Brand#11"], "years": [1997],
                        "sales_types": ["wholesales"], "months": ["jan"]}, stored))
    partition = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "year" in partition and "brand" in partition
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(sales_type,wholesales)" in pushed and "EqualTo(month,jan)" in pushed


def test_only_needed_columns_are_read(stored):
    plan = plan_of(run({"operation": "comparison"}, stored))
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} <= {"brand", "segment", "sales_type", "sales"}


def test_ranking_is_a_top_n(stored):
    plan = plan_of(run({"operation": "model_specs"}, stored))
    assert "TakeOrderedAndProject(limit=10" in plan
    assert "BroadcastHashJoin" in plan


def test_extraction_of_sheets_shuffles_only_for_headers(spark, make_sheet):
    from conftest import sheet_line
    from saleslens.plans.build import detail_from_sheets

    rows = make_sheet([(0, sheet_line("VR-ID")), (1, sheet_line("ABCD0001"))])
    plan = plan_of(detail_from_sheets(rows, n_files=1))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BroadcastHashJoin" in plan


def test_month_cells_are_read_once(make_sheet):
    from conftest import sheet_line
    from saleslens.plans.build import detail_from_sheets

    rows = make_sheet([(0, sheet_line("VR-ID")), (1, sheet_line("ABCD0001"))])
    assert plan_of(detail_from_sheets(rows)).count("[dDfFxX]$") == 1


def test_results_hold_at_any_partitioning(spark, sf_dir, stored):
    spec = {"operation": "model_specs"}
    want = run(spec, stored).orderBy("rank").collect()
    scattered = SalesTables(stored.detail.repartition(13, F.rand(3)))
    assert run(spec, scattered).orderBy("rank").collect() == want


def test_a_hot_brand_stays_whole(spark, sf_dir, tmp_path):
    """A third and more of all rows in one brand and model: nothing is lost or capped."""
    detail = facts.detail(spark, sf_dir)
    hot = detail.unionByName(
        detail.withColumn("brand", F.lit("HOT")).withColumn("model", F.lit("HOT")))
    tables = warehouse.save(spark, hot, str(tmp_path / "hot"))
    assert tables.detail.count() == 2 * detail.count()
    best = run({"operation": "model_specs"}, tables).filter("rank = 1").first()
    assert (best.model, best.sales) == ("HOT", detail.agg(F.sum("sales")).first()[0])


def test_cross_reference_reads_each_table_once_a_side(spark, sf_dir):
    plan = plan_of(REGISTRY["quality_cross_reference"](spark, sf_dir))
    assert plan.count("FileScan") <= 11  # 19 when counts and brands were taken apart


def test_scores_read_the_tallies(spark, sf_dir):
    """The answers are read once, into a small table; the scores of all questions follow from that."""
    for name in ("quality_score", "report_recommendations"):
        assert plan_of(REGISTRY[name](spark, sf_dir)).count("FileScan") <= 10  # 29 when each check read for itself


def test_integrity_aggregates_by_hash(spark, sf_dir):
    plan = plan_of(REGISTRY["integrity_record"](spark, sf_dir))
    wide = [line for line in plan.splitlines() if "ObjectHashAggregate" in line and "gvw" in line.split("functions=")[0]]
    assert not wide


def test_updates_read_touched_partitions_only(spark, stored):
    detail = warehouse.of_keys(stored.detail, [(1997, "Brand#11"), (1998, "Brand#12")])
    partition = plan_of(detail).split("PartitionFilters: [")[1].split("]")[0]
    assert all(key in partition for key in ("1997", "Brand#11", "1998"))


def test_cells_are_gathered_where_they_join(spark, sf_dir):
    """One shuffle by vehicle for both the gathering and the join; no wide row is pivoted or sorted."""
    plan = REGISTRY["clean_sales"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "pivotfirst" not in plan and "SortMergeJoin" not in plan and "Sort [" not in plan
    assert plan.count("Exchange hashpartitioning(l_partkey#") == 2  # the sums, by all their keys, and the cells


def test_deliveries_come_from_one_computation(spark, sf_dir, monkeypatch):
    """The sheets behind all deliveries are computed once, not once for each delivery."""
    cells, calls = facts.sheet_cells, []
    monkeypatch.setattr(facts, "sheet_cells", lambda *given: calls.append(1) or cells(*given))
    assert REGISTRY["incremental_update"](spark, sf_dir).count() > 0
    assert len(calls) == 1  # three before


def test_a_run_record_sends_headers_and_reads_facts_once(spark, sf_dir):
    """Header rows are broadcast, and what facts and TOTAL rows are counted from is written before."""
    plan = plan_of(REGISTRY["run_metadata"](spark, sf_dir))
    assert "SortMergeJoin" not in plan and "MapInArrow" not in plan and "MapInPandas" not in plan


def test_units_are_dealt_in_proportion_to_the_lines(spark, sf_dir, monkeypatch):
    """Wide rows are made in tasks whose number follows the input; AQE coalesces none of them."""
    import os

    monkeypatch.setattr(facts, "BYTES_OF_LINES", 1_000)
    n = -(-os.path.getsize(f"{sf_dir}/lineitem.parquet") // 1_000)
    for name in ("view_specs_only", "integrity_record", "quality_cross_reference"):
        plan = plan_of(REGISTRY[name](spark, sf_dir))
        assert f", {n}), REPARTITION_BY_NUM" in plan


def test_integrity_counts_written_specifications(stored):
    from saleslens.operators import views

    record = views.integrity_record(stored.master, "now", stored.specs_only)
    assert record.collect() == views.integrity_record(stored.master, "now").collect()
    keys = [line for line in plan_of(record).splitlines() if "HashAggregate(keys=" in line]
    assert not any("gvw" in line for line in keys)


@pytest.mark.parametrize("name", ["stored_equals_derived", "stored_aggregates"])
def test_questions_share_one_pass_over_the_facts(name, spark, sf_dir):
    """What is asked of derived tables reads written facts; no question joins or sums the lines again."""
    plan = plan_of(REGISTRY[name](spark, sf_dir))
    assert "Join" not in plan and "lineitem" not in plan


def test_months_of_a_specification_are_folded_before_the_shuffle(make_fact):
    from saleslens.operators import views

    months = ["jan", "jan", "dec", "all", None, None, "JAN", ""]
    rows = [{"month": m, "sales_type": t, "vr_id": v} for m in months for t in ("wholesales", "retail_sales")
            for v in ("VR1", None)]
    specs = views.specs_only(make_fact(*rows, {"month": "feb", "vr_id": "VR1", "cc": "1500"}, {"month": "feb", "brand": None}))
    found = [(r.brand, r.vr_id, r.cc, r.month) for r in specs.collect()]
    want = {("HINO", v, "", m) for v in ("VR1", None) for m in months}
    assert len(found) == len(set(found))
    assert set(found) == want | {("HINO", "VR1", "1500", "feb"), (None, "VR000001", "", "feb")}
    shuffled = plan_of(specs).split("Exchange hashpartitioning(")[1].split("]")[0]
    assert "vr_id#" in shuffled and "month#" not in shuffled


def test_specifications_without_months(make_fact):
    from saleslens.operators import views

    facts_without = make_fact({"month": "jan"}, {"month": "feb"}, {"model": "M2"}).drop("month")
    assert views.specs_only(facts_without).count() == 2
