"""Derived views of the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ALL_MONTHS, MONTHS, SALES_ONLY_COLUMNS, SPECS_ONLY_COLUMNS, TOTAL_LABEL
from .grouping import sum_by, with_keys

FLAG_COLUMNS = ["is_summary", "row_index"]
MONTHLY_KEYS = ["brand", "segment", "month", "sales_type", "year"]
COMPARISON_KEYS = ["brand", "sales_type", "year"]


def _existing(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def summary(master: DataFrame) -> DataFrame:
    return master.filter("is_summary").drop(*FLAG_COLUMNS)


def detailed(master: DataFrame) -> DataFrame:
    return master.filter("NOT is_summary").drop(*FLAG_COLUMNS)


def monthly(master: DataFrame) -> DataFrame:
    """Sales by brand, segment, month, sales type and year.

    TOTAL rows, where the input has them, form groups of their own (month ``all``); ``is_total``
    tells them apart.
    """
    return mark_totals(sum_by(master, MONTHLY_KEYS))


def mark_totals(months: DataFrame) -> DataFrame:
    return months.withColumn("is_total", F.col("month") == ALL_MONTHS)


def monthly_by_grouping_sets(detail: DataFrame) -> DataFrame:
    """``monthly`` of detail and totals from the detail alone, in one pass.

    The fine and the TOTAL groups are two grouping sets of one aggregate. Each row is expanded
    twice before the map-side sum; worth it where reading the detail costs more than that.
    """
    total = F.grouping("segment") == 1
    keys = [F.col(k) for k in MONTHLY_KEYS]
    brand, segment, month, sales_type, year = keys
    return (
        with_keys(detail, MONTHLY_KEYS)
        .groupingSets([keys, [brand, sales_type, year]], *keys)
        .agg(F.sum("sales").cast("bigint").alias("sales"), total.alias("is_total"))
        .withColumn("segment", F.when(F.col("is_total"), F.concat(F.lit(f"{TOTAL_LABEL} "), brand))
                    .otherwise(segment))
        .withColumn("month", F.when(F.col("is_total"), F.lit(ALL_MONTHS)).otherwise(month))
    )


def brand_comparison(master: DataFrame, compat: bool = False) -> DataFrame:
    """Sales by brand, sales type and year.

    TOTAL rows are left out. With ``compat`` they are summed along with the rows they total,
    which gives twice the true figure.
    """
    if not compat and "is_summary" in master.columns:
        master = master.filter("NOT is_summary")
    return sum_by(master, COMPARISON_KEYS)


def specs_only(master: DataFrame) -> DataFrame:
    """The distinct specifications.

    The months of a vehicle and year are folded into the bits of one number first, so that its texts are
    shuffled once and not once a month.
    """
    columns = _existing(master, SPECS_ONLY_COLUMNS)
    if "month" not in columns:
        return master.select(*columns).distinct()
    known = [F.lit(m) for m in (*MONTHS, ALL_MONTHS)]
    keys = [c for c in columns if c != "month"]
    # bit 0 is the month in ``other``: null, or a text of its own
    at = F.coalesce(F.array_position(F.array(*known), F.col("month")), F.lit(0)).cast("int")
    folded = (
        master.select(*keys, F.when(at == 0, F.col("month")).alias("other"),
                      F.call_function("shiftleft", F.lit(1), at).alias("bits"))
        .groupBy(*keys, "other").agg(F.bit_or("bits").alias("bits"))
    )
    months = folded.select("*", F.posexplode(F.array(F.col("other"), *known)).alias("at", "month"))
    return months.filter(F.getbit("bits", F.col("at")) == 1).select(*columns)


def sales_only(master: DataFrame) -> DataFrame:
    return master.select(*_existing(master, SALES_ONLY_COLUMNS))


def integrity_record(master: DataFrame, created_at: Column | str | None = None,
                     specs: DataFrame | None = None) -> DataFrame:
    """One row: record counts, coverage, brands and types, and whether TOTAL rows agree.

    Specifications are the distinct ones of ``master``, or the rows of ``specs`` where these are written
    already. All else is folded to a row per brand and sales type first.
    """
    created = F.lit(created_at) if isinstance(created_at, str) else created_at
    specs = specs_only(master) if specs is None else specs
    per_type = master.groupBy("brand", "sales_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(~F.col("is_summary"), F.col("sales"))), F.lit(0)).alias("detail"),
        F.coalesce(F.sum(F.when(F.col("is_summary"), F.col("sales"))), F.lit(0)).alias("total"),
    )
    row = per_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("master_records"),
        F.sum("detail").alias("detail_sales"),
        F.sum("total").alias("total_sales"),
        F.sort_array(F.collect_set("brand")).alias("brands_covered"),
        F.sort_array(F.collect_set("sales_type")).alias("sales_types"),
    ).withColumn("specs_records", specs.agg(F.count(F.lit(1))).scalar())
    records = F.col("master_records")
    return row.select(
        *([created.alias("created_at")] if created is not None else []),
        "specs_records",
        records.alias("sales_records"),
        records,
        (F.coalesce("detail_sales", F.lit(0)) == F.coalesce("total_sales", F.lit(0)))
        .alias("data_integrity_check"),
        F.when(records > 0, F.col("specs_records") / records * 100).otherwise(F.lit(0.0))
        .alias("specs_coverage"),
        "brands_covered",
        "sales_types",
    )


def processing_summary(df: DataFrame) -> DataFrame:
    """One row: number of records, brands and models, and the sorted years."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("brand").alias("brands"),
        F.countDistinct("model").alias("unique_models"),
        F.sort_array(F.collect_set("year")).alias("years"),
    )


def processing_by_brand(df: DataFrame) -> DataFrame:
    """Records, sales and models per brand."""
    return df.filter(F.col("brand").isNotNull()).groupBy("brand").agg(
        F.count("sales").alias("record_count"),
        F.sum("sales").alias("total_sales"),
        F.countDistinct("model").alias("unique_models"),
    )
