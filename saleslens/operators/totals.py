"""TOTAL rows and their union with the detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ALL_MONTHS, TOTAL_BLANK_SPECS, TOTAL_LABEL
from ..schema import FACT, conform
from .grouping import sum_by

TOTAL_KEYS = ["brand", "year", "sales_type"]


def total_rows(sums: DataFrame) -> DataFrame:
    """Sums per (brand, year, sales_type) as rows of the fact schema."""
    label = F.concat(F.lit(f"{TOTAL_LABEL} "), "brand")
    rows = sums.select(
        "brand",
        label.alias("segment"),
        label.alias("model"),
        F.lit(ALL_MONTHS).alias("month"),
        "sales_type",
        "sales",
        "year",
        F.lit(True).alias("is_summary"),
        F.lit(-1).alias("row_index"),
        F.concat_ws("_", F.lit(TOTAL_LABEL), "brand", F.col("year").cast("string"),
                    "sales_type").alias("vr_id"),
        *[F.lit("").alias(c) for c in TOTAL_BLANK_SPECS],
    )
    return conform(rows, FACT)


def totals(sales: DataFrame) -> DataFrame:
    """TOTAL rows of a detail table, or of any table summed from it by finer keys.

    TOTAL rows already among the input are left out, so a second run adds nothing.
    """
    if "is_summary" in sales.columns:
        sales = sales.filter(~F.col("is_summary"))
    return total_rows(sum_by(sales, TOTAL_KEYS))


def with_totals(detail: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Detail and TOTAL rows in one table, matched by column name."""
    return detail.unionByName(totals(detail) if total is None else total,
                              allowMissingColumns=True)
