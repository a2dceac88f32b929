"""Result tables in the shape a chart needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import ALL_MONTHS, MONTHS
from ..functions.scalars import month_number
from .grouping import sum_by, with_keys


def bar(df: DataFrame) -> DataFrame:
    """Sales by brand, split by sales type where there is one."""
    keys = ["brand", "sales_type"] if "sales_type" in df.columns else ["brand"]
    return sum_by(df, keys)


def line(df: DataFrame) -> DataFrame:
    """Sales by month, split by brand where there is one, with the month's number for the axis."""
    keys = ["month", "brand"] if "brand" in df.columns else ["month"]
    return sum_by(df, keys).withColumn("month_no", month_number(F.col("month")))


def share(df: DataFrame, name: str | None = None, digits: int = 6) -> DataFrame:
    """Sales per name and their part of all sales.

    The grand total is a scalar subquery over the grouped rows: a window over everything would
    bring all names into one task.
    """
    if name is None:
        name = "brand" if "brand" in df.columns else df.columns[0]
    sums = sum_by(df, [name])
    total = sums.agg(F.sum("sales").cast("double")).scalar()
    part = F.try_divide(F.col("sales").cast("double"), total)
    return sums.withColumn("share", F.round(part, digits))


def heatmap(df: DataFrame, months: list[str] | None = None) -> DataFrame:
    """One row per brand, one column per month in calendar order; several rows per cell add up."""
    months = months or MONTHS
    return (
        with_keys(df, ["brand", "month"])
        .groupBy("brand").pivot("month", months).agg(F.sum("sales").cast("bigint"))
    )


def default(df: DataFrame) -> DataFrame:
    """Sales, or else the last column, summed by the first column."""
    value = "sales" if "sales" in df.columns else df.columns[-1]
    first = df.columns[0]
    return with_keys(df, [first]).groupBy(first).agg(F.sum(value).alias(value))


def for_chart(df: DataFrame, chart_type: str | None) -> DataFrame:
    """The shape of a chart type; types without one of their own take the default."""
    shapes = {"bar": bar, "line": line, "pie": share}
    if chart_type == "heatmap":
        return heatmap(df, [*MONTHS, ALL_MONTHS])
    return shapes.get(chart_type, default)(df)
