"""Distributions, statistics and catalogues of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DISTRIBUTION_COLUMNS, SALES_TYPES
from .filters import column_for
from .grouping import with_keys

# Columns whose distinct values are kept as sketches, the bits of a sketch's buckets, and its error.
SKETCHED = ["segment", "model", "month", "sales_type", "vr_id", "cc", "tank"]
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
# A frequency sketch of so many items may lose values of up to this many rows for each item's share.
TOP_K_ERROR = 3.5
CATALOGUE_COLUMNS = ["brand", "sales_type", "month", "segment", "year"]


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """``dimension, value`` rows of the named columns, nulls left out."""
    present = [(c, column_for(df, c)) for c in columns]
    texts = df.select(*[F.col(source).cast("string").alias(c) for c, source in present if source])
    return (
        texts.unpivot([], texts.columns, "dimension", "value")
        .filter(F.col("value").isNotNull())
    )


def catalogue(df: DataFrame, columns: list[str] = CATALOGUE_COLUMNS) -> DataFrame:
    """The distinct values of each column as ``dimension, value`` rows."""
    return _long(df, columns).distinct()


def distribution(df: DataFrame, columns: list[str] = DISTRIBUTION_COLUMNS) -> DataFrame:
    """Row counts per value of each specification column, all columns in one pass."""
    return _long(df, columns).groupBy("dimension", "value").agg(
        F.count(F.lit(1)).alias("n_rows"))


def in_descending_order(counts: DataFrame) -> DataFrame:
    return counts.orderBy("dimension", F.desc("n_rows"), "value")


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row: the number of distinct values per column, nulls left out.

    ``approximate`` uses a sketch of fixed size instead of one shuffle row per distinct value.
    """
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[count(c).alias(c) for c in columns])


def sketches(df: DataFrame, columns: list[str] = SKETCHED) -> DataFrame:
    """Per (year, brand), a sketch of the distinct values of each column: of bounded size, and
    mergeable over any years and brands. Nulls are left out."""
    return df.groupBy("year", "brand").agg(*[F.hll_sketch_agg(c, F.lit(SKETCH_BITS)).alias(c) for c in columns])


def merged_distinct_counts(sketched: DataFrame, columns: list[str]) -> DataFrame:
    """``distinct_counts`` from sketches, with a relative standard error of ``SKETCH_ERROR``; few
    values are counted as they are."""
    return sketched.agg(*[
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns])


def top_values(df: DataFrame, column: str, k: int = 10, tracked: int = 10_000) -> DataFrame:
    """The ``k`` most frequent values of a column, ``value`` and ``n_rows``; equal counts by value.

    A sketch of ``tracked`` items names the candidates in one pass without a shuffle of values, a
    second pass counts them. A value that the sketch lost is rarer than its error, so the counts
    hold if the ``k``-th is above that, or if they make up all rows; if not, all values are counted.
    """
    source = column_for(df, column) or column
    values = df.select(F.col(source).cast("string").alias("value")).filter(F.col("value").isNotNull())
    row = values.agg(F.count(F.lit(1)).alias("n"), F.transform(
        F.expr(f"approx_top_k(value, {tracked}, {tracked})"), lambda c: c["item"]).alias("items")).first()
    # at most ``tracked`` groups
    found = values.filter(F.col("value").isin(row["items"] or [])).groupBy("value").agg(
        F.count(F.lit(1)).alias("n_rows")).collect()
    first = sorted(found, key=lambda r: (-r.n_rows, r.value))[:k]
    complete = sum(r.n_rows for r in found) == row["n"]
    if complete or (len(first) == k and first[-1].n_rows > TOP_K_ERROR * row["n"] / tracked):
        return df.sparkSession.createDataFrame(first, "value string, n_rows bigint")
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "value").limit(k)


def result_stats(df: DataFrame) -> DataFrame:
    """One row: total, number, mean and maximum of sales, and the distinct brands and types.

    Figures are 0 and lists empty where the column is absent.
    """
    def figure(fn):
        if "sales" not in df.columns:
            return F.lit(0.0)
        return F.coalesce(fn("sales").cast("double"), F.lit(0.0))

    def values(column):
        if column not in df.columns:
            return F.array().cast("array<string>")
        return F.sort_array(F.collect_set(column))

    return df.agg(
        figure(F.sum).alias("total_sales"),
        F.count(F.lit(1)).alias("record_count"),
        figure(F.avg).alias("avg_sales"),
        figure(F.max).alias("max_sales"),
        values("brand").alias("brands"),
        values("sales_type").alias("sales_types"),
    )


def headline(df: DataFrame) -> DataFrame:
    """One row: brands, rows, sales types, and first and last year."""
    return df.agg(
        F.countDistinct("brand").alias("brands"),
        F.count(F.lit(1)).alias("total_records"),
        F.countDistinct("sales_type").alias("sales_types"),
        F.concat_ws("-", F.min("year").cast("string"), F.max("year").cast("string"))
        .alias("time_period"),
    )


def brand_summary(df: DataFrame) -> DataFrame:
    """Rows, sales and mean sales per brand."""
    return with_keys(df, ["brand"]).groupBy("brand").agg(
        F.count("sales").alias("count"),
        F.sum("sales").alias("sum"),
        F.round(F.avg("sales"), 2).alias("mean"),
    )


def crosstab(df: DataFrame, types: list[str] = SALES_TYPES) -> DataFrame:
    """Sales by brand, one column per sales type, 0 where there is none."""
    return (
        with_keys(df, ["brand", "sales_type"])
        .groupBy("brand").pivot("sales_type", types).agg(F.sum("sales")).na.fill(0, types)
    )


def mean_null_share(columns: list[str]) -> Column:
    """Aggregate: the share of nulls per column, averaged over the columns."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.avg(F.col(f"`{c}`").isNull().cast("double"))
    return total / F.lit(len(columns))


def null_share(df: DataFrame) -> DataFrame:
    """One row: the mean share of nulls of a table."""
    return df.agg(mean_null_share(df.columns).alias("null_share"))
