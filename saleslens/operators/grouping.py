"""Grouped aggregates with the conventions of the sales model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max,
}


def aggregate(name, column: str | Column) -> Column:
    """The aggregate of that name; ``sum`` where the name is empty or not a text."""
    if not isinstance(name, str) or not name:
        name = "sum"
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregation {name!r}; one of {sorted(AGGREGATES)}")
    return AGGREGATES[name](column)


def states(column: str) -> list[Column]:
    """What rows of a group are kept as, so that groups can be merged: sum, number, least, most."""
    return [F.sum(column).cast("bigint").alias("sales"), F.count(column).alias("n"),
            F.min(column).alias("low"), F.max(column).alias("high")]


def merged(name: str) -> Column:
    """The aggregate of that name over groups kept as ``states``."""
    if name in ("avg", "mean"):
        return F.sum("sales") / F.nullif(F.sum("n"), F.lit(0))
    return {"sum": F.sum("sales"), "count": F.sum("n"), "min": F.min("low"), "max": F.max("high")}[name]


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have all the keys."""
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def group_by(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Group by ``keys``; rows with a null key belong to no group."""
    return with_keys(df, keys).groupBy(*keys).agg(*aggregates)


def sum_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return group_by(df, keys, F.sum("sales").cast("bigint").alias("sales"))
