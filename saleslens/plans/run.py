"""From a structured query to one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MONTHS, TECH_SPEC_KEYS
from ..functions.scalars import month_number
from ..operators.filters import apply_filters, column_for, is_total_segment
from ..operators.grouping import aggregate, group_by, merged
from ..operators.ranking import top_models
from .spec import QuerySpec
from .tables import SalesTables

TECHNICAL_EXTRAS = ["vr_id", "cc", "tank"]
DEFAULT_TECHNICAL_KEYS = ["fuel", "transmission"]


def source_name(spec: QuerySpec, compat: bool = False) -> str:
    """The table a query reads.

    Specification questions read vehicle rows, the rest reads TOTAL rows. A question that TOTAL
    rows cannot answer (by month, segment, model or specification) reads vehicle rows as well;
    with ``compat`` it does not, and a ranking lets TOTAL rows compete.
    """
    if spec.is_specification:
        return "master" if compat and spec.is_ranking else "detailed"
    if spec.below_totals and not compat:
        return "detailed"
    return "summary"


def source(spec: QuerySpec, tables: SalesTables, compat: bool = False) -> DataFrame:
    name = source_name(spec, compat)
    df = tables[name]
    if name == "summary":
        return df.filter(is_total_segment(F.col("segment")))
    return tables.stored["rollup"] if reads_rollup(spec, tables, compat) else df


def reads_rollup(spec: QuerySpec, tables: SalesTables, compat: bool = False) -> bool:
    """Whether the stored roll-up answers a query of vehicle rows: it holds sums, numbers and
    extremes of the same rows, by month and segment, in far fewer rows."""
    months_only = not (spec.model or any(spec.technical_filters.values()))
    return (source_name(spec, compat) == "detailed" and not spec.is_specification and months_only
            and tables.has_stored("rollup"))


def _default_keys(spec: QuerySpec) -> list[str]:
    if spec.operation == "comparison":
        return ["brand", "sales_type", "year"]
    if spec.analysis_type == "trend":
        return ["month", "brand", "sales_type"]
    return ["brand", "sales_type", "month"]


def _with_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """Add fields that the table holds under another name."""
    for name in names:
        column = column_for(df, name)
        if column is not None and name not in df.columns:
            df = df.withColumn(name, F.col(column))
    return df


def technical_analysis(df: DataFrame, spec: QuerySpec, default_keys: bool = False) -> DataFrame:
    """By brand, the filtered fields, vehicle, cc and tank: sales and number of model rows."""
    fields = list(spec.technical_filters)
    if default_keys and not fields:
        fields = DEFAULT_TECHNICAL_KEYS
    df = _with_fields(df, fields)
    keys = list(dict.fromkeys(c for c in ["brand", *fields, *TECHNICAL_EXTRAS] if c in df.columns))
    return group_by(df, keys, aggregate(spec.aggregation, "sales").alias("sales"),
                    F.count("model").alias("model_count"))


def technical_specs(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """By up to ten specification columns: sales, number of rows, number of models."""
    df = _with_fields(df, TECH_SPEC_KEYS)
    keys = [c for c in TECH_SPEC_KEYS if c in df.columns]
    return group_by(
        df, keys,
        aggregate(spec.aggregation, "sales").alias("total_sales"),
        F.count("model").alias("record_count"),
        F.countDistinct("model").alias("unique_models"),
    )


def run(query, tables: SalesTables, *, compat: bool = False, literal: bool = False,
        strict: bool = False, top: int = 10, default_tech_keys: bool = False) -> DataFrame:
    """Answer a structured query.

    ``compat``: read the tables as the original rules say, TOTAL rows included (``source_name``).
    ``literal``: patterns are plain text. ``strict``: a filter on an absent column raises.
    """
    spec = QuerySpec.of(query)
    df = apply_filters(source(spec, tables, compat), spec, literal, strict)
    if spec.is_ranking:
        if "model" in df.columns:
            return top_models(df, top)
        return group_by(df, ["brand", "segment"],
                        aggregate(spec.aggregation, "sales").alias("sales"))
    if reads_rollup(spec, tables, compat):
        sales = merged(spec.aggregation).alias("sales")
    else:
        sales = aggregate(spec.aggregation, "sales").alias("sales")
    if spec.operation == "comparison":
        return group_by(df, _default_keys(spec), sales)
    if spec.operation == "technical_analysis":
        return technical_analysis(df, spec, default_tech_keys)
    if spec.analysis_type == "technical_specs":
        return technical_specs(df, spec)
    return group_by(df, _default_keys(spec), sales)


def in_month_order(df: DataFrame) -> DataFrame:
    """Sorted by calendar month (``all`` last), then by the other text columns."""
    others = [c for c, t in df.dtypes if t == "string" and c != "month"]
    return df.orderBy(F.coalesce(month_number(F.col("month")), F.lit(len(MONTHS) + 1)), *others)
