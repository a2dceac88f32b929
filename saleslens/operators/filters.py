"""Filters of a structured query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EXACT_TECH_FIELDS, TOTAL_LABEL
from ..functions.scalars import matches_any

# Column that stands in for a field under its other name.
ALIASES = {"ff_fr": "system"}


def column_for(df: DataFrame, name: str) -> str | None:
    """The column a field stands for, or None where the table has none."""
    if name in df.columns:
        return name
    alias = ALIASES.get(name)
    return alias if alias in df.columns else None


def keep_in(df: DataFrame, name: str, values: list, strict: bool = False) -> DataFrame:
    """Rows whose field is one of ``values``; an empty list or an absent field keeps all."""
    if not values:
        return df
    column = column_for(df, name)
    if column is None:
        if strict:
            raise ValueError(f"no column {name!r} to filter on")
        return df
    return df.filter(F.col(column).isin(values))


def keep_matching(df: DataFrame, name: str, patterns: list, literal: bool = False,
                  strict: bool = False) -> DataFrame:
    """Rows whose field matches any pattern."""
    if not patterns:
        return df
    column = column_for(df, name)
    if column is None:
        if strict:
            raise ValueError(f"no column {name!r} to filter on")
        return df
    return df.filter(matches_any(F.col(column), patterns, literal))


def is_total_segment(segment: Column) -> Column:
    """Whether a segment label is that of a TOTAL row."""
    return F.coalesce(F.upper(segment).contains(TOTAL_LABEL), F.lit(False))


def apply_filters(df: DataFrame, spec, literal: bool = False, strict: bool = False) -> DataFrame:
    """All filters of a spec; they are ANDed, so Catalyst merges and pushes them."""
    for name, values in [
        ("brand", spec.brands),
        ("sales_type", spec.sales_types),
        ("month", spec.months),
        ("segment", spec.filtered_segments),
        ("year", spec.years),
    ]:
        df = keep_in(df, name, values, strict)
    df = keep_matching(df, "model", spec.model, literal, strict)
    for name, values in spec.technical_filters.items():
        if name in EXACT_TECH_FIELDS:
            df = keep_in(df, name, values, strict)
        else:
            df = keep_matching(df, name, [str(v) for v in values], literal, strict)
    return df
