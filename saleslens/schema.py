"""Table schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import EXTRA_SPEC_COLUMNS, SPEC_COLUMNS

# One row per spreadsheet row; cells are addressed by position.
SHEET_ROWS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("row_idx", T.LongType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
])

# One row per vehicle row, month and sales type.
FACT = T.StructType([
    T.StructField("brand", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("sales_type", T.StringType()),
    T.StructField("sales", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("is_summary", T.BooleanType()),
    T.StructField("row_index", T.LongType()),
    T.StructField("vr_id", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in SPEC_COLUMNS],
])

# What may follow the fact columns when the sheet carries them.
EXTRA_SPECS = [T.StructField(c, T.StringType()) for c in EXTRA_SPEC_COLUMNS]


def conform(df: DataFrame, schema: T.StructType = FACT) -> DataFrame:
    """Project ``df`` onto ``schema``: cast what is there, null what is not, drop the rest."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
