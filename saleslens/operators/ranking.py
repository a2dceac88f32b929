"""Top-k and first-value operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouping import sum_by

RANKING_SPECS = ["brand", "segment", "vr_id", "cc", "transmission", "fuel", "tank"]
# Longest ranking that is sent to every task; a longer one joins by shuffle.
ROWS_TO_SEND = 10_000


def first_value(column: str, order: str) -> Column:
    """The value at the lowest ``order`` among rows where the column is not null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.struct(order, column))).alias(column)


def top_models(df: DataFrame, k: int = 10) -> DataFrame:
    """The k best-selling models with rank and specifications; equal sales rank by name.

    Sales per model come first and need two columns. The specification columns are then read
    again, but only the rows of the k winners go on from the join, so that no text is aggregated
    for models that are left out.
    """
    best = sum_by(df, ["model"]).orderBy(F.desc("sales"), "model").limit(k)
    specs = [c for c in RANKING_SPECS if c in df.columns]
    order = "vr_id" if "vr_id" in df.columns else "brand"
    winners = df.select("model", *specs).join(
        F.broadcast(best) if k <= ROWS_TO_SEND else best, "model")
    # one row per vehicle before the first values are looked for
    ranked = winners.distinct().groupBy("model", "sales").agg(
        *[first_value(c, order) for c in specs])
    # k rows reach the window
    by_rank = Window.orderBy(F.desc("sales"), "model")
    return ranked.select(
        F.row_number().over(by_rank).alias("rank"), "model", *specs, "sales")


def sample_rows(df: DataFrame, n: int = 20, seed: int = 0) -> DataFrame:
    """``n`` rows picked by a hash of the row and a seed: the same pick in every run.

    It plans as a top-n, so no task holds more than ``n`` rows.
    """
    whole = F.concat_ws("|", F.lit(str(seed)), *[
        F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns
    ])
    return df.withColumn("_pick", F.md5(whole)).orderBy("_pick").limit(n).drop("_pick")
