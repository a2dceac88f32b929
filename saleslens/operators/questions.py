"""Language and intent columns for a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

_LOW = "_lowered"


def with_language(df: DataFrame, text: str = "text", picked: str | None = None) -> DataFrame:
    """Add ``language``; with ``picked``, a column of chosen languages, ``final_language`` too."""
    out = df.withColumn(_LOW, F.lower(text)).withColumn("language", tx.detect_language(F.col(_LOW)))
    if picked is not None:
        out = out.withColumn(
            "final_language", tx.effective_language(F.col(picked), F.col("language")))
    return out.drop(_LOW)


def with_intent(df: DataFrame, text: str = "text", scores: bool = False,
                whole_words: bool = False) -> DataFrame:
    """Add ``intent``, and with ``scores`` the keyword hits behind it.

    Keywords count as substrings, ``fr`` in "from" included, unless ``whole_words``.
    """
    out = df.withColumn(_LOW, F.lower(text)).withColumns({
        f"{intent}_score": score
        for intent, score in tx.intent_scores(F.col(_LOW), whole_words).items()
    })
    out = out.withColumn("intent", tx.intent_from_scores(
        F.col("specification_score"), F.col("sales_score"), F.col("prediction_score"))).drop(_LOW)
    if scores:
        return out
    return out.drop("specification_score", "sales_score", "prediction_score")


def classified(df: DataFrame, text: str = "text", scores: bool = False) -> DataFrame:
    """Add ``language`` and ``intent`` (and its scores); each text is lowered once for both."""
    out = df.withColumn(_LOW, F.lower(text))
    low = F.col(_LOW)
    hits = {f"{intent}_score": score for intent, score in tx.intent_scores(low).items()}
    out = out.withColumns({**hits, "language": tx.detect_language(low)}).drop(_LOW)
    out = out.withColumn("intent", tx.intent_from_scores(
        F.col("specification_score"), F.col("sales_score"), F.col("prediction_score")))
    return out if scores else out.drop("specification_score", "sales_score", "prediction_score")


def with_second_opinion(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``expected_intent`` by the short word lists."""
    return (
        df.withColumn(_LOW, F.lower(text))
        .withColumn("expected_intent", tx.second_opinion(F.col(_LOW))).drop(_LOW)
    )
