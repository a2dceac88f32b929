"""Keyword classifiers for question texts.

The functions take text that is already lower-cased, so that a plan with several of them
lowers each text once (see ``operators.questions``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    DEFAULT_INTENT,
    DEFAULT_LANGUAGE,
    INTENT_WORDS,
    LANGUAGE_WORDS,
    SECOND_OPINION_WORDS,
)
from .scalars import contains_any, count_present


def detect_language(lowered: Column) -> Column:
    """Language code of a text: the first language of the word list with a hit."""
    hits = [F.when(contains_any(lowered, words), F.lit(code))
            for code, words in LANGUAGE_WORDS.items()]
    return F.coalesce(*hits, F.lit(DEFAULT_LANGUAGE))


def effective_language(picked: Column, detected: Column) -> Column:
    """The picked language, unless that is the default: then the detected one."""
    return F.when(picked != DEFAULT_LANGUAGE, picked).otherwise(detected)


def intent_scores(lowered: Column, whole_words: bool = False) -> dict[str, Column]:
    """Keyword hits per intent."""
    return {intent: count_present(lowered, words, whole_words)
            for intent, words in INTENT_WORDS.items()}


def intent_from_scores(spec: Column, sales: Column, prediction: Column) -> Column:
    """A strict winner between specification and sales; else prediction if it was hit at all."""
    return (
        F.when(spec > F.greatest(sales, prediction), F.lit("specification"))
        .when(sales > F.greatest(spec, prediction), F.lit("sales"))
        .when(prediction > 0, F.lit("prediction"))
        .otherwise(F.lit(DEFAULT_INTENT))
    )


def second_opinion(lowered: Column) -> Column:
    """The intent by the two short word lists."""
    sales = count_present(lowered, SECOND_OPINION_WORDS["sales"])
    spec = count_present(lowered, SECOND_OPINION_WORDS["specification"])
    return (
        F.when(sales > spec, F.lit("sales"))
        .when(spec > 0, F.lit("specification"))
        .otherwise(F.lit(DEFAULT_INTENT))
    )


def issue_advice(issue: Column) -> Column:
    """Advice for one issue text; null where no rule fits."""
    from ..constants import ISSUE_ADVICE

    rules = []
    for words, advice in ISSUE_ADVICE:
        fits = F.lit(True)
        for word in words:
            fits = fits & issue.contains(word)
        rules.append(F.when(fits, F.lit(advice)))
    return F.coalesce(*rules)
