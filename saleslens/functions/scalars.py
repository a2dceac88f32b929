"""Scalar helpers over built-in functions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MONTH_NAMES_ID, MONTHS


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def month_name(month_no: Column) -> Column:
    """1..12 -> ``jan``..``dec``; anything else is null."""
    return F.try_element_at(_lookup(dict(enumerate(MONTHS, start=1))), month_no.cast("int"))


def month_number(month: Column) -> Column:
    """``jan``..``dec`` -> 1..12; anything else, such as ``all``, is null."""
    return F.try_element_at(_lookup({m: i for i, m in enumerate(MONTHS, start=1)}), month)


def month_name_id(month: Column) -> Column:
    """``jan``..``dec`` -> the Indonesian month name."""
    return F.try_element_at(_lookup(MONTH_NAMES_ID), month)


# White space as Unicode and the sheet readers see it: blanks, tabs, line breaks, no-break and
# typographic spaces.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


def to_number(text: Column) -> Column:
    """Text to double; null where it does not read as a number.

    Padding, exponents and underscores between digits are read; grouping commas, type suffixes
    (``5d``) and hexadecimal digits are not.
    """
    return stripped_number(strip(text))


def stripped_number(text: Column) -> Column:
    """As ``to_number``, of text without padding."""
    plain = F.when(
        text.contains("_"), F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")
    ).otherwise(text)
    return F.when(~plain.rlike("[dDfFxX]$|0[xX]"), plain.try_cast("double"))


def snake_case(text: Column) -> Column:
    """``PRODUCTION (CKD)`` -> ``production_ckd``."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit(" "), F.lit("_")), r"[()]", "")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether ``text`` holds at least one of the words, as a substring."""
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def count_present(text: Column, words: Iterable[str], whole_words: bool = False) -> Column:
    """How many of the words ``text`` holds. Substrings count unless ``whole_words``."""
    out = F.lit(0)
    for word in words:
        if whole_words:
            found = text.rlike(rf"(?<![\p{{L}}\p{{N}}]){re.escape(word)}(?![\p{{L}}\p{{N}}])")
        else:
            found = text.contains(word)
        out = out + found.cast("int")
    return out


def matches_any(text: Column, patterns: Iterable[str], literal: bool = False) -> Column:
    """Case-insensitive regex search for any pattern; null text is no match.

    With ``literal`` the patterns are plain substrings.
    """
    patterns = list(patterns)
    if literal:
        found = F.lit(False)
        for pattern in patterns:
            found = found | F.lower(text).contains(pattern.lower())
    else:
        found = text.rlike("(?iu)" + "|".join(patterns))
    return F.coalesce(found, F.lit(False))


def iso_timestamp(ts: Column) -> Column:
    """A timestamp as ISO 8601 text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
