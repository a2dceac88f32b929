"""Small document tables with every odd case."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["an", "be", "co", "der", "el", "fi", "gan", "ho", "is", "ka", "lu", "mo"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_docs(spark, extra=True):
    """Nulls in any column, empty, blank and very long texts, repeated rows, null and repeated ids,
    and, with ``extra``, columns whose names the operators would like to use."""
    rows = [
        (1, prose(1, 120), "en", "a", 1), (2, prose(2, 130), "en", None, 2), (3, None, "en", "a", 3),
        (4, "", None, "b", None), (5, " \t\n ", "de", "b", 5), (6, prose(6, 20_000), "de", "a", 6),
        (7, prose(1, 120), "en", "a", 7), (7, prose(1, 120), "en", "a", 7), (None, prose(8, 90), None, None, None),
        (None, prose(8, 90), None, None, None), (9, "x" * 50_000, "en", "a", 9), (10, "1234 !!", "en", "a", 10),
        (11, "naïve Ünïcode 文字 words", "de", "a", 11), (12, prose(1, 119) + " changed", "en", "a", 12),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("kept", "n_words", "score", "n_tokens", "removed", "digest", "text_key", "items", "row_key", "spans"):
            df = df.selectExpr("*", f"'mine' AS {name}")
    return df


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
