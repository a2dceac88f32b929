"""Corpus pipeline: documents to token counts in five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's result
to the shared folder and rereads it as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.llm import bpe, decontaminate, forest, ordinal, units
from saleslens.llm.common import col, staged
from saleslens.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, taught by ``labels``, finds good enough.

    Null and empty texts are judged as empty texts. All columns stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = ordinal.fit(docs, labels, ordinal.quality_grade(), ordinal.N_GRADES)
    return ordinal.score(docs, model, only_kept=True)[0]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of least id. Texts without words stay."""
    return forest.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; ``n_chars`` follows the text.

    A document of which no word is left goes; one that had none before stays.
    """
    rows, names = units.dedup(docs)
    left = F.coalesce(~forest.wordless(col("text")), F.lit(False))
    rows = rows.where(left | ~col(names["original_words"]))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(col(names["n_removed"]) > 0, F.length("text").cast(kind)).otherwise(col("n_chars"))
        rows = rows.withColumn("n_chars", changed)
    return rows.select(*map(col, docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate. All columns stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, names = decontaminate.decontaminate(docs, benchmark)
    return rows.where(~col(names["contaminated"])).select(*map(col, docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and the digests of the ids and of the decoded text, for each document."""
    wanted = ("n_tokens", "ids_sha256", "decoded_sha256")
    rows, names = bpe.encode(docs, tokenizer_path(), wanted=wanted)
    return rows.select("doc_id", *(col(names[w]).alias(w) for w in wanted))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminated),
    ("BPE encoding and decoding", tokens),
]

#: The learned classifier and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
