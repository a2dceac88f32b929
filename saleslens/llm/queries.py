"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.llm import bitmaps, bpe, decontaminate, forest, language, licences, ordinal, outliers, resample, shards, spelling, units, warc
from saleslens.session import shared_dir


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """``SALESLENS_TOKENIZER``, or the public word-level file where it is installed."""
    import public_tokenizers

    return os.environ.get("SALESLENS_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


def op1_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.outliers(_read(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.join(_read(spark, sf_dir, "documents")).documents


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows, names = decontaminate.decontaminate(docs, _read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", *(names[n] for n in ("n_words", "n_hit", "n_items")),
                       decontaminate.items_digest(names["items"]).alias("items_sha256"),
                       names["contaminated"], names["spans"])


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    learn = F.coalesce(third != 1, F.lit(False))
    model = language.fit(docs, learn=learn, order=F.xxhash64("text", "doc_id"))
    rows = docs.select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "text")
    return language.predict(rows, model)[0].drop("text")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, tokenizer_path(), wanted=("n_tokens", "ids_sha256", "decoded_sha256"))[0].drop("text")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.place(_read(spark, sf_dir, "documents"), shards.tree(40), shards.tree(41))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, root = _read(spark, sf_dir, "pages"), shared_dir(spark, "warc")
    warc.write(pages, root)
    kind = pages.schema["page_id"].dataType
    return warc.read(spark, root).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                         F.col("refers_to").cast(kind).alias("refers_to"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit(docs, _read(spark, sf_dir, "labels"), ordinal.quality_grade(), ordinal.N_GRADES)
    return ordinal.score(docs, model)[0].drop("text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))[0].drop("original_words")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows, names = bitmaps.apply(docs, bitmaps.keep_bitmaps(docs))
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return rows.select("doc_id", names["n_lines"], names["n_dropped"], kept.alias("kept_sha256"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.resample(docs, _read(spark, sf_dir, "benchmark")).drop("n_words")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mcd_outliers": op1_mcd_outliers,
    "op2_license_scan": op2_license_scan,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_bpe": op6_bpe,
    "op7_shards": op7_shards,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_resample": op12_resample,
    "op13_spelling": op13_spelling,
}
