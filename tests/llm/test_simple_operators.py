"""Decontamination, encoding, shards, outliers, language and quality on odd rows and whole tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import no_docs, odd_docs, prose
from pyspark.sql import functions as F

from saleslens.llm import bpe, decontaminate, language, ordinal, outliers, queries, shards

ITEMS = "item_id long, text string"


def docs_of(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# -- 4: decontamination -------------------------------------------------------------------------


def benchmark(spark):
    shared = prose(2, 130).split()
    rows = [(1, " ".join(shared[10:40])), (2, "Naïve ünïcode"), (3, None), (4, ""), (None, prose(1, 13)), (5, " ".join(shared[30:60])),
            (5, " ".join(shared[30:60])), (6, prose(60, 30)), (10, "xx"), (11, "ü" * 3), (7, "文字 WORDS")]
    return spark.createDataFrame(rows, ITEMS)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_equals_brute_force(spark, block):
    docs, items = odd_docs(spark), [(r.item_id, r.text) for r in benchmark(spark).collect()]
    rows, names = decontaminate.decontaminate(docs, benchmark(spark), max_block_bytes=block)
    got = rows.withColumn("sha", decontaminate.items_digest(names["items"])).collect()
    assert len(got) == docs.count() and rows.columns[: len(docs.columns)] == docs.columns
    for r in got:
        found = tuple(r[names[n]] for n in ("n_words", "n_hit", "n_items")) + (r.sha, r[names["contaminated"]])
        assert found == decontaminate.brute_force(r.text, items)
    assert any(r[names["contaminated"]] for r in got) and {r.kept for r in got} == {"mine"}


def test_spans_are_places_in_the_original(spark):
    text = "Start. " + prose(2, 40).upper() + " -- end"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(1, prose(2, 40))], ITEMS)
    rows, names = decontaminate.decontaminate(docs, items)
    (span,) = rows.first()[names["spans"]]
    assert text[span.start : span.end] == prose(2, 40).upper()


def test_decontamination_of_nothing(spark):
    rows, names = decontaminate.decontaminate(odd_docs(spark), spark.createDataFrame([], ITEMS))
    assert not rows.where(names["contaminated"]).count()
    assert decontaminate.decontaminate(no_docs(spark), benchmark(spark))[0].count() == 0


def test_decontamination_query_equals_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = docs_of(spark, sf_dir)
    rows = queries.op4_decontaminate(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert decontaminate.brute_force(texts[r.doc_id], items) == (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)


# -- 6: encoding --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(queries.tokenizer_path())
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def own():
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        return bpe.Tokenizer(file.read())


def test_encoding_equals_the_library(own, library):
    import random

    rng = random.Random(4)
    vocabulary = [w.replace("</w>", "") for w in library.get_vocab()]
    texts = ["", " ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "ΑΣ ΣΑΣ", "İstanbul", "a" * 30_000, "ab" * 9_000,
             "\x1c a\x85b\xa0c", "é" * 2_000, "👍🏽" * 50, "can't we'll I'D", "é ẛ̣", "١٢٣ Ⅷ ½"]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 4))) for _ in range(4_000)]
    texts += ["".join(rng.choice("aabbnthe  'srsd1é") for _ in range(rng.randint(1, 40))) for _ in range(4_000)]
    texts += ["a" + chr(c) + "b" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, repr(text[:60])
        assert own.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_pieces_stay_right_when_the_cache_turns(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    text = prose(9, 2_000)
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_encoding_query(spark, sf_dir, library):
    texts = docs_of(spark, sf_dir)
    for r in queries.op6_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())


def test_encoding_of_odd_rows(spark, library):
    rows, names = bpe.encode(odd_docs(spark), queries.tokenizer_path(), wanted=("n_tokens", "ids", "decoded"))
    assert names["n_tokens"] != "n_tokens"
    back, name = bpe.decode(rows, queries.tokenizer_path())
    for r in back.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r[name] == r.decoded if name != "decoded" else True
    assert bpe.encode(no_docs(spark), queries.tokenizer_path())[0].count() == 0


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file, pytest.raises((ValueError, KeyError, AttributeError)):
        bpe.Tokenizer(file.read())


# -- 7: shards ----------------------------------------------------------------------------------


def test_shard_query_laws(spark, sf_dir):
    texts = docs_of(spark, sf_dir)
    rows = queries.op7_shards(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and {r.law for r in rows} == {"key"}
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark):
    rows = shards.place(odd_docs(spark), shards.tree(40), shards.tree(41), parts=3).collect()
    assert len(rows) == 14 and len({r.shard for r in rows if r.doc_id is None}) == 1
    assert {r.text_crc32 for r in rows if r.doc_id == 3} == {0}
    assert shards.place(no_docs(spark), shards.tree(40)).count() == 0
    assert {r.grown_shard for r in shards.place(odd_docs(spark), shards.tree(40)).collect()} == {None}


def test_movement_stays_in_subtrees_that_changed(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    old = shards.tree(40)
    heavier = [s._replace(weight=3.0) if s.number == 17 else s for s in old]
    both = keys.select(shards.shard_of(F.col("k"), old).alias("a"), shards.shard_of(F.col("k"), heavier).alias("b")).collect()
    region = {s.number: s.region for s in old}
    rack = {s.number: s.rack for s in old}
    counts = np.bincount([r.a for r in both], minlength=40)
    assert counts.min() > 50 and counts.max() < 160
    for r in (r for r in both if r.a != r.b):
        assert region[r.b] == region[17]
        assert region[r.a] != region[17] or rack[r.b] == rack[17]
        assert rack[r.a] != rack[17] or r.b == 17
    grown = keys.select(shards.shard_of(F.col("k"), old).alias("a"), shards.shard_of(F.col("k"), shards.tree(43)).alias("b")).collect()
    assert {r.b for r in grown if r.a != r.b} == {40, 41, 42}


def test_shard_trees_are_checked():
    with pytest.raises(ValueError):
        shards.shard_of(F.lit("a"), [shards.Shard("r", "k", 1, -1.0)])


# -- 1: outliers --------------------------------------------------------------------------------


def test_statistics_of_a_text():
    text = "a b c d\na b c d\n\nx# $y\n  \nq"
    assert outliers.statistics(text) == (11, 13, 2, 1, 8, 4)
    for seed in range(30):
        words = " ".join(prose(seed, 60).split()[i % 7] for i in range(seed * 4))
        assert outliers.repeat_words(words.encode().split()) == outliers.plain_repeat_words(words)
    assert outliers.statistics(None) == outliers.statistics("") == (0, 0, 0, 0, 0, 0)


def test_chi_square():
    assert outliers.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert outliers.chi2_quantile(0.99, 5) == pytest.approx(15.08627, abs=1e-4)


def test_outliers_are_found_per_group(spark):
    def junk(seed):
        return " ".join(w + "$$$" for w in prose(seed, 100).split())

    rows = [(i, prose(i, 80 + i % 40), "en", "a", 0) for i in range(150)]
    rows += [(1000 + i, junk(i), "en", "a", 0) for i in range(20)]
    rows += [(2000 + i, junk(500 + i), "en", "signs", 0) for i in range(60)]  # there it is the rule
    got = {r.doc_id: r for r in outliers.outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(150)) and not any(got[1000 + i].kept for i in range(20))
    assert all(got[2000 + i].kept for i in range(60)) and not any(r.base_failed for r in got.values())


def test_outliers_in_repeats_alone(spark):
    def page(seed, n=100, extra=""):
        words = prose(seed, n).split()
        return "".join(" ".join(words[k : k + 5]) + "\n" + extra for k in range(0, n, 5))

    rows = [(i, page(i, 80 + i % 8 * 5), "en", "a", 0) for i in range(150)]
    rows += [(1000 + i, page(1000 + i, 100, "iskalu\n"), "en", "a", 0) for i in range(10)]
    rows += [(2000 + i, page(2000 + i, 60) + " ".join(prose(i, 20).split() * 2), "en", "a", 0) for i in range(10)]
    got = {r.doc_id: r for r in outliers.outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long")).collect()}
    assert all(got[1000 + i].n_dup_lines == 19 and got[1000 + i].n_repeat_words < 12 for i in range(10))
    assert all(got[2000 + i].n_dup_lines == 0 and 40 <= got[2000 + i].n_repeat_words <= 50 for i in range(10))
    assert not any(r.base_failed for r in got.values())
    assert not any(got[k + i].kept for k in (1000, 2000) for i in range(10))
    assert np.mean([got[i].kept for i in range(150)]) > 0.97


def test_outliers_of_odd_rows(spark):
    got = outliers.outliers(odd_docs(spark)).collect()
    assert len(got) == 14
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert outliers.outliers(no_docs(spark)).count() == 0


# -- 5: language --------------------------------------------------------------------------------


def test_language_query_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op5_language_id(spark, sf_dir).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_sample_is_chosen_by_hash(spark):
    rows = [(f"{prose(1000 * k + i, 1 + i % 40)} {k} {i}", lang) for k, lang in enumerate(("aa", "bb")) for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    labels, x, y = language._sample(docs, "text", "lang", F.xxhash64("text"), F.lit(True), 64)
    near = docs.withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(1 << 30)) < 1.5 * 32 / 400 * (1 << 30)).orderBy("h").collect()
    assert labels == ["aa", "bb"]
    for k, lang in enumerate(labels):
        texts = [r.text for r in near if r.lang == lang]
        assert len(texts) > 32 and (y == k).sum() == 32
        assert np.array_equal(x[y == k], np.stack([language.features(t).astype(np.float16).astype(np.float32) for t in texts[:32]]))


def test_all_languages_are_learned(spark):
    docs = spark.createDataFrame([(prose(i, 5), f"l{i}") for i in range(300)], "text string, lang string")
    assert len(language._sample(docs, "text", "lang", F.xxhash64("text"), F.lit(True), 64)[0]) == 300


def test_codebooks_part_all_languages():
    for n in (2, 3, 5, 6, 9, 40):
        book = language.codebook(n)
        assert len({tuple(row) for row in book.tolist()}) == n
        assert all(-n < c < n for c in book.sum(0, dtype=int))
    assert language.codebook(1).size == 0


def test_long_texts_are_counted_whole(monkeypatch):
    text = prose(5, 3_000)
    whole = language.features(text)
    monkeypatch.setattr(language, "_CHUNK", 777)
    assert np.allclose(language.features(text), whole)


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    model = language.fit(docs)
    rows, names = language.predict(docs, model)
    by = {r.doc_id: r for r in rows.collect()}
    assert rows.count() == 14 and by[3][names["lang_pred"]] == by[4][names["lang_pred"]] == by[10][names["lang_pred"]] == "und"
    assert by[1][names["lang_pred"]] in ("en", "de") and names["score"] == "score_"
    for empty in (no_docs(spark), docs.where("lang = 'en'")):
        known = language.fit(empty)
        assert {r[0] for r in language.predict(docs, known)[0].select("lang_pred").collect()} <= {"und", *known.labels}
    assert language.predict(no_docs(spark), model)[0].count() == 0


# -- 9: ordinal quality -------------------------------------------------------------------------


def test_quality_on_held_out_ratings(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    taught = labels.where("doc_id % 4 <> 0")
    model = ordinal.fit(docs.drop("quality", "toxic"), taught, ordinal.quality_grade(), ordinal.N_GRADES)
    assert (np.diff(model.thresholds) > 0).all()
    rows, _ = ordinal.score(docs.where("doc_id % 4 = 0"), model)
    share = {(r.quality, r.toxic): r.s for r in rows.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("double")).alias("s")).collect()}
    assert share[1, 0] > 0.95 and share[0, 0] < 0.05 and share[1, 1] < 0.2
    grade = {(r.quality, r.toxic): r.s for r in rows.groupBy("quality", "toxic").agg(F.avg("expected_grade").alias("s")).collect()}
    assert grade[0, 0] < grade[1, 1] < grade[1, 0]


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    ratings = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 1), (7, 1, 0), (None, 1, 0), (9, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = ordinal.fit(docs, ratings, ordinal.quality_grade(), 3)
    rows, names = ordinal.score(docs, model)
    assert rows.count() == 14 and names["kept"] == "kept_" and rows.where(f"{names['tail_prob']} between 0 and 1").count() == 14
    assert ordinal.score(docs, model, only_kept=True)[0].columns == docs.columns
    empty = ordinal.fit(docs, ratings.limit(0), ordinal.quality_grade(), 3)
    assert ordinal.score(docs, empty, only_kept=True)[0].count() == 14
    assert ordinal.score(no_docs(spark), model)[0].count() == 0
