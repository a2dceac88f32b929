"""Importance resampling, against a plain computation."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import no_docs, odd_docs

from saleslens.llm import queries, resample

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text, n_buckets, shortest, longest):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % n_buckets for r in runs]


def plain(docs, target, n_buckets=10_000, shortest=1, longest=1):
    """All columns of all documents, sorted."""
    made = [(i, *plain_features(t, n_buckets, shortest, longest)) for i, t in docs]
    s = Counter(b for _, _, f in made for b in f)
    t = Counter(b for x in target for b in plain_features(x, n_buckets, shortest, longest)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + n_buckets) / ((s[b] + 1) * (t.total() + n_buckets)))) for b in range(n_buckets)]
    rows = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawn[: 10 * len(drawn) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.mark.parametrize("shape", [(10_000, 1, 1), (70_000, 1, 3), (97, 2, 4)])
def test_odd_rows(spark, shape):
    docs = odd_docs(spark).selectExpr("*", "'mine' AS key", "'mine' AS rank")
    docs = docs.unionByName(spark.range(100, 140).selectExpr("id AS doc_id", "repeat(concat('w', id, ' same '), 30) AS text"), allowMissingColumns=True)
    docs = docs.unionByName(spark.range(40).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "repeat('same again ', 12) AS text"), allowMissingColumns=True)
    target = spark.createDataFrame([("same w101 naïve",), (None,), ("",)], "text string")
    want = plain(texts(docs), [r.text for r in target.collect()], *shape)
    assert got(resample.resample(docs, target, "doc_id", "text", "text", *shape)) == want


def test_empty_tables(spark):
    target = spark.createDataFrame([], "text string")
    assert resample.resample(no_docs(spark), target).count() == 0
    assert got(resample.resample(odd_docs(spark), target)) == plain(texts(odd_docs(spark)), [])


def test_ranks_over_many_ranges(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).selectExpr("id", "id % 3 AS v")
        ranked = resample.ranked(rows, [rows.v, rows.id], "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])
    assert [r.id for r in sorted(ranked, key=lambda r: r.place)] == sorted(range(5000), key=lambda i: (i % 3, i))
    assert sorted(r.place for r in ranked) == list(range(1, 5001))


def test_shifts_and_substrings():
    rng = random.Random(5)
    for length in [0, 1, 2, 63, 64, 65, 1000, 70_001]:
        head, tail = rng.randbytes(7), rng.randbytes(length)
        shifted = resample.shift(np.array([zlib.crc32(head)]), np.array([length]))
        assert int(shifted[0]) ^ zlib.crc32(head + tail) == zlib.crc32(tail)
    words = [[rng.randbytes(rng.randint(1, 90)).replace(b" ", b"x") for _ in range(n)] for n in (0, 1, 40, 0, 7)]
    prefixes = resample.scan(words)
    for n in (1, 2, 5):
        at = 0
        for text in words:
            first = np.arange(at, at + max(0, len(text) - n + 1))
            want = [zlib.crc32(b" ".join(text[k : k + n])) for k in range(len(first))]
            assert resample.ngram_crcs(prefixes, first, n).tolist() == want
            at += len(text)


def test_query_equals_brute_force(spark, sf_dir):
    docs = texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    want = plain(docs, [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    found = queries.op12_resample(spark, sf_dir)
    assert found.dtypes == [(n, "bigint") for n in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(((w[0], *w[2:]) for w in want), key=repr)


@pytest.mark.parametrize("texts", [200, 1], ids=["many texts", "one long text"])
def test_memory_of_a_batch(texts):
    """A batch of rows is worked through in pieces: what a task holds is in proportion to a piece."""
    words = b" ".join(b"w%d" % (k % 977) for k in range(800_000 // texts))
    tracemalloc.start()
    try:
        found = [b.astype("<u2") for piece in resample._pieces(iter([words] * texts), 1) for b in resample.buckets_of(piece, 10_000, 1, 1)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(map(len, found)) == 800_000
    assert peak < (48 << 20 if texts > 1 else 96 << 20)
    assert found[0][:3].tolist() == [zlib.crc32(b"w%d" % k) % 10_000 for k in range(3)]
