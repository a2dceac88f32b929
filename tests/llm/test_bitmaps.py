"""Line dedup with keep bitmaps, against a walk through the documents."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import no_docs, odd_docs

from saleslens.llm import bitmaps, queries

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def walk(rows, min_docs, keep_first=False, least=1):
    """Kept text and counts of each distinct (id, text), by hand."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, bitmap_order(*r)))
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders, first = defaultdict(set), {}
    for d, (_, text) in enumerate(docs):
        for place, line in enumerate((text or "").split("\n")):
            if len(key(line)) >= least and key(line):
                holders[key(line)].add(d)
                first.setdefault(key(line), (d, place))
    out = {}
    for d, (i, text) in enumerate(docs):
        lines = (text or "").split("\n")
        kept = [x for p, x in enumerate(lines)
                if len(holders[key(x)]) < min_docs or (keep_first and first[key(x)] == (d, p))]
        out[i, text] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def bitmap_order(doc_id, text):
    mark = "\0".join(["-" if doc_id is None else str(doc_id), "true" if text is None else "false", text or ""])
    return hashlib.md5(mark.encode()).digest()


def check(spark, docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = walk(rows, options.get("min_docs", 10), options.get("keep_first", False), options.get("least", 1))
    maps = bitmaps.keep_bitmaps(docs, **options)
    assert maps.count() == len(set(rows))
    for r in maps.collect():
        assert bitmaps.unpack(r.keep, r.n_lines).sum() == r.n_lines - r.n_dropped
    cut, names = bitmaps.apply(docs, maps)
    assert cut.columns == [*docs.columns, *names.values()]
    got = sorted(((r.doc_id, r.text, r[names["n_lines"]], r[names["n_dropped"]]) for r in cut.collect()), key=repr)
    assert got == sorted(((i, None if t is None else want[i, t][2], *want[i, t][:2]) for i, t in rows), key=repr)


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_odd_rows(spark, min_docs, keep_first):
    lines = ["same line", "  Same LINE\r", "", "\x0b", "ÄÖ", "äö", "a", "same line", "x" * 3000]
    texts = ["\n".join(lines[k % len(lines)] for k in range(d % 5, 3 * d)) for d in range(12)] + ["\n\n\n", "same line"]
    rows = [(100 + d % 9, t, None, None, d, "mine") for d, t in enumerate(texts)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string")
    docs = odd_docs(spark).unionByName(more, allowMissingColumns=True)
    check(spark, docs, min_docs=min_docs, keep_first=keep_first)


def test_no_documents_and_short_keys(spark):
    maps = bitmaps.keep_bitmaps(no_docs(spark))
    assert maps.count() == 0 and bitmaps.apply(no_docs(spark), maps)[0].count() == 0
    docs = spark.createDataFrame([(d, "ab\nÄÖÜ\nabc") for d in range(4)], "doc_id long, text string")
    check(spark, docs, min_docs=2, least=3)


@pytest.mark.parametrize("keep_first", [False, True])
def test_a_hot_line_over_many_ranges(spark, keep_first):
    """One line in all documents, others in just under and just over the least number."""
    rows = [(d, f"hot\nonly {d}\ngroup {d // 9}\ngroups {d // 10}\nhot") for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for partitions in (1, 7, 60):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            check(spark, docs, min_docs=10, keep_first=keep_first)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])


def test_query_equals_a_walk(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = walk(rows, 10)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op11_line_dedup(spark, sf_dir).collect()}
    assert got == {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for (i, _), (n, gone, kept) in want.items()}
    assert sum(n for _, n, _ in got.values())


def test_bitmaps_are_small():
    kept = np.ones(1_000_000, bool)
    kept[::5000] = False
    assert len(bitmaps.pack(kept)) < 5000 and (bitmaps.unpack(bitmaps.pack(kept), len(kept)) == kept).all()
