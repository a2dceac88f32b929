import numpy as np
from helpers import prose

from saleslens.llm import common


def test_word_hashes_do_not_depend_on_the_cut(monkeypatch):
    words = common.words_of((prose(3, 500) + " " + "y" * 3000).encode())
    whole = common.word_hashes(words)
    monkeypatch.setattr(common, "_CHUNK", 64)
    assert (common.word_hashes(words) == whole).all()
    assert len(set(whole.tolist())) == len(set(words))


def test_shingles_are_sets_of_runs():
    words = [b"a", b"b", b"c", b"d", b"e", b"f", b"a", b"b", b"c", b"d", b"e"]
    assert len(common.shingles(words)) == 6  # seven runs, one of them twice
    assert len(common.shingles(words[:3])) == 1
    assert len(common.shingles([])) == 0
    assert common.shingles(words[:3])[0] != common.shingles(words[:4])[0]


def test_words():
    assert common.words_of("Ab-c9 É_x".encode()) == [b"ab", b"c9", "É".encode(), b"x"]
    assert common.words_of(None) == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 9), (5, 5), (30, 9), *((100 + i, 101 + i) for i in range(40))]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in common.components(df, "t").collect()}
    assert {got[n] for n in (1, 2, 3)} == {1} and {got[n] for n in (7, 9, 30)} == {7}
    assert {got[100 + i] for i in range(41)} == {100} and 5 not in got
    assert common.components(df.limit(0), "t").count() == 0


def test_tiles_let_any_two_rows_meet_once_or_more(spark):
    df = spark.range(50).selectExpr("1 AS g", "id AS r", "50 AS n")
    dealt = common.tiles(df, "g", "n", 8, "r").collect()
    meet, sizes = set(), {}
    for lo, hi in {(x.lo, x.hi) for x in dealt}:
        inside = [x.r for x in dealt if (x.lo, x.hi) == (lo, hi)]
        sizes[lo, hi] = len(inside)
        meet |= {(a, b) for a in inside for b in inside if a < b}
    assert len(meet) == 50 * 49 // 2 and max(sizes.values()) < 40


def test_names():
    assert common.fresh(["Kept", "kept_"], "kept", "kept") == ["kept__", "kept___"]


def test_sorted_groups_across_batches():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 3, 4, 4]
    batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + 3], "v": list(range(i, min(i + 3, 8)))}) for i in range(0, 8, 3)]
    groups = [(t["k"][0].as_py(), t["v"].to_pylist()) for t in common.sorted_groups(iter(batches), 1)]
    assert groups == [(1, [0, 1]), (2, [2, 3, 4]), (3, [5]), (4, [6, 7])]
    assert np.unique(keys).size == len(groups)
