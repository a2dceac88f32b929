"""Jaccard join, line dedup and the pipeline."""

import functools
import random
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from helpers import no_docs, odd_docs, prose

import corpus_pipeline
from saleslens.llm import forest, queries, units
from saleslens.llm.common import words_of


def shingle_set(text):
    words = words_of(text.encode()) if text else []
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute_join(rows):
    """class_id and n_links of each (id, text), by comparing all."""
    sets = [shingle_set(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)].append(i)
    first = {r: min((i for i in m if i is not None), default=None) for r, m in least.items()}
    return [(i, first[root(k)], links[k], len(least[root(k)])) for k, (i, _) in enumerate(rows)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def near_copies(n, seed=0):
    rng = random.Random(seed)
    base, out = prose(700 + seed, 220).split(), []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(len(words))] = f"w{i}x{rng.randrange(1000)}"
        out.append(" ".join(words))
    return out


def found(df):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.class_rows) for r in df.collect()), key=key)


def test_join_of_odd_rows(spark):
    docs = odd_docs(spark)
    assert found(forest.join(docs).documents) == sorted(brute_join([(r.doc_id, r.text) for r in docs.collect()]), key=key)
    assert forest.join(no_docs(spark)).documents.count() == 0


def test_join_splits_large_groups_and_keeps_all_links(spark, monkeypatch):
    monkeypatch.setattr(forest, "VERIFY_BLOCK", 16)
    monkeypatch.setattr(forest, "BUCKET_BLOCK", 16)
    texts = near_copies(120) + near_copies(40, 1) + [prose(i, 60) for i in range(40)] + near_copies(2)[:1] * 5
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(forest.join(docs).documents) == sorted(brute_join(rows), key=key)


def test_join_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert found(queries.op3_jaccard_join(spark, sf_dir)) == sorted(brute_join(rows), key=key)


def test_intersections_and_labels():
    sets = [np.unique(np.array(s, np.uint64)) for s in ([1, 2, 3], [2, 3, 4, 5], [9], [1, 2, 3, 4, 5, 9])]
    both = forest.intersections(sets)
    assert all(both[a, b] == len(set(sets[a].tolist()) & set(sets[b].tolist())) for a in range(4) for b in range(4) if a != b)
    assert 1 - (1 - 0.8 ** forest.prefix_length()) ** forest.TREES >= forest.RECALL
    assert forest.prefix_length(0.95) > forest.prefix_length(0.8)


def test_prefixes_are_shortened_as_far_as_needed(spark, monkeypatch):
    """Many pairs that are much alike need no short prefixes; a few at the threshold need the shortest."""
    depths = []
    real = forest._bucket_pairs

    def noted(sets, groups, depth, threshold):
        depths.append(depth)
        return real(sets, groups, depth, threshold)

    monkeypatch.setattr(forest, "_bucket_pairs", noted)
    monkeypatch.setattr(forest, "ENOUGH_SEEN", 40)
    close = []
    for seed in range(60):
        words = prose(2000 + seed, 400).split()
        close += [" ".join(words), " ".join([*words[:200], "changed", *words[201:]])]
    rows = list(enumerate(close))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(forest.join(docs).documents) == sorted(brute_join(rows), key=key)
    assert depths[0] == forest.DEPTH and depths[-1] > forest.prefix_length()
    depths.clear()
    assert forest.join(docs.where("doc_id < 2")).documents.where("n_links = 1").count() == 2
    assert depths == list(range(forest.DEPTH, forest.prefix_length() - 1, -1))


def test_one_of_each_keeps_columns_and_wordless_rows(spark):
    docs = odd_docs(spark)
    kept = forest.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted((i is None, i or 0) for i in (1, 2, 3, 4, 5, 6, 9, 10, 11, None))


def in_word(c):
    return c.isascii() and c.isalnum() or ord(c) > 127 and c != "\x85" and unicodedata.category(c)[0] not in "PZ"


@functools.cache
def word_hash(word):
    return int(units.parts([word]).word_hash[0])


def plain_parts(text):
    """The parts of a text: line, start, end, and its words with their places."""
    out, begin = [], 0
    for number, line in enumerate(text.split("\n")):
        words = [(m.start() + begin, m.group()) for m in re.finditer("W+", "".join("W" if in_word(c) else "s" for c in line))]
        words = [(a, text[a : a + len(w)].translate({c: c + 32 for c in range(65, 91)})) for a, w in words]
        heads = [0] + [k for k in range(1, len(words)) if re.search("[。！？｡]", text[words[k - 1][0] : words[k][0]])]
        starts = []
        for lo, hi in zip(heads, [*heads[1:], len(words)], strict=True):
            h = [word_hash(w) for _, w in words[lo:hi]]
            starts += [lo] + [lo + i for i in range(6, len(h) - 5) if h[i] < min(h[i - 5 : i]) and h[i] <= min(h[i + 1 : i + 6])]
        for k, a in enumerate(starts if words else []):
            b = starts[k + 1] if k + 1 < len(starts) else None
            out.append((number, words[a][0] if k else begin, begin + len(line) if b is None else words[b][0], words[a:b]))
        begin += len(line) + 1
    return out


def long_enough(words):
    key = "".join(w for _, w in words)
    return max(len(words), sum(len(s.findall(key)) / n for s, n in units._UNSPACED)) >= 5


def plain_units(rows):
    """Texts and the number of whole parts removed, by walking through the documents in rank."""
    docs = [(i, t, plain_parts(t)) for i, t in sorted(rows)]
    first, holders = {}, defaultdict(set)
    for d, (_, _, found) in enumerate(docs):
        for p, (_, _, _, words) in enumerate(found):
            key = tuple(w for _, w in words)
            first.setdefault(key, (d, p))
            holders[key].add(d)
    out = {}
    for d, (i, text, found) in enumerate(docs):
        keeper = {}
        for p, (_, _, _, words) in enumerate(found):
            key = tuple(w for _, w in words)
            sized = long_enough(words)
            common = len(holders[key]) >= 10 and words[-1][0] + len(words[-1][1]) - words[0][0] >= 12
            if first[key] != (d, p) and (sized or common):
                keeper[p] = first[key]
        gone = set()
        for p, (d0, p0) in keeper.items():
            gone |= set(range(found[p][1], found[p][2]))
            for q, q0, step in ((p - 1, p0 - 1, -1), (p + 1, p0 + 1, 1)):
                if not 0 <= q < len(found) or q in keeper or not 0 <= q0 < len(docs[d0][2]) or not (long_enough(found[q][3]) and long_enough(found[p][3])):
                    continue
                mine, its = found[q][3][::step], [w for _, w in docs[d0][2][q0][3]][::step]
                n = next((k for k in range(len(mine)) if k >= len(its) or mine[k][1] != its[k]), len(mine))
                n -= n % 2
                if n and n == len(mine):
                    gone |= set(range(found[q][1], found[q][2]))
                elif n:
                    gone |= set(range(mine[n - 1][0], found[q][2]) if step < 0 else range(found[q][1], mine[n][0]))
        whole = [gone >= set(range(a, b)) for _, a, b, _ in found]
        lines, begin = [], 0
        for number, line in enumerate(text.split("\n")):
            its = [w for w, f in zip(whole, found, strict=True) if f[0] == number]
            if not its or not all(its):
                lines.append("".join(c for k, c in enumerate(line, begin) if k not in gone))
            begin += len(line) + 1
        out[i] = ("\n".join(lines), sum(whole))
    return out


def holds(words, some):
    return any(words[k : k + len(some)] == some for k in range(len(words) - len(some) + 1))


def test_line_dedup_query_equals_a_walk(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_units(rows)
    got = queries.op10_line_dedup(spark, sf_dir).collect()
    assert len(got) == len(rows)
    originals = dict(rows)
    for r in got:
        assert (r.text, r.n_removed) == want[r.doc_id]
        for cut in r.removed:
            line = originals[r.doc_id][cut.start : cut.end]
            assert "\n" not in line and holds(words_of(originals[cut.keeper].encode()), words_of(line.encode()))


def test_line_dedup_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows, names = units.dedup(docs)
    assert names["removed"] == "removed_" and rows.count() == 14
    by = {r.doc_id: r for r in rows.collect()}
    assert by[3].text is None and by[4].text == "" and by[5].text == " \t\n "
    assert by[7].text == "" and by[7][names["removed"]][0].keeper == 1 and by[1].text == prose(1, 120)
    assert units.dedup(no_docs(spark))[0].count() == 0


def test_repeated_lines_of_scripts_without_blanks(spark):
    repeated = ["本网站的所有内容均受版权保护，未经许可不得转载。", "このサイトの内容を無断で転載することを禁じます。", "ห้ามทำซ้ำหรือเผยแพร่เนื้อหาของเว็บไซต์นี้โดยไม่ได้รับอนุญาต",
                "один\u3000два\u2014три\u2003четыре\u2026пять"]
    short = ["你好", "目录", "สวัสดี"]
    texts = ["\n".join([f"第{i}篇", *repeated, *short]) for i in range(3)]
    rows, _ = units.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r for r in rows.collect()}
    assert got[0].text == texts[0]
    for i in (1, 2):
        assert got[i].text == "\n".join([f"第{i}篇", *short]) and [r.keeper for r in got[i].removed] == [0] * 4
    assert units.digest("未经许可，不得转载本站的内容。") == units.digest("未经许可 不得转载本站的内容")


def ranges(spark, n):
    """Shuffles of ``n`` partitions, not coalesced; gives what was set before."""
    names = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    was = [spark.conf.get(name) for name in names]
    for name, value in zip(names, (n, "false"), strict=True):
        spark.conf.set(name, value)
    return dict(zip(names, was, strict=True))


@pytest.mark.parametrize("n", [1, 40])
def test_passages_inside_lines(spark, n):
    """Passages of fifty words amid other words, a very common line, and short lines."""
    passages = [prose(900 + k, 50 + k) for k in range(4)]
    texts = []
    for d in range(60):
        a, b, c = prose(3 * d, 30), prose(3 * d + 1, 17), prose(3 * d + 2, 12)
        texts.append(f"{a} {passages[d % 4]} {b}\nAll rights reserved.\nMenu\nthe same long line of more than five words\n{c}\nrow {d // 5} of them all here")
    rows = [*enumerate(texts), (60, "All rights\n" * 3 + "one two three four five six\n" * 3)]
    was = ranges(spark, n)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: r for r in units.dedup(docs)[0].collect()}
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)
    want = plain_units(rows)
    assert {i: (r.text, r.n_removed) for i, r in got.items()} == want
    for d in range(4, 60):
        words = got[d].text.split()
        assert not holds(words, passages[d % 4].split()[:9]) and not holds(words, passages[d % 4].split()[-9:])
        assert holds(words, prose(3 * d, 30).split()) and holds(words, prose(3 * d + 1, 17).split())
        assert "Menu" in words and "rights" not in words and "long" not in words
    assert got[60].text == "All rights\n" * 3 + "one two three four five six\n"


def test_paragraphs(spark):
    a, b = prose(1, 10), prose(2, 10)
    docs = spark.createDataFrame([(1, f"{a}\n{b}\n\n{b}"), (2, f"{b}\n \n{a}\n{b}\n\nend")], "doc_id long, text string")
    rows, _ = units.dedup(docs, unit="paragraph")
    assert {r.doc_id: r.text for r in rows.collect()} == {1: f"{a}\n{b}\n\n{b}", 2: "end"}


def test_cut_keeps_what_is_left_as_it_was():
    text = "a\nb\nc\nd"
    places = units.split(text)
    assert units.cut(text, places, {0}) == "b\nc\nd" and units.cut(text, places, {1, 2}) == "a\nd"
    assert units.cut(text, places, {3}) == "a\nb\nc" and units.cut(text, places, {0, 1, 2, 3}) == "" and units.cut(text, places, set()) == text


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_odd_rows(spark, sf_dir, empty):
    docs = no_docs(spark) if empty else odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == (docs.columns if name != corpus_pipeline.STAGES[-1][0] else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        out.collect()


def test_pipeline_equals_its_steps_by_hand(spark):
    """From what the classifier keeps on, every stage against its plain version."""
    import hashlib

    from tokenizers import Tokenizer

    from saleslens.llm.decontaminate import brute_force

    sf_dir = "/root/testdata/sf0.01"
    first = corpus_pipeline.quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect()
    rows = [(r.doc_id, r.text) for r in first]
    classes = {i: c for i, c, _, _ in brute_join(rows)}
    rows = [(i, t) for i, t in rows if classes[i] == i]
    left = plain_units(rows)
    rows = [(i, left[i][0]) for i, t in rows if words_of(left[i][0].encode()) or not words_of(t.encode())]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {" ".join(map(bytes.decode, words_of(t.encode())[k : k + 13])) for _, t in items for k in range(max(1, len(words_of(t.encode())) - 12))}
    rows = [(i, t) for i, t in rows if not any(w in " ".join(map(bytes.decode, words_of(t.encode()))) for w in windows)
            or not brute_force(t, items)[-1]]
    library = Tokenizer.from_file(queries.tokenizer_path())
    want = {}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 0 < len(got) < len(first)


def test_pairs_of_blocks_that_are_alike_give_one_edge():
    """Each block's own ties are told by its own tile; a block of 30 more adds one edge for each other block."""
    node = np.arange(60)
    own = np.repeat([0, 1], 30)
    near = np.ones((60, 60), bool)
    a, b = forest._ties(near, node, own)
    assert list(zip(a.tolist(), b.tolist())) == [(0, 30)]
    a, b = forest._ties(near[:30, :30], node[:30], own[:30])
    assert len(a) == 29 and set(a.tolist()) == {0}
    # rows of one candidate group count as one node
    a, b = forest._ties(near[:30, :30], node[:30] // 10 * 10, own[:30])
    assert list(zip(a.tolist(), b.tolist())) == [(0, 10), (0, 20)]
    near = np.zeros((60, 60), bool)
    near[3, 40] = near[40, 3] = near[3, 5] = near[5, 3] = True
    a, b = forest._ties(near, node, own)
    assert list(zip(a.tolist(), b.tolist())) == [(3, 40)]


def test_parts_of_many_texts_are_told_in_one_go(monkeypatch):
    """Chains are made for a batch, not for each text, and what is told of a text does not depend on the others."""
    texts = [prose(k, 5 + 13 * k % 90).replace(" co", "\nco") + f"\n{prose(3, 20)}\n" * (k % 3) for k in range(200)] + ["", "x", "\n", "。文字"]
    calls = []
    chain = units._chain
    monkeypatch.setattr(units, "_chain", lambda *given: calls.append(1) or chain(*given))
    number, digests, told = units._tell(units.parts(texts))
    assert len(calls) == 2
    together = {(k, d.tobytes()): t for k, d, t in zip(number.tolist(), digests, told, strict=True)}
    assert len(together) == len(told) > 400
    alone = {}
    for k, text in enumerate(texts):
        _, marks, what = units._tell(units.parts([text]))
        alone |= {(k, d.tobytes()): t for d, t in zip(marks, what, strict=True)}
    assert together == alone
    assert any(len(units._unpack(t)[1]) > 1 for t in told)
