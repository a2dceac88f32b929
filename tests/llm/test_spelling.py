"""Spelling variants, against comparing all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import no_docs, odd_docs

from saleslens.llm import queries, spelling

RUN = re.compile("[A-Za-z\\u00C0-\\u00FF]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(docs, one_in=199):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def near(a, b):
    """Whether one edit makes ``b`` of ``a``, of words in order of length."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_near(words):
    """Near words of each, by the places that a pair may differ in."""
    holes = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
    out = {w: set() for w in words}
    for (a, b), some in holes.items():
        both = some | ({a + b} & words.keys())
        for w in both:
            out[w] |= both - {w}
    return {w: {v for v in some if near(*sorted((w, v), key=len))} for w, some in out.items()}


def plain(docs, one_in=199):
    n = plain_words(docs, one_in)
    found, form = brute_near(n), {}
    for w in n:
        best = min(found[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], len(found[w]), n.get(form[w])))
    return rows


def got(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def typos(seed, n_words, alphabet="abé"):
    """Words with variants of variants, of very different frequency."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_words):
        word = "".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9)))
        times = 700
        while times >= 5:
            out += [word] * times
            k = rng.randrange(len(word) + 1)
            word = rng.choice([word[:k] + rng.choice(alphabet) + word[k:], word[:k] + word[k + 1 :], word[:k] + rng.choice(alphabet) + word[k + 1 :]])
            times //= rng.randint(3, 7)
    rng.shuffle(out)
    return [(k, " ".join(out[k::50])) for k in range(50)]


@pytest.mark.parametrize("block", [3, 4096])
def test_chains_and_large_groups(spark, block):
    rows = typos(1, 60) + [(100, "Aaaaaa aaaaaaa aaaaaab AAAAAA " * 30), (101, "aaaaaaaa " * 600), (None, "ÄÖÜÄÖÜ äöüäöü " * 9), (102, "ab×cdef÷ " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert any(f is not None and r != f for _, f, r, _, _, _ in want) and max(w[4] for w in want) > 3
    assert got(spelling.variants(docs, block=block)) == want


def test_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "'mine' AS word", "'mine' AS n")
    assert got(spelling.variants(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert spelling.variants(no_docs(spark)).count() == 0


def test_acceptors_are_least_and_compose():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(150)})
    made = spelling.minimised(words)

    def accepted(state, read=""):
        if made.final[state]:
            yield read
        for label, to in made.arcs[state].items():
            yield from accepted(to, read + label)

    assert sorted(accepted(made.start)) == words
    languages = [frozenset(accepted(s)) for s in range(len(made.arcs))]
    assert len(set(languages)) == len(languages)
    pairs = set(spelling.one_edit_pairs(made, made))
    assert {(a, b) for a, b in pairs if a != b} == {(a, b) for a in words for b in words if near(*sorted((a, b), key=len))}


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.op13_spelling(spark, sf_dir)
    assert found.dtypes == [(c, "string") for c in ("word", "form", "root")] + [(c, "bigint") for c in ("n", "n_near", "form_n")]
    assert got(found) == plain(docs)
