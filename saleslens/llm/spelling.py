"""Spelling variant grouping by finite-state composition.

The vocabulary is the frequent words of the corpus. Two words are near if one edit (a code point
inserted, deleted or replaced) makes one of the other: the pairs that the vocabulary's acceptor,
composed with a one-edit transducer and with the acceptor again, accepts.

The composition is enumerated by initial state. A pair of which the shorter word has ``l`` code points has its
edit either behind the first ``l // 2`` of them, which both words then share, or before the rest, which
both then end with. So the pairs are those of the machines that start behind a shared prefix of that
length, and of the reversed machines that start behind a shared suffix. Each start is a group of
words of ``l`` and ``l + 1`` code points. A group builds the minimised acceptors of what its words have
left, and walks the states of the composition (state of one, whether the edit is spent, state of
the other) from the initial one. Groups beyond a block are dealt as pairs of blocks, so no task holds a
whole large group, and no two words are left out.

Words are counted with a bounded table in each task before the shuffle.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import col, map_batches, map_rows, sorted_groups, staged, tiles

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Code points and occurrences of the words that are compared.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: How much more frequent a form is than its variant.
RATIO = 5
#: One in so many runs of a document loses a code point.
DELETE_ONE_IN = 199
#: Words of a group that one task holds on either side.
BLOCK = 4096
#: Words that a task counts before it hands the counts on.
HELD_WORDS = 200_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

# ---------------------------------------------------------------------------------------------
# words


def runs(text: str) -> Counter[str]:
    """How often each run of Latin letters stands in a text, A-Z in lower case."""
    return Counter(RUN.findall(text.translate(_LOWER)))


def thinned(doc_id: str, run: str, one_in: int = DELETE_ONE_IN) -> str:
    """The run, or the run without one code point where its hash with the document's id says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if one_in and h % one_in == 0:
        k = h % len(run)
        return run[:k] + run[k + 1 :]
    return run


def word_counts(docs: DataFrame, doc_id: str, text: str, least_length: int = LEAST_LENGTH, one_in: int = DELETE_ONE_IN) -> DataFrame:
    """``word`` and ``n`` over all documents. A null id counts as one of no characters."""
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=schema.names)
            held.clear()
            return made

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for found, n in runs(value.as_py()).items():
                    word = thinned(name, found, one_in)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    light = docs.where(col(text).isNotNull()).select(F.coalesce(col(doc_id).cast("string"), F.lit("")).alias("id"), col(text).alias("text"))
    return map_batches(light, schema, run).groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------------------------------------
# automata


class Acceptor(NamedTuple):
    """A minimised acyclic acceptor: arcs of each state by label, and whether it is final."""

    arcs: list[dict[str, int]]
    final: list[bool]
    start: int


def minimised(words: Iterable[str]) -> Acceptor:
    """The least acceptor of sorted distinct words. States that accept the same endings are one: the
    last word's states are looked up, from its end, once no later word can pass through them."""
    arcs: list[dict[str, int]] = []
    final: list[bool] = []
    known: dict[tuple, int] = {}
    # the states of the last word are open: arcs and finality, not yet numbered
    path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
    last = ""

    def settle(depth: int) -> None:
        while len(path) > depth + 1:
            out, end = path.pop()
            mark = (end[0], tuple(out.items()))
            state = known.get(mark)
            if state is None:
                state = known[mark] = len(arcs)
                arcs.append(out)
                final.append(end[0])
            path[-1][0][last[len(path) - 1]] = state

    for word in words:
        shared = 0
        limit = min(len(word), len(last))
        while shared < limit and word[shared] == last[shared]:
            shared += 1
        settle(shared)
        path.extend(({}, [False]) for _ in range(len(word) - shared))
        path[-1][1][0] = True
        last = word
    settle(0)
    out, end = path[0]
    arcs.append(out)
    final.append(end[0])
    return Acceptor(arcs, final, len(arcs) - 1)


def one_edit_pairs(left: Acceptor, right: Acceptor) -> Iterator[tuple[str, str]]:
    """The pairs that ``left``, composed with one edit and with ``right``, accepts.

    The transducer copies a label, or once replaces one by another, drops one or puts one in. A
    pair may come more than once, as an edit within a run of equal labels has several places.
    """
    todo = [(left.start, right.start, False, "", "")]
    while todo:
        a, b, spent, read, written = todo.pop()
        from_a, from_b = left.arcs[a], right.arcs[b]
        if spent and left.final[a] and right.final[b]:
            yield read, written
        few, many = (from_a, from_b) if len(from_a) <= len(from_b) else (from_b, from_a)
        for label in few:
            if label in many:
                todo.append((from_a[label], from_b[label], spent, read + label, written + label))
        if spent:
            continue
        for x, to_a in from_a.items():
            for y, to_b in from_b.items():
                if x != y:
                    todo.append((to_a, to_b, True, read + x, written + y))
            todo.append((to_a, b, True, read + x, written))
        for y, to_b in from_b.items():
            todo.append((a, to_b, True, read, written + y))


# ---------------------------------------------------------------------------------------------
# groups


def shared_part(word: str, length: int, front: bool) -> str:
    """What a word has in common with the others of its group, of words of ``length`` and one more."""
    half = length // 2
    return word[:half] if front else word[len(word) - (length - half) :]


def rest(word: str, length: int, front: bool) -> str:
    """What is left of it, from the shared part outwards."""
    half = length // 2
    return word[half:] if front else word[: len(word) - (length - half)][::-1]


def near_in_group(words: list[str], blocks: list[int], meet: tuple[int, int], length: int, front: bool) -> set[tuple[str, str]]:
    """The near pairs between the two blocks of a group that ``meet``; the first of a pair is of ``length``.

    A pair that both kinds of groups would find belongs to that of the shared prefix.
    """
    shared = shared_part(words[0], length, front)
    whole = (lambda r: shared + r) if front else (lambda r: r[::-1] + shared)
    sides: dict[int, list[str]] = {}
    for word, block in zip(words, blocks, strict=True):
        sides.setdefault(block, []).append(word)
    out = set()
    for a, b in {meet, meet[::-1]}:
        left = sorted(rest(w, length, front) for w in sides.get(a, ()) if len(w) == length)
        right = sorted(rest(w, length, front) for w in sides.get(b, ()))
        if not left or not right:
            continue
        one = minimised(left)
        other = minimised(right)
        for u, v in one_edit_pairs(one, other):
            if abs(len(v) - len(u)) <= 1 and len(v) >= len(u):
                u, v = whole(u), whole(v)
                if front or u[: length // 2] != v[: length // 2]:
                    out.add((u, v))
    return out


def near_pairs(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, block: int = BLOCK) -> DataFrame:
    """``word, near, near_n`` for each ordered pair of near words, once. ``vocabulary`` has ``word`` and ``n``."""
    schema = T.StructType([T.StructField("start", T.BinaryType()), T.StructField("length", T.IntegerType()), T.StructField("front", T.BooleanType()),
                           vocabulary.schema["word"], vocabulary.schema["n"]])

    def starts(batch: pa.RecordBatch) -> pa.RecordBatch:
        take, keys, lengths, fronts = [], [], [], []
        for k, word in enumerate(batch.column(0).to_pylist()):
            for length in {len(word), max(least_length, len(word) - 1)}:
                for front in (True, False):
                    take.append(k)
                    keys.append(hashlib.md5(f"{length} {front} {shared_part(word, length, front)}".encode()).digest())
                    lengths.append(length)
                    fronts.append(front)
        chosen = batch.take(pa.array(take, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lengths, pa.int32()), pa.array(fronts), *chosen.columns], names=schema.names)

    keyed = staged(map_rows(vocabulary.select("word", "n"), schema, starts), "spelling-starts")
    sizes = keyed.groupBy("start").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # written, so that the join has shuffles of its own, in which a common start is split
    dealt = tiles(keyed.join(staged(sizes, "spelling-sizes"), "start"), "start", "size", block, "word")
    order = ("start", "lo", "hi")
    dealt = dealt.select(*order, "length", "front", "own", "word", "n").repartition(*order).sortWithinPartitions(*order)
    found = T.StructType([vocabulary.schema["word"], T.StructField("near", T.StringType()), T.StructField("near_n", T.LongType())])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, int]] = []

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=found.names)
            rows.clear()
            return made

        for group in sorted_groups(batches, 3):
            if group.num_rows < 2:
                continue
            words, counts = group.column(6).to_pylist(), group.column(7).to_pylist()
            n = dict(zip(words, counts, strict=True))
            length = group.column(3)[0].as_py()
            meet = (group.column(1)[0].as_py(), group.column(2)[0].as_py())
            for u, v in near_in_group(words, group.column(5).to_pylist(), meet, length, group.column(4)[0].as_py()):
                rows.append((u, v, n[v]))
                # two words of one length come in both orders by themselves
                if len(v) > length:
                    rows.append((v, u, n[u]))
                if len(rows) >= 8192:
                    yield out()
        if rows:
            yield out()

    return map_batches(dealt, found, compose)


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last of the forms that follow from ``word`` and ``form``.

    Each round doubles how far a word has followed; forms grow in frequency, so that chains end.
    """
    chains = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = chains.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        jumped = staged(chains.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "spelling-roots")
        chains = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return chains


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             ratio: int = RATIO, one_in: int = DELETE_ONE_IN, block: int = BLOCK) -> DataFrame:
    """One row per word of the vocabulary: ``word, form, root`` and ``n, n_near, form_n``.

    Words are runs of Latin letters, A-Z in lower case, thinned by ``thinned``, of at least
    ``least_length`` code points and ``least_count`` occurrences. ``form`` is the near word of largest ``n``
    (ties: the smallest), if it has ``ratio`` times the word's; otherwise it and ``form_n`` are null. ``root``
    is the last of the forms that follow, or the word. Null and empty texts have no words, a null id
    is one of no characters, repeated rows count each; no documents give no rows.
    """
    words = staged(word_counts(docs, doc_id, text, least_length, one_in).where(F.col("n") >= least_count), "spelling-words")
    first = F.struct((-F.col("near_n")).alias("less"), F.col("near"))
    near = near_pairs(words, least_length, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(first).alias("most"))
    rows = words.join(near, "word", "left")
    enough = -F.col("most.less") >= ratio * F.col("n")
    rows = staged(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("most.near")).alias("form"),
                              F.when(enough, -F.col("most.less")).alias("form_n")), "spelling-near")
    last = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
