"""Benchmark decontamination: one Aho-Corasick automaton over the windows of the benchmark.

Questions and answers are normalised to lower-case words; every run of 13 words (a shorter item as
a whole) is a pattern of one automaton. Each document is normalised alike and scanned once; the
matches are mapped back to words and, for the spans, to code points of the original text.

The automaton goes to the tasks as a broadcast of the benchmark's texts. Its size is checked: a
benchmark beyond ``max_block_bytes`` is dealt into blocks of at most about that size, scanned one
after the other with the hits so far carried along in a written table.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import WORD_PATTERN, add_fields, appended, col, fresh, map_rows, staged, utf8, words_of

WINDOW = 13
MAX_BLOCK_BYTES = 1 << 20
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20

_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_VERDICT = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), _SPANS)
_WORDS = re.compile(WORD_PATTERN)
_BUILT: dict[str, tuple] = {}


def _blocks(benchmark: DataFrame, item: str, text: str, max_bytes: int) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks of bounded size the benchmark has, and their (item, text) rows one by one."""
    items = benchmark.select(col(item).cast("string").alias("i"), col(text).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // max_bytes))
    dealt = (items if n == 1 else items.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == k) for k in range(n))
    return n, ([(r.i, r.t) for r in part.collect()] for part in dealt)


def _automaton(rows: list[tuple], window: int):
    """The automaton over word numbers, and the number of each benchmark word (others are 0).

    A pattern's value is its width and the items that have it.
    """
    found: dict[tuple, tuple[int, set]] = {}
    numbers: dict[bytes, int] = {}
    for item, text in rows:
        words = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text.encode())]
        width = min(window, len(words))
        for i in range(len(words) - width + 1 if words else 0):
            found.setdefault(tuple(words[i : i + width]), (width, set()))[1].add("null" if item is None else item)
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, (width, items) in found.items():
        machine.add_word(key, (width, frozenset(items)))
    if found:
        machine.make_automaton()
    return (machine if found else None), numbers


def _machine(key: str, rows, window: int):
    """The automaton of a broadcast, built once for each Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = _automaton(rows.value, window)
    return _BUILT[key]


def _scan(words: list[bytes], machine, numbers: dict[bytes, int]) -> tuple[np.ndarray, set]:
    """Which words are hit, and the items that occur."""
    hit, items = np.zeros(len(words), bool), set()
    if words and machine is not None:
        for end, (width, which) in machine.iter(tuple([numbers.get(w, 0) for w in words])):
            hit[end - width + 1 : end + 1] = True
            items |= which
    return hit, items


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last word of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: int = SHARE, max_block_bytes: int = MAX_BLOCK_BYTES,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the verdict added, and the names of the added columns.

    Added are ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items``,
    ``items`` (the ids as strings, sorted), ``contaminated`` (``n_hit > 0`` and
    ``share * n_hit >= n_words``) and ``spans`` (start and end, in code points of the original
    text, of each run of hit words). A name that ``docs`` has already gets a ``_``.

    A null or empty text has no words, no hits and is clean; so is every text if the benchmark is
    empty. Items with null or wordless text have no window; an item with a null id counts as
    ``null``. Repeated items count once for each distinct id; repeated documents each get a row.
    """
    names = dict(zip(("n_words", "n_hit", "n_items", "items", "contaminated", "spans"),
                     fresh(docs.columns, "n_words", "n_hit", "n_items", "items", "contaminated", "spans"), strict=True))
    (runs, seen) = fresh([*docs.columns, *names.values()], "runs_so_far", "items_so_far")
    pair = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    state = add_fields(docs.schema, (runs, T.ArrayType(pair)), (seen, T.ArrayType(T.StringType())))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    types = (T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.BooleanType(), T.ArrayType(span))
    verdict = add_fields(docs.schema, *zip(names.values(), types, strict=True))
    spark, at = docs.sparkSession, docs.columns.index(text)
    base = len(docs.columns)

    def scan_block(rows, key: str, first: bool, last: bool):
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            machine, numbers = _machine(key, rows, window)
            before = [([], [])] * batch.num_rows if first else list(
                zip(batch.column(base).to_pylist(), batch.column(base + 1).to_pylist(), strict=True))
            out: list[tuple] = []
            for value, (old, old_items) in zip(utf8(batch.column(at)), before, strict=True):
                words = words_of(value)
                hit, items = _scan(words, machine, numbers)
                for x in old:
                    hit[x["a"] : x["b"] + 1] = True
                items, found = sorted(items.union(old_items)), _runs(hit)
                if last:
                    n_hit = int(hit.sum())
                    out.append((len(words), n_hit, len(items), items, n_hit > 0 and share * n_hit >= len(words),
                                _spans(value, found)))
                else:
                    out.append(([{"a": a, "b": b} for a, b in found], items))
            kept = pa.RecordBatch.from_arrays(batch.columns[:base], names=batch.schema.names[:base])
            fields = zip(names.values(), _VERDICT, strict=True) if last else ((runs, _RUNS), (seen, pa.list_(pa.string())))
            return appended(kept, *((n, pa.array(list(v), k)) for (n, k), v in zip(fields, zip(*out, strict=True), strict=True)))

        return fn

    now = docs
    n, blocks = _blocks(benchmark, item, item_text, max_block_bytes)
    for k, rows in enumerate(blocks):
        shared = spark.sparkContext.broadcast(rows)
        key = f"{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
        last = k == n - 1
        now = map_rows(staged(now, "decontaminate") if k else now, verdict if last else state,
                       scan_block(shared, key, not k, last))
    return now, names


def _spans(value: bytes | None, found: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as code points of the original text."""
    if not found:
        return []
    places = [m.span() for m in _WORDS.finditer(value.decode())]
    return [{"start": places[a][0], "end": places[b][1]} for a, b in found]


def items_digest(items: str):
    """Hex SHA-256 of the sorted item ids joined by commas."""
    return F.sha2(F.array_join(col(items), ",").cast("binary"), 256)


def brute_force(text: str | None, items: list[tuple], window: int = WINDOW, share: int = SHARE) -> tuple:
    """The same verdict by comparing every window with every place, for tests."""
    words = words_of(text.encode()) if text else []
    hit, found = [False] * len(words), set()
    for item, body in items:
        own = words_of(body.encode()) if body else []
        width = min(window, len(own))
        for i in range(len(own) - width + 1 if own else 0):
            for j in range(len(words) - width + 1):
                if words[j : j + width] == own[i : i + width]:
                    hit[j : j + width] = [True] * width
                    found.add("null" if item is None else str(item))
    n = sum(hit)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), n, len(found), digest, n > 0 and share * n >= len(words)
