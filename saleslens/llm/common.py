"""Helpers of this package: written intermediates, column names, Arrow batches, words, hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.session import shared_dir, ship

# ---------------------------------------------------------------------------------------------
# Spark side


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later uses start from the files, and a
    lost executor costs a read, not the work before it."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names like ``wanted`` that clash with no name in ``taken`` (Spark ignores case)."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"{name}_"
        used.add(name.lower())
        out.append(name)
    return out


def col(name: str):
    """A column by its whole name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(doc_id, text):
    """What makes a document: its id and its text. Rows that repeat both are one."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(doc_id.cast("string"), F.lit("-")), text.isNull().cast("string"),
                                     F.coalesce(text, F.lit(""))).cast("binary")))


def add_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in fields)])


def map_batches(df: DataFrame, schema: T.StructType, fn: Callable) -> DataFrame:
    """``mapInArrow`` with this package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_rows(df: DataFrame, schema: T.StructType, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``mapInArrow`` with a function of one batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return map_batches(df, schema, run)


def appended(batch: pa.RecordBatch, *columns: tuple[str, pa.Array]) -> pa.RecordBatch:
    """The batch with more columns after its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *(a for _, a in columns)],
                                      names=[*batch.schema.names, *(n for n, _ in columns)])


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """A text column's values as UTF-8."""
    return (v.as_py() for v in column.cast(pa.binary()))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows with equal values in the first ``keys`` columns, of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_pylist() for k in range(keys)]
        rows = list(zip(*columns, strict=True))
        start = 0
        for i in range(n):
            if rows[i] != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, rows[i]
        held.append(batch.slice(start, n - start))
    if held:
        yield pa.Table.from_batches(held)


# ---------------------------------------------------------------------------------------------
# words

# A-Z become a-z; every other ASCII character but a-z and 0-9 parts words; bytes of other
# characters stay.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
#: A word in an original text, before A-Z are lowered.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-case words of a UTF-8 text: digits, ASCII letters and all non-ASCII characters."""
    return text.translate(_WORD).split() if text else []


# ---------------------------------------------------------------------------------------------
# hashes

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def series(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15))


_BYTE = series(11, 256)
_BASE = series(12, 1)[0] | _U(1)
_STEP = series(13, 64) | _U(1)
_CHUNK = 1 << 20


def _powers(n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(n - 1, _BASE, _U), out=out[1:]) if n > 1 else None
    return out


_POWERS = _powers(256)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word (all not empty), a polynomial over its bytes."""
    global _POWERS
    out, start = np.empty(len(words), _U), 0
    while start < len(words):
        size, end = 0, start
        while end < len(words) and (size < _CHUNK or end == start):
            size += len(words[end])
            end += 1
        part = words[start:end]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        if (longest := int(lengths.max())) > len(_POWERS):
            _POWERS = _powers(2 * longest)
        begins = np.cumsum(lengths) - lengths
        place = np.arange(size) - np.repeat(begins, lengths)
        with np.errstate(over="ignore"):
            values = _BYTE[np.frombuffer(b"".join(part), np.uint8)] * _POWERS[place]
            out[start:end] = np.add.reduceat(values, begins)
        start = end
    return mix(out)


def shingles(words: list[bytes], k: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of all runs of ``k`` words; a shorter text is one run."""
    if not words:
        return np.empty(0, _U)
    h = word_hashes(words)
    k = min(k, len(h))
    n = len(h) - k + 1
    runs = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            runs += h[j : j + n] * _STEP[j]
    return np.unique(mix(runs + _U(k)))


# ---------------------------------------------------------------------------------------------
# graphs


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """``node`` and ``component`` (the least node) of the graph of the edges ``a``, ``b``.

    Each round takes the least label among the neighbours, then follows labels once; it ends when
    no label has changed. A round's labels are a written table. Folding on the map side keeps a hub
    from weighing on one task; joins on its label are split by the adaptive skew join.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{purpose}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    labels = staged(labels.select("node", F.least("node", "component").alias("component")), f"{purpose}-labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = staged(lower, f"{purpose}-lower")
        ahead = lower.select(F.col("node").alias("component"), F.col("component").alias("ahead"))
        jumped = lower.join(ahead, "component").select("node", "old", F.col("ahead").alias("component"))
        jumped = staged(jumped, f"{purpose}-labels")
        labels = jumped.drop("old")
        if jumped.where("old <> component").isEmpty():
            return labels


def tiles(rows: DataFrame, group: str, size: str, block: int, row: str) -> DataFrame:
    """Rows dealt to pairs of blocks of their group, so that any two meet and no task gets a whole
    large group: columns ``own``, ``lo``, ``hi`` are added. A group of up to ``block`` rows is one pair."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(row, group), F.greatest(n, F.lit(1))).cast("int")
    rows = rows.withColumn("n_blocks", F.greatest(n, F.lit(1))).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    return (rows.withColumn("other", other).withColumn("lo", F.least("own", "other"))
            .withColumn("hi", F.greatest("own", "other")).drop("other", "n_blocks"))
