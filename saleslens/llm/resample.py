"""Target-distribution importance resampling on hashed n-grams, by prefix CRCs.

A text is normalised to its lower-case words, joined by one space. One scan over it stores the running
CRC-32 at the start and the end of each word. The CRC of any n-gram follows from two of these: that
at its end, and that at its start shifted by the n-gram's length. A shift by so many zero bytes is a
linear map over GF(2); xor cancels the prefix, ``crc(B) = crc(AB) ^ shift(crc(A), |B|)``.

An n-gram's bucket is its CRC modulo the number of buckets. Buckets are counted over the whole corpus
and over the whole target, and a bucket's gain is the log ratio of the two smoothed shares. A
document's weight is the sum of its n-grams' gains; Gumbel noise from a hash of its id makes the
highest scores a sample without replacement.

Texts are scanned once: the buckets of their n-grams are written, and counts and weights are read from there.
Ranks over the whole corpus come from a range sort: a task numbers its own rows, and the rows of the
ranges before are added. The only table that goes to the driver and to all tasks is that of the
gains, one number a bucket.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from saleslens.llm.common import col, map_batches, map_rows, staged, words_of

SHORTEST, LONGEST = 1, 1
BUCKETS = 10_000
#: Documents of fewer words are scored, not drawn.
LEAST_WORDS = 20
#: Share of those with enough words that is drawn, in percent.
PERCENT = 10
SEED = 2024
#: N-grams whose buckets are found at once, within a batch of rows or a long text: words as objects and the
#: arrays beside them take about 200 bytes an n-gram, and several tasks share an executor.
PIECE = 1 << 17

# ---------------------------------------------------------------------------------------------
# CRC-32 as a linear map

_POLYNOMIAL = 0xEDB88320
#: Lengths whose shift is one table; longer ones take a shift for each bit of the length.
_NEAR = 64


def _byte_table() -> np.ndarray:
    """What one zero byte makes of each value of the register's low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


_BYTE = _byte_table()


def _tables(columns: np.ndarray) -> np.ndarray:
    """A map given by the images of the 32 bits, as a table for each byte of its argument."""
    out = np.zeros((4, 256), np.uint32)
    value = np.arange(256)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(value >> bit & 1, columns[8 * byte + bit], 0).astype(np.uint32)
    return out


def _through(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


def _shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables for shifts by 0 to ``_NEAR`` - 1 bytes, and by 1, 2, 4 ... 2**31 bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    image, near = bits.copy(), []
    for _ in range(_NEAR):
        near.append(_tables(image))
        image = _BYTE[image & 255] ^ (image >> 8)
    doubled = [near[1]]
    for _ in range(31):
        doubled.append(_tables(_through(doubled[-1], _through(doubled[-1], bits))))
    return np.ascontiguousarray(np.stack(near)), doubled


_NEAR_TABLES, _DOUBLED = _shifts()


def shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs after as many zero bytes each (the pre- and post-inversion of CRC-32 cancels out)."""
    out = crc.astype(np.uint32, copy=True)
    near = length < _NEAR
    k, c = length[near], out[near]
    out[near] = (_NEAR_TABLES[k, 0, c & 255] ^ _NEAR_TABLES[k, 1, c >> 8 & 255]
                 ^ _NEAR_TABLES[k, 2, c >> 16 & 255] ^ _NEAR_TABLES[k, 3, c >> 24])
    far = np.flatnonzero(~near)
    for bit in range(int(length[far].max()).bit_length() if len(far) else 0):
        some = far[length[far] >> bit & 1 == 1]
        out[some] = _through(_DOUBLED[bit], out[some])
    return out


class Prefixes(NamedTuple):
    """Running CRCs and byte offsets of a normalised text at the starts and ends of its words."""

    start: np.ndarray
    end: np.ndarray
    start_at: np.ndarray
    end_at: np.ndarray


def _extend(crc: int, piece: bytes) -> int:
    return zlib.crc32(piece, crc)


def scan(texts: list[list[bytes]]) -> Prefixes:
    """The running CRCs of texts given as words, one scan each, one text after the other.

    Each text's run starts anew. The scan stops after each word; a space further on starts the next.
    """
    sizes = np.fromiter((len(w) for words in texts for w in words), np.int64)
    end = np.empty(len(sizes), np.uint32)
    heads, at = [], 0
    for words in texts:
        if words:
            pieces = itertools.chain(words[:1], map(b" ".__add__, itertools.islice(words, 1, None)))
            crcs = itertools.islice(itertools.accumulate(pieces, _extend, initial=0), 1, None)
            end[at : at + len(words)] = np.fromiter(crcs, np.uint32, len(words))
            heads.append(at)
            at += len(words)
    start = np.zeros(len(sizes), np.uint32)
    state = ~end[:-1]
    start[1:] = ~(_BYTE[(state ^ np.uint32(0x20)) & 255] ^ (state >> 8))
    start[heads] = 0
    end_at = np.cumsum(sizes + 1) - 1
    return Prefixes(start, end, end_at - sizes, end_at)


def ngram_crcs(prefixes: Prefixes, first: np.ndarray, n: int) -> np.ndarray:
    """The CRCs of the runs of ``n`` words from each of the places ``first``."""
    last = first + n - 1
    return prefixes.end[last] ^ shift(prefixes.start[first], prefixes.end_at[last] - prefixes.start_at[first])


# ---------------------------------------------------------------------------------------------
# features


def _pieces(texts: Iterator[bytes | None], longest: int) -> Iterator[list[list[bytes]]]:
    """Texts as words, so many at once as have ``PIECE`` n-grams at most, or one."""
    held, size = [], 0
    for text in texts:
        words = words_of(text)
        if held and (size + len(words)) * longest > PIECE:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def buckets_of(texts: list[list[bytes]], n_buckets: int, shortest: int, longest: int) -> list[np.ndarray]:
    """The buckets of all runs of ``shortest`` to ``longest`` words of each text, repeats included."""
    prefixes = scan(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    found, owner = [], []
    for n in range(shortest, longest + 1):
        runs = np.maximum(sizes - n + 1, 0)
        whose = np.repeat(np.arange(len(texts)), runs)
        first = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + begin[whose]
        found += [ngram_crcs(prefixes, first[k : k + PIECE], n) % np.uint32(n_buckets) for k in range(0, len(first), PIECE)]
        owner.append(whose)
    whose = np.concatenate(owner)
    buckets = np.concatenate([np.empty(0, np.uint32), *found])
    if shortest < longest:
        buckets = buckets[np.argsort(whose, kind="stable")]
    ends = np.cumsum(np.bincount(whose, minlength=len(texts)))
    return np.split(buckets, ends[:-1])


def features(docs: DataFrame, n_buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """``key``, ``n_words`` and ``buckets`` (packed numbers) of each row; ``docs`` has ``key`` and ``text``."""
    schema = T.StructType([docs.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("buckets", T.BinaryType())])
    wide = _packed(n_buckets)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, packed = [], []
        for texts in _pieces((v.as_py() for v in batch.column(1).cast(pa.binary())), longest - shortest + 1):
            counts += map(len, texts)
            packed += (b.astype(wide).tobytes() for b in buckets_of(texts, n_buckets, shortest, longest))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=schema.names)

    return map_rows(docs.select("key", "text"), schema, run)


def _packed(n_buckets: int) -> str:
    return "<u2" if n_buckets <= 1 << 16 else "<u4"


def bucket_counts(rows: DataFrame, n_buckets: int) -> DataFrame:
    """``bucket`` and ``n`` over all rows: a task counts its own, and the counts are added."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_py(), _packed(n_buckets)), minlength=n_buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=schema.names)

    return map_batches(rows.select("buckets"), schema, count).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths, rounded down: one number a bucket, whatever the corpus."""
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for counts, out in ((corpus, s), (target, t)):
        for r in counts.collect():
            out[r["bucket"]] = r["n"]
    all_s, all_t = s.sum(), t.sum()
    ratios = ((t + 1) * (all_s + n_buckets)) / ((s + 1) * (all_t + n_buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the id (null: of no characters)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weights(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``key, n_words, n_features, weight`` of rows with their ``buckets``."""
    schema = T.StructType([rows.schema["key"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])
    kind = _packed(len(gain))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.frombuffer(v.as_py(), kind) for v in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(len, found), pa.int64()),
                                           pa.array([int(gain[f].sum()) for f in found], pa.int64())], names=schema.names)

    return map_rows(rows.select("key", "n_words", "buckets"), schema, run)


# ---------------------------------------------------------------------------------------------
# ranks


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in the order of all of them.

    Rows are range-partitioned and sorted; each partition numbers its rows, and the rows of the
    partitions before it are added. These counts are one row a partition.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("own", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)),
                                              pa.array(np.arange(at + 1, at + n + 1))], names=schema.names)
            at += n

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = staged(map_batches(ranged, schema, number), "ranked")
    counts = numbered.groupBy("part").agg(F.max("own").alias("n"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    joined = numbered.join(F.broadcast(before), "part")
    return joined.select(*map(col, rows.columns), (F.col("own") + F.col("before")).cast("long").alias(name))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             n_buckets: int = BUCKETS, shortest: int = SHORTEST, longest: int = LONGEST, least_words: int = LEAST_WORDS,
             percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_features, weight, score, rank``.

    ``rank`` counts the drawn documents from 1, by score, then by id (null last); it is null for those
    not drawn. Null and empty texts have no n-grams and weight 0. Repeated rows are documents of
    their own with ranks of their own. An empty target has only the smoothing; no documents give no rows.
    """
    shape = (n_buckets, shortest, longest)
    rows = staged(features(docs.select(col(doc_id).alias("key"), col(text).alias("text")), *shape), "buckets")
    aim = features(target.select(F.lit(None).cast("long").alias("key"), col(target_text).alias("text")), *shape)
    gain = gains(bucket_counts(rows, n_buckets), bucket_counts(aim, n_buckets), n_buckets)
    scored = weights(rows, gain).withColumn("score", (F.col("weight") + noise(F.col("key"), seed)).cast("long"))
    enough = F.col("n_words") >= least_words
    drawn = rows.where(enough).count() * percent // 100
    # those with enough words come first; what follows them is never drawn
    order = [F.when(enough, F.lit(0)).otherwise(F.lit(1)), F.col("score").desc(), F.col("key").asc_nulls_last()]
    placed = ranked(scored, order, "place")
    rank = F.when(enough & (F.col("place") <= drawn), F.col("place"))
    return placed.select(F.col("key").alias("doc_id"), "n_words", "n_features", "weight", "score", rank.alias("rank"))
