"""Line dedup that returns compressed keep bitmaps instead of text.

Lines are split at ``\\n``. A line's key is the line without blanks at both ends and with A-Z in
lower case; keys of fewer than ``least`` code points are never dropped. Keys found in at least
``min_docs`` documents lose their lines: all of them, or all but the first occurrence.

A document lists each of its keys once, as a 128-bit digest with the places of its lines. The list
is range-partitioned and sorted by (digest, document, place of the first line). Ranges are cut by
all three, so a line that stands in a third of all documents fills many partitions rather than one.
A task streams its partition and holds at most ``min_docs`` records of the key at hand: it settles
every key that lies inside its range. What the two keys at its borders have elsewhere it cannot see;
it hands on one summary for each, and the few records that wait for it. These meet by digest.

A bitmap has one bit a line, set where the line stays, most significant bit first, deflated.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import add_fields, appended, col, fresh, map_batches, map_rows, row_key, staged

#: Documents that hold a key, from which on its lines go.
MIN_DOCS = 10
#: Code points of the shortest key that counts.
LEAST = 1
BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """A line's key, of UTF-8: blanks cut off at both ends, A-Z in lower case."""
    return line.strip(BLANKS).lower()


def places(text: bytes, least: int = LEAST) -> dict[bytes, list[int]]:
    """The places of the lines of each key that counts, in the order of their first lines."""
    out: dict[bytes, list[int]] = {}
    for place, line in enumerate(text.split(b"\n")):
        key = line_key(line)
        if key and (least <= 1 or len(key.decode()) >= least):
            out.setdefault(key, []).append(place)
    return out


def pack(kept: np.ndarray) -> bytes:
    """A bitmap of booleans, one a line."""
    return zlib.compress(np.packbits(kept).tobytes())


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


class _Record(NamedTuple):
    doc_id: object
    doc: bytes
    lines: bytes


class _Run:
    """The records of one key as far as a task has come, and what it hands on of them."""

    def __init__(self, digest: bytes, at_start: bool, min_docs: int, keep_first: bool):
        self.digest, self.at_start = digest, at_start
        self.min_docs, self.keep_first = min_docs, keep_first
        self.n, self.last, self.held = 0, None, []
        self.head: _Record | None = None

    def add(self, record: _Record, lose) -> None:
        """One more record; at and after ``min_docs`` documents they are lost at once."""
        if record.doc == self.last:
            return  # a repeated row
        self.last, self.n = record.doc, self.n + 1
        if self.head is None:
            self.head = record
            if self.keep_first:
                return  # settled at the end: only there is known whether an earlier range has the key
        if self.n < self.min_docs:
            self.held.append(record)
            return
        for held in self.held:
            lose(held, False)
        self.held = []
        lose(record, False)

    def close(self, at_end: bool, lose, wait, summary) -> None:
        border = self.at_start or at_end
        if border:
            summary(self)
            for held in self.held:
                wait(held)
            if self.keep_first:
                wait(self.head)
        elif self.keep_first and self.n >= self.min_docs:
            lose(self.head, True)


def _wanted(digests: list[bytes], min_docs: int) -> np.ndarray:
    """The rows of a sorted batch that need a look: a key's rows between two others in the batch, and
    fewer than ``min_docs`` of them, lose nothing."""
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    starts = np.concatenate([[0], np.flatnonzero((both[1:] != both[:-1]).any(axis=1)) + 1])
    sizes = np.diff(np.append(starts, len(both)))
    look = sizes >= min_docs
    look[[0, -1]] = True
    return np.flatnonzero(np.repeat(look, sizes))


def _stream(min_docs: int, keep_first: bool, names: list[str]):
    """Sorted records in; out come records that lose lines, records that wait for what other ranges
    have of their key, and the summaries of the keys at the borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: _Run | None = None

        def lose(record: _Record, spare: bool) -> None:
            rows.append(("lost", None, *record, spare, None))

        def finish(at_end: bool) -> None:
            now.close(at_end, lose, lambda r: rows.append(("waits", now.digest, *r, False, None)),
                      lambda s: rows.append(("sum", s.digest, s.head.doc_id, s.head.doc, None, False, s.n)))

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.binary(), id_type, pa.binary(), pa.binary(), pa.bool_(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            id_type = batch.schema.field(1).type
            batch = batch.take(pa.array(_wanted(batch.column(0).to_pylist(), min_docs)))
            for digest, doc_id, doc, lines in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if now is None or digest != now.digest:
                    at_start = now is None
                    if now is not None:
                        finish(False)
                    now = _Run(digest, at_start, min_docs, keep_first)
                now.add(_Record(doc_id, doc, lines), lose)
                if len(rows) >= 8192:
                    yield out()
        if now is not None:
            finish(True)
        if rows:
            yield out()

    return run


def _records(docs: DataFrame, least: int) -> DataFrame:
    """``digest, doc_id, doc, first, lines`` of every key of every document, of ``doc_id``, ``doc``, ``text``."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), docs.schema["doc_id"], docs.schema["doc"],
                           T.StructField("first", T.IntegerType()), T.StructField("lines", T.BinaryType())])

    def list_lines(batches):
        for batch in batches:
            rows, digests, firsts, lines = [], [], [], []
            for k, text in enumerate(batch.column(2).cast(pa.binary())):
                for key, found in places(text.as_py(), least).items():
                    rows.append(k)
                    digests.append(hashlib.md5(key).digest())
                    firsts.append(found[0])
                    lines.append(np.array(found, "<u4").tobytes())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0).take(take), batch.column(1).take(take),
                                              pa.array(firsts, pa.int32()), pa.array(lines, pa.binary())], names=schema.names)

    return map_batches(docs, schema, list_lines)


def lost_lines(docs: DataFrame, least: int = LEAST, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``doc``, ``lines`` (places, packed) and ``spare_first`` (the first of them stays), for each key
    that loses lines in a document. ``docs`` has ``doc_id``, ``doc`` (see ``row_key``) and ``text``."""
    schema = T.StructType([T.StructField("state", T.StringType()), T.StructField("digest", T.BinaryType()), docs.schema["doc_id"],
                           docs.schema["doc"], T.StructField("lines", T.BinaryType()), T.StructField("spare_first", T.BooleanType()),
                           T.StructField("n", T.LongType())])
    order = [F.col("digest"), F.col("doc_id").asc_nulls_last(), F.col("doc"), F.col("first")]
    ranged = _records(docs, least).repartitionByRange(*order).sortWithinPartitions(*order)
    told = staged(map_batches(ranged, schema, _stream(min_docs, keep_first, schema.names)), "lines-told")
    # at most two summaries a partition, and at most min_docs records that wait for each
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc")
    total = told.where("state = 'sum'").groupBy("digest").agg(F.sum("n").alias("everywhere"), F.min(rank)["doc"].alias("head"))
    waits = told.where("state = 'waits'").select("digest", "doc", "lines").join(total, "digest").where(F.col("everywhere") >= min_docs)
    late = waits.select("doc", "lines", (F.lit(keep_first) & (F.col("doc") == F.col("head"))).alias("spare_first"))
    return told.where("state = 'lost'").select("doc", "lines", "spare_first").union(late)


def _gone(lines: list[dict]) -> np.ndarray:
    """The places that a document loses, in order."""
    found = [np.frombuffer(r["lines"], "<u4")[1 if r["spare_first"] else 0 :] for r in lines]
    return np.sort(np.concatenate(found)) if found else np.empty(0, np.uint32)


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST,
                 min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """One row per document: ``doc_key`` (see ``row_key``), ``doc_id``, ``n_lines``, ``n_dropped``, ``keep``.

    A document is a distinct pair of id and text; rows that repeat both count once and have one row
    here. Ids may be null or repeat. Null and empty text are one empty line, which stays, as do
    lines of blanks. With ``keep_first`` a key's first line stays in the first document that has it,
    by id (null last), then by ``doc_key``. No documents give no rows.
    """
    keyed = docs.select(row_key(col(doc_id), col(text)).alias("doc"), col(doc_id).alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    gone = (lost_lines(keyed.select("doc_id", "doc", "text"), least, min_docs, keep_first)
            .groupBy("doc").agg(F.collect_list(F.struct("lines", "spare_first")).alias("gone")))
    breaks = F.length("text") - F.length(F.translate("text", "\n", ""))
    light = keyed.select("doc", "doc_id", (breaks + 1).cast("long").alias("n_lines")).dropDuplicates(["doc"])
    rows = light.join(gone, "doc", "left")
    schema = T.StructType([T.StructField("doc_key", T.BinaryType()), T.StructField("doc_id", docs.schema[doc_id].dataType),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType())])

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        dropped, bitmaps = [], []
        for n, lines in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            places_gone = _gone(lines or [])
            kept = np.ones(n, bool)
            kept[places_gone] = False
            dropped.append(len(places_gone))
            bitmaps.append(pack(kept))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(dropped, pa.int64()), pa.array(bitmaps, pa.binary())], names=schema.names)

    return map_rows(rows, schema, mark)


def apply(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the lines of the bitmaps only, and the names of the columns added.

    Added are ``n_lines`` and ``n_dropped``; names that ``docs`` has already get a ``_``. Null text
    stays null. All other columns stay; every row finds the bitmap of its id and text.
    """
    wanted = ("n_lines", "n_dropped")
    names = dict(zip(wanted, fresh(docs.columns, *wanted), strict=True))
    key, keep = fresh([*docs.columns, *names.values()], "doc_key", "keep")
    marks = bitmaps.select(F.col("doc_key").alias(key), *(F.col(w).alias(names[w]) for w in wanted), F.col("keep").alias(keep))
    joined = docs.withColumn(key, row_key(col(doc_id), col(text))).join(marks, key)
    rows = joined.select(*map(col, docs.columns), *map(col, names.values()), col(keep))
    at, width = docs.columns.index(text), len(docs.columns)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for whole, n, gone, bits in zip(batch.column(at).cast(pa.binary()), *(batch.column(width + k).to_pylist() for k in range(3)), strict=True):
            whole = whole.as_py()
            if whole is not None and gone:
                lines = whole.split(b"\n")
                whole = b"\n".join(lines[k] for k in np.flatnonzero(unpack(bits, n)))
            out.append(None if whole is None else whole.decode())
        columns = [pa.array(out, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(width)]
        kept = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])
        return appended(kept, *((names[w], batch.column(width + k)) for k, w in enumerate(wanted)))

    return map_rows(rows, add_fields(docs.schema, *((names[w], T.LongType()) for w in wanted)), cut), names
