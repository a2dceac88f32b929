"""Substring dedup by hashing parts of lines or paragraphs.

A line, or a paragraph between blank lines, is parted at words chosen by their hash: before a word
whose hash is the least among ``REACH`` words on both sides. Whether a word is chosen depends on these
words only, so a passage parts alike wherever it stands, also inside a line. Parts have more than
``REACH`` words; a shorter line is one part. Full stops of scripts without blanks part as well.

Parts are normalised to lower-case words, parted at Unicode blanks and punctuation too, and hashed. Of
the parts with one hash over all documents the earliest ranked occurrence stays, by document id and
place, and the others are cut out. Where a passage ends inside a part, the cut is extended by pairs of
words: each part carries hashes of its neighbours' first 2, 4, 6 ... words from its side, and the words
next to a removed part go as far as these are the same next to the part that stays; short lines neither go so
nor take words along. What is cut is returned with its place in the original text
and the document that keeps it.

Hashes are range-partitioned with the documents in their rank, so that a part that stands in a
third of all documents fills many ranges. A task streams its range; only the part at the start of a
range has to wait for where it began, which one summary a range tells.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import WORD_PATTERN, add_fields, appended, col, fresh, map_batches, map_rows, mix, series, staged

#: Words on either side among which a chosen word has the least hash.
REACH = 5
#: Parts of fewer words may meet by chance. They are repeated if so many documents hold them, and
#: if they have so many characters.
LEAST_WORDS, LEAST_DOCS, LEAST_CHARACTERS = 5, 10, 12
#: Code points that are parted at once, or one text.
PIECE = 1 << 20
#: Words next to a removed part go with it in twos, as one alone may meet by chance; bytes of their hash.
TOGETHER, _TELLING = 2, 3

# Scripts written without blanks, and how many of their characters count as a word.
_UNSPACED = (
    (re.compile("[々-〇ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff]"), 2),
    (re.compile("[ก-ฺเ-๎ກ-໎ໜ-ໟཀ-ྼက-႟ក-៓ᥐ-᧟ᨠ-᪭]"), 4),
)
_STOPS = "。！？｡"
_BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n(?:[ \t\r]*\n)+")}
# Blanks and punctuation are known below this code point; beyond it all characters belong to words.
_KNOWN = 0x20000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it belongs to a word, its hash (A-Z as a-z), its share of a word."""
    plain = [chr(c).isalnum() if c < 128 else not (c == 0x85 or unicodedata.category(chr(c))[0] in "PZ") for c in range(_KNOWN)]
    inside = np.array([*plain, True])
    values = series(41, _KNOWN + 1)
    values[65:91] = values[97:123]
    shares = np.zeros(_KNOWN + 1, np.float32)
    for script, n in _UNSPACED:
        shares[[c for c in range(128, _KNOWN) if script.match(chr(c))]] = 1 / n
    shares[_KNOWN] = 0.5
    return inside, np.where(inside, values, np.uint64(0)), shares


_INSIDE, _VALUES, _SHARES = _tables()
_ODD = series(42, 3) | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def _sums(values: np.ndarray, begins: np.ndarray, base: np.uint64) -> np.ndarray:
    """A polynomial over each run of values, which starts at ``begins`` and ends before the next."""
    sizes = np.diff(np.append(begins, len(values)))
    place = np.arange(len(values)) - np.repeat(begins, sizes)
    return np.add.reduceat(values * _powers(base, int(sizes.max()))[place], begins)


def split(text: str, unit: str = "line") -> list[tuple[int, int]]:
    """Start and end of each line or paragraph, in code points, without the break after it."""
    out, start = [], 0
    for found in _BREAKS[unit].finditer(text):
        out.append((start, found.start()))
        start = found.end()
    return [*out, (start, len(text))]


class Parts(NamedTuple):
    """The parts of some texts, one text after the other, and their words."""

    text: np.ndarray  # number of the text of each part
    line: np.ndarray  # number of its line in its text
    start: np.ndarray  # its place in its text, with what stands before its first word in the line
    end: np.ndarray
    first: np.ndarray  # its first word, and at the end the number of words
    size: np.ndarray  # its words; in scripts without blanks, some characters count as one
    digest: np.ndarray  # two numbers each
    word_start: np.ndarray  # place of each word in its text
    word_end: np.ndarray
    word_hash: np.ndarray


def parts(texts: list[str], unit: str = "line", reach: int = REACH) -> Parts:
    """The parts of texts. A line without words has none."""
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    if unit == "line":
        line_end = np.flatnonzero(points == 10)
        line_start = np.concatenate([[0], line_end[:-1] + 1])
    else:
        spans = np.array([(a + begin, b + begin) for t, begin in zip(texts, begins, strict=False) for a, b in split(t, unit)])
        line_start, line_end = spans[:, 0], spans[:, 1]
    known = np.minimum(points, _KNOWN)
    inside = _INSIDE[known]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    n = len(start)
    if not n:
        none = np.empty(0, np.int64)
        return Parts(none, none, none, none, np.zeros(1, np.int64), none, np.empty((0, 2), np.uint64), none, none, np.empty(0, np.uint64))
    values = _VALUES[known]
    if len(points) and int(points.max()) >= _KNOWN:
        values = np.where(points >= _KNOWN, mix(points.astype(np.uint64) + np.uint64(1 << 40)), values)
    hashes = mix(_sums(values[start[0] :], start - start[0], _ODD[0]))
    line = np.searchsorted(line_start, start, "right") - 1
    stops = np.cumsum(np.isin(points, [ord(c) for c in _STOPS]))[start]
    at = np.arange(n)
    opens = np.concatenate([[True], (line[1:] != line[:-1]) | (stops[1:] != stops[:-1])])
    heads = np.flatnonzero(opens)
    sizes = np.diff(np.append(heads, n))
    head, tail = np.repeat(heads, sizes), np.repeat(heads + sizes, sizes)
    chosen = (at - head > reach) & (tail - at > reach)
    for k in range(1, reach + 1):
        chosen[k:] &= hashes[k:] < hashes[:-k]
        chosen[:-k] &= hashes[:-k] <= hashes[k:]
    first = np.flatnonzero(opens | chosen)
    ends = np.append(first, n)
    counts = np.diff(ends).astype(np.float64)
    if int(points.max()) > 127:
        shares = np.add.reduceat(np.where(inside, _SHARES[known], 0)[start[0] :], start - start[0])
        counts = np.maximum(counts, np.add.reduceat(shares, first))
    length = np.diff(ends).astype(np.uint64)
    digest = np.stack([mix(_sums(hashes, first, _ODD[1]) + length), mix(_sums(mix(hashes ^ _ODD[0]), first, _ODD[2]) + length)], axis=1)
    of_line = line[first]
    text = np.searchsorted(begins, start[first], "right") - 1
    new_line = np.concatenate([[True], of_line[1:] != of_line[:-1]])
    part_start = np.where(new_line, line_start[of_line], start[first])
    part_end = np.where(np.append(new_line[1:], True), line_end[of_line], np.append(start[first[1:]], 0))
    shift = begins[text]
    word_shift = np.repeat(shift, np.diff(ends))
    of_text = of_line - np.searchsorted(line_start, shift)
    return Parts(text, of_text, part_start - shift, part_end - shift, ends, counts, digest, start - word_shift, end - word_shift, hashes)


def digest(unit: str) -> bytes | None:
    """The hash of a text's first part; None if it has no words."""
    found = parts([unit]).digest
    return found[0].tobytes() if len(found) else None


def _pieces(texts: Iterator[tuple[int, str]]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbered texts in lists of up to ``PIECE`` code points, or of one text."""
    rows, held, size = [], [], 0
    for k, text in texts:
        if held and size + len(text) > PIECE:
            yield rows, held
            rows, held, size = [], [], 0
        rows.append(k)
        held.append(text)
        size += len(text) + 1
    if held:
        yield rows, held


# ---------------------------------------------------------------------------------------------
# what a part tells of itself: whether it is short, its places, and the words next to the first of them


class _Chain(NamedTuple):
    """For each part, hashes of its first 2, 4, 6 ... words: bytes, and where those of each part begin and end."""

    data: bytes
    at: np.ndarray

    def of(self, part: int) -> bytes:
        return self.data[self.at[part, 0] : self.at[part, 1]]


def _chain(hashes: np.ndarray, ends: np.ndarray) -> _Chain:
    """Chains of the parts; part ``k`` has the words ``ends[k]`` to ``ends[k + 1]``."""
    sizes = np.diff(ends)
    place = np.arange(len(hashes)) - np.repeat(ends[:-1], sizes)
    total = np.cumsum(hashes * _powers(_ODD[1], int(sizes.max()))[place])
    before = np.concatenate([np.zeros(1, np.uint64), total])[ends[:-1]]
    some = place % TOGETHER == TOGETHER - 1
    sums = mix(total[some] - np.repeat(before, sizes // TOGETHER))
    data = np.ascontiguousarray(sums.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_TELLING]).tobytes()
    at = np.concatenate([[0], np.cumsum(sizes // TOGETHER)]) * _TELLING
    return _Chain(data, np.stack([at[:-1], at[1:]], axis=1))


def _both_ways(found: Parts) -> tuple[_Chain, _Chain]:
    """The chains of all parts from their first words on, and from their last words back."""
    ends = found.first
    back = _chain(found.word_hash[::-1], ends[-1] - ends[::-1])
    return _chain(found.word_hash, ends), back._replace(at=back.at[::-1])


_ABOUT = np.dtype([("short", "u1"), ("size", "<u4"), ("place", "<u4"), ("before", "<u4")])


def _pack(short: bool, places: bytes, before: bytes, after: bytes) -> bytes:
    return b"".join([b"\1" if short else b"\0", len(places).to_bytes(4, "little"), places, len(before).to_bytes(4, "little"), before, after])


def _unpack(told: bytes) -> tuple[bool, np.ndarray, bytes, bytes]:
    n = int.from_bytes(told[1:5], "little")
    m = int.from_bytes(told[5 + n : 9 + n], "little")
    return told[0] == 1, np.frombuffer(told, "<u4", n // 4, 5), told[9 + n : 9 + n + m], told[9 + n + m :]


def _tell(found: Parts) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The distinct parts of each text: the text's number, the digest and a description of each."""
    length = found.word_end[found.first[1:] - 1] - found.word_start[found.first[:-1]]
    short = found.size < LEAST_WORDS
    told = np.flatnonzero(~short | (length >= LEAST_CHARACTERS))
    if not len(told):
        return np.empty(0, np.int64), np.empty((0, 2), np.uint64), []
    # parts of one text and digest side by side, in their order
    told = told[np.lexsort((found.digest[told, 1], found.digest[told, 0], found.text[told]))]
    text, mark = found.text[told], found.digest[told]
    heads = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (mark[1:] != mark[:-1]).any(axis=1)]))
    n = np.diff(np.append(heads, len(told)))
    first = told[heads]
    opens = np.searchsorted(found.text, text[heads])  # the text's first part
    ahead, back = _both_ways(found)
    before = np.where((first > opens)[:, None], back.at[first - 1], 0)
    follows = np.append(found.text[1:] == found.text[:-1], False)[first]
    after = np.where(follows[:, None], ahead.at[np.minimum(first + 1, len(found.text) - 1)], 0)
    about = np.empty(len(first), _ABOUT)
    about["short"], about["size"], about["place"], about["before"] = short[first], 4, first - opens, before[:, 1] - before[:, 0]
    packed, width = about.tobytes(), _ABOUT.itemsize
    out = [packed[k : k + width] + back.data[a:b] + ahead.data[c:d]
           for k, (a, b), (c, d) in zip(range(0, len(packed), width), before.tolist(), after.tolist(), strict=True)]
    for k in np.flatnonzero(n > 1).tolist():
        places = told[heads[k] : heads[k] + n[k]] - opens[k]
        out[k] = _pack(bool(short[first[k]]), places.astype("<u4").tobytes(), back.data[slice(*before[k])], ahead.data[slice(*after[k])])
    return text[heads], mark[heads], out


# ---------------------------------------------------------------------------------------------
# ranges of digests


class _Holder(NamedTuple):
    doc_id: object
    row: int
    told: bytes


class _Run:
    """The documents that hold one part, as far as a task has come, in their rank."""

    def __init__(self, digest: bytes, at_start: bool):
        self.digest, self.at_start = digest, at_start
        self.n, self.last, self.head = 0, None, None
        self.held: list[_Holder] = []
        self.need = 1

    def add(self, holder: _Holder, emit) -> None:
        if holder[:2] == self.last:
            return  # a repeated row
        self.last, self.n = holder[:2], self.n + 1
        if self.head is None:
            self.head, self.need = holder, LEAST_DOCS if holder.told[0] else 1
        if self.at_start:
            emit("waits", self.digest, holder, None, 0)
        elif self.n < self.need:
            self.held.append(holder)
        else:
            for early in [*self.held, holder]:
                emit("gone", None, early, self.head, 0)
            self.held = []

    def close(self, at_end: bool, emit) -> None:
        if self.at_start or at_end:
            emit("sum", self.digest, self.head, None, self.n)
            for holder in self.held:
                emit("waits", self.digest, holder, None, 0)


def _stream(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: _Run | None = None

        def emit(state, digest, holder, head, n) -> None:
            if state == "sum":
                rows.append((state, digest, *holder, None, None, None, None, n))
                return
            short, places, _, _ = _unpack(holder.told)
            if head is None:
                rows.append((state, digest, *holder[:2], None, places.tobytes(), None, None, short, n))
            elif holder[:2] != head[:2] or len(places) > 1:
                # not the occurrence that stays, or not that alone
                rows.append((state, None, *holder[:2], head.told, places.tobytes(), head.doc_id, holder[:2] == head[:2], None, n))

        def out() -> pa.RecordBatch:
            kinds = (pa.string(), pa.binary(), id_type, pa.int64(), pa.binary(), pa.binary(), id_type, pa.bool_(), pa.bool_(), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return made

        for batch in batches:
            if not batch.num_rows:
                continue
            id_type = batch.schema.field(1).type
            digests = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 2)
            same = (digests[1:] == digests[:-1]).all(axis=1)
            several = pc.not_equal(pc.binary_slice(batch.column(3), 1, 5), b"\4\0\0\0").to_numpy(zero_copy_only=False)
            look = np.append(same, True) | np.append([True], same) | several
            batch = batch.take(pa.array(np.flatnonzero(look)))
            for digest, *holder in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if now is None or digest != now.digest:
                    if now is not None:
                        now.close(False, emit)
                    now = _Run(digest, now is None)
                now.add(_Holder(*holder), emit)
                if len(rows) >= 4096:
                    yield out()
        if now is not None:
            now.close(True, emit)
        if rows:
            yield out()

    return run


def repeats(docs: DataFrame, unit: str = "line") -> DataFrame:
    """``doc_id``, ``row``, ``places`` (of a part), ``keeper`` and ``kept`` (the part that stays) and
    ``spare_first`` (the first place is the one that stays). ``docs`` has ``doc_id, row, text``."""
    schema = T.StructType([T.StructField("digest", T.BinaryType()), docs.schema["doc_id"], docs.schema["row"], T.StructField("told", T.BinaryType())])

    def list_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _pieces(enumerate(batch.column(2).to_pylist())):
                number, digests, told = _tell(parts(texts, unit))
                at = pa.array(np.array(rows)[number], pa.int64())
                ends = pa.py_buffer(np.arange(0, 16 * len(told) + 1, 16, dtype=np.int32))
                digests = pa.Array.from_buffers(pa.binary(), len(told), [None, ends, pa.py_buffer(digests.tobytes())])
                yield pa.RecordBatch.from_arrays([digests, batch.column(0).take(at), batch.column(1).take(at), pa.array(told, pa.binary())],
                                                 names=schema.names)

    order = [F.col("digest"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranged = map_batches(docs, schema, list_parts).repartitionByRange(*order).sortWithinPartitions(*order)
    out = T.StructType([T.StructField("state", T.StringType()), *schema.fields, T.StructField("places", T.BinaryType()),
                        T.StructField("keeper", docs.schema["doc_id"].dataType), T.StructField("spare_first", T.BooleanType()),
                        T.StructField("short", T.BooleanType()), T.StructField("n", T.LongType())])
    seen = staged(map_batches(ranged, out, _stream(out.names)), "units-seen")
    # at most two rows a range
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "told")
    heads = seen.where("state = 'sum'").groupBy("digest").agg(F.sum("n").alias("everywhere"), F.min(rank).alias("head"))
    late = (seen.where("state = 'waits'").select("digest", "doc_id", "row", "places", "short").join(staged(heads, "units-heads"), "digest")
            .where(~F.col("short") | (F.col("everywhere") >= LEAST_DOCS)))
    first = (F.col("row") == F.col("head.row")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id"))
    late = late.select("doc_id", "row", "places", F.col("head.doc_id").alias("keeper"), F.col("head.told").alias("kept"), first.alias("spare_first"))
    told = seen.where("state = 'gone'").select("doc_id", "row", "places", "keeper", F.col("told").alias("kept"), "spare_first")
    return told.union(late).where(~F.col("spare_first") | (F.octet_length("places") > 4))


# ---------------------------------------------------------------------------------------------
# cutting


class _Cut(NamedTuple):
    start: int
    end: int
    keeper: object


def _matching(words: bytes, others: bytes) -> int:
    """How many words in a row are the same, by their chains."""
    n = min(len(words), len(others))
    for k in range(0, n, _TELLING):
        if words[k : k + _TELLING] != others[k : k + _TELLING]:
            return k // _TELLING * TOGETHER
    return n // _TELLING * TOGETHER


def cuts(found: Parts, k: int, gone: list[dict], chains: tuple[_Chain, _Chain]) -> tuple[list[_Cut], set[int], int]:
    """What goes from the ``k``-th text: pieces of it in order, the lines that go whole, the number of whole parts.

    ``chains`` are those of all parts, both ways.
    """
    lo, hi = (int(x) for x in np.searchsorted(found.text, [k, k + 1]))
    keeper, beside = {}, {}
    for row in gone:
        places = np.frombuffer(row["places"], "<u4")
        _, _, before, after = _unpack(row["kept"])
        for place in places[1 if row["spare_first"] else 0 :].tolist():
            keeper[place], beside[place] = row["keeper"], (before, after)
    starts, ends, lines = (x[lo:hi].tolist() for x in (found.start, found.end, found.line))
    short = (found.size[lo:hi] < LEAST_WORDS).tolist()
    out = {p: [_Cut(starts[p], ends[p], keeper[p])] for p in keeper}
    for p in keeper:
        for q, ahead in ((p - 1, False), (p + 1, True)):
            if not 0 <= q < hi - lo or q in keeper or short[p] or short[q]:
                continue  # short lines are told by their number alone
            a, b = int(found.first[lo + q]), int(found.first[lo + q + 1])
            n = _matching(chains[not ahead].of(lo + q), beside[p][ahead])
            start, end = starts[q], ends[q]
            if n < b - a:
                start, end = (start, int(found.word_start[a + n])) if ahead else (int(found.word_start[b - n]), end)
            if n:
                out.setdefault(q, []).append(_Cut(start, end, keeper[p]))
    pieces, whole, left = [], 0, set()
    for q in range(hi - lo):
        if q not in out:
            left.add(lines[q])
            continue
        start = reached = starts[q]
        end = ends[q]
        for piece in sorted(out[q], key=lambda c: (c.start, -c.end)):
            if piece.end > reached:
                pieces.append(piece._replace(start=max(piece.start, reached)))
                start, reached = start + piece.end - pieces[-1].start, piece.end
        # what is left of the part is as long as it has not been moved to its end
        whole += start == end
        if start < end:
            left.add(lines[q])
    return pieces, set(lines) - left, whole


def cut(text: str, places: list[tuple[int, int]], gone: set[int], pieces: list[tuple] = ()) -> str:
    """The text without the lines of these numbers, each with the break after it (the last: before),
    and without the pieces of other lines."""
    if not gone and not pieces:
        return text
    out, shown, at = [], False, 0
    for k, (a, b) in enumerate(places):
        while at < len(pieces) and pieces[at][1] <= a:
            at += 1
        if k in gone:
            continue
        if shown:
            out.append(text[places[k - 1][1] : a])  # the break before this line, as it stood there
        shown = True
        while at < len(pieces) and pieces[at][0] < b:
            out.append(text[a : pieces[at][0]])
            a = pieces[at][1]
            at += 1
        out.append(text[a:b])
    return "".join(out)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "line") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with repeated parts cut from the text, and the names of the columns added.

    Added are ``n_units`` (parts), ``n_removed`` (of them, whole), ``removed`` (start and end in code
    points of the original text, and the id of the document that keeps the words) and
    ``original_words`` (whether the original text had any word). Names that ``docs`` has already get
    a ``_``. Ids rank in their order, null last; texts of one id by a hash. Rows that repeat both id
    and text are one document and are treated alike. Null text stays null, empty text empty; lines
    of which nothing is left go with their break. All other columns stay.
    """
    wanted = ("n_units", "n_removed", "removed", "original_words")
    names = dict(zip(wanted, fresh(docs.columns, *wanted), strict=True))
    id_type = docs.schema[doc_id].dataType
    row = F.xxhash64(col(text))
    light = docs.where(col(text).isNotNull()).select(col(doc_id).alias("doc_id"), row.alias("row"), col(text).alias("text"))
    gone = repeats(light, unit).groupBy("doc_id", "row").agg(F.collect_list(F.struct("places", "keeper", "kept", "spare_first")).alias("gone"))
    key, gone_id, found_gone = fresh([*docs.columns, *names.values()], "row_key", "gone_id", "gone")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("row").alias(key), F.col("gone").alias(found_gone))
    joined = docs.join(gone, col(doc_id).eqNullSafe(col(gone_id)) & (row == col(key)), "left").select(*map(col, docs.columns), col(found_gone))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("keeper", id_type)])
    types = (T.LongType(), T.LongType(), T.ArrayType(span), T.BooleanType())
    word = re.compile(WORD_PATTERN)
    at, at_id, width = docs.columns.index(text), docs.columns.index(doc_id), len(docs.columns)

    def remove(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        texts = batch.column(at).to_pylist()
        counts, gone_counts, removed = [0] * n, [0] * n, [[]] * n
        worded = [bool(t) and word.search(t) is not None for t in texts]
        for rows, held in _pieces((k, t) for k, t in enumerate(texts) if t):
            found = parts(held, unit)
            chains = None
            for k, row in enumerate(rows):
                counts[row] = int(np.subtract(*np.searchsorted(found.text, [k + 1, k])))
                lost = batch.column(width)[row].as_py()
                if not lost:
                    continue
                chains = chains or _both_ways(found)
                pieces, lines, gone_counts[row] = cuts(found, k, lost, chains)
                texts[row] = cut(held[k], split(held[k], unit), lines, pieces)
                removed[row] = [{"start": p.start, "end": p.end, "keeper": p.keeper} for p in pieces]
        columns = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(width)]
        kept = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width])
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("keeper", batch.schema.field(at_id).type)]))
        return appended(kept, (names["n_units"], pa.array(counts, pa.int64())), (names["n_removed"], pa.array(gone_counts, pa.int64())),
                        (names["removed"], pa.array(removed, spans)), (names["original_words"], pa.array(worded)))

    return map_rows(joined, add_fields(docs.schema, *((names[w], t) for w, t in zip(wanted, types, strict=True))), remove), names
