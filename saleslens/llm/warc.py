"""Deterministic sharded WARC archives: write, commit, read.

Records are put in one total order (id, url, payload digest) by a range sort of their light parts.
From the compressed size of every record the running total gives the file each record belongs to, so
the files hold the same bytes however the work was dealt. The payloads then move once, compressed,
straight to their file: the first key of each file tells where. Of equal payloads of at least
``REVISIT_BYTES`` the first in order is a response, the others are revisits without payload.

A task writes a file under a temporary name and returns a manifest row. The manifest is a written
table, so it lists one finished attempt of each task whatever was lost or run twice; a second job
moves the listed files to their names, and a marker commits the archive. Readers take the files
that the manifest of a committed archive lists.

The folder is any URI that Arrow's file systems and Spark both reach.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from saleslens.llm.common import col, map_batches, staged

REVISIT_BYTES = 100
ROLL_BYTES = 32 << 20
MAX_FILES = 1 << 20
LEVEL = 4
DATE = "2000-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:saleslens:warc")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------------------------------------
# records


def _clean(value: str) -> str:
    """A header value without characters that would end it, which come percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def _name(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps(parts))}>"


def _member(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
                                      ("Content-Length", str(len(block)))] if v is not None]
    record = ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def response(page: str | None, url: str | None, digest: str, payload: bytes, copy: int = 0) -> bytes:
    """A response record as a gzip member. A null id or url has no header."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    return _member([
        ("WARC-Type", "response"), ("WARC-Record-ID", _name("response", page, url, digest, copy)), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else _clean(url)), ("WARC-Page-ID", page),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ], block)


def revisit(page: str | None, url: str | None, digest: str, size: int, copy: int, first: str | None, first_url: str | None) -> bytes:
    """A revisit record as a gzip member, which refers to the response of the same payload."""
    return _member([
        ("WARC-Type", "revisit"), ("WARC-Record-ID", _name("revisit", page, url, digest, copy)), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else _clean(url)), ("WARC-Page-ID", page), ("WARC-Profile", _PROFILE),
        ("WARC-Refers-To", _name("response", first, first_url, digest, 0)),
        ("WARC-Refers-To-Target-URI", None if first_url is None else _clean(first_url)), ("WARC-Refers-To-Page-ID", first),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(size)),
        ("Content-Type", "application/http; msgtype=response"),
    ], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")


def info(number: int) -> bytes:
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _name("warcinfo", number)), ("WARC-Date", DATE),
                    ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


# ---------------------------------------------------------------------------------------------
# writing


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(("s3://" + root.split("://", 1)[1]) if root.startswith(("s3a://", "s3n://")) else root)


def _light(pages: DataFrame, page_type: T.DataType) -> DataFrame:
    """What order, kind and file follow from; payloads under the revisit bound come along."""
    rows = pages.select("id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    schema = T.StructType([T.StructField("id", page_type), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()),
                           T.StructField("size", T.LongType()), T.StructField("small", T.BinaryType()), T.StructField("packed", T.LongType())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            out = []
            for page, url, payload, digest in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                body, page = payload.as_py(), page.as_py()
                big = len(body) >= REVISIT_BYTES
                packed = len(response(None if page is None else str(page), url.as_py(), digest.as_py(), body)) if big else 0
                out.append((len(body), None if big else body, packed))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *(
                pa.array(list(v), k) for v, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True))],
                names=schema.names)

    return map_batches(rows, schema, fn)


def _ordered(light: DataFrame) -> DataFrame:
    """Numbers ``seq`` in the total order, the id's range partition and the place in it, and ``tie``, the
    number of equal rows before. Equal rows are in one range; ``tie`` depends on nothing else."""
    keys = [F.col("id").asc_nulls_last(), F.col("url").asc_nulls_last(), F.col("digest")]
    ranged = light.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("seq", F.monotonically_increasing_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("tie", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tie = None, 0
        for b in batches:
            ties = []
            for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                last, tie = row, tie + 1 if row == last else 0
                ties.append(tie)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ties, pa.int64())], names=schema.names)

    return staged(map_batches(ranged, schema, number), "warc-ordered")


def _judged(ordered: DataFrame) -> DataFrame:
    """Kind of each record; the gzip members of revisits and small responses; every packed size."""
    first = ordered.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "id", "url")).alias("first")).where("n > 1")
    # written, so that the join has shuffles of its own, in which a common payload is split
    rows = ordered.join(staged(first.select("digest", "first"), "warc-first"), "digest", "left")
    rows = rows.withColumn("kind", F.when(F.col("first").isNotNull() & (F.col("first.seq") != F.col("seq")), F.lit("revisit")).otherwise("response"))
    rows = rows.select("seq", "tie", "id", "url", "digest", "size", "small", "packed", "kind", F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url"))
    schema = T.StructType([*(rows.schema[c] for c in ("seq", "id", "url", "digest", "size", "kind")),
                           T.StructField("member", T.BinaryType()), T.StructField("packed", T.LongType())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda v: None if v is None else str(v)
        for b in batches:
            members, packed = [], []
            for r in b.to_pylist():
                if r["kind"] == "revisit":
                    made = revisit(text(r["id"]), r["url"], r["digest"], r["size"], r["tie"], text(r["first_id"]), r["first_url"])
                elif r["small"] is not None:
                    made = response(text(r["id"]), r["url"], r["digest"], r["small"], r["tie"])
                else:
                    made = None
                members.append(made)
                packed.append(r["packed"] if made is None else len(made))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("seq", "id", "url", "digest", "size", "kind")),
                                              pa.array(members, pa.binary()), pa.array(packed, pa.int64())], names=schema.names)

    return staged(map_batches(rows, schema, fn), "warc-judged")


def _filed(judged: DataFrame, roll: int) -> DataFrame:
    """``judged`` with its ``file``: the running total of packed sizes, in steps of ``roll``."""
    part = F.shiftright("seq", 33)  # the range partition
    sums = judged.groupBy(part.alias("part")).agg(F.sum("packed").alias("total"))
    before = sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    own = F.sum("packed").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = judged.withColumn("part", part).withColumn("own", F.coalesce(own, F.lit(0))).join(before, "part")
    return staged(rows.withColumn("file", F.floor((F.col("before") + F.col("own")) / F.lit(roll)).cast("long")).drop("part", "own", "before"), "warc-filed")


def write(pages: DataFrame, root: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
          roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` as WARC files below ``root`` and return the manifest.

    A null payload is empty. Null ids and urls sort last and leave out their header. Repeated rows
    each get a record. An empty table gives an archive without files. Other columns are not written.
    A file is closed once it holds ``roll_bytes`` compressed; a larger record has a file to itself.
    """
    spark = pages.sparkSession
    page_type = pages.schema[page_id].dataType
    rows = pages.select(col(page_id).alias("id"), col(url).cast("string").alias("url"),
                        F.coalesce(col(payload).cast("binary"), F.lit(b"").cast("binary")).alias("payload"))
    filed = _filed(_judged(_ordered(_light(rows, page_type))), roll_bytes)
    big = (F.col("kind") == "response") & F.col("member").isNull()
    firsts = filed.where(big).groupBy("file").agg(F.min(F.struct("seq", "id", "url", "digest")).alias("k"))
    n_files = firsts.count()
    if n_files > MAX_FILES:
        raise ValueError(f"{n_files} files: use a larger roll_bytes")
    # a key for each file, at most MAX_FILES of them
    bounds = sorted((r.file, _rank(r.k.id, r.k.url, r.k.digest)) for r in firsts.collect())
    shared = spark.sparkContext.broadcast(([f for f, _ in bounds], [k for _, k in bounds]))
    schema = T.StructType([T.StructField("file", T.LongType()), T.StructField("id", page_type), T.StructField("url", T.StringType()),
                           T.StructField("digest", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("member", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, keys = shared.value
        for b in batches:
            place, members = [], []
            for page, link, body, digest in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                page, link, digest = page.as_py(), link.as_py(), digest.as_py()
                place.append(files[max(0, bisect_right(keys, _rank(page, link, digest)) - 1)])
                members.append(response(None if page is None else str(page), link, digest, body.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), b.column(0), b.column(1), b.column(3),
                                              pa.nulls(b.num_rows, pa.int64()), pa.array(members, pa.binary())], names=schema.names)

    carried = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("id", "url", "payload", F.sha2("payload", 256).alias("digest"))
    packed = map_batches(carried, schema, pack)
    wanted = filed.select("file", "id", "url", "digest", "seq", "member")
    order = ["file", F.col("id").asc_nulls_last(), F.col("url").asc_nulls_last(), "digest", F.col("seq").asc_nulls_first()]
    records = packed.unionByName(wanted).repartition(max(1, n_files), "file").sortWithinPartitions(*order)
    temporary = f"{root.rstrip('/')}/_temporary-{uuid.uuid4().hex}"
    home, folder = _file_system(temporary)
    home.create_dir(folder, recursive=True)
    manifest = staged(map_batches(records, _MANIFEST, _writer(temporary)), "warc-manifest")
    moved = map_batches(manifest, _MANIFEST, _mover(temporary, root))
    listed = f"{root.rstrip('/')}/_manifest"
    moved.write.parquet(listed)
    home.delete_dir(folder)
    with home.open_output_stream(f"{_file_system(root)[1]}/_COMMITTED") as marker:
        marker.write(b"")
    return spark.read.schema(_MANIFEST).parquet(listed)


def _rank(page, url, digest) -> tuple:
    return page is None, page or 0, url is None, url or "", digest


_MANIFEST = T.StructType([T.StructField("name", T.StringType()), T.StructField("temporary", T.StringType()), T.StructField("records", T.LongType()),
                          T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType())])


def _writer(temporary: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, folder = _file_system(temporary)
        now, out, done = None, None, []
        key, held = None, None

        def close():
            if out is not None:
                out["stream"].close()
                done.append((f"part-{now:08d}.warc.gz", out["name"], out["records"], out["bytes"], out["hash"].hexdigest()))

        def put(member: bytes, count: int = 1):
            out["stream"].write(member)
            out["hash"].update(member)
            out["bytes"] += len(member)
            out["records"] += count

        for b in batches:
            for file, page, url, digest, seq, member in zip(*b.columns, strict=True):
                file, seq = file.as_py(), seq.as_py()
                this = (file, page.as_py(), url.as_py(), digest.as_py())
                if seq is None:  # a payload ahead of the record that may want it
                    key, held = this, member
                    continue
                if file != now:
                    close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    now, out = file, {"name": name, "stream": home.open_output_stream(f"{folder}/{name}", compression=None), "records": 0, "bytes": 0, "hash": hashlib.sha256()}
                    put(info(file), 0)
                if member.is_valid:
                    put(member.as_py())
                elif key == this:
                    put(held.as_py())
                else:
                    raise RuntimeError(f"no payload for {this}")
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(v)) for v in zip(*done, strict=True)], names=_MANIFEST.names)

    return fn


def _mover(temporary: str, root: str):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, folder = _file_system(temporary)
        _, final = _file_system(root)
        for b in batches:
            for row in b.to_pylist():
                source, target = f"{folder}/{row['temporary']}", f"{final}/{row['name']}"
                if home.get_file_info(source).type != fs.FileType.NotFound:
                    home.move(source, target)
                elif home.get_file_info(target).size != row["bytes"]:  # moved by an attempt before
                    raise RuntimeError(f"{target} is not the file of the manifest")
            yield b

    return fn


# ---------------------------------------------------------------------------------------------
# reading


def members(content: memoryview) -> Iterator[bytes]:
    """The records of a file of gzip members."""
    at, size = 0, len(content)
    while at < size:
        opener, out = zlib.decompressobj(31), []
        while not opener.eof:
            if at >= size:
                raise EOFError("the last record is cut off")
            piece = content[at : at + 65536]
            out.append(opener.decompress(piece))
            at += len(piece) - len(opener.unused_data)
        yield b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


RECORDS = T.StructType([T.StructField(n, t) for n, t in (
    ("file", T.StringType()), ("record_id", T.StringType()), ("record_type", T.StringType()), ("page_id", T.StringType()), ("url", T.StringType()),
    ("payload", T.BinaryType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.StringType()))])


def read(spark: SparkSession, root: str) -> DataFrame:
    """The response and revisit records of a committed archive; ids come as text.

    A response's size and digest are those of the payload as read, and must be the ones in its
    headers; a revisit's are its headers'. Its payload is null.
    """
    home, folder = _file_system(root)
    if home.get_file_info(f"{folder}/_COMMITTED").type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{root} is not a committed archive")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{root.rstrip('/')}/_manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*.warc.gz")
    found = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(manifest.select("name"), "name", "left_semi")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                out, held = [], 0
                for record in members(memoryview(content.as_buffer())):
                    headers, block = parse(record)
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    digest, size, payload = headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["warc-payload-length"]), None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{headers['warc-record-id']}: payload and headers differ")
                        held += size
                    out.append((name.as_py(), headers["warc-record-id"], kind, headers.get("warc-page-id"), headers.get("warc-target-uri"),
                                payload, size, digest, headers.get("warc-refers-to-page-id")))
                    if held > 8 << 20 or len(out) >= 4096:
                        yield _batch(out)
                        out, held = [], 0
                if out:
                    yield _batch(out)

    return map_batches(found.select("name", "content"), RECORDS, fn)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORDS.names)
