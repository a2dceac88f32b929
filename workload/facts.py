"""The given tables read as the sales model.

``lineitem`` joined with ``part`` becomes the fact table, its wide form becomes sheets, and
every row of ``part`` asks a question. All of it is derived lazily, so a query on top of it
grows with the tables.
"""

from __future__ import annotations

import csv
import functools
import io
import itertools
import operator
import struct
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saleslens.constants import MONTHS, SALES_BLOCKS, SHEET_POSITIONS, SHEET_WIDTH
from saleslens.functions.scalars import month_name
from saleslens.operators.quality import CHECK, answer_checks, assess, intent_check
from saleslens.operators.totals import with_totals
from saleslens.plans.run import run
from saleslens.plans.tables import SalesTables
from saleslens.schema import FACT
from saleslens.session import file_length, ship


# Lines, as bytes of their file, whose units one task joins with ``part``.
BYTES_OF_LINES = 4 << 20
# Lines, as bytes of their file, whose sheet rows come in one file of each half of a delivery.
BYTES_OF_DELIVERY = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text(column: Column) -> Column:
    return column.cast("string")


def _pick(column: Column, cases: dict[int, str], default: str) -> Column:
    out = None
    for value, label in cases.items():
        out = (F.when if out is None else out.when)(column == value, F.lit(label))
    return out.otherwise(F.lit(default))


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: its key, labels and specifications."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return read(spark, sf_dir, "part").select(
        key,
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("segment"),
        F.col("p_name").alias("model"),
        F.concat(F.lit("VR"), F.lpad(_text(key), 8, "0")).alias("vr_id"),
        _text(1000 + size * 100).alias("cc"),
        _pick(key % 3, {0: "Manual", 1: "Automatic"}, "AMT").alias("transmission"),
        _pick(key % 4, {0: "Diesel", 1: "Petrol", 2: "Hybrid"}, "Electric").alias("fuel"),
        F.concat(_text(size), F.lit("T")).alias("gvw"),
        F.concat(_text(60 + size * 5), F.lit("HP")).alias("ps_hp"),
        F.concat_ws("x", _text(3000 + size * 50), _text(1500 + size * 10),
                    _text(1400 + size * 20)).alias("dimension"),
        _pick(key % 6, {0: "2 Seater", 1: "7 Seater", 2: "20+ Seater"}, "5 Seater").alias("seater"),
        _pick(key % 5, {0: "4x4", 1: "6x4"}, "4x2").alias("wheel"),
        F.when(key % 7 == 0, "").otherwise(_text(20 + size)).alias("tank"),
        F.when(key % 11 == 0, "").otherwise(
            F.concat(_text(4 + key % 5), F.lit("-speed"))).alias("gear"),
        _pick(key % 2, {0: "FF"}, "FR").alias("system"),
        _text(90 + size).alias("speed"),
        _pick(key % 4, {0: "2", 1: "3"}, "5").alias("door"),
    )


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per part, year, month and sales type.

    The sum comes before the join with ``part``: a part that holds a third of all lines is
    folded on the map side and reaches the join as at most 48 rows a year.
    """
    flag = F.col("l_returnflag")
    sales_type = (
        F.when(flag == "A", "wholesales").when(flag == "N", "retail_sales")
        .when(F.col("l_linestatus") == "F", "production_ckd").otherwise("import_cbu")
    )
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(
            "l_partkey",
            F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month_no"),
            sales_type.alias("sales_type"),
        )
        .agg(F.sum("l_quantity").cast("bigint").alias("sales"))
    )


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    """In how many tasks units meet their vehicles: in proportion to the lines, at least as many as a shuffle has."""
    length = file_length(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-length // BYTES_OF_LINES))


def files_of_delivery(spark: SparkSession, sf_dir: str) -> int:
    """In how many files half a delivery of all sheets comes: in proportion to the lines, as a file is
    written by one task."""
    return max(1, -(-file_length(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet") // BYTES_OF_DELIVERY))


def detail(spark: SparkSession, sf_dir: str, units: DataFrame | None = None) -> DataFrame:
    """The fact table without TOTAL rows, from the lines or from units that are written already.

    Units are dealt by number: a shuffle left to AQE is coalesced by its narrow rows to as few tasks as
    there are cores, and the wide rows that the join makes of them have to fit a task's memory.
    """
    units = shipped(spark, sf_dir) if units is None else units
    units = units.repartition(_tasks(spark, sf_dir), "l_partkey")
    parts = vehicles(spark, sf_dir)
    return (
        units.join(parts, units.l_partkey == parts.p_partkey)
        .withColumn("month", month_name(F.col("month_no")))
        .withColumn("is_summary", F.lit(False))
        .withColumn("row_index", F.lit(-1).cast("bigint"))
        .select(*FACT.fieldNames())
    )


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_totals(detail(spark, sf_dir))


def tables(spark: SparkSession, sf_dir: str) -> SalesTables:
    return SalesTables(detail(spark, sf_dir))


def _padded(text: Column) -> Column:
    """Text between white space that sheets hold in practice: tabs, line breaks, no-break spaces."""
    return F.concat(F.lit("\t\u00a0"), text, F.lit(" \r\n"))


def month_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vehicle and year the 48 month cells as text, in the order of the sales blocks.

    Every 9th part never sells, and some cells hold what sheets hold in practice: words, grouped
    digits, halves, negatives. Units are gathered before the join, as in ``detail``.
    """
    types = F.array(*[F.lit(t) for t in SALES_BLOCKS])
    at = (F.array_position(types, F.col("sales_type")) - 1) * len(MONTHS) + F.col("month_no") - 1
    units = F.when(at.isNotNull(), F.struct(at.cast("int").alias("at"), "sales"))
    # rows of one cell each meet by vehicle, where the join with ``part`` wants them too: no wide row is
    # shuffled, sorted or held by an aggregate
    gathered = (
        shipped(spark, sf_dir).select("l_partkey", "year", units.alias("units")).repartition("l_partkey")
        .groupBy("l_partkey", "year").agg(F.map_from_entries(F.collect_list("units")).alias("units"))
    )
    key = F.col("l_partkey")
    wholesale_jan, retail_feb = 0, 13

    def as_cell(units: Column, at: Column) -> Column:
        return (
            F.when(key % 9 == 0, F.when(units > 25, "-").when(units > 0, "0"))
            .when((at == wholesale_jan) & (key % 13 == 1), "n/a")
            .when((at == wholesale_jan) & (key % 13 == 2), F.concat(_text(units), F.lit(".5")))
            .when((at == retail_feb) & (key % 13 == 3), "1,000")
            .when((at == retail_feb) & (key % 13 == 4), "0.5")
            .when((at == retail_feb) & (key % 13 == 5), "-3")
            .when((at == wholesale_jan) & (key % 13 == 6), _padded(_text(units)))
            .otherwise(_text(units))
        )

    slots = F.array(*[F.lit(i) for i in range(len(SALES_BLOCKS) * len(MONTHS))])
    cells = gathered.select("l_partkey", "year", F.transform(
        slots, lambda at: as_cell(F.try_element_at("units", at), at)).alias("months"))
    parts = vehicles(spark, sf_dir).hint("shuffle_hash")
    return cells.join(parts, cells.l_partkey == parts.p_partkey)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vehicle and year, the 48 month cells as columns ``wholesale_jan`` ..."""
    names = [f"{prefix}_{m}" for prefix, _, _ in SALES_BLOCKS.values() for m in MONTHS]
    table = month_cells(spark, sf_dir)
    others = [c for c in table.columns if c != "months"]
    return table.select(*others, *[F.col("months")[i].alias(n) for i, n in enumerate(names)])


def file_brand(brand: Column) -> Column:
    """``Brand#11`` as it would name a workbook: ``BRAND_11``."""
    return F.upper(F.replace(brand, F.lit("#"), F.lit("_")))


def file_path(year: Column, brand: Column) -> Column:
    return F.concat(_text(year), F.lit("/"), file_brand(brand), F.lit(".xlsx"))


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every (year, brand) sheet: ``path, row_idx, cells``.

    A head of company lines, block titles and month names stands above the vehicles; it starts
    at a row that differs by year. Vehicle rows keep gaps between row numbers, as sheets do.
    """
    return _vehicle_lines(spark, sf_dir).unionByName(_head_lines(spark, sf_dir))


def _vehicle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of sheets below their heads, from row 20 on for keys from 0 on."""
    table = month_cells(spark, sf_dir)
    by_position = {pos: name for name, pos in SHEET_POSITIONS.items()}
    key = F.col("p_partkey")
    # the four columns of a sheet that the fact table does not have, and padded labels
    table = table.withColumns({
        "no": _text(key % 97), "fc_kml": F.concat(_text(key % 20), F.lit(".5")),
        "co2": F.when(key % 8 > 0, _text(100 + key % 8)), "tyre_size": _text(13 + key % 6),
        "vr_id": F.when(key % 17 == 0, _padded(F.col("vr_id"))).otherwise(F.col("vr_id")),
        "segment": F.when(key % 19 == 0, _padded(F.col("segment"))).otherwise(F.col("segment")),
        "model": F.when(key % 23 == 0, _padded(F.col("model"))).otherwise(F.col("model")),
        "tank": F.when(key % 29 == 0, _padded(F.col("tank"))).otherwise(F.col("tank")),
    })
    given = set(table.columns)
    first_month = min(start for _, _, start in SALES_BLOCKS.values())
    gap = F.array(F.lit(None).cast("string"))

    def cell(position: int) -> Column:
        name = "vr_id" if position == 0 else by_position.get(position)
        return F.col(name) if name in given else F.lit(None).cast("string")

    blocks = [F.slice("months", 1 + 12 * i, 12) for i in range(len(SALES_BLOCKS))]
    return table.select(
        file_path(F.col("year"), F.col("brand")).alias("path"),
        (20 + F.col("p_partkey")).alias("row_idx"),
        F.concat(
            F.array(*[cell(i) for i in range(first_month)]),
            blocks[0], gap, blocks[1], gap, blocks[2], gap, blocks[3],
        ).alias("cells"),
    )


def _head_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of the sheets, which stand above row 20."""
    def line(at: dict[int, str]) -> Column:
        return F.array(*[F.lit(at.get(i)).cast("string") for i in range(SHEET_WIDTH)])

    titles = {start: title for _, title, start in SALES_BLOCKS.values()}
    names = {0: "VR-ID", 1: "NO.", 2: "SEGMENT", 3: "MODEL"}
    for _, _, start in SALES_BLOCKS.values():
        names.update({start + i: m.upper() for i, m in enumerate(MONTHS)})
    # 4 + year % 5 moves the head by year, so header rows differ between files
    first = (4 + F.col("year") % 5).cast("bigint")
    head_lines = F.array(
        F.struct(F.lit(0).cast("bigint").alias("at"), line({0: "COMPANY"}).alias("cells")),
        F.struct(F.lit(1).cast("bigint").alias("at"), line({0: "BRAND"}).alias("cells")),
        F.struct((first - 1).alias("at"), line(titles).alias("cells")),
        F.struct(first.alias("at"), line(names).alias("cells")),
    )
    return (
        read(spark, sf_dir, "lineitem").select("l_partkey", F.year("l_shipdate").alias("year")).distinct()
        .join(vehicles(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"))
        .select("year", "brand").distinct()
        .select(file_path(F.col("year"), F.col("brand")).alias("path"),
                F.explode(head_lines).alias("h"))
        .select("path", F.col("h.at").alias("row_idx"), F.col("h.cells").alias("cells"))
    )


# What the rows of ``part`` ask, by p_partkey modulo the number of openings. Together they reach
# every language and intent, ties, and keywords inside other words.
OPENINGS = [
    "Berapa total penjualan",
    "Bandingkan penjualan retail",
    "Tampilkan spesifikasi model",
    "Compare wholesale sales of",
    "What is the fuel and transmission of",
    "Which model is the best selling of",
    "Show the forecast for",
    "Where does this come from:",
    "Model forecast sales of",
    "いくつ売れた",
    "販売の分析",
    "Wie viele wurden verkauft von",
    "Diagramm der Modelle von",
    "¿Cuántos vende",
    "Gráfico de",
    "Will national demand grow for",
    "HOW MANY seater and wheel options has",
    "Market share trend of",
    "Maps and photos of",
    "Tell me about",
]
SUBMITTED = ["specification", "sales", "general", "prediction", "sales"]
PICKED = ["en", "id", "en"]
ISSUES = [
    "No fuel data found for", "Unusually high sales of", "Negative sales of",
    "missing specs of", "Empty model names of", "Separate data files not found for",
    "Odd spelling of",
]


def _nth(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per part, with the intent it was submitted under and a picked language."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("query_id"),
        F.concat_ws(" ", _nth(OPENINGS, key % len(OPENINGS)), "p_brand", "p_type").alias("text"),
        _nth(SUBMITTED, key % len(SUBMITTED)).alias("submitted_intent"),
        _nth(PICKED, key % len(PICKED)).alias("picked"),
        F.array(
            F.concat_ws(" ", _nth(ISSUES, key % 7), "p_brand"),
            F.concat_ws(" ", _nth(ISSUES, F.col("p_size") % 7), "p_type"),
        ).alias("issues"),
        F.concat_ws("-", F.lit("2025"), F.lpad(_text(1 + key % 12), 2, "0"),
                    F.lpad(_text(1 + F.col("p_size") % 28), 2, "0")).alias("timestamp"),
        "p_size",
    )


# What is asked of the tables, by the question's number modulo the number of specs. The empty trend
# and the result that is not a table's reach every outcome of the checks.
ASKED = {
    "ranking": {"operation": "model_specs", "intent": "specification"},
    "comparison": {"operation": "comparison", "intent": "sales"},
    "empty": {"analysis_type": "trend", "intent": "sales", "brands": ["Brand#0"]},
    "foreign": {"operation": "comparison", "intent": "general"},
}


def asked(spark: SparkSession, sf_dir: str) -> dict:
    """Spec and result of each kind of question."""
    own = tables(spark, sf_dir)
    results = {name: run(spec, own) for name, spec in ASKED.items()}
    # brands and sales of the part list, which the tables do not know under these names
    results["foreign"] = read(spark, sf_dir, "part").select(
        F.concat(F.col("p_brand"), F.lit("X")).alias("brand"), F.col("p_retailprice").alias("price"))
    return {name: (ASKED[name], results[name]) for name in ASKED}


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier build recorded: the rows it was made from."""
    return read(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("sales_records"))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four computed checks per question: its intent, and those of the answer it got."""
    questioned = intent_check(questions(spark, sf_dir)).withColumn(
        "answer", _nth(list(ASKED), F.col("query_id") % len(ASKED)))
    keys = ["query_id", F.col("submitted_intent").alias("intent"), "timestamp", "issues"]
    found = answer_checks(asked(spark, sf_dir), tables(spark, sf_dir), recorded(spark, sf_dir))
    # three checks for each kind of question
    return (
        questioned.select(*keys, *CHECK)
        .unionByName(questioned.select(*keys, "answer").join(found, "answer").drop("answer"))
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assessed answers, one per question."""
    return assess(checks(spark, sf_dir), ["query_id", "intent", "timestamp", "issues"])


# --- files --------------------------------------------------------------------------------

FILES_PER_BATCH = 1_000
# In how many tasks workbooks are written at least.
LANDING_TASKS = 32


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per vehicle and year: its path, the vehicle's cells and the rows left blank."""
    rows = _vehicle_lines(spark, sf_dir).filter("row_idx >= 20")
    key = F.col("row_idx") - 20
    return rows.select(
        F.concat_ws("/", "path", _text(key)).alias("path"), "cells",
        key.alias("p_partkey"), (key % 7).cast("int").alias("blank"))


@functools.cache
def _letters(index: int) -> str:
    out, index = "", index + 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def _row(number: int, values: list) -> str:
    """A row of a sheet, its number from 1."""
    parts = []
    for at, value in enumerate(values):
        if value is None:
            continue
        ref = f"{_letters(at)}{number}"
        if value.isascii() and value.isdigit() and value[0] != "0":
            parts.append(f'<c r="{ref}"><v>{value}</v></c>')
        else:
            body = escape(value, {"\r": "&#13;"})
            parts.append(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{body}</t></is></c>')
    return f'<row r="{number}">{"".join(parts)}</row>'


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_SHEET = "xl/worksheets/sheet2.xml"
_OPENING, _CLOSING = f'<worksheet xmlns="{_MAIN}"><sheetData>', "</sheetData></worksheet>"
# The parts of a workbook beside its first sheet, which is the second file.
_PARTS = {
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="r"><sheets><sheet name="b" r:id="i2"/><sheet name="a" r:id="i1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="i1" Target="worksheets/sheet1.xml"/>'
                                  '<Relationship Id="i2" Target="worksheets/sheet2.xml"/></Relationships>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData/></worksheet>',
}


@functools.cache
def _without_sheet() -> bytes:
    """A workbook that lacks its first sheet."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in _PARTS.items():
            book.writestr(name, text)
    return out.getvalue()


@functools.cache
def _laid_out() -> tuple[bytes, bytes]:
    """A workbook's bytes before its first sheet, and the entries of its directory so far."""
    book = _without_sheet()
    size, start = struct.unpack("<II", book[-10:-2])
    return book[:start], book[start : start + size]


def _book(rows: str) -> bytes:
    """A workbook of the given rows: its sheet is put behind the other parts, which are the same in all."""
    sheet = f"{_OPENING}{rows}{_CLOSING}".encode()
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed, name = deflate.compress(sheet) + deflate.flush(), _SHEET.encode()
    before, entries = _laid_out()
    # version, flags, deflated, time, date, checksum, lengths
    told = struct.pack("<HHHHHIIIHH", 20, 0, 8, 0, 33, zlib.crc32(sheet), len(packed), len(sheet), len(name), 0)
    entry = b"PK\1\2" + struct.pack("<H", 20) + told + struct.pack("<HHHII", 0, 0, 0, 0, len(before)) + name
    start = len(before) + 30 + len(name) + len(packed)
    n = len(_PARTS) + 1
    end = b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, n, n, len(entries) + len(entry), start, 0)
    return b"".join((before, b"PK\3\4", told, name, packed, entries, entry, end))


@functools.cache
def _head() -> tuple[list, list]:
    """The block titles and the names below them."""
    titles, names = [None] * SHEET_WIDTH, [None] * SHEET_WIDTH
    names[0] = "VR-ID"
    for _, title, start in SALES_BLOCKS.values():
        titles[start] = title
        names[start : start + len(MONTHS)] = [m.upper() for m in MONTHS]
    return titles, names


@functools.cache
def _head_rows() -> str:
    titles, names = _head()
    return _row(1, ["COMPANY"]) + _row(2, titles) + _row(3, names)


def _lists(column: pa.ListArray) -> Iterator[list | None]:
    """The lists of texts in a column, as ``to_pylist`` gives them; its texts are made all at once."""
    at = column.offsets.to_numpy()
    texts = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).tolist()
    at = (at - at[0]).tolist()
    return (texts[a:b] if valid else None for a, b, valid in zip(at, at[1:], column.is_valid().to_pylist()))


def _workbook(cells: list, blank: int) -> bytes:
    """A workbook of three head lines, blank rows and one vehicle."""
    return _book(_head_rows() + _row(4 + blank, cells))


def _csv_file(cells: list, blank: int) -> bytes:
    """A CSV file: a record over two lines, blank lines, and a vehicle with two cells too many."""
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerows([["COMPANY", "of two\nlines"], *_head()])
    out.write("\r\n" * blank)
    writer.writerow([*(c or "" for c in cells), "more", "cells"])
    return out.getvalue().encode()


def files(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """``path`` and ``content`` of the files; every 97th vehicle's are cut off in the middle."""
    def contents(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, FILES_PER_BATCH):
                few = batch.slice(start, FILES_PER_BATCH)
                made = [make(c, b) for c, b in zip(_lists(few["cells"]), few["blank"].to_pylist())]
                yield pa.RecordBatch.from_arrays([few["path"], pa.array([
                    m[: len(m) // 2] if k % 97 == 0 else m
                    for m, k in zip(made, few["p_partkey"].to_pylist())], pa.binary())], names=["path", "content"])

    ship(spark)
    ship(spark, Path(__file__).parent)
    return file_rows(spark, sf_dir).mapInArrow(contents, "path string, content binary")


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, _workbook)


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, _csv_file)


def _sheets(batches) -> Iterator[tuple[str, Iterator[tuple[int, list]]]]:
    """Row numbers and cells of each sheet, as batches sorted by path and row number bring them."""
    rows = ((path, (number, cells)) for batch in batches for start in range(0, batch.num_rows, FILES_PER_BATCH)
            for few in [batch.slice(start, FILES_PER_BATCH)]
            for path, number, cells in zip(few["path"].to_pylist(), few["row_idx"].to_pylist(), _lists(few["cells"])))
    for path, group in itertools.groupby(rows, operator.itemgetter(0)):
        yield path, (row for _, row in group)


def _write_sheet(sheet, rows: Iterator[tuple[int, list]], remarks: bool) -> None:
    """Write the rows of a sheet as they come, and twenty rows of remarks for each of them."""
    sheet.write(_OPENING.encode())
    n = number = 0
    for number, cells in rows:
        n, number = n + 1, number + 1
        sheet.write(_row(number, cells).encode())
    last = 20 * n if remarks else 0
    for first in range(0, last, FILES_PER_BATCH):
        sheet.write("".join([
            f'<row r="{at}"><c r="B{at}" t="inlineStr"><is><t xml:space="preserve">remark {at - number - 1}</t></is></c></row>'
            for at in range(number + 1 + first, number + 1 + min(last, first + FILES_PER_BATCH))]).encode())
    sheet.write(_CLOSING.encode())


def land_workbooks(sheets: DataFrame, root: str) -> int:
    """Write one workbook below ``root`` for each sheet of ``path, row_idx, cells``; their number. Every
    second year's workbooks have twenty rows of remarks for each row, so that files differ much in
    length. A task writes its workbooks one after the other, row by row, and holds none of them."""
    home, folder = fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")

    def write(batches):
        n = 0
        for path, rows in _sheets(batches):
            home.create_dir(f"{folder}/{path.rsplit('/', 1)[0]}", recursive=True)
            with home.open_output_stream(f"{folder}/{path}") as stream:
                with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
                    for name, text in _PARTS.items():
                        book.writestr(name, text)
                    with book.open(_SHEET, "w", force_zip64=True) as file, io.BufferedWriter(file, 1 << 16) as sheet:
                        _write_sheet(sheet, rows, int(path.split("/")[0]) % 2 == 1)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ship(sheets.sparkSession)
    ship(sheets.sparkSession, Path(__file__).parent)
    # by number: left to AQE, a few hundred sheets meet in as few tasks as there are cores, unevenly
    tasks = max(LANDING_TASKS, int(sheets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = sheets.select("path", "row_idx", "cells").repartition(tasks, "path").sortWithinPartitions("path", "row_idx")
    return ordered.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def damaged_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path`` and ``content`` of workbooks cut off in the middle, one for every 50th part."""
    parts = read(spark, sf_dir, "part").filter("p_partkey % 50 = 0").select(
        F.concat(F.lit("1999/"), _text(F.col("p_partkey")), F.lit(".xlsx")).alias("path"), F.col("p_name").alias("name"))

    def cut(batches):
        for batch in batches:
            made = [_book(_row(1, ["COMPANY", name])) for name in batch["name"]]
            yield pd.DataFrame({"path": batch["path"], "content": [m[: len(m) // 2] for m in made]})

    ship(spark, Path(__file__).parent)
    return parts.mapInPandas(cut, "path string, content binary")
