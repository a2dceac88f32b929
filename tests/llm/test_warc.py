import gzip
import hashlib
from pathlib import Path

import pytest
from helpers import prose

from saleslens.llm import warc
from saleslens.session import shared_dir

PAGES = "page_id long, url string, html string, seq string"


def odd_pages(spark):
    page = "<html>" + prose(1, 60) + "</html>"
    rows = [(5, "http://b/5", page), (3, "http://a/3", page), (3, "http://a/3", page), (9, None, page), (None, "http://n/", page),
            (1, "http://a/1", None), (2, "http://a/2", ""), (4, "http://a/4\r\nX: y", "short"), (6, "http://a/6", "short"),
            (7, "http://é/ü", "文" * 40), (8, "http://a/8", "\r\n\r\n" + prose(2, 20_000)), (10, "http://a/10", "x" * 99), (11, "http://a/11", "x" * 99)]
    return spark.createDataFrame([(*r, "mine") for r in rows], PAGES)


def archive(spark, pages, **options):
    root = shared_dir(spark, "test-warc")
    return root, warc.write(pages, root, **options)


def files(root):
    return {p.name: p.read_bytes() for p in sorted(Path(root).glob("*.warc.gz"))}


def test_round_trip_of_odd_pages(spark):
    pages = odd_pages(spark)
    root, manifest = archive(spark, pages, roll_bytes=2000)
    rows = warc.read(spark, root).collect()
    assert len(rows) == 13 and manifest.count() > 1 and sum(r.records for r in manifest.collect()) == 13
    want = sorted((r.page_id is None, r.page_id or 0, hashlib.sha256((r.html or "").encode()).hexdigest(), len((r.html or "").encode())) for r in pages.collect())
    assert sorted((r.page_id is None, int(r.page_id or 0), r.payload_digest, r.payload_bytes) for r in rows) == want
    copies = [r for r in rows if r.payload_bytes > 100 and r.page_id in ("3", "5", "9", None)]
    assert sorted(r.record_type for r in copies) == ["response"] + ["revisit"] * 4
    assert next(r for r in copies if r.record_type == "response").page_id == "3" and {r.refers_to for r in copies if r.record_type == "revisit"} == {"3"}
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 100)
    assert len({r.record_id for r in rows}) == 13
    assert {r.page_id: r.payload for r in rows}["8"] == bytearray(("\r\n\r\n" + prose(2, 20_000)).encode())
    assert {r.page_id: r.url for r in rows}["4"] == "http://a/4%0D%0AX: y"


def test_files_are_the_same_however_the_rows_are_dealt(spark):
    pages = odd_pages(spark)
    one, _ = archive(spark, pages.coalesce(1), roll_bytes=1500)
    many, manifest = archive(spark, pages.repartition(7), roll_bytes=1500)
    assert files(one) == files(many) and len(files(one)) > 1
    for row in manifest.collect():
        content = files(many)[row.name]
        assert (row.bytes, row.sha256) == (len(content), hashlib.sha256(content).hexdigest())
    assert not list(Path(many).glob("_temporary*"))


def test_files_are_the_same_with_any_number_of_ranges(spark):
    """Revisits, small payloads and repeated rows, in ranges of any number."""
    rows = [(k // 2 if k % 9 == 0 else k, f"http://a/{k % 50}", prose(k % 37, 60) if k % 3 else f"small {k % 5}") for k in range(400)]
    pages = spark.createDataFrame(rows + rows[:60] * 2, "page_id long, url string, html string")
    names = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
    was = [spark.conf.get(n) for n in names]
    made = []
    try:
        spark.conf.set(names[1], "false")
        for n in (1, 4, 9):
            spark.conf.set(names[0], n)
            root, manifest = archive(spark, pages.repartition(n + 1), roll_bytes=6000)
            kinds = {r.record_id: r.record_type for r in warc.read(spark, root).collect()}
            assert len(kinds) == 520 and set(kinds.values()) == {"response", "revisit"}
            made.append((files(root), kinds))
    finally:
        for name, value in zip(names, was, strict=True):
            spark.conf.set(name, value)
    assert len(made[0][0]) > 3 and made[0] == made[1] == made[2]


def test_records_are_gzip_members_in_order(spark):
    root, _ = archive(spark, odd_pages(spark))
    (content,) = files(root).values()
    plain = [bytes(m) for m in warc.members(memoryview(content))]
    assert b"".join(plain) == gzip.decompress(content) and all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in plain)
    ids = [warc.parse(m)[0].get("warc-page-id") for m in plain[1:]]
    assert ids == ["1", "2", "3", "3", "4", "5", "6", "7", "8", "9", "10", "11", None]


def test_moving_again_after_a_lost_task(spark):
    root, manifest = archive(spark, odd_pages(spark), roll_bytes=1500)
    batch = manifest.toArrow().combine_chunks().to_batches()[0]
    assert list(warc._mover(f"{root}/_temporary-gone", root)(iter([batch])))  # all are in place
    next(Path(root).glob("*.warc.gz")).write_bytes(b"other")
    with pytest.raises(RuntimeError):
        list(warc._mover(f"{root}/_temporary-gone", root)(iter([batch])))


def test_uncommitted_and_empty_archives(spark):
    with pytest.raises(FileNotFoundError):
        warc.read(spark, shared_dir(spark, "nothing"))
    root, manifest = archive(spark, odd_pages(spark).limit(0))
    assert manifest.count() == 0 and warc.read(spark, root).count() == 0


def test_cut_files_are_noticed():
    whole = warc.info(1)
    with pytest.raises(EOFError):
        list(warc.members(memoryview(whole[:-5])))
