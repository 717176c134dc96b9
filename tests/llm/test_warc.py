"""WARC archives: round trips, ranges at every cut, embedded archives, damage, odd rows."""

import base64
import gzip
import hashlib
import io

import pytest
from odd_rows import SMALL
from pyspark.sql import functions as F

from cytolake.llm import queries, warc

DATE = "2000-01-01T00:00:00Z"


def plain(rows):
    """What the query has to return for ``(page_id, html)``."""
    first = {}
    for i, t in rows:
        first[t or ""] = max(first.get(t or "", i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        same = first[t or ""] == i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else first[t or ""]))
    return sorted(out)


def test_query_equals_brute_force(spark, tmp_path):
    pages = [(i, "http://a.example/x y\r\nz", t) for i, t in enumerate(["<p>a</p>", "", None, "<p>a</p>", "über 日本語", "x" * 200_000, "<p>a</p>", "", "b"])]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries.QUERIES["op13_warc"](spark, str(tmp_path)).collect())
    assert got == plain([(i, t) for i, _, t in pages])


def test_whole_table_and_every_reader_sees_the_same(spark, tmp_path):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    folder = str(tmp_path / "archives")
    warc.write_archives(pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 1000)), folder, archive_bytes=10_000)
    want = None
    for size in (1 << 24, 20_000, 777):
        got = sorted(tuple(r) for r in warc.read_archives(spark.read.parquet(f"{folder}/manifest"), size, True).drop("path").collect())
        assert want is None or got == want
        want = got
    archives = spark.read.parquet(f"{folder}/manifest").collect()
    assert sum(a.records for a in archives) == 100 and len(archives) > 3
    texts = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    stored = {warc.row_of(r.record_id): bytes(r.payload) for r in warc.read_archives(warc.archives_in(spark, folder), with_payload=True).collect() if r.record_type == "response"}
    assert stored == {str(i + 1000): t for i, t in texts.items()}
    for a in archives:  # any gzip reader can read them
        told = gzip.open(a.path).read()
        assert told.count(b"WARC/1.1\r\n") == a.records + 1


def _scanned(data, size):
    file = io.BytesIO(data)
    return [r for k in range(-(-len(data) // size)) for r in warc.records_in(file, k * size, min(len(data), (k + 1) * size), True)]


def test_ranges_of_every_size_find_every_record_once():
    data = b"".join(warc.record(str(i), f"http://e/{i}", bytes([i]) * (i * 37), DATE) for i in range(12))
    whole = _scanned(data, len(data))
    assert [warc.row_of(r["record_id"]) for r in whole] == [str(i) for i in range(12)]
    for size in (1, 2, 3, 50, 99, 100, 101, 1000):
        assert _scanned(data, size) == whole


def test_an_archive_inside_a_page_is_not_read_as_records(spark, tmp_path):
    inner = warc.record("inner", "http://inner", b"payload of a page that is an archive", DATE)
    outer = b"".join(warc.record(n, "http://outer", inner * k, DATE, level=0) for n, k in (("a", 5), ("b", 1)))  # stored as it is
    (tmp_path / "x.warc.gz").write_bytes(outer)
    assert any(warc.row_of(r["record_id"]) == "inner" for r in _scanned(outer, 200))
    for size in (100, 200, 1 << 20):
        got = warc.read_archives(warc.archives_in(spark, str(tmp_path)), size).orderBy("offset").collect()
        assert [warc.row_of(r.record_id) for r in got] == ["a", "b"] and all(r.intact for r in got)


def test_damage_is_told_and_the_rest_is_read():
    members = [warc.record(str(i), None, b"text %d " % i * 500, DATE) for i in range(3)]
    broken = members[1][:-20] + bytes(20)
    found = _scanned(members[0] + broken + members[2], 64)
    assert [(warc.row_of(r["record_id"]), r["intact"]) for r in found] == [("0", True), ("1", False), ("2", True)]
    cut_off = _scanned(members[0] + members[1][:-30], 64)
    assert [r["intact"] for r in cut_off] == [True, False]
    wrong = warc.record("9", None, b"abc", DATE)
    assert _scanned(wrong, 10)[0]["payload"] == b"abc"


def test_magic_bytes_and_flags_are_not_enough():
    noise = warc.GZIP_MAGIC + b"\x00" + warc.GZIP_MAGIC + b"\xff" + gzip.compress(b"no record") + warc.GZIP_MAGIC
    data = noise + warc.record("1", None, b"", DATE) + noise
    for size in (1, 7, 1000):
        assert [warc.row_of(r["record_id"]) for r in _scanned(data, size)] == ["1"]


def test_odd_rows(spark, odd, nothing, tmp_path):
    docs = spark.read.parquet(odd).withColumn("content", F.lit("x")).withColumn("first", F.lit("x")).withColumn("payload", F.lit("x"))
    folder = str(tmp_path / "odd")
    warc.write_archives(docs, folder, "doc_id", "source", "text", least_bytes=1)
    got = warc.read_archives(spark.read.parquet(f"{folder}/manifest")).where("record_type <> 'warcinfo'").collect()
    assert len(got) == docs.count() and all(r.intact for r in got)
    kinds = [(warc.row_of(r.record_id), r.record_type) for r in got]
    assert kinds.count(("8", "response")) == 2 and kinds.count((None, "response")) == 2  # repeated rows, rows without an id
    assert all(k == "response" for _, k in kinds)
    none = str(tmp_path / "none")
    warc.write_archives(spark.read.parquet(nothing), none, "doc_id", "source", "text")
    assert warc.read_archives(spark.read.parquet(f"{none}/manifest")).count() == 0


@pytest.mark.parametrize("least, revisits", [(0, 3), (1, 2), (100, 0)])
def test_short_payloads_can_be_left_alone(spark, tmp_path, least, revisits):
    rows = [(1, ""), (2, ""), (3, "a"), (4, "a"), (5, "a")]
    folder = str(tmp_path / "w")
    pages = spark.createDataFrame([(i, "http://u", t) for i, t in rows], "page_id int, url string, html string")
    warc.write_archives(pages, folder, least_bytes=least)
    found = warc.read_archives(spark.read.parquet(f"{folder}/manifest")).where("record_type = 'revisit'")
    assert found.count() == revisits
