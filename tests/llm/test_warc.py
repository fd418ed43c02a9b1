import base64
import gzip
import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest

from ratespark.llm import warc

PAGES = [
    (3, "http://a.example/x y", "<p>one\r\n\r\nWARC/1.1\r\n</p>\n\n"), (1, "http://b.example/", "<p>same</p>"), (2, None, "<p>same</p>"),
    (5, "", None), (4, "https://c.example/\n", ""), (6, "http://d.example", "é中\U0001f600" * 2000), (7, "http://d.example", "tail"),
    (8, "http://e.example", "<p>same</p>"), (None, "http://f.example", "<p>same</p>"), (9, "u", "x"), (9, "u", "x"),
]


def expected(pages):
    groups = defaultdict(list)
    for page_id, _, html in pages:
        groups[(html or "").encode()].append(page_id)
    out = []
    for body, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        ids.remove(first)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((first, len(body), digest, "response", None))
        out += [(i, len(body), digest, "revisit", first) for i in ids]
    return sorted(out, key=str)


@pytest.fixture
def archives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    arc, target = str(tmp_path / "arc"), str(tmp_path / "warc")
    warc.write_arc(pages, arc)
    warc.convert_arc(spark, arc, target)
    return arc, target


def test_round_trip_gives_types_digests_and_references(spark, archives):
    rows = warc.resolved(warc.read_warc(spark, archives[1])).collect()
    assert sorted(map(tuple, rows), key=str) == expected(PAGES)


def test_payloads_and_dates_survive(spark, archives):
    rows = warc.read_warc(spark, archives[1]).collect()
    assert not [r.problem for r in rows if r.problem]
    bodies = {bytes(r.payload) for r in rows if r.record_type == "response"}
    assert bodies == {(h or "").encode() for _, _, h in PAGES}
    assert {r.date for r in rows} == {"2024-01-01T00:00:00Z"}
    assert len({r.record_id for r in rows}) == len(rows)
    assert {r.record_type for r in rows} == {"warcinfo", "response", "revisit"}


def test_both_versions_are_written_and_read(spark, archives):
    rows = warc.read_arc(spark, archives[0]).where("url NOT LIKE 'filedesc%'").collect()
    assert {r.version for r in rows} == {1, 2} and len(rows) == len(PAGES)
    assert {r.status for r in rows if r.version == 2} == {"200"} and {r.status for r in rows if r.version == 1} == {None}


def test_small_payloads_can_be_left_alone(spark, archives, tmp_path):
    warc.convert_arc(spark, archives[0], str(tmp_path / "w2"), min_bytes=5)
    rows = warc.resolved(warc.read_warc(spark, str(tmp_path / "w2"))).collect()
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 5)
    assert sum(r.record_type == "revisit" for r in rows) == 3


def test_damaged_files_are_reported(spark, tmp_path):
    good = b"filedesc://x 0.0.0.0 19990101000000 text/plain 9\n1 0 abc\n\n\nhttp://o.example/a b 1.2.3.4 199901 text/html 5\nhello\n"
    (tmp_path / "a").mkdir()
    with gzip.open(tmp_path / "a" / "x.arc.gz", "wb") as f:
        f.write(good + b"no header at all\n\ndns:o.example 1.1.1.1 19990101000000 text/dns 3\nabc\nhttp://o.example/c 1.2.3.4 19990101000000 text/html 500\nshort")
    rows = warc.read_arc(spark, str(tmp_path / "a")).collect()
    assert [r.problem for r in rows] == [None, None, "not a header line", None, "cut off"]
    assert rows[1].url == "http://o.example/a b" and bytes(rows[1].content) == b"hello"
    warc.convert_arc(spark, str(tmp_path / "a"), str(tmp_path / "w"))
    found = {r.url: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert {r.record_type for r in found.values()} == {"warcinfo", "resource"}
    assert found["http://o.example/a b"].date == "1999-01-01T00:00:00Z"
    assert bytes(found["dns:o.example"].payload) == b"abc"


def test_blocks_are_cut_at_any_place():
    data = b"ab\n\ncd\r\nefg\n"
    for first in range(len(data) + 1):
        lines = data[:-1].split(b"\n")
        batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(lines)), pa.array(lines, pa.binary())], names=["file", "line"])
        reader = warc.Lines(iter([batch]))
        assert reader.next_file() == "f"
        assert reader.block(first) == (data[:first], True)
        assert reader.block(len(data) - first)[0] == data[first:]


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_arc(pages, str(tmp_path / "a"))
    warc.convert_arc(spark, str(tmp_path / "a"), str(tmp_path / "w"))
    assert warc.resolved(warc.read_warc(spark, str(tmp_path / "w"))).collect() == []
