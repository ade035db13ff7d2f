"""Archives and boilerplate lines."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tensorspark.llm import site_lines, warc
from tensorspark.llm.common import open_fs

BIG = "<html>" + "a page " * 40
ODD_PAGES = [
    (1, "http://a.example/x", BIG, "r"),
    (2, None, BIG, "r"),
    (None, "http://a.example/n", BIG, "r"),
    (3, "", None, "r"),
    (4, "http://a.example/é\r\nX: y", "short", "r"),
    (5, "http://a.example/", "short", "r"),
    (6, "no url", "x" * 3_000_000, "r"),
    (7, "https://b.example:80", "<p>\U0001f600 \r\n\r\n WARC/1.1</p>" * 20, "r"),
    (1, "http://a.example/x", BIG, "r"),
]


@pytest.fixture
def odd_pages(make):
    return make("page_id long, url string, html string, digest string", ODD_PAGES)


def test_archives_round_trip(spark, odd_pages):
    folder = warc.write_archives(odd_pages)
    records = warc.read_archives(spark, folder)
    got = sorted(
        (str(r.page_id), str(r.url), r.payload_digest, r.payload_bytes, r.record_type, str(r.refers_to))
        for r in warc.resolve_revisits(records).collect()
    )
    want = []
    for page, url, html, _ in ODD_PAGES:
        raw = (html or "").encode()
        first = 1 if html == BIG and page != 1 else None
        kind = "revisit" if first else "response"
        url = url and url.replace("\r", "%0D").replace("\n", "%0A")
        want.append((str(page), str(url), hashlib.sha256(raw).hexdigest(), len(raw), kind, str(first)))
    assert got == sorted(want)
    payloads = {r.page_id: bytes(r.payload) for r in records.where("payload is not null").collect()}
    assert payloads == {p: (h or "").encode() for p, _, h, _ in ODD_PAGES if p not in (2, None)}


def test_no_pages(spark, odd_pages):
    folder = warc.write_archives(odd_pages.limit(0))
    assert warc.read_archives(spark, folder).count() == 0


def archive(spark, pages):
    folder = warc.write_archives(pages.coalesce(1))
    filesystem, path = open_fs(folder)
    name = spark.read.parquet(f"{folder}/manifest").first().file
    with filesystem.open_input_file(f"{path}/{name}") as stream:
        return stream.read()


def test_layout_and_damage(spark, odd_pages):
    data = archive(spark, odd_pages)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    read = lambda raw: list(warc.frames(pa.BufferReader(raw)))
    records = read(data)
    assert len(records) == len(ODD_PAGES) + 1 and records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    assert read(struct.pack("<II", magic, len(packed)) + packed + data[8 + size :]) == records
    for broken in (data[:-3], data[8:], data[: 8 + size // 2], b"", data[:-40] + b"x" * 40):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            read(broken)


def test_records_are_validated():
    good = warc.page_record(1, "http://x", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc._page(good)[-1] == b"payload"
    for bad in (
        good[:-1],
        good.replace(b"WARC/1.1", b"WARC/9.9"),
        good.replace(b"payload\r\n", b"paxload\r\n"),
        good.replace(b"WARC-Date", b"WARC-Data"),
        good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 2),
    ):
        with pytest.raises(ValueError):
            warc._page(bad)


def test_missing_response_is_an_error(spark, odd_pages):
    folder = warc.write_archives(odd_pages)
    records = warc.read_archives(spark, folder).where("record_type = 'revisit' or page_id > 1")
    with pytest.raises(Exception, match="refers to no response"):
        warc.resolve_revisits(records).collect()


def test_site_lines(make):
    rows = [(i, f"http://h.example/{i}", f"<p>menu</p><p>own {i}<p>menu") for i in range(4)]
    rows += [(4, "http://h.example", "<p>menu"), (5, "http://x.example", "<p>menu<p>m"), (6, None, None)]
    rows += [(None, "http://h.example", ""), (4, "http://h.example", "<p>menu")]
    pages = make("page_id long, url string, html string", rows).withColumn("site", F.lit("clash"))
    out = site_lines.drop_site_lines(pages, site_lines.host(pages.url), site_lines.html_lines(pages.html))
    got = sorted((str(r.page_id), r.site, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    want = [(str(i), "h.example", 3, 2, f"own {i}") for i in range(4)]
    want += [("4", "h.example", 1, 1, "")] * 2
    want += [("5", "x.example", 2, 0, "menu\nm"), ("6", "", 0, 0, ""), ("None", "h.example", 0, 0, "")]
    assert got == sorted(want)
    empty = pages.limit(0)
    assert site_lines.drop_site_lines(empty, site_lines.host(empty.url), site_lines.html_lines(empty.html)).count() == 0


@pytest.mark.parametrize("limit", [site_lines.BROADCAST_BYTES, 0])
def test_lines_of_small_sites_and_pages_without_site(make, monkeypatch, limit):
    monkeypatch.setattr(site_lines, "BROADCAST_BYTES", limit)
    long = "<p>".join(f"word {k}" for k in range(20_000))
    rows = [(1, "http://two.example/a", "<p>menu<p>one"), (2, "http://two.example/b", "<p>menu<p>two")]
    rows += [(3, "http://one.example/", "<p>menu"), (4, None, "<p>menu"), (5, "nowhere", "<p>menu"), (6, "", "<p>menu")]
    rows += [(7, "http://big.example/", f"<p>menu<p>{long}"), (8, "http://big.example/", "<p>menu<p>word 7")]
    rows += [(9, "http://three.example/", "<p>a<p>b"), (10, "http://three.example/", "<p>a"), (11, "http://three.example/", "<p>c")]
    pages = make("page_id long, url string, html string", rows)
    out = site_lines.drop_site_lines(pages, site_lines.host(pages.url), site_lines.html_lines(pages.html))
    got = {r.page_id: (r.n_dropped, r.text) for r in out.collect()}
    assert got[1] == (1, "one") and got[2] == (1, "two")  # on both pages of the host
    assert [got[k] for k in (3, 4, 5, 6)] == [(0, "menu")] * 4
    assert got[7][0] == 2 and got[7][1].startswith("word 0\nword 1\n") and "word 7\n" not in got[7][1]
    assert got[8] == (2, "")
    assert (got[9], got[10], got[11]) == ((1, "b"), (1, ""), (0, "c"))
