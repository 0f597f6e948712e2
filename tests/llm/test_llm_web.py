"""Archives: round trip against brute force, index searches, keys."""
import base64
import hashlib
import zlib

import pytest

import __spark_entry__ as entry
from monthloom.llm.files import open_file
from monthloom.llm.warc import Archive, parse_record, url_key
from tests.compare import compare, connect
from tests.conftest import MEDIUM

PAGES = [
    (1, "http://a.example.com/x", "<p>one</p>"), (2, "http://a.example.com/x", "<p>one</p>"),
    (3, "https://b.example.com:443/y?q=1#f", "<p>é</p>"), (4, None, None), (5, "", ""),
    (6, "http://a.example.com/x", "\r\n\r\nWARC/1.1\r\n"), (7, "not a url \n", "<p>one</p>"),
    (None, "http://c.example.com", "<p>one</p>"), (None, "http://d.example.com", "only"),
    (9, "http://[bad", "z" * 200_000), (10, "http://a.example.com/x", "\x00 "),
    (10, "http://a.example.com/x", "\x00 "),
]


def brute(rows, least):
    keeper, count = {}, {}
    for page, _, html in rows:
        body = (html or "").encode()
        count[body] = count.get(body, 0) + 1
        if page is not None:
            keeper[body] = max(page, keeper.get(body, page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        top = keeper.get(body)
        revisit = len(body) >= least and count[body] > 1 and top is not None and page != top
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_every_record_is_found_and_read(spark, least):
    pages = spark.createDataFrame([(*r, "f") for r in PAGES],
                                  "page_id long, url string, html string, file string")
    archive = Archive(spark, pages.repartition(3), min_bytes=least, block_lines=2, per_part=3)
    assert len(archive.top) > 1
    found = archive.look_up(pages, key="page_id")
    got = archive.read(found).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                   for r in got), key=str) == brute(PAGES, least)
    assert {bytes(r.payload) for r in got if r.payload is not None} >= {b"<p>\xc3\xa9</p>"}
    one = spark.createDataFrame([("https://A.Example.com/x",), ("http://none.example.org/",)],
                                "url string")
    assert sorted(r.page_id for r in archive.look_up(one).collect()) == [1, 2, 6, 10, 10]


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archive = Archive(spark, pages)
    assert archive.read(archive.look_up(pages)).count() == 0


def test_members_are_whole_archives_of_their_own(spark):
    pages = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string").coalesce(1)
    archive = Archive(spark, pages)
    rows = archive.captures.collect()
    with open_file(archive.folder, rows[0].file) as f:
        data = f.read()
    assert sum(r.length for r in rows) == len(data)
    whole, rest = b"", data
    while rest:
        member = zlib.decompressobj(31)
        whole += member.decompress(rest)
        rest = member.unused_data
    assert whole.count(b"WARC/1.1\r\n") == 3
    head, http, payload = parse_record(whole)
    assert head["WARC-Type"] == "revisit" and not payload and http["content-length"] == "10"


@pytest.mark.parametrize(("url", "key"), [
    ("http://www.Example.com:80/a?b#c", "com,example,www)/a?b"),
    ("https://example.com:8443", "com,example:8443)/"), ("ftp", "ftp"),
    ("http://x.org/a bé", "org,x)/a%20b%C3%A9"), ("http://h:nope/", "http://h:nope/"),
])
def test_keys(url, key):
    assert url_key(url) == key


def test_query_equals_sql(spark):
    assert compare(entry.queries()["op6_warc"](spark, MEDIUM), entry.oracle_sql()["op6_warc"],
                   connect(MEDIUM)) == []
