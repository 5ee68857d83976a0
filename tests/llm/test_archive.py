import base64
import hashlib

import pytest
from conftest import DATA

from wharfline.llm import archive, queries
from wharfline.llm.common import written


def referred(archives):
    return archive.referred(archive.read_warc(archives))


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows):
    top = {}
    for i, html in rows:
        if i is not None:
            top[sha(html)] = max(top.get(sha(html), i), i)
    return sorted([(i, len((h or "").encode()), sha(h), *(("response", None) if i is None or top[sha(h)] == i else ("revisit", top[sha(h)]))) for i, h in rows], key=repr)


def read(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=repr)


def test_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    assert read(queries.queries()["op7_arc_to_warc"](spark, DATA)) == brute(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_query_in_both_versions(spark, version):
    """As the query does it, for each version of the legacy format."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    archives = written(archive.pages_to_warc(pages, version=version), "warc")
    assert read(referred(archives)) == brute([(r.page_id, r.html) for r in pages.collect()])
    records = archive.read_warc(archives).collect()
    assert {r.date[:4] for r in records} == {"2024"} and len({r.date for r in records}) > 1


@pytest.mark.parametrize("version", [1, 2])
def test_odd_pages(spark, version):
    rows = [(1, "http://a b\n/ü", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "<p>\r\n\r\nWARC/1.0\r\n"), (6, "u", "x" * 200_000), (None, "u", "x"), (2, None, "x"), (7, "u", "only"), (8, "filedesc://x.arc", "1 0 x"), (9, "filedesc:", "y"), (10, "Filedesc://z", "z")]
    pages = spark.createDataFrame([(*r, "clash", 1, "2001-02-03 04:05:06", 2, b"m") for r in rows], "page_id long, url string, html string, digest string, refers_to int, date string, part int, map binary")
    archives = written(archive.pages_to_warc(pages, version=version), "warc")
    assert read(referred(archives)) == brute([(i, h) for i, _, h in rows])
    assert {(r.uri, r.date) for r in archive.read_warc(archives).collect()} == {(u, "2001-02-03T04:05:06Z") for u in ("http://a%20b%0A/ü", "-", "u", "filedesc://x.arc", "filedesc:", "Filedesc://z")}
    assert referred(archive.pages_to_warc(pages.limit(0))).count() == 0


def test_few_payloads_are_shuffled(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i if i > 20 else 0}") for i in range(5000)], "page_id long, url string, html string")
    body = pages.html
    light = archive.revisits(pages, "page_id", body, 0)
    known = pages.selectExpr("page_id", "url", "html", "'2024' as date")
    assert sorted((r.page_id, r.refers_to) for r in archive.marked(known, light, body).collect() if r.refers_to is not None) == [(i, 20) for i in range(20)]
    assert archive.marked(known, light, body).count() == 5000


def test_records():
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    for version in (1, 2):
        body = archive.version_block("2001", version) + b"".join(archive.arc_record(u, "1.2.3.4", "20010203", "text/html", block, version) for u in ("u1", "u2"))
        first, *got = archive.arc_records(body)
        assert first[0]["url"] == "filedesc://part.arc" and first[1].startswith(f"{version} 0 ".encode())
        assert [(h["url"], h["date"], b) for h, b in got] == [("u1", "20010203", block), ("u2", "20010203", block)]
        # Files end to end may change the version.
        again = archive.version_block("2001", 3 - version) + archive.arc_record("u3", "1.2.3.4", "2001", "text/html", block, 3 - version)
        assert [h["url"] for h, _ in archive.arc_records(body + again)][-1] == "u3"
        for bad in (body[:-5], body[body.index(b"u1 ") :], body.replace(f"\n{version} 0".encode(), b"\n9 0", 1), archive.version_block("2001", version) + archive.arc_record("u", "i", "2001", "m", block, 3 - version)):
            with pytest.raises(ValueError):
                list(archive.arc_records(bad))
    dates = {"20010203": "2001-02-03T00:00:00Z", "20010203040506": "2001-02-03T04:05:06Z", "2024-01-02 03:04:05": "2024-01-02T03:04:05Z", "2024-01-02T03:04": "2024-01-02T03:04:00Z", "2001": "2001-01-01T00:00:00Z", "": "0000-01-01T00:00:00Z"}
    assert {d: archive.arc_date(d) for d in dates} == dates
    repeat = block.replace(b"X: y", b"X-Page-Id: 5\r\nX-Refers-To-Page: 7")
    named = block.replace(b"X: y", b"X-Page-Id: 7")
    one, two, three, four = (next(archive.warc_records(archive.warc_record(h, b))) for h, b in ((got[0][0], named), (got[0][0], repeat), (got[0][0] | {"mime": "text/dns"}, b"a.example 1.2.3.4"), first))
    assert [x[0]["warc-type"] for x in (one, two, three, four)] == ["response", "revisit", "resource", "warcinfo"]
    assert one[1] == named and two[1] == repeat[:-4] and two[0]["warc-refers-to"] == one[0]["warc-record-id"] != two[0]["warc-record-id"]
    assert one[0]["warc-payload-digest"] == two[0]["warc-payload-digest"] == "sha1:" + archive.base32_sha1(b"body") and three[0]["content-type"] == "text/dns"
