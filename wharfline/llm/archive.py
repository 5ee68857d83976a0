"""Legacy web archives: ARC records are parsed by their version's header line and declared lengths and rewritten as WARC records.

An archive is a row of a table: consecutive records in one binary value, so
that Spark itself writes and reads archives wherever tables may lie.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import tidy, written
from wharfline.llm.text import steps

#: Fixed values of the formats: the fields of an ARC header line by version, and the WARC profile of revisits.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "code", "checksum", "location", "offset", "file", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

#: Bytes after which a task ends an archive and begins the next.
ARCHIVE_BYTES = 4 << 20

#: HTTP header fields of a block that hold the page's id and that of the page it repeats.
PAGE_FIELD, REFERS_FIELD = b"X-Page-Id", b"X-Refers-To-Page"
#: Bits of the filter that keeps pages which repeat no other out of the join's shuffle; 2 MB are broadcast. Beyond some ten million revisits more pages pass it, none wrongly.
SIEVE_BITS = 1 << 24
_MAP_BITS = 1 << 15

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
#: The scheme that marks version blocks, and how a page's address of that scheme is written, so that none passes for one.
VERSION_SCHEME, PAGE_SCHEME = "filedesc:", "%66iledesc:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_date(stamp: str) -> str:
    """The digits of an ARC date, cut or padded to 14, as a WARC-Date."""
    s = re.sub("[^0-9]", "", stamp)[:14]
    s += "00000101000000"[len(s) :]
    return f"{s[:4]}-{s[4:6]}-{s[6:8]}T{s[8:10]}:{s[10:12]}:{s[12:14]}Z"


def _arc_line(url: str | None, ip: str, date: str, mime: str, size: int, version: int) -> bytes:
    """A header line. Spaces and control characters of the URL are percent-encoded, since spaces part the fields."""
    safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "-"
    middle = [] if version == 1 else ["200", "-", "-", "0", "-"]
    return " ".join([safe, ip, date, mime, *middle, str(size)]).encode() + b"\n"


def arc_record(url: str | None, ip: str, date: str, mime: str, block: bytes, version: int = 1) -> bytes:
    if (url or "").startswith(VERSION_SCHEME):
        url = PAGE_SCHEME + url[len(VERSION_SCHEME) :]
    return _arc_line(url, ip, date, mime, len(block), version) + block + b"\n"


def version_block(date: str, version: int) -> bytes:
    """The record that begins an ARC file: its block names the version and the fields of the header lines."""
    block = f"{version} 0 wharfline\n{ARC_TITLES[version]}\n\n".encode()
    return _arc_line(f"{VERSION_SCHEME}//part.arc", "0.0.0.0", date, "text/plain", len(block), version) + block


def arc_records(body: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and blocks of the records of an ARC body, version blocks included, each read by the version declared before it.

    A body that doesn't begin with a version block, a header of another field count, or a length beyond the data raises ValueError.
    """
    names, at = None, 0
    while at < len(body):
        if body[at : at + 1] == b"\n":
            at += 1
            continue
        end = body.index(b"\n", at)
        fields = body[at:end].decode().split(" ")
        if fields[0].startswith(VERSION_SCHEME):
            declared = body[end + 1 :].split(b"\n", 1)[0].split(b" ")[0]
            if not declared.isdigit() or int(declared) not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {declared[:20]!r}")
            names = ARC_FIELDS[int(declared)]
        if names is None:
            raise ValueError("an ARC body begins with a version block")
        if len(fields) != len(names):
            raise ValueError(f"ARC header has {len(fields)} fields, not {len(names)}: {body[at:end][:200]!r}")
        head = dict(zip(names, fields))
        at = end + 1 + int(head["length"])
        if at > len(body):
            raise ValueError(f"ARC record of {head['url'][:200]} ends beyond the archive")
        yield head, body[end + 1 : at]


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head, its empty line included, and the payload."""
    cut = block.find(b"\r\n\r\n")
    return (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (b"", block)


def record_id(page: str, digest: str) -> str:
    """The record id of a page's response: known wherever the page's id and its payload's digest are, as in the records that revisit it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page} {digest}')}>"


def _http_field(http: bytes, name: bytes) -> str | None:
    found = re.search(rb"\r\n" + name + rb": ([^\r\n]+)\r\n", http)
    return found[1].decode() if found else None


def warc_record(head: dict[str, str], block: bytes) -> bytes:
    """The WARC record equivalent to an ARC record.

    A version block becomes a warcinfo record, an HTTP block a response, or a revisit without its
    payload if its head says what page it repeats, and any other block a resource of its own type.
    """
    date = arc_date(head["date"])
    http, payload = http_parts(block) if block.startswith(b"HTTP/") else (b"", block)
    digest = base32_sha1(payload)
    page, refers = _http_field(http, PAGE_FIELD), _http_field(http, REFERS_FIELD)
    kind = "warcinfo" if head["url"].startswith(VERSION_SCHEME) else "resource" if not http else "response" if refers is None else "revisit"
    kept = http if kind == "revisit" else block
    own = record_id(page, digest) if page and kind == "response" else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((head['url'], date, digest, http.hex())))}>"
    url = head["url"]
    url = VERSION_SCHEME + url[len(PAGE_SCHEME) :] if url.startswith(PAGE_SCHEME) else url
    lines = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {own}",
        f"WARC-Date: {date}",
        f"WARC-Block-Digest: sha1:{base32_sha1(kept)}",
        *([f"WARC-Filename: {url[len(VERSION_SCHEME) + 2 :]}"] if kind == "warcinfo" else [f"WARC-Target-URI: {url}", f"WARC-IP-Address: {head['ip']}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]),
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers, digest)}"] if kind == "revisit" else []),
        f"Content-Type: {'application/http; msgtype=response' if http else head['mime']}",
        f"Content-Length: {len(kept)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + kept + b"\r\n\r\n"


def warc_records(body: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and blocks of the records of a WARC body."""
    at = 0
    while at < len(body):
        end = body.index(b"\r\n\r\n", at)
        first, *lines = body[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:100]}")
        head = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        stop = end + 4 + int(head["content-length"])
        yield head, body[end + 4 : stop]
        at = stop + 4


def revisits(pages: DataFrame, page_id: str, payload: Column, least: int) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload, of ``least`` bytes or more, is that of a page with a larger id.

    Only ids and digests are shuffled. The largest id of each digest is
    pre-aggregated by task; only digests of more than one page come to the join,
    whose hot keys adaptive execution splits.
    """
    light = pages.select(F.col(page_id).alias("page_id"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    top = light.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return light.join(top, ["digest", "n"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def marked(pages: DataFrame, light: DataFrame, payload: Column) -> DataFrame:
    """page_id, url, html, date and refers_to of all pages.

    Only pages whose id passes a bitmap of the ids of ``light`` (see ``revisits``) go through the join with it; the others' html isn't shuffled.
    """
    place = F.pmod(F.xxhash64("page_id"), F.lit(SIEVE_BITS))
    part, bit = F.floor(place / _MAP_BITS).alias("part"), (place % _MAP_BITS).alias("bit")
    maps = F.broadcast(light.select(part, bit).groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("map")))
    octet = F.conv(F.hex(F.substring("map", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(octet / F.pow(F.lit(2), F.col("bit") % 8)) % 2 == 1, F.lit(False))
    sieved = pages.withColumn("digest", F.sha1(payload.cast("binary"))).select("*", part, bit).join(maps, "part", "left").withColumn("hit", hit)
    columns = ["page_id", "url", "html", "date", "digest"]
    asked = sieved.where("hit").select(*columns).join(light, ["page_id", "digest"], "left")
    return sieved.where(~F.col("hit")).select(*columns, F.lit(None).cast("bigint").alias("refers_to")).unionByName(asked.select(*columns, "refers_to")).drop("digest")


def to_arc(pages: DataFrame, *, version: int = 1, ip: str = "0.0.0.0") -> DataFrame:
    """ARC bodies (``arc`` binary) of pages with columns page_id, url, html, date and refers_to, each begun by a version block.

    The page id, and what a page refers to, travel as HTTP headers of the block. A task ends an archive after ARCHIVE_BYTES; a longer page has one of its own.
    """

    def build(batches):
        for batch in steps(batches, "html", ARCHIVE_BYTES):
            out, size = [], 0
            for page, url, html, date, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "date", "refers_to"))):
                fields = [f"{name.decode()}: {value}\r\n" for name, value in ((PAGE_FIELD, page), (REFERS_FIELD, refers)) if value is not None]
                block = "".join(["HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n", *fields, "\r\n"]).encode() + (html or "").encode()
                stamp = re.sub("[^0-9]", "", date or "") or "0"
                out.append(arc_record(url, ip, stamp, "text/html", block, version) if out else version_block(stamp, version) + arc_record(url, ip, stamp, "text/html", block, version))
                size += len(block)
                if size >= ARCHIVE_BYTES:
                    yield pa.record_batch([pa.array([b"".join(out)], pa.binary())], ["arc"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array([b"".join(out)], pa.binary())], ["arc"])

    return pages.select("page_id", "url", "html", "date", "refers_to").mapInArrow(tidy(build), "arc binary")


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """WARC bodies (``warc`` binary) of ARC bodies (``arc``) of any version, record by record."""

    def convert(batches):
        for batch in batches:
            for arc in batch.column("arc"):
                body = b"".join(warc_record(head, block) for head, block in arc_records(arc.as_py()))
                yield pa.record_batch([pa.array([body], pa.binary())], ["warc"])

    return archives.select("arc").mapInArrow(tidy(convert), "warc binary")


#: Columns of the records that ``read_warc`` gives.
RECORD = "record_id string, date string, uri string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to_record string, payload binary"


def read_warc(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """A row for each response, revisit and resource of WARC bodies (``warc``): see RECORD; payload is null for revisits, or for all without ``payloads``.

    A record whose declared block digest, or whose declared payload digest, differs from its bytes raises ValueError.
    """

    def read(batches):
        for batch in batches:
            for body in batch.column("warc"):
                rows = []
                for head, block in warc_records(body.as_py()):
                    if head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"block digest of {head['warc-record-id']}")
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, payload = http_parts(block) if head["warc-type"] != "resource" else (b"", block)
                    full = head["warc-type"] != "revisit"
                    if full and head["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
                        raise ValueError(f"payload digest of {head['warc-record-id']}")
                    page = _http_field(http, PAGE_FIELD)
                    rows.append((head["warc-record-id"], head["warc-date"], head["warc-target-uri"], page and int(page), int(head["warc-payload-length"]), head["warc-payload-digest"][5:], head["warc-type"], head.get("warc-refers-to"), payload if full and payloads else None))
                if rows:
                    kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] * 3 + [pa.binary()]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split(" ")[0] for f in RECORD.split(", ")])

    return archives.select("warc").mapInArrow(tidy(read), RECORD)


def referred(records: DataFrame) -> DataFrame:
    """``records`` with refers_to, the page id of the response whose record id a revisit names; null for other records. No payload goes through the join."""
    light = written(records.drop("payload", "refers_to"), "records")
    asked = light.where("refers_to_record is not null").select("refers_to_record").distinct()
    target = light.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to")).join(asked, "refers_to_record", "left_semi").distinct()
    return light.join(target, "refers_to_record", "left")


def pages_to_warc(pages: DataFrame, *, least: int = 0, version: int = 1) -> DataFrame:
    """WARC archives of all ``pages`` (page_id, url, html, and date, if there), by way of ARC records of the given version.

    Of pages with equal payloads of at least ``least`` bytes the one with the
    largest id is a response and the others revisit it. Null html is an empty
    payload, a null url is "-". Rows that repeat the largest id are responses
    all, of one record id; a null id gives a response. ``date`` holds stamps of any writing whose digits are a date's;
    without that column a page's stamp counts its id in seconds from 2024 on. Other columns are ignored. An empty table gives no archive.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    counted = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyyMMddHHmmss")
    stamp = F.col("date").cast("string") if "date" in pages.columns else counted
    known = pages.select("page_id", "url", "html", stamp.alias("date"))
    light = written(revisits(known, "page_id", body, least), "revisits")
    return arc_to_warc(to_arc(marked(known, light, body), version=version))
