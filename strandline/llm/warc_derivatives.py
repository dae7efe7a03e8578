"""Operator 10: metadata and plain-text conversion records derived from WARC responses.

Every response gives two records that refer to it (WARC-Refers-To) and to each other (WARC-Concurrent-To):

* a `conversion` record (text/plain) with the text of the payload,
* a `metadata` record (application/warc-fields) with the source's identifier, digests, HTTP status and content type,
  the page's title and its number of links.

Both keep the source's target URI, date and further headers (KEEP), and carry block digests of their own (SHA-1 in
base32); the source's payload digest stands in WARC-Source-Payload-Digest, as given or computed where the source has
none. Identifiers are UUIDs made from the source's identifier and the record's type, so a task that runs again writes
the same records. Work is by row; nothing is gathered.

Sources: read_warc reads WARC files (plain or gzipped by record or whole) through Spark's binary reader, so any store
that Spark reads will do; responses_of_pages wraps a table of pages. Sink: warc_files deals records into bodies of files.

Defined cases: a null or empty payload gives an empty text and still both records. A response without an identifier is
named by its URI and payload digest. Repeated responses give repeated records. Bytes that are no UTF-8 are read by the
charset that the source names, else replaced. Tags and comments that never close end with the page. Responses of
other types than HTML and text give an empty conversion. An empty table gives an empty result. Very long pages are held
whole, one at a time; gzipped files are opened as they are read. Names of header fields are read in any case. Chunked and
compressed payloads are decoded for the text (as far as they go, if they are damaged); digests are of the bytes as they
came. A record that is cut short, a damaged gzip member or bytes that are none end their file with the records before it;
`file_reports` counts both by file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.shared import table

#: Source headers that derived records keep as they are.
KEEP = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type", "WARC-Truncated")
#: Elements that start a new line of text.
_BLOCKS = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody tfoot thead title tr ul".split())
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)|<(/?[a-zA-Z][a-zA-Z0-9:-]*)(?:[^"'<>]++|"[^"]*+"|'[^']*+')*+>|<[!?][^>]*+>""",
    re.S | re.I,
)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LINK = re.compile(r"<a\s(?:[^>]*?\s)?href\s*=", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
#: The named fields of the standard, as it writes them.
_FIELDS = (
    "WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type", "WARC-Concurrent-To", "WARC-Block-Digest", "WARC-Payload-Digest", "WARC-IP-Address", "WARC-Refers-To",
    "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Target-URI", "WARC-Truncated", "WARC-Warcinfo-ID", "WARC-Filename", "WARC-Profile", "WARC-Identified-Payload-Type",
    "WARC-Segment-Number", "WARC-Segment-Origin-ID", "WARC-Segment-Total-Length",
)
_FIELD = {x.lower(): x for x in _FIELDS}
_GAP = re.compile(r"[ \t\r\f\v\xa0]+")
RESPONSE = "record_id string, headers map<string,string>, block binary"
RECORD = "record_id string, warc_type string, refers_to string, concurrent_to string, target_uri string, content_type string, content_length bigint, block_digest string, source_payload_digest string, headers map<string,string>, block binary"


def _line_break(m: re.Match) -> str:
    name = m[2]
    if not name:
        return " " if m[1] or m[0].startswith("<!--") else ""
    name = name.lstrip("/").lower()
    return "\n" if name in _BLOCKS else " " if name in ("td", "th", "img", "input", "button") else ""


def html_text(page: str) -> str:
    """The text of a page: a line by block element, white space collapsed, character references resolved."""
    text = _MARKUP.sub(_line_break, page.replace("\n", " "))
    lines = (_GAP.sub(" ", html.unescape(x)).strip() for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status, lower-cased headers and payload of an HTTP response block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", {}, block
    first, *rest = head.decode("latin-1").split("\r\n")
    fields = (x.partition(":") for x in rest if ":" in x)
    return (first.split(" ", 2) + [""])[1], {k.strip().lower(): v.strip() for k, _, v in fields}, payload


def named(headers: dict[str, str]) -> dict[str, str]:
    """Headers with the standard's fields as it writes them; the first of fields that differ in case only counts."""
    out: dict[str, str] = {}
    for k, v in headers.items():
        out.setdefault(_FIELD.get(k.lower(), k), v)
    return out


def _dechunked(data: bytes) -> bytes:
    """The payload of a chunked body, as far as its chunks are whole; data that does not start with one is no chunked body."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = data[at:end].split(b";")[0].strip()
        try:
            n = int(size, 16)
        except ValueError:
            break
        if n <= 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if out else data


def _inflated(data: bytes, way: str) -> bytes:
    """What gzip or deflate bytes hold, up to the first damage; data that is neither stays."""
    for bits in (47, -15) if way == "deflate" else (47,):  # deflate is sent with and without its wrapper
        opened, out = zlib.decompressobj(bits), bytearray()
        try:
            for a in range(0, len(data), 1 << 16):
                out += opened.decompress(data[a : a + (1 << 16)])
            out += opened.flush()
        except zlib.error:
            pass
        if out:
            return bytes(out)
    return data


def decoded(http: dict[str, str], payload: bytes) -> bytes:
    """The payload without its transfer and content encodings; others than chunked, gzip and deflate stay."""
    for name in ("transfer-encoding", "content-encoding"):
        for way in reversed([x.strip().lower() for x in http.get(name, "").split(",")]):  # the last one was applied last
            if way == "chunked":
                payload = _dechunked(payload)
            elif way in ("gzip", "x-gzip", "deflate"):
                payload = _inflated(payload, way)
    return payload


def _decode(payload: bytes, kind: str) -> str:
    try:
        return payload.decode()
    except UnicodeDecodeError:
        m = _CHARSET.search(kind.encode()) or _CHARSET.search(payload[:2048])
        try:
            return payload.decode(m[1].decode() if m else "utf-8", "replace")
        except LookupError:
            return payload.decode("utf-8", "replace")


def derive(record_id: str | None, headers: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and conversion records of one response."""
    headers = named(headers)
    status, http, payload = split_http(block or b"")
    source_digest = headers.get("WARC-Payload-Digest") or digest(payload)
    source = record_id or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, (headers.get('WARC-Target-URI') or '') + source_digest)}>"
    kind = http.get("content-type", "")
    page = _decode(decoded(http, payload), kind)
    is_html = "html" in kind.lower() or (not kind and "<" in page)
    text = html_text(page) if is_html else page if kind.lower().startswith("text/") or not kind else ""
    title = _TITLE.search(page) if is_html else None
    fields = {
        "source-record-id": source,
        "source-payload-digest": source_digest,
        "source-block-digest": headers.get("WARC-Block-Digest") or digest(block or b""),
        "http-status": status,
        "source-content-type": kind,
        "title": _GAP.sub(" ", html.unescape(title[1]).replace("\n", " ")).strip() if title else "",
        "outlinks": str(len(_LINK.findall(page)) if is_html else 0),
        "text-characters": str(len(text)),
    }
    name = {t: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {t}')}>" for t in ("metadata", "conversion")}
    bodies = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v)), "conversion": ("text/plain; charset=utf-8", text)}
    out = []
    for t, (content_type, body) in bodies.items():
        data = body.encode("utf-8", "replace")
        other = name["conversion" if t == "metadata" else "metadata"]
        every = {"WARC-Type": t, "WARC-Record-ID": name[t], "WARC-Refers-To": source, "WARC-Concurrent-To": other}
        every |= {k: headers[k] for k in KEEP if headers.get(k)}
        every |= {"WARC-Source-Payload-Digest": source_digest, "WARC-Block-Digest": digest(data), "Content-Type": content_type, "Content-Length": str(len(data))}
        out.append({"record_id": name[t], "warc_type": t, "refers_to": source, "concurrent_to": other, "target_uri": headers.get("WARC-Target-URI"), "content_type": content_type, "content_length": len(data), "block_digest": every["WARC-Block-Digest"], "source_payload_digest": source_digest, "headers": list(every.items()), "block": data})
    return out


_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "warc_type", "refers_to", "concurrent_to", "target_uri", "content_type")]
    + [("content_length", pa.int64()), ("block_digest", pa.string()), ("source_payload_digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]
)


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records by row of responses(record_id, headers, block), columns as in RECORD."""

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for source, headers, block in zip(*[b.column(i) for i in range(3)]):
                data = block.as_py() or b""
                rows += derive(source.as_py(), dict(headers.as_py() or []), data)
                size += len(data)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return responses.select("record_id", "headers", "block").mapInArrow(run, RECORD)


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    """A record as it stands in a WARC file."""
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in headers.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


class _Damaged(Exception):
    """The bytes of a file end here."""


def _blocks(data: bytes, size: int = 1 << 16):
    """The bytes of a file in blocks; of a gzipped one, what its members hold, opened as they come."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while at < len(data):
        member = zlib.decompressobj(31)
        try:
            while not member.eof and at < len(data):
                part = view[at : at + size]
                yield member.decompress(part)
                at += len(part) - len(member.unused_data)
            yield member.flush()
        except zlib.error as e:
            raise _Damaged from e
        if not member.eof:
            raise _Damaged
        while data[at : at + 1] == b"\0":  # padding between members
            at += 1


def parse(data: bytes, damage: list[str] | None = None):
    """(headers, block) of every record of a WARC file's bytes; a record at a time is held. A cut record or damage ends the file
    (and is told in damage)."""
    buffer, blocks = bytearray(), _blocks(data)

    def more() -> bool:
        try:
            for x in blocks:
                if x:
                    buffer.extend(x)
                    return True
        except _Damaged:
            if damage is not None:
                damage.append("gzip")
        return False

    def cut():
        if damage is not None and not damage:
            damage.append("cut")

    while True:
        while (at := buffer.find(b"WARC/")) < 0:
            if damage is not None and not damage and len(buffer) > 4 and buffer.strip():
                damage.append("no record")
            del buffer[: max(0, len(buffer) - 4)]
            if not more():
                return
        del buffer[:at]
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not more():
                return cut()
        lines = buffer[:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = named({k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)})
        n = headers.get("Content-Length", "")
        stop = end + 4 + (int(n) if n.isdigit() else 0)
        while len(buffer) < stop:
            if not more():
                return cut()
        yield headers, bytes(buffer[end + 4 : stop])
        del buffer[:stop]


_RESPONSE = pa.schema([("record_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def _batched(rows, schema: pa.Schema, size, limit: int = 4 << 20):
    """Rows (tuples) as batches of some MB by size(row), or of one row."""
    some, n = [], 0
    for row in rows:
        some.append(row)
        n += size(row)
        if n >= limit:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some, n = [], 0
    if some:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def records_in(contents: DataFrame, types: tuple[str, ...] = ("response",)) -> DataFrame:
    """RESPONSE columns of the records of some types in the WARC bytes of contents(content); null bytes hold none, broken ones those
    before the damage."""

    def found(batches):
        for b in batches:
            for content in b.column(0):
                for headers, block in parse(content.as_py() or b""):
                    if headers.get("WARC-Type") in types:
                        yield headers.get("WARC-Record-ID"), list(headers.items()), block

    def run(batches):
        yield from _batched(found(batches), _RESPONSE, lambda r: len(r[2]))

    return contents.select("content").mapInArrow(run, RESPONSE)


def file_reports(contents: DataFrame) -> DataFrame:
    """(records, damage) of each row of contents(content): how many whole records its bytes hold, and what ended them early: gzip (a
    damaged or unfinished member, or bytes after the last), cut (a record without its end), no record, or null."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                damage: list[str] = []
                n = sum(1 for _ in parse(content.as_py() or b"", damage))
                yield pa.record_batch([pa.array([n], pa.int64()), pa.array([damage[0] if damage else None], pa.string())], names=["records", "damage"])

    return contents.select("content").mapInArrow(run, "records bigint, damage string")


def read_warc(spark: SparkSession, path: str, types: tuple[str, ...] = ("response",)) -> DataFrame:
    """RESPONSE columns of the records of some types; one task reads a file (of 2 GB at most), as gzip cannot be split."""
    return records_in(spark.read.format("binaryFile").load(path), types)


def warc_files(records: DataFrame, name: str = "derived", file_bytes: int = 128 << 20, compress: bool = True) -> DataFrame:
    """(file, content): records dealt into bodies of WARC files of about file_bytes before compression."""

    def run(batches):
        from pyspark import TaskContext

        task, k, parts, size = TaskContext.get().partitionId(), 0, [], 0
        out = lambda: pa.record_batch([pa.array([f"{name}-{task:05d}-{k:05d}.warc" + ".gz" * compress]), pa.array([b"".join(parts)], pa.binary())], names=["file", "content"])
        for b in batches:
            for headers, block in zip(b.column(0), b.column(1)):
                data = serialise(dict(headers.as_py()), block.as_py())
                parts.append(gzip.compress(data, mtime=0) if compress else data)
                size += len(data)
                if size >= file_bytes:
                    yield out()
                    k, parts, size = k + 1, [], 0
        if parts:
            yield out()

    return records.select("headers", "block").mapInArrow(run, "file string, content binary")


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """RESPONSE columns of pages(page_id, url, html); the identifier is a UUID made from the page's id and address."""
    h = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    record_id = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))
    page = F.coalesce("html", F.lit(""))
    block = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), page), "UTF-8")
    headers = F.create_map(
        F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Record-ID"), record_id,
        F.lit("WARC-Target-URI"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", ""), F.lit("WARC-Date"), F.lit(date),
    )
    return pages.select(record_id.alias("record_id"), headers.alias("headers"), block.alias("block"))


def as_warc(responses: DataFrame, compress: bool = False) -> DataFrame:
    """(content): each response as the bytes of a WARC record, gzipped if asked, with the digests of its block and payload."""

    def written(batches):
        for b in batches:
            for headers, block in zip(b.column(0), b.column(1)):
                every, data = dict(headers.as_py() or []), block.as_py() or b""
                every |= {"WARC-Block-Digest": digest(data), "WARC-Payload-Digest": digest(split_http(data)[2])}
                every |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(data))}
                record = serialise(every, data)
                yield (gzip.compress(record, mtime=0) if compress else record,)

    def run(batches):
        yield from _batched(written(batches), pa.schema([("content", pa.binary())]), lambda r: len(r[0]))

    return responses.select("headers", "block").mapInArrow(run, "content binary")


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records derived from all pages: each page is a WARC response with digests, read back from its bytes."""
    d = derivatives(records_in(as_warc(responses_of_pages(table(spark, sf_dir, "pages")))))
    headers = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("headers"))))
    return d.select(
        "record_id", "warc_type", "refers_to", "concurrent_to", "target_uri", "content_type", "content_length", "block_digest",
        "source_payload_digest", headers.alias("headers"), F.decode("block", "UTF-8").alias("content"),
    )
