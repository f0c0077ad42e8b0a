r"""WARC archives: writing pages as segmented records, reading them back and reassembling segments.

Writing: of pages with equal payloads of at least `least` bytes the one with the largest page_id
is a response record and the others are revisits of it, naming its record, URL and date; smaller
pages are all responses. A response's payload is chunk-framed (HTTP/1.1 transfer coding), and a
block longer than `segment` bytes is cut into a first record and continuation records that name
it as their origin. Every record is a gzip member of its own, and each file of at most `per_file`
records begins with a warcinfo record. Record names are UUIDs made from the row, so a task that
runs again writes the same names.

Files come from Spark's own text writer, which commits whole tasks: a lost executor leaves no
half-written archive. It ends every value with a separator; a member of less than 16 MB ends with
a zero byte (the top byte of its length), so members are handed over without that byte and the
separator is it.

Reading: members are inflated one after the other, records parsed by their Content-Length,
grouped by origin identifier (a page's segments only), ordered by segment number, checked against
the total length in the last one, and the chunk framing of the joined block is undone. The digest
of the result is compared with the one in the header; `intact` tells whether all checks held. A
member or record that is cut short gives one row of record_type "damaged", and what follows it in
the file is lost; nothing is skipped in silence. Plain archives and ones with several records to
a member are read too; warcinfo, request, metadata and other records without a page are left out.

A null html is the empty payload. A null page_id ranks below all others and stays null; a null
url stays null. Rows that are equal in page_id, url and html are records of their own: all of them
responses if that page_id is the largest. Payloads are equal when length, SHA-1 and SHA-256 are.
Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import saved, scratch, table

LEAST = 1000
SEGMENT = 1 << 16
CHUNK = 1 << 13
PER_FILE = 2000
_END = b"\r\n"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "calibra:warc")
#: Extension fields that hold page ids, and the URI of a page without a URL.
_PAGE, _REFERS, _NO_URL = "Calibra-Page-ID", "Calibra-Refers-To-Page-ID", "urn:calibra:no-url:"


def frame(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in the chunked transfer coding."""
    out = [b"%x\r\n%b\r\n" % (len(part := payload[i : i + size]), part) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unframe(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped. Raises ValueError if it is cut short."""
    out, at = [], 0
    while True:
        end = body.find(_END, at)
        if end < 0:
            raise ValueError("chunk header is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if at + size + 2 > len(body):
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + _END * 2


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, json.dumps(parts))}>"


def _uri(url: str | None, page_id: str | None) -> str:
    return _NO_URL + quote(str(page_id)) if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")


def info_record(date: str, *name: object) -> bytes:
    fields = b"software: calibra\r\nformat: WARC File Format 1.1\r\n"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", *name)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], fields)


def page_records(page_id: str | None, url: str | None, payload: bytes, date: str, nth: int = 0, refers_to: tuple[str | None, str | None] | None = None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page; refers_to: page_id and url of the response it repeats."""
    digest = hashlib.sha1(payload).hexdigest()
    name, uri = record_id(page_id, url, digest, nth), _uri(url, page_id)
    place = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    own = [("WARC-Record-ID", name), *place, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    own += [] if page_id is None else [(_PAGE, quote(page_id))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        kind += [("WARC-Refers-To", record_id(*refers_to, digest, 0)), ("WARC-Refers-To-Target-URI", _uri(refers_to[1], refers_to[0])), ("WARC-Refers-To-Date", date)]
        kind += [] if refers_to[0] is None else [(_REFERS, quote(refers_to[0]))]
        yield record(kind + own, http + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + frame(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield record([("WARC-Type", "response")] + own + [("WARC-Segment-Number", "1")] * (len(parts) > 1), parts[0])
    for k, part in enumerate(parts[1:], 2):
        head = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(name, k)), *place, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(k))]
        yield record(head + [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(parts)), part)


def with_copies(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html (empty for null), nth (among equal rows) and of, the page_id and url whose payload the row repeats."""
    html = F.coalesce("html", F.lit(""))
    size = F.octet_length(html)
    rows = pages.select("page_id", "url", html.alias("html"), F.when(size >= least, F.sha2(html, 256)).alias("same"))
    what = [F.isnull("page_id"), "page_id", F.isnull("url"), "url", "html"]
    keyed = rows.withColumns({f"u{k}": F.xxhash64(F.lit(k), *what) for k in (1, 2)})
    twice = saved(keyed.groupBy("u1", "u2").agg(F.count("*").alias("n")).where("n > 1"), "page-repeats")
    once = rows.withColumn("nth", F.lit(0))
    if not twice.isEmpty():  # equal rows are numbered where their group is one row
        first = keyed.join(twice, ["u1", "u2"], "left_semi").groupBy("u1", "u2").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "html", "same")), F.count("*").cast("int").alias("n"))
        many = first.select("page_id", "url", "html", "same", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("nth"))
        once = keyed.join(twice, ["u1", "u2"], "left_anti").select("page_id", "url", "html", "same", F.lit(0).alias("nth")).unionByName(many)
    groups = rows.where("same IS NOT NULL").groupBy("same").agg(F.max(F.struct("page_id", "url")).alias("of"), F.count("*").alias("n")).where("n > 1").select("same", "of")
    repeats = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("of.page_id"))
    # the written tables' sizes are known, so small ones are broadcast and large ones are merge-joined
    return once.join(saved(groups, "page-copies"), "same", "left").select("page_id", "url", "html", "nth", F.when(repeats, F.col("of")).alias("of"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT, per_file: int = PER_FILE, date: str | None = None) -> None:
    """Writes all pages as records to WARC files under path, a gzip member for each; date (ISO 8601, default now) is the records'."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    if not 0 < segment < 1 << 23 or per_file < 2:
        raise ValueError("segments are 1 to 2**23 - 1 bytes, files two records or more")

    def member(data: bytes) -> bytes:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out = packer.compress(data) + packer.flush()
        assert out[-1] == 0 and len(data) < 1 << 24
        return out[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for page_id, url, html, nth, of in zip(*(batch.column(c) for c in ("page_id", "url", "html", "nth", "of")), strict=True):
                key, of = page_id.as_py(), of.as_py()
                refers = None if of is None else (None if of["page_id"] is None else str(of["page_id"]), of["url"])
                for data in page_records(None if key is None else str(key), url.as_py(), html.as_buffer().to_pybytes(), date, nth.as_py(), refers, segment):
                    if n % per_file == 0:  # the writer begins a file here
                        out.append(member(info_record(date, part, n)))
                        n += 1
                    out.append(member(data))
                    held += len(out[-1])
                    n += 1
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = with_copies(pages, least).mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


def members(data: bytes) -> Iterator[bytes]:
    """The inflated gzip members of an archive, one at a time, or its bytes if it is not compressed. Raises ValueError where one is cut short."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while at < len(data):
        packer = zlib.decompressobj(31)
        out = []
        while not packer.eof:
            part = view[at : at + (1 << 16)]
            if not len(part):
                raise ValueError("member is cut short")
            try:
                out.append(packer.decompress(part))
            except zlib.error as e:
                raise ValueError(f"no member at byte {at}") from e
            at += len(part) - len(packer.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (names in lower case) and block of each record of an archive, compressed or not; records do not cross members."""
    for part in members(data):
        at, view = 0, memoryview(part)
        while at < len(part):
            end = part.find(b"\r\n\r\n", at)
            if end < 0 or not part.startswith(b"WARC/", at):
                raise ValueError(f"no record at byte {at}")
            lines = part[at:end].decode().split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines if ":" in line)}
            size = int(headers.get("content-length", -1))
            if size < 0 or end + 4 + size + 4 > len(part):
                raise ValueError(f"record at byte {at} is cut short")
            yield headers, view[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = bytes(block).partition(b"\r\n\r\n")
    return unframe(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def sha1_hex(digest: str) -> str:
    """The hex form of a digest header; base32, as many archives write it, is turned into it."""
    value = digest.rpartition(":")[2].strip()
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()
    except ValueError:
        return value


#: Record types that stand for a page or a part of one.
_PAGES = frozenset(("response", "revisit", "resource", "conversion", "continuation"))


_RECORD = pa.schema([
    ("origin", pa.string()), ("segment", pa.int32()), ("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()),
    ("refers_to", pa.string()), ("total", pa.int64()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("block", pa.binary()),
])


def read_records(spark: SparkSession, path: str, files: str = "part-*") -> DataFrame:
    """One row for each record of the files of that pattern. Whole responses are decoded here; segments keep their block for reassembly.

    A task holds one compressed file and one inflated member of it; Spark reads files of up to 2 GB.
    """

    def row(headers: dict[str, str], block: memoryview) -> tuple:
        name, kind = headers.get("warc-record-id", ""), headers["warc-type"]
        origin, number = headers.get("warc-segment-origin-id", name), int(headers.get("warc-segment-number", 0))
        digest, total = sha1_hex(headers.get("warc-payload-digest", "")), headers.get("warc-segment-total-length")
        page, refers, url = headers.get(_PAGE.lower()), headers.get(_REFERS.lower()), headers.get("warc-target-uri")
        url = None if url is None or url.startswith(_NO_URL) else url
        size, intact, kept = None, None, None
        if number:
            kept = bytes(block)
        elif kind == "revisit":
            found = [h for h in bytes(block).lower().split(_END) if h.startswith(b"content-length:")]
            size, intact = (int(found[0][15:]), "warc-refers-to" in headers) if found else (None, False)
        else:
            try:
                payload = payload_of(block) if "application/http" in headers.get("content-type", "") else bytes(block)
                size, intact = len(payload), hashlib.sha1(payload).hexdigest() == digest
            except ValueError:
                intact = False
        return origin, number, page and unquote(page), url, kind, digest, refers and unquote(refers), total and int(total), size, intact, kept

    def rows(data: bytes) -> Iterator[tuple]:
        n = 0
        try:
            for headers, block in parse(data):
                n += 1
                if headers.get("warc-type") in _PAGES:
                    yield row(headers, block)
        except ValueError as e:
            yield f"damaged after record {n}: {e}, {hashlib.sha1(data).hexdigest()}", 0, None, None, "damaged", None, None, None, None, False, None

    def send(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [()] * len(_RECORD)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)], schema=_RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for one in rows(content.as_buffer().to_pybytes()):
                    held.append(one)
                    size += len(one[-1] or b"")
                    if len(held) == 500 or size > 1 << 22:
                        yield send(held)
                        held, size = [], 0
                yield send(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("content")
    return files.mapInArrow(run, "origin string, segment int, page string, url string, record_type string, digest string, refers_to string, total long, payload_bytes long, intact boolean, block binary")


def reassemble(records: DataFrame, key_type: str = "bigint") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact: one row for each origin.

    Only blocks of segmented records travel, and a group is one page's segments.
    """
    fields = ("segment", "page", "url", "record_type", "digest", "refers_to", "total", "payload_bytes", "intact", "block")
    groups = records.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("parts"))
    first = F.col("parts")[0]
    flat = groups.select(
        *(first[c].alias(c) for c in fields[1:-1]), F.col("parts.segment").alias("numbers"), F.array_max("parts.total").alias("whole"),
        F.when(F.size("parts") + first["segment"] > 1, F.col("parts.block")).alias("blocks"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digest, intact = (batch.column(c).to_pylist() for c in ("payload_bytes", "digest", "intact"))
            for i, parts in enumerate(batch.column("blocks")):
                if not parts.is_valid:
                    continue
                block = b"".join(x or b"" for x in parts.as_py())
                numbers = batch.column("numbers")[i].as_py()
                intact[i] = numbers == list(range(1, len(numbers) + 1)) and batch.column("whole")[i].as_py() == len(block)
                try:
                    payload = payload_of(block)
                    size[i] = len(payload)
                    intact[i] &= hashlib.sha1(payload).hexdigest() == digest[i]
                except ValueError:
                    intact[i] = False
            own = [batch.column(c) for c in ("page", "url", "record_type", "refers_to")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(intact, pa.bool_())], ["page", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"])

    out = flat.mapInArrow(run, "page string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, intact boolean")
    return out.select(F.col("page").cast(key_type).alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(key_type).alias("refers_to"), "intact")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return reassemble(read_records(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
g AS (SELECT h, max(page_id) AS largest FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN largest <> page_id THEN largest END AS refers_to, true AS intact
FROM p LEFT JOIN g ON p.h = g.h
"""
