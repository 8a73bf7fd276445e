"""Legacy ARC archives to WARC, and WARC files written and read by Spark.

ARC records have one header line whose fields depend on the version in the archive's first record, and a
declared length. The converter reads both versions and makes the WARC record that says the same: identifier,
timestamp, type and digests are derived, so a recomputed task makes the same bytes. Files go through Spark's
text sink (a record is a line that ends in CR LF CR LF) and come back through its binary file source, so any
store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposcope.llm import words as W
from toposcope.settings import ensure_checkpoint_dir, stored

# Fixed: the field lines of both ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
END = b"\r\n\r\n"
LAST = (1 << 63) - 1
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:toposcope:warc")


@dataclass
class ArcRecord:
    """One ARC record: named header fields and the bytes of its declared length."""

    version: int
    fields: dict[str, str]
    block: bytes


def digest32(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324


def arc_bytes(version: int, name: str, date: str, records: Iterator[tuple[str, str, bytes]]) -> Iterator[bytes]:
    """An ARC archive in pieces: its version block, then ``(url, content type, block)`` records."""
    head = f"{version} 0 toposcope\n{ARC_FIELDS[version]}\n".encode()
    middle = "" if version == 1 else " 200 - - 0 " + name
    yield f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(head)}\n".encode() + head + b"\n"
    for url, kind, block in records:
        middle = "" if version == 1 else f" 200 {digest32(block)} - 0 {name}"
        yield f"{url} 0.0.0.0 {date} {kind}{middle} {len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC archive. The first record (filedesc) names the version that later header lines follow.

    A header line is split from the right, so a URL may hold spaces. Blank lines between records are skipped;
    a block shorter than declared raises.
    """
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.index(b"\n", at)
        line = data[at:stop].decode("utf-8", "surrogateescape").rstrip("\r")
        length = int(line.rsplit(" ", 1)[1])
        block = data[stop + 1 : stop + 1 + length]
        if len(block) < length:
            raise ValueError(f"ARC record of {length} bytes is cut off: {line[:80]}")
        if version is None:
            version = int(block.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
        names = ARC_FIELDS[version].split()
        yield ArcRecord(version, dict(zip(names, line.rsplit(" ", len(names) - 1), strict=True)), block)
        at = stop + 1 + length


def _headers(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """HTTP fields (lower-case names), the bytes up to the payload, and the payload; without HTTP, all is payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, gap, payload = block.partition(END)
    fields = (line.partition(":") for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:])
    return {n.strip().lower(): v.strip() for n, _, v in fields}, head + gap, payload


def record_id(page: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page} {digest}')}>"


def warc_record(arc: ArcRecord, refers_to: tuple[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record, without its closing CR LF CR LF.

    ``refers_to`` (page, row, digest) makes a revisit: the HTTP header stays, the payload goes. The filedesc record
    becomes a warcinfo record, blocks without an HTTP header a resource record.
    """
    d = arc.fields["Archive-date"].ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    url = arc.fields["URL"]
    http, head, payload = _headers(arc.block)
    page, row, digest = http.get("x-page-id", ""), http.get("x-row-id", ""), digest32(payload)
    kind = "warcinfo" if url.startswith("filedesc://") else "revisit" if refers_to else "response" if http else "resource"
    block = head if kind == "revisit" else arc.block
    lines = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(f'{page}/{row}' if http else url, digest)}", f"WARC-Date: {date}",
        f"WARC-Filename: {url[11:]}" if kind == "warcinfo" else f"WARC-Target-URI: {url or 'about:blank'}",
        "Content-Type: " + ("application/http; msgtype=response" if http else arc.fields["Content-type"]),
        f"WARC-Block-Digest: sha1:{digest32(block)}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        first, first_row, first_digest = refers_to
        lines[4:4] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(f'{first}/{first_row}', first_digest)}", f"Refers-To-Page: {first}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + END + block


def _convert(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """Pages as ARC archives of both versions, parsed and converted; one row per WARC record."""
    for chunk in W.text_chunks(batches, "html"):
        ids, urls = chunk.column("page_id").to_pylist(), chunk.column("url").to_pylist()
        refers, rows, first_rows = chunk.column("refers_to").to_pylist(), chunk.column("row").to_pylist(), chunk.column("refers_row").to_pylist()
        targets = {}
        files: dict[int, list] = {1: [], 2: []}
        for i, url, html, first, row, first_row in zip(ids, urls, chunk.column("html"), refers, rows, first_rows, strict=True):
            payload = html.as_py()
            page = "" if i is None else str(i)
            if first is not None:
                digest = digest32(payload)
                targets[page, str(row), digest] = (str(first), str(first_row), digest)
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {page}\r\nX-Row-Id: {row}\r\n\r\n"
            clean = (url or "").replace("\n", "%0A").replace("\r", "%0D")
            files[1 + (i or 0) % 2].append((clean, "text/html", head.encode() + payload))
        out = []
        for version, records in files.items():
            if records:
                name = f"pages-{ids[0]}-{len(ids)}.v{version}.arc"
                for arc in parse_arc(b"".join(arc_bytes(version, name, date, iter(records)))):
                    http, _, payload = _headers(arc.block)
                    out.append(warc_record(arc, targets.get((http["x-page-id"], http["x-row-id"], digest32(payload))) if targets and http else None))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.large_binary()).cast(pa.binary())], names=["record"])


def first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(page_id, sha1, refers_to, refers_row)`` of pages whose payload an earlier page (the smallest id) has too.

    ``pages`` has ``page_id, row, html``; ``refers_row`` is the least ``row`` of the smallest page id with the
    payload, the response that revisits point to. Only digests are shuffled; the groups are stored, so that both
    sides of the join are plain shuffles and a payload of a third of all pages is split over several tasks.
    """
    digests = pages.select("page_id", "row", F.sha1("html").alias("sha1"), F.octet_length("html").alias("size")).where(F.col("size") >= least_bytes)
    first = F.min(F.struct("page_id", "row"))
    groups = stored(digests.groupBy("sha1").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("refers_row")))
    return digests.join(groups, "sha1").where(F.col("page_id") != F.col("refers_to")).select("page_id", "sha1", "refers_to", "refers_row").distinct()


def write_warc(records: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Write rows of one binary column ``record`` as gzipped WARC files; each file is read back as one row."""
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _unzipped(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        one = zlib.decompressobj(31)
        while at < len(data) and not one.eof:
            yield one.decompress(data[at : at + step])
            at = min(at + step, len(data))
        at -= len(one.unused_data)


def parse_warc(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(fields, block)`` of each record of a WARC stream that comes in parts; names are lower-case."""
    buffer = bytearray()

    def fill(until) -> bool:
        while not until():
            part = next(parts, None)
            if part is None:
                return False
            buffer.extend(part)
        return True

    while fill(lambda: END in buffer):
        stop = buffer.index(END)
        lines = bytes(buffer[:stop]).decode("utf-8", "surrogateescape").split("\r\n")
        fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
        size, low = int(fields["content-length"]), stop + 4
        if not fill(lambda: len(buffer) >= low + size + 4):  # noqa: B023
            raise ValueError("WARC record is cut off")
        yield fields, bytes(buffer[low : low + size])
        del buffer[: low + size + 4]
    if buffer.strip():
        raise ValueError("WARC stream ends within a record header")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string()), ("digest_ok", pa.bool_())])
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for fields, block in parse_warc(_unzipped(content.as_py())):
                if fields["warc-type"] == "warcinfo":
                    continue
                http, head, payload = _headers(block)
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                page, first = http.get("x-page-id"), fields.get("refers-to-page")
                whole = fields["warc-type"] != "revisit"
                rows.append(
                    (int(page) if page else None, len(payload) if whole else int(http["content-length"]), digest, fields["warc-type"], int(first) if first else None,
                     fields["warc-record-id"], fields["warc-date"], fields.get("warc-target-uri"), digest32(payload) == digest if whole else digest32(block) == fields["warc-block-digest"].removeprefix("sha1:"))
                )
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (but warcinfo) of gzipped WARC files: page, payload size and digest, type, response of a revisit, id, date, URI."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string, digest_ok boolean")


def convert_pages(pages: DataFrame, path: str | None = None, least_bytes: int = 0, date: str = "20240101000000") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files, converted from ARC, and read them back: one row per page.

    Of pages with equal payloads of at least ``least_bytes``, the one with the smallest id is a response and the
    others revisit it. Null html is an empty payload. A null page id counts as largest and comes back as null;
    rows that repeat an id and its html have one type, a null url becomes about:blank. An empty table gives no
    rows. Every record has its own WARC-Record-ID (page, Spark row id and payload digest), repeated rows too; a
    revisit refers to the response of the least row of its first page. ``path`` defaults to a new folder beside the checkpoints.
    """
    spark = pages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/warc/{uuid.uuid4().hex}"
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(LAST)).alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"),
    )
    firsts = first_pages(rows, least_bytes)
    joined = rows.withColumn("sha1", F.sha1("html")).join(firsts, ["page_id", "sha1"], "left")
    joined = joined.select(F.when(F.col("page_id") != LAST, F.col("page_id")).alias("page_id"), "url", "html", "refers_to", "row", "refers_row")
    write_warc(joined.mapInArrow(partial(_convert, date=date), "record binary"), path)
    return read_warc(spark, path)
