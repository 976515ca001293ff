"""Web archives of zstandard frames: a WARC record per frame, the dictionary in the first frame.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, raw
or itself compressed; each record is one zstandard frame. The reader loads the dictionary
from there, decodes frame by frame and checks version line, headers, lengths, the record's
end and the payload digest; whatever does not hold raises an error that names archive and offset.

Pages with equal payloads are stored once: the one with the smallest page_id is a
``response``, the others are ``revisit`` records that refer to it and hold no payload.

Defined results: a null html is an empty payload; a null url becomes ``urn:page:<id>``. Of
repeated rows (equal page_id and payload) each is written, and all are ``response`` if theirs
is the smallest id. A null page_id counts as larger than any other; if it is the smallest of
its payload the record is a response. Line breaks in a url are percent-encoded. Extra columns
are dropped; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import frames as Z
from .common import as_utf8, unclash

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENDING = b"\r\n\r\n"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Sample of pages and size of the dictionary; the date of all records is a parameter of write().
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 3 << 20, 32 << 10
SCHEMA = "archive string, offset long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def record_id(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def page_of(uri: str) -> int | None:
    if not (uri.startswith("<urn:page:") and uri.endswith(">")):
        raise ValueError(f"record id {uri!r} is not of this archive")
    return None if uri[10:-1] == "null" else int(uri[10:-1])


def build_record(page, url: str | None, payload: bytes, size: int, digest: str, refers_to, is_revisit: bool, date: str) -> bytes:
    """One WARC record; its block is an HTTP response, without the body in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    target = (url or f"urn:page:{'null' if page is None else page}").replace("\r", "%0D").replace("\n", "%0A")
    lines = [f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if is_revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head = "\r\n".join(lines + [f"Content-Length: {len(block)}"])
    return VERSION + b"\r\n" + head.encode() + ENDING + block + ENDING


def parse_headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name in out:
            raise ValueError(f"bad or repeated header line {line[:80]!r}")
        out[name] = value.strip()
    return out


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a whole record, with its version, headers and lengths checked."""
    head, gap, rest = raw.partition(ENDING)
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", VERSION):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    headers = parse_headers(lines)
    if lacks := [h for h in NEEDED if h not in headers]:
        raise ValueError(f"headers missing: {', '.join(lacks)}")
    if not headers["Content-Length"].isdigit():
        raise ValueError(f"bad Content-Length {headers['Content-Length']!r}")
    if len(rest) != int(headers["Content-Length"]) + len(ENDING) or not rest.endswith(ENDING):
        raise ValueError(f"Content-Length {headers['Content-Length']}, but the block has {len(rest) - len(ENDING)} bytes")
    return headers, rest[:-len(ENDING)]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_row(raw: bytes) -> tuple:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload or None) of a page's record."""
    headers, block = parse_record(raw)
    kind = headers["WARC-Type"]
    http, gap, payload = block.partition(ENDING)
    if kind not in ("response", "revisit") or not gap or not http.startswith(b"HTTP/1."):
        raise ValueError(f"no HTTP {kind}")
    size = int(parse_headers(http.partition(b"\r\n")[2])["Content-Length"])
    algorithm, _, digest = headers["WARC-Payload-Digest"].partition(":")
    if algorithm != "sha1":
        raise ValueError(f"unknown digest {algorithm}")
    page = page_of(headers["WARC-Record-ID"])
    if kind == "revisit":
        if payload or headers.get("WARC-Profile") != PROFILE:
            raise ValueError("a revisit with a payload or of another profile")
        return page, headers["WARC-Target-URI"], kind, size, digest, page_of(headers["WARC-Refers-To"]), None
    if len(payload) != size or base32_sha1(payload) != digest:
        raise ValueError("the payload differs from its length or digest")
    return page, headers["WARC-Target-URI"], kind, size, digest, None, payload


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds digest (hex SHA-1), is_revisit and refers_to (page_id of the payload's response).

    The smallest page_id of a digest is a partial aggregation, so that a payload which a
    third of all pages share is one row per task. Only digests of several pages are joined back; the pages of
    a hot one are then the large side of a left join, which AQE splits.
    """
    sized = pages.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    shared = (sized.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= least_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    joined = sized.join(shared.select("digest", "first_page"), "digest", "left")
    later = F.col("first_page").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_page")))
    return joined.withColumn("is_revisit", later).withColumn("refers_to", F.when(later, F.col("first_page"))).drop("first_page")


def dictionary_of(pages: DataFrame) -> bytes:
    """Trained in one task on a sample bounded in pages and bytes."""

    def train(batches):
        samples, total = [], 0
        for batch in batches:
            data, offs = as_utf8(batch.column(0))
            raw = data.tobytes()
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
                if total < SAMPLE_BYTES:
                    samples.append(raw[a:min(b, a + SAMPLE_BYTES - total)])
                    total += len(samples[-1])
        yield pa.RecordBatch.from_arrays([pa.array([Z.train_dictionary(samples, DICTIONARY_BYTES)], pa.binary())], names=["data"])

    sample = Z.bounded_sample(pages, "page_id", SAMPLE_PAGES).select("html").repartition(1)
    one = sample.mapInArrow(train, "data binary").first()  # no row if Spark finds the table empty
    return bytes(one["data"]) if one else b""


def write(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write archives below ``path``, one per partition."""
    rows = unclash(pages, ["page_id", "url", "html"]).withColumn("page_id", F.col("page_id").cast("long"))
    data = dictionary_of(rows)
    # the dictionary is stored compressed, as a frame within the skippable frame
    head = Z.skippable(zstandard.ZstdCompressor(level=9).compress(data), Z.DICTIONARY_MAGIC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = Z.compressor(data)
        fresh = True
        for batch in batches:
            raw, offs = as_utf8(batch.column(2))
            raw, cut = raw.tobytes(), offs.tolist()
            page, url, digest, later, refers = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            out = [head] if fresh else []
            fresh = False
            for i in range(batch.num_rows):
                payload = raw[cut[i]:cut[i + 1]]
                b32 = base64.b32encode(bytes.fromhex(digest[i])).decode()
                out.append(press.compress(build_record(page[i], url[i], payload, len(payload), b32, refers[i], later[i], date)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    rows = with_originals(rows, least_bytes).select("page_id", "url", "html", "digest", "is_revisit", "refers_to")
    Z.write_frames(rows.mapInArrow(run, "frame binary"), path)
    return path


def archive_dictionary(content: bytes) -> bytes:
    """The dictionary of an archive's leading skippable frame; empty if it begins with a record."""
    if len(content) < 8:
        return b""
    at = next(Z.frames(content, Z.decompressor(b"")))
    if at[2] != Z.DICTIONARY_MAGIC:
        raise ValueError("an archive must begin with its dictionary")
    inner = at[3]
    if inner[:4] == zstandard.FRAME_HEADER:
        return zstandard.ZstdDecompressor().decompressobj().decompress(inner)
    return inner


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path`` (SCHEMA), with ``payload`` binary unless it isn't wanted."""
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["payload"] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = memoryview(content.as_buffer())
                rows, size, at = [], 0, 0
                try:
                    data = archive_dictionary(content)
                    for at, _, magic, raw in Z.frames(content, Z.decompressor(data)):
                        if magic:
                            continue
                        row = page_row(raw)
                        rows.append((archive, at, *(row if payloads else row[:-1])))
                        size += len(raw)
                        if size > 4 << 20:
                            yield table(rows)
                            rows, size = [], 0
                except (ValueError, KeyError) as e:
                    raise ValueError(f"{archive}, near offset {at}: {e}") from None
                if rows:
                    yield table(rows)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return Z.read_files(spark, path).mapInArrow(run, SCHEMA + ", payload binary" * payloads)


def op3_warczst(pages: DataFrame, path: str | None = None) -> DataFrame:
    """The query's digest: writes the archives, reads them back, and returns what it read."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
