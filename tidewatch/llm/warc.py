"""WARC archives: a writer, and a sequential reader.

An archive is a file of gzip members, one per record.  Spark's text writer writes them to any
store it knows: the last byte of a gzip member is the highest of four that hold
its plain length, which is 0 below 16 MiB, so a row is a run of members without that byte and the
line separator is the byte 0.  A payload that would make a record longer goes into
continuation records of the same archive, as the standard has it.  A row holds the records of
whole pages up to some bytes and an archive so many rows, so the reader, which is given an
archive at once, needs bounded memory however much one task writes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import ship, small_batches

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes in a record at most, and compressed bytes that the reader feeds at a time.
SEGMENT_BYTES = 8 << 20
PIECE_BYTES = 1 << 16
#: An archive holds at most so many rows of so many bytes each, the last page of a row on top.
ROW_BYTES = 4 << 20
ROWS_PER_ARCHIVE = 16
LEVEL = 4

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One gzip member."""
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _name(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def records(
    page: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT_BYTES
) -> Iterator[bytes]:
    """The members of one page: a response, in segments if it is long, or a revisit without payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = None if url is None else _CONTROL.sub(lambda c: f"%{ord(c[0]):02X}", url)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    if refers_to is not None:
        yield _record([*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))], http)
        return
    if len(payload) <= segment:
        yield _record(fields, http + payload)
        return
    yield _record([*fields, ("WARC-Segment-Number", "1")], http + payload[:segment])
    for number, start in enumerate(range(segment, len(payload), segment), 2):
        last = start + segment >= len(payload)
        yield _record(
            [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{_name(page)[:-1]}:{number}>"), ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", _name(page)), ("WARC-Segment-Number", str(number)),
                ("WARC-Segment-Total-Length", str(len(http) + len(payload)) if last else None),
            ],
            payload[start : start + segment],
        )


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, row_bytes: int = ROW_BYTES,
) -> None:
    """Write a record for every row of ``pages`` to archives in ``folder``, which must be new.

    Of the rows with equal payloads of ``min_bytes`` or more, those with the largest id are
    responses and the others revisit them; rows without an id are responses only among
    themselves.  Shorter payloads are all responses.  Null payloads are empty; a null url is left out
    of its record, control characters and spaces in a url are percent-encoded.  An empty table
    gives a folder without records.  An archive holds ``ROWS_PER_ARCHIVE * row_bytes`` bytes and a page
    for each row more at most; one page is never spread over two.  Payloads are compared by SHA-1 and length; the
    rows of one payload may be a third of all, which Spark's skew join splits.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    first = rows.groupBy(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes")).agg(F.max("page").alias("first"))
    joined = rows.join(first, (rows["digest"] == first["_digest"]) & (rows["bytes"] == first["_bytes"]))
    refers = F.when((F.col("bytes") >= min_bytes) & ~F.col("page").eqNullSafe(F.col("first")), F.col("first"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for batch in small_batches(batches, 100):
            for page, url, body, refers_to in zip(*batch.columns):
                for member in records(page.as_py(), url.as_py(), body.as_py(), refers_to.as_py(), segment_bytes):
                    held += member
                if held[-1]:
                    raise ValueError("a record of 16 MiB or more: use a smaller segment_bytes")
                if len(held) >= row_bytes:
                    yield row(held)
                    held = bytearray()
        if held:
            yield row(held)

    def row(held: bytearray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bytes(held[:-1])], pa.binary())], ["members"])

    rows = joined.select("page", "url", "payload", refers.alias("refers_to")).mapInArrow(packed, "members binary")
    lines = rows.select(F.col("members").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", ROWS_PER_ARCHIVE).text(folder)


def members_of(data: bytes, piece: int = PIECE_BYTES) -> Iterator[bytes]:
    """The plain bytes of each gzip member, decompressed piece by piece."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpacker, plain = zlib.decompressobj(31), bytearray()
        while not unpacker.eof:
            if at >= len(data):
                raise ValueError("the last record is cut off")
            part = view[at : at + piece]
            plain += unpacker.decompress(part)
            at += len(part)
        at -= len(unpacker.unused_data)
        yield bytes(plain)


def _framed(plain: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record, framed by its length and verified by its digest."""
    head, _, rest = plain.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    if not version.startswith("WARC/1.") or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('WARC-Record-ID')}: wrong framing")
    block = rest[:length]
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"{fields['WARC-Record-ID']}: wrong block digest")
    return fields, block


def _page(name: str | None) -> int | None:
    number = (name or "none").strip("<>").rpartition(":")[2]
    return None if number == "none" else int(number)


def read_records(data: bytes, piece: int = PIECE_BYTES) -> Iterator[tuple]:
    """(page, url, payload, payload length, digest, type, refers to) of each page in an archive.

    The payload of a revisit is None; its length and digest are those of the page it stands
    for.  Segments are joined.  Wrong framing, lengths or digests raise ValueError.
    """
    waiting: tuple[dict[str, str], list[bytes]] | None = None
    for plain in members_of(data, piece):
        fields, block = _framed(plain)
        if fields["WARC-Type"] == "continuation":
            if waiting is None or fields["WARC-Segment-Origin-ID"] != waiting[0]["WARC-Record-ID"]:
                raise ValueError(f"{fields['WARC-Record-ID']}: continues nothing")
            waiting[1].append(block)
            if "WARC-Segment-Total-Length" not in fields:
                continue
            fields, block = waiting[0], b"".join(waiting[1])
            waiting = None
        elif waiting is not None:
            raise ValueError(f"{waiting[0]['WARC-Record-ID']}: a segment is missing")
        elif "WARC-Segment-Number" in fields:
            waiting = fields, [block]
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        length = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        whole = fields["WARC-Type"] == "response"
        if whole and (len(payload) != length or base32_sha1(payload) != digest):
            raise ValueError(f"{fields['WARC-Record-ID']}: wrong payload")
        yield (
            _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload if whole else None, length, digest,
            fields["WARC-Type"], _page(fields.get("WARC-Refers-To")),
        )
    if waiting is not None:
        raise ValueError(f"{waiting[0]['WARC-Record-ID']}: a segment is missing")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    One row per page of all archives in ``folder``, each read from its start to its end by
    one task; ``payload`` is left out without ``payloads``, and null for revisits.
    """
    ship(spark)
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kept = [k for k, name in enumerate(names) if payloads or name != "payload"]
    if not payloads:
        schema = schema.replace("payload binary, ", "")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for row in read_records(data.as_py()):
                    rows.append(row)
                    held += len(row[2] or b"") if payloads else 100
                    if held > SEGMENT_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[k]) for k in kept], [names[k] for k in kept])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(opened, schema)
