"""Web archives (WARC) with a Zstandard dictionary per file."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tablelens.llm.common import pin_batches, shared_folder, written

SKIPPABLE = 0x184D2A5D  # fixed value: frame type of a leading dictionary
ARCHIVE_BYTES = 16_000_000  # of records before compression, per file
DICTIONARY_BYTES = 65_536
LEVEL = 6
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
_FILE = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("archive", pa.string()),
])


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the page with the same payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        # a header line cannot hold line ends
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda c: f"%{ord(c[0]):02X}", url))
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}",
        ]
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body += b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A trained dictionary; of too few records to train on, their own bytes (none if there are under 8)."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        own = b"".join(records)[:DICTIONARY_BYTES]
        return own if len(own) >= 8 else b""


def archive(records: list[bytes]) -> bytes:
    """A file: the dictionary in a skippable frame, then every record as a frame of its own."""
    shared = dictionary(records)
    kind = zstandard.DICT_TYPE_AUTO
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared, dict_type=kind) if shared else None)
    return struct.pack("<II", SKIPPABLE, len(shared)) + shared + b"".join(packer.compress(one) for one in records)


def records_of(blob: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of a file, one frame after the other."""
    kind, size = struct.unpack_from("<II", blob)
    if kind != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    shared = blob[8 : 8 + size]
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
    at, view = 8 + size, memoryview(blob)
    while at < len(blob):
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if at >= len(blob):
                raise ValueError("the archive ends inside a record")
            piece = view[at : at + step]
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def parsed(raw: bytes, file: str) -> tuple:
    """The fields of a record; a response's payload must match its digest."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    page = fields["WARC-Record-ID"][len("<urn:x-page:") : -1]
    other = fields.get("WARC-Refers-To")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        if payload_digest(payload) != digest or len(payload) != int(fields["X-Payload-Length"]):
            raise ValueError(f"{file}: the payload of page {page} does not match its digest")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = re.sub("%([0-9A-F]{2})", lambda c: chr(int(c[1], 16)), url)
    return (
        None if page == "none" else int(page), url, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"],
        int(other[len("<urn:x-page:") : -1]) if other else None, payload, file,
    )


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        waiting: list[bytes] = []

        def flush() -> pa.RecordBatch:
            # a name of its own per attempt: a repeated task leaves a file that no list names
            name, blob = f"pages-{uuid.uuid4().hex}.warc.zst", archive(waiting)
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(blob)
            done = pa.RecordBatch.from_pydict({"archive": [name], "records": [len(waiting)], "bytes": [len(blob)]}, schema=_FILE)
            waiting.clear()
            return done

        held = 0
        for batch in batches:
            for cells in zip(*(batch.column(k).to_pylist() for k in range(4))):
                one = record(*cells)
                waiting.append(one)
                held += len(one)
                if held >= ARCHIVE_BYTES:
                    yield flush()
                    held = 0
        if waiting:
            yield flush()

    return write


def _read(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{path}/{name}") as file:
                    blob = file.read()
                rows, size = [], 0
                for raw in records_of(blob):
                    row = parsed(raw, name)
                    rows.append(row if with_payload else (*row[:6], None, name))
                    size += len(raw) if with_payload else 300
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RECORD)], schema=_RECORD)

    return read


def write_archives(
    df: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    least_bytes: int = 0,
) -> tuple[str, DataFrame]:
    """Write a WARC record per page; returns the folder and the list of files (``archive``, ``records``, ``bytes``).

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is a response, the
    others revisit it. Only digests that occur more than once are joined back, on digest and one of 16
    salts, so a hot payload spreads. Each task fills files of about 16 MB of records, builds a dictionary from a file's
    records and compresses them one by one. The list is a table in the shared folder: a task that is repeated
    writes files of other names, and only listed files are read.

    Null html is an empty payload, a null url is left out; rows that repeat the smallest id are all responses, other repeated
    rows revisits; rows without an id take part, but are nobody's response unless all with that payload are such.
    Other columns are not archived.
    """
    spark = pin_batches(df.sparkSession)
    folder = folder or shared_folder(spark, "archives")
    payload = F.coalesce(F.col(f"`{html_column}`"), F.lit("")).cast("binary")
    pages = df.select(
        F.col(f"`{id_column}`").cast("long").alias("page_id"), F.col(f"`{url_column}`").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    groups = pages.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first")
    )
    groups = groups.where("n > 1").select(F.col("digest").alias("same"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("own"))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, (salted["digest"] == groups["same"]) & (salted["salt"] == groups["own"]), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = joined.select("page_id", "url", "payload", refers.alias("refers_to"))
    return folder, written(rows.mapInArrow(_write(folder), from_arrow_schema(_FILE)), "archive-list")


def read_archives(folder: str, files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the listed files; each payload is checked against its digest, files are read whole, one at a time."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("archive").repartition(parts, "archive")
    return dealt.mapInArrow(_read(folder, with_payload), from_arrow_schema(_RECORD))


ARCHIVE_SQL = """
WITH pages_ AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS digest FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM pages_ GROUP BY digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(digest, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM pages_ JOIN firsts USING (digest)
"""
