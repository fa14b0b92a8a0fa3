import base64
import hashlib
import struct

import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from tablelens.llm import warc
from tablelens.llm.warc import archive, parsed, read_archives, record, records_of, write_archives


@pytest.mark.parametrize("count", [0, 1, 3, 200])
def test_archives_hold_a_leading_dictionary_and_one_frame_per_record(count):
    records = [record(i, f"http://e.org/{i}\r\nX: y", (f"<p>page {i} " + "common text " * 20).encode(), None) for i in range(count)]
    blob = archive(records)
    kind, size = struct.unpack_from("<II", blob)
    assert kind == 0x184D2A5D and (size > 0 or not records)
    assert list(records_of(blob)) == records
    if count:
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(blob[8 : 8 + size]))
        assert plain.decompressobj().decompress(blob[8 + size :]) == records[0]
        assert parsed(records[0], "f")[1] == "http://e.org/0\r\nX: y"


def test_damage_is_found():
    good = record(1, "u", b"payload", None)
    with pytest.raises(ValueError, match="digest"):
        parsed(good.replace(b"\r\n\r\npayload", b"\r\n\r\npayloaD"), "f")
    blob = archive([good] * 9)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(records_of(blob[:-3]))
    with pytest.raises(ValueError, match="dictionary"):
        list(records_of(blob[8:]))


def test_round_trip_with_copies_nulls_and_long_pages(frame, spark, monkeypatch):
    rows = [(i, f"u{i}", f"<p>{i}" + "text " * 50, 1) for i in range(40)]
    rows += [(100 + i, None, "<p>hot page", 1) for i in range(300)]  # a payload that repeats
    rows += [(7000, "n", None, 1), (7001, "e", "", 1), (7002, "l", "long " * 100_000, 1), (None, "x", "<p>hot page", 1), (50, "d", "dup", 1), (50, "d", "dup", 1), (51, "d", "dup", 1)]
    table = frame(rows, "page_id long, url string, html string, archive int").repartition(5)
    folder, files = write_archives(table)
    got = read_archives(folder, files).collect()
    assert len(got) == len(rows) == sum(r.records for r in files.collect())
    first = {}
    for page_id, _, page, _ in rows:
        if page_id is not None:
            first[page or ""] = min(first.get(page or "", page_id), page_id)
    pages = {r[0]: (r[2] or "") for r in rows}
    for row in got:
        payload = pages[row.page_id].encode() if row.page_id is not None else b"<p>hot page"
        assert row.payload_bytes == len(payload)
        assert row.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        least = first[payload.decode()]
        assert (row.record_type, row.refers_to) == (("response", None) if row.page_id == least else ("revisit", least))
        assert row.payload == (payload if row.record_type == "response" else None)
    names = {f.base_name for f in fs.FileSystem.from_uri(folder)[0].get_file_info(fs.FileSelector(fs.FileSystem.from_uri(folder)[1]))}
    assert {r.archive for r in files.collect()} <= names


def test_least_bytes_and_empty_tables(frame):
    table = frame([(1, "a", "x"), (2, "b", "x"), (3, "c", "longer"), (4, "d", "longer")], "page_id long, url string, html string")
    rows = {r.page_id: r.record_type for r in read_archives(*write_archives(table, least_bytes=3)).collect()}
    assert rows == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert read_archives(*write_archives(table.limit(0))).count() == 0
