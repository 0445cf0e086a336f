import base64
import hashlib
import io
import struct

import pytest
import zstandard

from quire.llm import warc
from quire.llm.common import file_system

ROWS = [(1, "http://a/ b%\r\nX: y", "<p>same"), (4, None, "<p>same"), (2, "u", "<p>same"), (3, "ü", "é" * 3000), (5, "x", None), (6, "x", ""), (None, "n", "<p>same"), (8, "l", "long " * 200_000), (8, "l", "long " * 200_000)]


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        last = max((j for j, _, g in rows if j is not None and (g or "").encode() == data), default=None)
        again = i is not None and len(data) >= least and i < last
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    found = warc.stored(pages, min_bytes=least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(ROWS, least)
    assert warc.stored(pages.limit(0)).count() == 0


def test_payloads_and_urls_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1)  # a file a record
    pages = spark.createDataFrame([(i, u, f"{h}{i}") for i, u, h in ROWS if i], "page_id long, url string, html string").distinct()
    files = warc.archive(pages)
    got = sorted((r["page_id"], r["target_uri"], bytes(r["payload"]).decode()) for r in warc.read(files).collect())
    assert got == sorted((r["page_id"], r["url"] or "", r["html"]) for r in pages.collect())
    fs, path = file_system(files.first()["file"])
    with fs.open_input_stream(path, compression=None) as stream:
        assert struct.unpack("<I", stream.read(4))[0] == warc.SKIPPABLE


def pack(*records, words=b"dictionary bytes"):
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    return warc.dictionary_frame(words) + b"".join(packer.compress(r) for r in records)


def test_what_is_wrong_is_refused():
    fine = warc.record(1, "u", b"payload")
    assert [n for n, _ in warc.frames(io.BytesIO(pack(fine, fine)))] == [0, 1]
    assert warc.parse(fine)["payload"] == b"payload"
    for bad in (b"", pack(fine)[8:], pack(fine)[:-3], pack(fine) + b"junk!", warc.dictionary_frame(b"dictionary bytes")[:-1]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(io.BytesIO(bad)))
    for bad in (fine[:-1], fine.replace(b"payload\r", b"paYload\r"), fine.replace(b"WARC/1.1", b"WARC/0.9"), fine.replace(b"WARC-Date", b"WARC-Day"), fine.replace(b"Length: 7", b"Length: 8"), b"WARC/1.1\r\n"):
        with pytest.raises(ValueError):
            warc.parse(bad)
