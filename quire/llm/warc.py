"""WARC archives compressed with Zstandard: one frame a record, after a skippable frame that holds the dictionary.

``archive`` marks which rows are responses and which revisit one, writes the records to files in the shared folder
and gives a table of the files; ``read`` gives a row for each record of such files, after checks of headers, lengths
and digests. File names are new in every attempt, and only those in the written table count, so an attempt that is
lost or repeated leaves nothing but an unread file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import file_system, scratch, text_of, written

#: Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes after which a new file begins; level; dictionary bytes; rows and bytes of each that it may be trained on.
FILE_BYTES, LEVEL, DICT_BYTES, DICT_ROWS, DICT_ROW_BYTES = 32 << 20, 3, 32 << 10, 400, 8 << 10
RECORD = "record_id string, page_id long, record_type string, target_uri string, refers_to long, payload_digest string, payload_bytes long, payload binary, file string, frame long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise ValueError(f"record id {name!r}")
    return int(name[10:-1]) if name[10:-1] else None


def target(url: str | None) -> str:
    """A header's value for the URL: white space, control characters and per cent signs as %XX."""
    return "".join(f"%{b:02X}" if b <= 32 or b in (37, 127) else chr(b) for b in (url or "").encode()).encode("latin-1").decode("utf-8")


def untarget(value: str) -> str:
    raw, out, i = value.encode(), bytearray(), 0
    while i < len(raw):
        if raw[i] == 37:
            out.append(int(raw[i + 1 : i + 3], 16))
            i += 3
        else:
            out.append(raw[i])
            i += 1
    return out.decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, with the length of the payload that it leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_name(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target(url)}",
        f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of headers")
    first, *lines = head.split(b"\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"header {line[:80]!r}")
        fields[name.decode().lower()] = value.strip().decode()
    return {"": first.decode(), **fields}, rest


def parse(raw: bytes, with_payload: bool = True) -> dict:
    """The columns of one record; ValueError where headers, lengths or the digest are not right."""
    fields, rest = headers_of(raw)
    if fields[""].encode() != VERSION:
        raise ValueError(f"version {fields['']!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, not {size}")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    http, payload = headers_of(rest[:size])
    length = int(http["content-length"])
    if kind == "response":
        if len(payload) != length:
            raise ValueError(f"payload of {len(payload)} bytes, not {length}")
        if base32(hashlib.sha1(payload).digest()) != digest:
            raise ValueError("digest of the payload")
    elif kind != "revisit" or payload or fields.get("warc-profile") != PROFILE or "warc-refers-to" not in fields:
        raise ValueError(f"type {kind!r}")
    name = fields["warc-record-id"]
    return {
        "record_id": name, "page_id": page_of(name), "record_type": kind, "target_uri": untarget(fields.get("warc-target-uri", "")),
        "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None, "payload_digest": digest,
        "payload_bytes": length, "payload": payload if with_payload and kind == "response" else None,
    }


def dictionary_frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(data)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary for such payloads; where they are too few to train one, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        joined = b"".join(samples)[:size]
        return joined if len(joined) >= 8 else VERSION


def frames(stream) -> Iterator[tuple[int, bytes]]:
    """(number, content) of each frame after the leading dictionary. Holds one record and a block of input at a time."""
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("the leading frame is not a skippable one")
    held = stream.read(size)
    if len(held) != size:
        raise ValueError("the dictionary is cut off")
    if held[:4] == struct.pack("<I", FRAME):
        held = zstandard.ZstdDecompressor().decompress(held)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    number, rest = 0, stream.read(1 << 20)
    while rest:
        if len(rest) >= 4 and rest[:4] != struct.pack("<I", FRAME):
            raise ValueError(f"frame {number} has no magic number")
        one, parts = reader.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                break
            if not (rest := stream.read(1 << 20)):
                raise ValueError(f"frame {number} is cut off")
        yield number, b"".join(parts)
        number, rest = number + 1, one.unused_data or stream.read(1 << 20)


def archive(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write pages to archives below folder (one of the shared scratch by default); a table (file, records, bytes).

    Of records with equal payloads of at least min_bytes bytes, those with the largest page_id are responses and the
    others revisit it; smaller ones are all responses, as are rows with a null page_id. A null html is an empty
    payload, a null url an empty one. Repeated rows make a record each; an empty table makes no file.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    raw = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_of(html).cast("binary").alias("payload"))
    keyed = raw.withColumn("digest", F.sha1("payload"))
    groups = keyed.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    marked = keyed.join(groups.select("digest", "last"), "digest", "left").select("page_id", "url", "payload", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))
    samples = [bytes(r[0]) for r in raw.select(F.substring("payload", 1, DICT_ROW_BYTES)).limit(DICT_ROWS).collect()]
    words = train_dictionary(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
        out, name, made, size, done = None, "", 0, 0, []
        try:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                    number, link, payload, refers = (v.as_py() for v in row)
                    if out is None:
                        name, made = f"{uuid.uuid4().hex}.warc.zst", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        size = out.write(dictionary_frame(words))
                    frame = packer.compress(record(number, link, payload, refers, refers is not None))
                    out.write(frame)
                    made, size = made + 1, size + len(frame)
                    if size >= FILE_BYTES:
                        out.close()
                        out = None
                        done.append((f"{folder}/{name}", made, size))
            if out is not None:
                out.close()
                out = None
                done.append((f"{folder}/{name}", made, size))
        finally:
            if out is not None:
                out.close()
        files, counts, sizes = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "records", "bytes"])

    return written(marked.mapInArrow(run, "file string, records long, bytes long"), "archives")


def read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row (RECORD) for each record of the archives in column file; a ValueError fails the job, with file and frame."""
    schema = RECORD if with_payload else RECORD.replace(", payload binary", "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "frame": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)

        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = file_system(file)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for number, raw in frames(stream):
                        try:
                            rows.append(parse(raw, with_payload) | {"file": file, "frame": number})
                        except ValueError as error:
                            raise ValueError(f"{file}, frame {number}: {error}") from error
                        held += len(raw) if with_payload else 300
                        if held >= 8 << 20:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    count = files.count()
    return files.select("file").repartition(max(1, min(count, 100_000))).mapInArrow(run, schema)


def stored(pages: DataFrame, folder: str | None = None, **names) -> DataFrame:
    """The records of pages, without payloads, after a round through archives. Each revisit's length and digest are held against its response's."""
    found = written(read(archive(pages, folder, **names), with_payload=False), "records")
    kept = found.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).distinct()
    again = found.filter("record_type = 'revisit'").join(kept, "refers_to", "left")
    right = (F.col("d") == F.col("payload_digest")) & (F.col("b") == F.col("payload_bytes"))
    checked = again.withColumn("page_id", F.when(F.coalesce(right, F.lit(False)), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("revisit without its response: "), "record_id")).cast("long")))
    return found.filter("record_type = 'response'").unionByName(checked.select(found.columns))
