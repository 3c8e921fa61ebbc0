"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Spark's text sink writes the files, on whatever file system the shared folder is: a row is an archive's bytes, and its line separator is an empty
skippable frame, which every Zstandard reader passes over.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed values of the format: Zstandard frames, WARC's dictionary frame (0x184D2A5D), and an empty skippable frame (0x184D2A50).
FRAME, DICTIONARY, EMPTY_FRAME = b"\x28\xb5\x2f\xfd", b"\x5d\x2a\x4d\x18", "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is trained on at most so many records, and bytes of each, at the head of a file.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 200, 16_384, 65_536
BYTES_PER_FILE = 64 << 20


def record_id(page_id: int | None, salt: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{salt}:{page_id}')}>"


def encode_record(row: dict) -> bytes:
    """A WARC/1.1 record of a page: response with its payload, or revisit without one. An address is percent-encoded where it would break a header line."""
    payload = (row["html"] or "").encode()
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(row['page_id'], 'page')}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8",
    ]
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if row["record_type"] == "revisit":
        head += [f"WARC-Refers-To: {record_id(row['refers_to'], 'page')}", f"X-Refers-To-Page: {row['refers_to']}", f"WARC-Profile: {PROFILE}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """The record's fields and payload; raises ValueError where version, header lines, length or digest are wrong."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] != "WARC/1.1" or any(": " not in x for x in lines[1:]):
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    missing = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest"} - fields.keys()
    if missing or not fields["Content-Length"].isdigit():
        raise ValueError(f"header fields: {sorted(missing) or 'Content-Length'}")
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"the record holds {len(rest)} bytes after its header, Content-Length says {n}")
    payload, digest = rest[:n], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or fields.get("X-Payload-Length", str(n)) != str(n)):
        raise ValueError("the payload doesn't fit its digest")
    if fields["WARC-Type"] == "revisit" and ("WARC-Refers-To" not in fields or n):
        raise ValueError("a revisit needs WARC-Refers-To and no payload")
    return {"fields": fields, "payload": payload}


def dictionary_of(samples: list[bytes]) -> bytes:
    """Trained on the samples; where they are too few or too alike for that, nothing."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes() if len(samples) > 7 else b""
    except zstandard.ZstdError:
        return b""


def frames_of(rows: Iterator[dict]) -> Iterator[bytes]:
    """The dictionary's frame, then a frame for each row; only the sample is held."""
    first: list[bytes] = []
    rest = map(encode_record, rows)
    for raw in rest:
        first.append(raw)
        if len(first) == SAMPLE_RECORDS:
            break
    if not first:
        return
    trained = dictionary_of([x[:SAMPLE_BYTES] for x in first])
    yield DICTIONARY + struct.pack("<I", len(trained)) + trained
    pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    yield from map(pack.compress, first)
    yield from map(pack.compress, rest)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, by its header and block headers."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    i = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    last = 0
    while not last:
        if i + 3 > len(data):
            raise ValueError("a frame breaks off")
        block = int.from_bytes(data[i : i + 3], "little")
        last, kind, n = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("a reserved block type")
        i += 3 + (1 if kind == 1 else n)
    i += 4 * (flags >> 2 & 1)
    if i > len(data):
        raise ValueError("a frame breaks off")
    return i


def records_of(content: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    data, at, unpack = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = bytes(data[at : at + 4])
        if magic[1:] == DICTIONARY[1:] and 0x50 <= magic[0] <= 0x5F:
            n = int.from_bytes(data[at + 4 : at + 8], "little")
            if at + 8 + n > len(data):
                raise ValueError("a skippable frame breaks off")
            if magic == DICTIONARY:
                if at:
                    raise ValueError("the dictionary must be the first frame")
                raw = bytes(data[8 : 8 + n])
                raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME else raw
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + n
        elif magic == FRAME:
            end = frame_end(data, at)
            yield decode_record(unpack.decompressobj().decompress(data[at:end]))
            at = end
        else:
            raise ValueError(f"no Zstandard frame at byte {at}")


def with_revisits(pages: DataFrame, *, min_bytes: int = 1000) -> DataFrame:
    """pages(page_id, url, html) with payload_digest, record_type and refers_to.

    Of rows with equal payloads of min_bytes or more, the one with the largest page_id is the response that the others
    revisit. Null html is an empty payload. Rows without a page_id are responses and nobody's referent. Pages that share id and
    payload are all responses. Only ids and digests are dealt out for the grouping; the payloads
    are dealt out once, for the join with its outcome.
    """
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(raw).alias("payload_digest"))
    narrow = pages.filter((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", F.sha1(raw).alias("d"), F.sha2(raw, 256).alias("k"))
    last = narrow.groupBy("k", "d").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = narrow.join(last, ["k", "d"]).filter("page_id <> refers_to").select("page_id", F.col("d").alias("payload_digest"), "refers_to").distinct()
    return keyed.join(revisits, ["page_id", "payload_digest"], "left").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def write_archives(pages: DataFrame, path: str, *, min_bytes: int = 1000, bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Archives under path, closed once they hold bytes_per_file of records, and so small enough to read whole, however the rows are dealt out; only a page that is larger by itself makes a larger file."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = lambda rows: pa.RecordBatch.from_arrays([pa.array([b"".join(frames_of(iter(rows)))], pa.binary())], ["value"])
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                held.append(row)
                size += 512 + len(row["html"] or "")
                if size >= bytes_per_file:
                    yield archive(held)
                    held, size = [], 0
        if held:
            yield archive(held)

    archives = with_revisits(pages, min_bytes=min_bytes).mapInArrow(pack, "value binary")
    # a cast of binary to string keeps the bytes as they are, and the text sink writes them so
    archives.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_FRAME).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under path: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload. A broken archive stops the job."""
    small_batches(spark)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def row(r: dict) -> dict:
        f, number = r["fields"], lambda x: None if x is None else int(x)
        url = f.get("WARC-Target-URI")
        return {
            "page_id": number(f.get("X-Page-ID")), "url": url and re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url), "record_type": f["WARC-Type"], "payload_digest": f["WARC-Payload-Digest"].removeprefix("sha1:"),
            "payload_bytes": int(f.get("X-Payload-Length", f["Content-Length"])), "refers_to": number(f.get("X-Refers-To-Page")), "payload": r["payload"],
        }

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                held, size = [], 0
                for r in records_of(content.as_py()):
                    held.append(row(r))
                    size += len(r["payload"])
                    if len(held) >= 512 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(unpack, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")
