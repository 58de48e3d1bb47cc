"""Web archives: one Zstandard frame per record behind a dictionary frame."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from probeline.llm.common import batch
from probeline.llm.files import read_files, write_file

#: Magic numbers of a skippable frame that holds a dictionary, of a dictionary and of a data frame (fixed values).
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437
FRAME_MAGIC = 0xFD2FB528
#: An archive is closed at this many payload bytes; its dictionary is trained on its first records.
ARCHIVE_BYTES = 16 << 20
TRAINED_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
LEAST_PAYLOAD = 1000
#: Bytes of an archive handed to the decoder at once.
STEP_BYTES = 16 << 10
_RECORD_TYPES = {"response": "application/http;msgtype=response", "revisit": "application/http;msgtype=response"}


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, original: int | None) -> bytes:
    """One WARC record; ``original`` is the page a revisit refers to."""
    kind = "response" if original is None else "revisit"
    # a revisit has no body; the digest and the length of its payload stand in the header
    body = payload if kind == "response" else b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    named = lambda p: "<urn:page:null>" if p is None else f"<urn:page:{p}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {named(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if original is not None:
        head.append(f"WARC-Refers-To: {named(original)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += [f"Content-Type: {_RECORD_TYPES[kind]}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A leading skippable frame with the dictionary, then a frame per record. Few or small records give an
    empty dictionary and plain frames."""
    sample, size = [], 0
    for one in records:
        if size >= TRAINED_BYTES:
            break
        sample.append(one)
        size += len(one)
    try:
        trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, size // 8 + 256), sample).as_bytes()
    except zstandard.ZstdError:
        trained = b""
    out = [DICTIONARY_FRAME.to_bytes(4, "little"), len(trained).to_bytes(4, "little"), trained]
    held = zstandard.ZstdCompressionDict(trained) if trained else None
    writer = zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=True, write_checksum=True)
    return b"".join(out + [writer.compress(one) for one in records])


def frames(content: bytes) -> Iterator[bytes]:
    """Decode the frames of an archive one by one."""
    if int.from_bytes(content[:4], "little") != DICTIONARY_FRAME or len(content) < 8:
        raise ValueError("the archive has no leading dictionary frame")
    at = 8 + int.from_bytes(content[4:8], "little")
    trained = content[8:at]
    if at > len(content):
        raise ValueError("the dictionary frame is cut short")
    if trained[:4] == FRAME_MAGIC.to_bytes(4, "little"):  # the dictionary itself may be compressed
        trained = zstandard.ZstdDecompressor().decompress(trained)
    if trained and trained[:4] != DICTIONARY_MAGIC.to_bytes(4, "little"):
        raise ValueError("the dictionary frame holds no dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    view = memoryview(content)
    while at < len(content):
        if content[at : at + 4] != FRAME_MAGIC.to_bytes(4, "little"):
            raise ValueError(f"no frame begins at byte {at}")
        walk, out = reader.decompressobj(), []
        while not walk.eof:  # in small steps, as what a step holds beyond the frame is copied
            if at >= len(content):
                raise ValueError("the last frame is cut short")
            out.append(walk.decompress(view[at : at + STEP_BYTES]))
            at += STEP_BYTES
        at = min(at, len(content)) - len(walk.unused_data)
        yield b"".join(out)


def parsed(one: bytes) -> dict:
    """Fields of a record; version, headers, lengths and the payload digest must be right."""
    head, found, rest = one.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length is not Content-Length")
    payload = rest[:length].partition(b"\r\n\r\n")[2]
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    full = int(fields["warc-payload-length"]) if "warc-payload-length" in fields else None if revisit else len(payload)
    if not revisit and (full != len(payload) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload does not match its length and digest")
    page = lambda name: (
        int(at) if (at := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")).lstrip("-").isdigit() else None
    )
    return {
        "page_id": page("warc-record-id"),
        "url": fields.get("warc-target-uri", ""),
        "payload": None if revisit else payload,
        "payload_bytes": full,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": page("warc-refers-to") if revisit else None,
    }


def with_originals(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``page_id, url, html, digest, original``: the page a revisit refers to, null for a response.

    Equal payloads of ``least`` bytes or more share the record of the largest ``page_id``; the largest is found by
    a map-side combined maximum, and the join back is one that Spark splits where a payload is hot. Smaller pages
    get keys of their own there, which match none and spread. Pages without an id, and repeats of the largest one,
    are responses.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    large = F.octet_length("html") >= least
    largest = keyed.where(large).groupBy("digest").agg(F.max("page_id").alias("largest"))
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    found = keyed.withColumn("shared", F.when(large, F.col("digest")).otherwise(own)).join(
        largest.withColumnRenamed("digest", "shared"), "shared", "left"
    )
    original = F.when(F.col("page_id") < F.col("largest"), F.col("largest"))
    return found.select("page_id", "url", "html", "digest", original.alias("original"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Write all pages as records into archives of ``folder``; gives ``name, records`` per archive.

    The result is lazy: an action on it writes. Records stay in the partitions in which they met their originals,
    by page id within each, so a repeated attempt writes the same bytes under the same name. A null html is an
    empty payload; other columns are ignored.
    """
    ordered = with_originals(pages, least).sortWithinPartitions("page_id", "digest", "url")
    schema = pa.schema([("name", pa.string()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{seq:06d}.warc.zst"
            write_file(folder, name, archive(held))
            return batch({"name": [name], "records": [len(held)]}, schema)

        for rows in batches:
            columns = [rows.column(c) for c in ("page_id", "url", "html", "digest", "original")]
            for k in range(rows.num_rows):
                page, url, html, digest, original = (c[k].as_py() for c in columns)
                held.append(record(page, url, html.encode(), digest, original))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    seq, held, size = seq + 1, [], 0
        if held:
            yield close()

    return ordered.mapInArrow(write, "name string, records bigint")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives; a damaged archive stops the read with what is wrong."""
    fields = [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ] + [("url", pa.string()), ("payload", pa.binary())] * with_payload
    schema = pa.schema(fields)
    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for content in rows.column("content"):
                held = []
                for one in frames(content.as_py()):
                    held.append(parsed(one))
                    if len(held) == 1000:
                        yield batch({f.name: [h[f.name] for h in held] for f in schema}, schema)
                        held = []
                if held:
                    yield batch({f.name: [h[f.name] for h in held] for f in schema}, schema)

    return read_files(spark, folder).mapInArrow(read, ddl + ", url string, payload binary" * with_payload)
