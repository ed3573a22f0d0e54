"""Web archives with a Zstandard dictionary: written by Spark's own writer, one archive per partition.

An archive is a sequence of Zstandard frames.  The first is a skippable frame (magic
0x184D2A5D) that holds a dictionary trained on the archive's own first records; every
record is a frame of its own, compressed with it.  Frames are the lines of a text
write whose line separator is itself an empty skippable frame.  So archives are
committed by Spark like any other output, on any file system, and a lost executor
leaves nothing half written.

Records with equal payloads are stored once: that of the least page id is a
``response``, the others are ``revisit`` records without a payload that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches

DICT_MAGIC = (0x184D2A5D).to_bytes(4, "little")
#: An empty skippable frame: magic 0x184D2A50 and length 0.
SEPARATOR = "P*M\x18\0\0\0\0"
DICT_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
SAMPLE_RECORDS = 256
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"
FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; the payload follows its HTTP head, a revisit ends with the head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    head += [f"X-Page-ID: {page_id}"] * (page_id is not None) + ["X-No-URL: 1"] * (url is None)
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first)}", f"X-Refers-To-Page-ID: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records; too few of them to train on serve as the dictionary's content themselves."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive, the dictionary's first; none without records."""
    samples, held = [], 0
    for r in records:
        samples.append(r)
        held += len(r)
        if held >= SAMPLE_BYTES or len(samples) >= SAMPLE_RECORDS:
            break
    if not samples:
        return
    trained = train(samples)
    yield DICT_MAGIC + len(trained).to_bytes(4, "little") + trained
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    for r in itertools.chain(samples, records):
        yield packer.compress(r)


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Archive every row of ``pages`` under ``path``.

    Null payloads are empty ones.  Rows of at least ``min_bytes`` with equal payloads share a response, that of the least
    key; rows that repeat that key and payload are responses as well.  Rows without a key are responses if no row
    with a key has the payload.  An empty table writes an archive folder without records.  Other columns are ignored.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).cast("string").alias("_url"), body.alias("_body")).withColumn("_sha", F.sha2("_body", 256))
    first = rows.where(F.octet_length("_body") >= min_bytes).groupBy("_sha").agg(F.min("_key").alias("_first"))
    named = rows.join(first, "_sha", "left").select("_key", "_url", F.when(F.octet_length("_body") >= min_bytes, F.col("_first")).alias("_first"), "_body")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in it:
                for k, u, f, x in zip(*batches(b, ["_key", "_url", "_first", "_body"]), strict=True):
                    yield record(k, u, x, f, f is not None and f != k)

        made = frames(records())
        while part := list(itertools.islice(made, 128)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary())], names=["frame"])

    named.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def parse(archive: bytes) -> Iterator[tuple]:
    """The records of one archive as rows of ``FIELDS``; a payload that does not match its digest is an error."""
    if archive[:4] != DICT_MAGIC:
        raise ValueError("the archive does not start with its dictionary")
    size = int.from_bytes(archive[4:8], "little")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    stream = io.BufferedReader(unpacker.stream_reader(io.BytesIO(memoryview(archive)[8 + size :]), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        head = {}
        while (line := stream.readline().rstrip(b"\r\n").decode()) != "":
            name, _, value = line.partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        http, _, body = block.partition(b"\r\n\r\n")
        total = int(http.rpartition(b"Content-Length: ")[2])
        named = head["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (len(body) != total or digest(body) != named):
            raise ValueError(f"payload of record {head['WARC-Record-ID']} is damaged")
        number = lambda n, head=head: int(head[n]) if n in head else None
        yield number("X-Page-ID"), None if "X-No-URL" in head else head["WARC-Target-URI"], head["WARC-Type"], number("X-Refers-To-Page-ID"), total, named, None if revisit else body


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records under ``path``: ``FIELDS``; a revisit has no payload of its own."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for content in b.column("content"):
                rows = parse(content.as_py())
                while part := list(itertools.islice(rows, 256)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(run, FIELDS)
