"""WARC writer and reader with a Zstandard dictionary in each archive.

Each partition becomes archives of about ``archive_bytes`` of records (before compression): a
dictionary is built from an archive's first records, at most ``sample_bytes`` of them, stored in a
leading skippable frame, and every record is a frame of its own, compressed with that dictionary.
A record whose payload equals that of another is a revisit of
the one with the smallest id.

Archives go to a folder that all nodes share, each written under another name and renamed when it
is whole; records are in order of id and payload, so a task that runs again replaces its archives by
the same. They are read back with Spark's binary reader, which takes an archive at a time.

Defined results: a null payload is empty, a null URL leaves the header out, rows with a null id are
always responses and are read back without an id, rows that repeat an id and payload are all
responses if that id is the smallest, else all revisits.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlescan.llm.common import mounted, prepare, with_columns, write_file

#: Fixed values of the formats: the skippable frame that holds a dictionary, the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:record:"
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>]")
RECORD = "id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def later_copies(pages: DataFrame, page_id: str, payload: str, min_bytes: int) -> DataFrame:
    """(_page, _first): for each id that comes after the smallest with one of its payloads, a map from
    that payload's digest to the smallest id. Payloads stay out of the exchange that finds it."""
    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("_payload").to_pylist()]
        return [pa.array([sha1_base32(r) for r in raw], pa.string()), pa.array([len(r) for r in raw], pa.int64())]

    own = pages.select(F.col(f"`{page_id}`").alias("_id"), F.col(f"`{payload}`").alias("_payload"))
    small = (with_columns(own, make, "_digest string, _bytes bigint", ["_id"])
             .filter(F.col("_id").isNotNull() & (F.col("_bytes") >= min_bytes)))
    first = (small.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") > 1).drop("_n"))
    return (small.select("_digest", "_id").join(first, "_digest").filter(F.col("_id") > F.col("_first")).distinct()
            .groupBy(F.col("_id").alias("_page"))
            .agg(F.map_from_entries(F.collect_list(F.struct("_digest", "_first"))).alias("_firsts")))


def record(page: int | None, url: str | None, payload: bytes, first: int | None, digest: str) -> bytes:
    """One WARC record: an HTTP response, or for a revisit its header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}",
            f"WARC-Record-ID: <{_ID}{'' if page is None else page}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if first is not None:
        head += [f"WARC-Refers-To: <{_ID}{first}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join([*head, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def dictionary(sample: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """Trained on the sample, or the sample's own bytes where there is too little to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, sample)) // 8)), sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: Iterator[bytes], level: int, dictionary_bytes: int, sample_bytes: int) -> Iterator[bytes]:
    """The bytes of an archive: the dictionary's frame, then a frame for each record."""
    sample, total = [], 0
    for r in records:
        sample.append(r)
        total += len(r)
        if total >= sample_bytes:
            break
    own = dictionary(sample, dictionary_bytes)
    raw = own.as_bytes()
    yield struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
    writer = zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True)
    for r in itertools.chain(sample, records):
        yield writer.compress(r)


def upto(records: Iterator[bytes], size: int) -> Iterator[bytes]:
    """Records until they come to size bytes; the rest stays."""
    total = 0
    for r in records:
        yield r
        total += len(r)
        if total >= size:
            return


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
          min_bytes: int = 0, level: int = 3, dictionary_bytes: int = 32 << 10, sample_bytes: int = 2 << 20,
          archive_bytes: int = 256 << 20) -> DataFrame:
    """Write the archives into folder, shared by all nodes. Returns (path, n_records); nothing is
    written before that is evaluated. Payloads shorter than min_bytes are never revisits."""
    prepare(pages.sparkSession)
    target = mounted(folder)
    os.makedirs(target, exist_ok=True)
    own = pages.select(F.col(f"`{page_id}`").cast("long").alias("_id"), F.col(f"`{url}`").alias("_url"),
                       F.col(f"`{payload}`").alias("_payload"))
    again = later_copies(pages, page_id, payload, min_bytes)
    rows = (own.join(again, own["_id"] == again["_page"], "left")
            .select("_id", "_url", "_payload", "_firsts").sortWithinPartitions("_id", F.xxhash64("_payload"), "_url"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0

        def records() -> Iterator[bytes]:
            nonlocal count
            for batch in batches:
                for page, link, text, firsts in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    digest = sha1_base32(raw)
                    count += 1
                    yield record(page, link, raw, dict(firsts or ()).get(digest), digest)

        todo = records()
        for number in itertools.count():
            before, head = count, next(todo, None)
            if head is None:
                return
            path = f"{target}/part-{TaskContext.get().partitionId():06d}-{number:05d}.warc.zst"
            own = upto(itertools.chain([head], todo), archive_bytes)
            write_file(path, archive(own, level, dictionary_bytes, sample_bytes))
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count - before], pa.int64())], ["path", "n_records"])

    return rows.mapInArrow(stage, "path string, n_records bigint")


def frames(raw: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    own = zstandard.ZstdCompressionDict(raw[8:8 + size])
    reader = zstandard.ZstdDecompressor(dict_data=own)
    at, view = 8 + size, memoryview(raw)
    while at < len(raw):
        one, out = reader.decompressobj(), []
        while not one.eof:
            part = view[at:at + (16 << 10)]
            if not part:
                raise ValueError("the archive is cut short")
            out.append(one.decompress(part))
            at += len(part) - len(one.unused_data)
        yield b"".join(out)


def parsed(raw: bytes) -> dict:
    """The columns of RECORD from a record; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: int(x[len(_ID) + 1:-1]) if x and len(x) > len(_ID) + 2 else None
    return {"id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "refers_to": number(fields.get("WARC-Refers-To")), "payload_digest": digest, "payload_bytes": size,
            "payload": payload if response else None}


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the archives in folder, as RECORD; payload null without payloads."""
    prepare(spark)
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                todo = map(parsed, frames(raw.as_py()))
                while part := list(itertools.islice(todo, 256)):
                    if not payloads:
                        part = [p | {"payload": None} for p in part]
                    yield pa.RecordBatch.from_arrays([pa.array([p[n] for p in part], t) for n, t in zip(names, types)], names)

    archives = (spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content"))
    return archives.mapInArrow(stage, RECORD)
