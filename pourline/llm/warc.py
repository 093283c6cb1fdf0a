"""WARC archives whose records are Zstandard frames with a dictionary of their own.

Every task writes one archive: a Zstandard dictionary is built from its first
records (up to ``SAMPLE_BYTES``), goes into a leading skippable frame, and every
record becomes a frame of its own that uses it, so a record can be read alone.
Equal payloads of ``LEAST_BYTES`` or more are stored once: the row of the largest
page_id is the response, the others are revisits that carry the payload's digest,
its length (the HTTP header's) and whom they refer to.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh_folder
from .store import mapped, writing

LEAST_BYTES = 1000
#: Repeated payloads (some 100 bytes each) that every executor may hold; more are joined by a shuffle, each dealt over ``SALTS`` parts.
BROADCAST_ROWS, SALTS = 200_000, 16
#: What one archive's dictionary is trained on at most, and its own size.
SAMPLE_BYTES, DICTIONARY_BYTES = 4_000_000, 64 * 1024
#: Fixed values of the format: skippable frame for a dictionary, and a Zstandard frame's start.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
EMPTY_SHA1 = hashlib.sha1(b"").hexdigest()


def _name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def _clean(value: str | None) -> str:
    """A header value in one line: control characters are percent-encoded."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header alone as its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstd.ZstdCompressionDict | None:
    """A trained dictionary, or plain content of the samples where they are too few to train on."""
    if not samples:
        return None
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, samples)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with writing(folder, f"{TaskContext.get().partitionId():06d}", ".warc.zst") as (out, uri):
            waiting, size, press = [], 0, None

            def begin() -> zstd.ZstdCompressor:
                made = dictionary(waiting)
                if made is not None:
                    packed = zstd.ZstdCompressor(level=3).compress(made.as_bytes())
                    out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
                press = zstd.ZstdCompressor(level=3, dict_data=made)
                for x in waiting:
                    out.write(press.compress(x))
                waiting.clear()
                return press

            for batch in batches:
                for row in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "digest", "refers_to", "revisit")), strict=True):
                    made = record(*row)
                    n += 1
                    if press is not None:
                        out.write(press.compress(made))
                        continue
                    waiting.append(made)
                    size += len(made)
                    if size >= SAMPLE_BYTES:
                        press = begin()
            if press is None:
                begin()
        yield pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [n]})

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one archive per task; one row per archive: uri, n_records.

    A null payload is empty.  A row without page_id is never a response that others
    refer to; if all rows of a payload have none, all are responses.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    short = F.octet_length("payload") < LEAST_BYTES
    again = durable(
        rows.where(~short)
        .groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    )
    if again.count() <= BROADCAST_ROWS:
        long = rows.where(~short).join(F.broadcast(again), "digest", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        spread = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        long = rows.where(~short).withColumn("salt", salt).join(spread, ["digest", "salt"], "left").drop("salt")
    # Short payloads are never revisits: they stay where they are, however many are equal.
    marked = long.unionByName(rows.where(short).withColumn("refers_to", F.lit(None).cast("long"))).withColumn(
        "revisit", F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    )
    return durable(marked.mapInArrow(_write(folder), "uri string, n_records long"))


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an open archive."""
    head = stream.read(8)
    made = None
    if len(head) == 8 and struct.unpack("<II", head)[0] == SKIPPABLE:
        raw = stream.read(struct.unpack("<II", head)[1])
        raw = zstd.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME else raw
        made = zstd.ZstdCompressionDict(raw)
    else:
        stream.seek(0)
    text = io.BufferedReader(zstd.ZstdDecompressor(dict_data=made).stream_reader(stream, read_across_frames=True), 1 << 16)
    while line := text.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        headers = {}
        while (line := text.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            headers[key] = value.strip()
        block = text.read(int(headers["Content-Length"]))
        text.read(4)
        yield headers, block


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            rows: list[tuple] = []
            with mapped(uri) as stream:
                for headers, block in read_records(stream):
                    kind, (http, _, payload) = headers["WARC-Type"], block.partition(b"\r\n\r\n")
                    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    length = int(http.rpartition(b"Content-Length:")[2])
                    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != said):
                        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not have its digest")
                    page, refers = headers["Page-ID"], headers.get("Refers-To-Page-ID")
                    rows.append((int(page) if page else None, headers["WARC-Target-URI"], length, said, kind, int(refers) if refers else None))
                    if len(rows) >= 5000:
                        yield _batch(rows, names)
                        rows = []
            if rows:
                yield _batch(rows, names)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    files = max(1, archives.count())
    return archives.repartition(files, "uri").mapInArrow(
        _read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages to new archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, fresh_folder(pages.sparkSession, "warc")))
