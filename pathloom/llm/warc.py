"""WARC archives in which every record is its own Zstandard frame, all with one dictionary that leads the archive.

An archive is: a skippable frame (magic 0x184D2A5D) that holds the dictionary, then the frames of a warcinfo record and
of one record for each page. The dictionary is trained on records of that very archive, of which a stated number of
bytes is looked at, spread evenly over it. A page whose payload another page has too is a revisit of the smallest
page_id that has it, and holds no payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_rows

#: Fixed values of the format.
MAGIC, CRLF, VERSION, WHEN = 0x184D2A5D, b"\r\n", b"WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a dictionary, of the records it's trained on, and of payload in an archive, at most (but for its last record).
DICTIONARY, TRAINED_ON, ARCHIVE = 32_768, 2_000_000, 16_000_000


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Date": WHEN} | fields | {"Content-Length": str(len(block))}
    return b"".join([VERSION, CRLF, *(f"{k}: {v}\r\n".encode() for k, v in head.items()), CRLF, block, CRLF, CRLF])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(CRLF * 2)
    version, *lines = head.split(CRLF)
    if version != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(x.decode().split(": ", 1) for x in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != CRLF * 2:
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A resource-like record of the page; refers_to: the page_id of the response that a revisit repeats."""
    fields = {"WARC-Record-ID": _name(page_id), "WARC-Target-URI": " ".join((url or "urn:none").split()) or "urn:none", "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "X-Page-Id": "" if page_id is None else str(page_id), "X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": _name(refers_to), "X-Refers-To-Page-Id": str(refers_to)}, http)


def train(records: list[bytes]) -> bytes:
    """A dictionary for these records; of few records, the records themselves as a raw dictionary."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINED_ON))
    chosen = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY, chosen, k=256, d=8).as_bytes() if len(chosen) >= 16 else b"".join(chosen)[-DICTIONARY:]
    except zstandard.ZstdError:  # too little or too uniform to train on
        return b"".join(chosen)[-DICTIONARY:]


def write_archive(records: list[bytes], level: int = 3) -> bytes:
    data = train(records)
    c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=True)
    info = record("warcinfo", {"WARC-Record-ID": f"<{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(data).hexdigest()).urn}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
    return b"".join([struct.pack("<II", MAGIC, len(data)), data, *map(c.compress, [info, *records])])


def read_archive(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record, by the dictionary that leads the archive."""
    magic, n = struct.unpack_from("<II", archive)
    if magic != MAGIC:
        raise ValueError("no dictionary leads this archive")
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + n]))
    rest = memoryview(archive)[8 + n :]
    while rest:
        frame = d.decompressobj()
        data = frame.decompress(rest)
        rest = rest[len(rest) - len(frame.unused_data) :]
        yield parse(data)


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive binary, n_records long): whole archives that together hold a record for each row of pages.

    Null html is an empty payload; equal payloads, empty ones too, have one response, the smallest page_id; pages that
    share that page_id as well are all responses, and so are those whose payload no page with a page_id has. Other
    columns don't matter; an empty table makes no archives. The pages are shuffled once, by digest, beside the smallest
    page_id of each digest, which is found with partial sums; a payload that many pages share may be split."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    first = own.groupBy("sha1").agg(F.min("page_id").alias("first_id"))
    own = own.join(first, "sha1").select("page_id", "url", F.col("html").cast("binary").alias("html"), F.when(F.col("page_id") != F.col("first_id"), F.col("first_id")).when(F.col("page_id").isNull(), F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: batch(archive=pa.array([write_archive(held)], pa.binary()), n_records=pa.array([len(held)], pa.int64()))
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(page_record(*row))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return own.mapInArrow(run, "archive binary, n_records long")


def write(pages: DataFrame, path: str, **columns: str) -> None:
    """The archives as a Parquet table of whole files, in a folder that all executors reach. What was there is
    replaced; a table without pages makes a table without archives, which read() takes."""
    archives(pages, **columns).write.mode("overwrite").parquet(path)


def read(written: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of every page's record in the archives.
    A response's length and digest are those of the payload that was read, and must agree with its header; a revisit has
    no payload, and those of its header. Null and empty archives, and a table of none, have no records; a row that repeats
    gives its records again. Archives are read one by one, so a task holds the records of one; other columns don't matter."""

    def rows(archive: bytes) -> Iterator[tuple]:
        for f, block in read_archive(archive):
            kind = f["WARC-Type"]
            if kind == "warcinfo":
                continue
            digest, length, payload = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"]), None
            if kind == "response":
                payload = block.partition(CRLF * 2)[2]
                if (digest, length) != (payload_digest(payload), len(payload)):
                    raise ValueError("a payload isn't the one that was archived")
            number = lambda k: int(f[k]) if f.get(k) else None
            yield number("X-Page-Id"), length, digest, kind, number("X-Refers-To-Page-Id"), payload

    def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found = [x for a in b.column(0).to_pylist() if a for x in rows(a)]
        if not found:
            return None
        kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()
        names = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"
        return batch(**{n: pa.array(c, k) for n, c, k in zip(names, zip(*found, strict=True), kinds, strict=True)})

    return map_rows(written.select("archive"), run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary", rows=1)
