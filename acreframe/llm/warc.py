"""Web archives: WARC records in Zstandard archives with a dictionary, written and read back.

An archive begins with a skippable frame that holds the dictionary; each record is a frame of its own, compressed with that
dictionary, so any record can be decoded alone. The reader loads the dictionary from the leading frame, decodes one frame
for each record and checks the version line, the headers that every record must have, the lengths and the digests.

Of records with equal payloads that with the largest id is the response and the others are revisits without a payload.
Archives are files in the shared folder, of ``ARCHIVE_BYTES`` at most or one record; a table of their paths lists those of
tasks that ended well, so what a lost task left is never read.

Defined results: a null payload counts as empty, empty payloads are equal; a null url is written as ``urn:none``; a null id
counts as the smallest; of repeated rows of one id the payloads count for themselves.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreframe.llm._shared import class_sample, file_system, group_attach, mapped, scratch, slices, written

ARCHIVE_BYTES = 128 << 20
DICTIONARY_BYTES = 48 << 10
DICTIONARY_PAGES = 400
# The skippable frame of a dictionary, and the frame of a dictionary in the format's own layout (fixed values).
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
NEEDED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
DATE = b"2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train(payloads: list[bytes]) -> bytes:
    """A dictionary from some payloads; empty where they are too few to train on."""
    import zstandard

    if len(payloads) < 16 or sum(map(len, payloads)) < 16 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record, uncompressed."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    target = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>".encode(),
        b"WARC-Date: " + DATE,
        b"WARC-Target-URI: " + target.encode("utf-8", "surrogatepass"),
        f"WARC-Payload-Digest: sha1:{digest}".encode(),
        b"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}".encode(),
    ]
    if revisit:
        lines += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record; ValueError where a header is missing or wrong or a length does not hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION or not gap:
        raise ValueError("no version line or no end of the headers")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("a header without a name")
        fields[name.strip().lower()] = value.strip()
    if missing := [n for n in NEEDED if n not in fields]:
        raise ValueError(f"headers are missing: {missing}")
    length = int(fields[b"content-length"])
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length does not hold")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no HTTP headers")
    stated = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields[b"warc-type"].decode()
    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    if kind == "response" and (stated != len(payload) or payload_digest(payload) != digest):
        raise ValueError("the payload's length or digest does not hold")
    if kind == "revisit" and (payload or b"warc-refers-to" not in fields):
        raise ValueError("a revisit with a payload or without its response")
    page, refers = (_page(fields.get(x)) for x in (b"warc-record-id", b"warc-refers-to"))
    return {"page": page, "url": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), "bytes": stated, "digest": digest, "type": kind, "refers": refers, "payload": payload if kind == "response" else None}


def _page(value: bytes | None) -> int | None:
    number = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(number) if number else None


def read_archive(stream):
    """The records of an archive, from a binary stream, one frame at a time."""
    import zstandard

    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("the archive has no leading frame")
    magic, size = struct.unpack("<II", head)
    dictionary = stream.read(size)
    if magic != SKIPPABLE or len(dictionary) != size:
        raise ValueError("the archive does not lead with its dictionary")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if size else None)
    rest = b""
    while True:
        one, out, begun = reader.decompressobj(), [], bool(rest)
        while not one.eof:
            if not rest:
                rest = stream.read(1 << 18)
                if not rest:
                    break
                begun = True
            out.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        if not one.eof:
            if begun:
                raise ValueError("the archive ends inside a record")
            return
        yield parse(b"".join(out))


def write_archives(rows: DataFrame, dictionary: bytes, folder: str, page: str, url: str, packed: str) -> DataFrame:
    """Paths and record counts of the archives that the rows' records went to."""
    shipped = rows.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        import zstandard

        data = zstandard.ZstdCompressionDict(shipped.value) if shipped.value else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True).compress
        unpack = zstandard.ZstdDecompressor(dict_data=data).decompress
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0
        done = []
        try:
            for part in slices(batches):
                for p, u, body, digest, last in zip(*(part.column(c).to_pylist() for c in (page, url, packed, "digest", "last")), strict=True):
                    if out is None:
                        name, size, n = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                        out = fs.open_output_stream(f"{root}/{name}")
                        out.write(leading_frame(shipped.value))
                    frame = pack(record(p, u, unpack(body), digest, last, last != p))
                    out.write(frame)
                    size, n = size + len(frame), n + 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((name, n))
                        out = None
        finally:
            if out is not None:
                out.close()
                done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["archive", "records"])

    return mapped(rows, run, "archive string, records bigint")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of archives in ``folder``, a row each; each task streams the archives it was given."""

    def run(batches):
        fs, root = file_system(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
        fields = ["page", "url", "bytes", "digest", "type", "refers", *["payload"] * with_payload]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([r[f] for r in out], k) for f, k in zip(fields, kinds, strict=True)], names=names)

        for part in batches:
            for name in part.column(0).to_pylist():
                out, held = [], 0
                with fs.open_input_stream(f"{root}/{name}") as stream:
                    for r in read_archive(stream):
                        out.append(r)
                        held += len(r["payload"] or b"") if with_payload else 1000
                        if held > 4_000_000:
                            yield batch(out)
                            out, held = [], 0
                if out:
                    yield batch(out)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    return mapped(archives.select("archive"), run, schema)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> tuple[DataFrame, str]:
    """(table of archives, their folder) after all pages have been written.

    Payloads travel compressed with the dictionary. Which of equal payloads is the response comes from a salted
    aggregation by digest, so a payload that a third of all pages share is dealt out to many tasks.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    n = pages.count()
    sample = class_sample(pages.select(F.col(key).cast("bigint").alias(key), F.col(payload).alias("_body"), F.lit(0).alias("_all")).where("_body is not null"), key, "_all", DICTIONARY_PAGES, "_body") if n else []
    dictionary = train([r["_body"].encode("utf-8", "surrogatepass") for r in sample])
    shipped = spark.sparkContext.broadcast(dictionary)

    def compress(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(shipped.value) if shipped.value else None).compress
        for part in slices(batches):
            bodies = [(b or "").encode("utf-8", "surrogatepass") for b in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([pack(b) for b in bodies], pa.binary()), pa.array([payload_digest(b) for b in bodies], pa.string())], names=["page", "url", "packed", "digest"])

    small = mapped(pages.select(F.col(key).cast("bigint").alias("page"), F.col(url).alias("url"), F.col(payload).alias("body")), compress, "page bigint, url string, packed binary, digest string")
    marked = group_attach(small, ["digest"], {"last": (F.max("page"), F.max("last"))}, F.concat_ws("/", F.col("page").cast("string"), F.col("url")))
    archives = written(write_archives(marked, dictionary, folder, "page", "url", "packed"), "archives")
    return archives, folder


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each page, as read back from archives."""
    archives, folder = archive(pages, key, url, payload)
    found = read_archives(archives.repartition(max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
