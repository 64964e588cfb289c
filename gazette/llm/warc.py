"""WARC archives in Zstandard: one frame per record, a dictionary in the leading skippable frame.

Writing: payloads of some size that occur more than once are kept once, as the response of the largest
page_id; the others become revisit records that name it and carry its HTTP head, but no payload. Tasks
write archives of bounded size into the shared folder, each under a name of its own attempt; the
manifest, a table of the archives that finished tasks wrote, is what readers start from, so archives of
lost or repeated attempts are never read.

Reading: an archive is read as a stream. The dictionary comes from the first, skippable frame; then one
frame after the other is one record. Every record is checked: version line, needed headers, declared
against real lengths, closing blank lines, the payload against its digest; and the number of records
against the manifest. A damaged archive raises an error.

Equal payloads are found by SHA-256 and length; SHA-1, which can be made to collide, is only the digest that
records show.

Memory: a task holds one batch of pages, one record and the dictionary. The dictionary is trained on a
bounded sample: `sample_pages` pages, the smallest by a hash of the id, and of each a slice of up to
`sample_chars` characters, whole if the page is no longer, else from a place that the hash names. It changes
sizes, never contents.

Defined cases: a null html is an empty payload, a null url leaves out its header; a page without page_id
is written without one and never referred to, except that a payload which only such pages have is a
response each time; repeated rows of a page_id are records of their own, all of the same type. No pages,
no archives, no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import stored
from gazette.session import shared_dir

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_CHARS = 16 << 10, 256, 8 << 10
#: Uncompressed bytes after which a new archive is begun; bytes read at once.
ARCHIVE_BYTES, READ_BYTES = 64 << 20, 1 << 20
LEAST_SHARED = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def dictionary(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> bytes:
    """A dictionary from a bounded sample; of too small a sample its own bytes; of nothing, nothing.

    The sample is chosen on ids alone, the smallest by hash, so that only chosen pages are moved.
    """
    known = pages.filter(F.length("html") > 0).select(F.xxhash64("page_id").alias("at"), "html")
    chosen = known.select("at").distinct().orderBy("at").limit(sample_pages)
    places = F.greatest(F.length("html") - sample_chars + 1, F.lit(1))
    slices = F.substr("html", F.pmod(F.xxhash64("at"), places).cast("int") + 1, F.lit(sample_chars))
    rows = known.join(F.broadcast(chosen), "at").select("at", slices.alias("html"))
    parts = [r["html"].encode() for r in sorted(rows.groupBy("at").agg(F.min("html").alias("html")).collect())]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        whole = b"".join(parts)[:DICTIONARY_BYTES]
        return whole if len(whole) >= 8 else b""


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, body: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (body if refers_to is None else b"")
    headers = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        headers.append(f"WARC-Target-URI: {safe}")
    headers.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        headers += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    headers += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(headers)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS
) -> DataFrame:
    """Writes all pages; returns the manifest: path, records and bytes of each archive."""
    spark = pages.sparkSession
    root = shared_dir(spark, "warc")
    slim = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body")
    ).withColumns({"n_bytes": F.octet_length("body").cast("bigint"), "digest": F.sha1("body"), "same": F.sha2("body", 256)})
    heads = (
        slim.filter(F.col("n_bytes") >= LEAST_SHARED)
        .groupBy("same", "n_bytes")
        .agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select("same", "n_bytes", "head")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to")
    rows = slim.join(heads, ["same", "n_bytes"], "left").select("page_id", "url", "body", "digest", "n_bytes", refers)
    shared = dictionary(pages.select("page_id", "html"), sample_pages, sample_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = pyarrow.fs.FileSystem.from_uri(root)
        files.create_dir(at, recursive=True)
        told = zstandard.ZstdCompressionDict(shared) if shared else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=told)
        out, path, records, size, made = None, "", 0, 0, []
        for batch in batches:
            for x in batch.to_pylist():
                if out is None:
                    path = f"{at}/{uuid.uuid4().hex}.warc.zst"
                    out = files.open_output_stream(path, compression=None)
                    out.write(struct.pack("<II", SKIPPABLE, len(shared)) + shared)
                    records = size = 0
                data = record(x["page_id"], x["url"], x["body"], x["digest"], x["n_bytes"], x["refers_to"])
                out.write(packer.compress(data))
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    made.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, records, size))
        if made:
            names = ["path", "records", "bytes"]
            prefix = root[: len(root) - len(at)] if root.endswith(at) else ""
            columns = list(zip(*[(prefix + p, r, s) for p, r, s in made], strict=True))
            yield pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True)))

    return stored(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def frames(stream: pa.NativeFile) -> Iterator[bytes]:
    """The content of each frame after the skippable one, which holds the dictionary."""
    start = stream.read(8)
    magic, size = struct.unpack("<II", start) if len(start) == 8 else (0, 0)
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a skippable frame")
    told = stream.read(size)
    if len(told) != size:
        raise ValueError("the dictionary frame is cut off")
    if told[:4] == zstandard.FRAME_HEADER:
        told = zstandard.ZstdDecompressor().decompress(told)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(told)) if told else zstandard.ZstdDecompressor()
    held = stream.read(READ_BYTES)
    while held:
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data or stream.read(READ_BYTES)
                break
            held = stream.read(READ_BYTES)
            if not held:
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def parsed(data: bytes) -> dict:
    """The fields of one record, after its checks."""
    top, gap, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8").split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise ValueError("a record does not begin with its version line and headers")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "Content-Length"):
        if name not in headers:
            raise ValueError(f"a record has no {name}")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not the declared one")
    http, gap, body = rest[:size].partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)$", http)
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if not gap or length is None or kind not in ("response", "revisit") or (kind == "revisit") != ("WARC-Refers-To" in headers):
        raise ValueError("a record's block or type is broken")
    if kind == "response" and (len(body) != int(length[1]) or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError("a payload does not agree with its length or digest")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != urn(None) else None
    return {
        "page_id": number(headers["WARC-Record-ID"]),
        "url": headers.get("WARC-Target-URI"),
        "payload_bytes": int(length[1]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(headers.get("WARC-Refers-To")),
        "payload": body if kind == "response" else None,
    }


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives: its fields and, unless left out, the payload of responses."""
    schema = RECORDS + (", payload binary" if payloads else "")
    spark = manifest.sparkSession
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    arrow = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.to_pylist():
                files, at = pyarrow.fs.FileSystem.from_uri(archive["path"])
                rows, size, records = [], 0, 0
                with files.open_input_stream(at, compression=None) as stream:
                    for data in frames(stream):
                        row = parsed(data)
                        records += 1
                        rows.append({n: row[n] for n in names})
                        size += len(data) if payloads else 0
                        if len(rows) >= 4096 or size > READ_BYTES * 8:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, size = [], 0
                if records != archive["records"]:
                    raise ValueError(f"{archive['path']} has {records} records, not {archive['records']}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(width, "path").mapInArrow(run, schema)
