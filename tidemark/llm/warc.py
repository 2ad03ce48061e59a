"""WARC archives with one Zstandard dictionary each.

Records are written in archives of bounded size. An archive's dictionary is built from its own records and leads the file
in a skippable frame; each record is a frame of its own, so it can be read by offset. Equal payloads are stored once, as the
response of the largest page_id; the others are revisit records with the digest and size of the whole payload.

Archives are written by the tasks through pyarrow's file systems into a folder that all executors share, under names that
are new for each attempt; the manifest lists those of the attempts that counted, so a lost executor leaves no
gap and no double. Defined results: null html is an empty payload; rows that repeat the largest page_id of a payload are
responses both; null ids rank below all others; an archive of too few records to build a dictionary from has none; an
empty table gives no archive; further columns are ignored; line breaks in a url are dropped, a null url is left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_folder, written

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16 << 20  # of records before compression
DICTIONARY_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"  # pages have no date of their own


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(told: str | None) -> int | None:
    number = told.removeprefix("<urn:page:").removesuffix(">") if told else "null"
    return None if number == "null" else int(number)


def record(page, url, payload: bytes, refers) -> bytes:
    """A response record, or a revisit of the page ``refers`` (a list of one id, as an id may be null)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "").replace("\n", ""))
    if refers:
        head += [f"WARC-Refers-To: {_id(refers[0])}", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def pack(records: list[bytes], level: int = 3) -> bytes:
    """An archive: the dictionary in a skippable frame, then a frame per record."""
    try:
        made = zstandard.train_dictionary(DICTIONARY_BYTES, records, k=200, d=8)
    except zstandard.ZstdError:
        made = None
    z = zstandard.ZstdCompressor(level=level, dict_data=made) if made else zstandard.ZstdCompressor(level=level)
    raw = made.as_bytes() if made else b""
    return (struct.pack("<II", SKIPPABLE, len(raw)) + raw if made else b"") + b"".join(map(z.compress, records))


def unpack(archive):
    """Yields (headers, block) of every record of an open archive."""
    source = io.BufferedReader(archive) if not hasattr(archive, "peek") else archive
    start = source.read(8)
    made = None
    if len(start) == 8 and struct.unpack("<II", start)[0] == SKIPPABLE:
        made, start = zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", start)[1])), b""
    z = zstandard.ZstdDecompressor(dict_data=made) if made else zstandard.ZstdDecompressor()
    rest = io.BytesIO(start + source.read()) if start else source
    with z.stream_reader(rest, read_across_frames=True) as plain, io.BufferedReader(plain, 1 << 16) as lines:
        while line := lines.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"no record where one should begin: {line[:40]!r}")
            headers = {}
            while (line := lines.readline().rstrip(b"\r\n")):
                name, _, value = line.decode().partition(": ")
                headers[name] = value
            block = lines.read(int(headers["Content-Length"]))
            if lines.read(4) != b"\r\n\r\n":
                raise ValueError("a record is cut off")
            yield headers, block


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages (page_id, url, html) and returns the manifest: archive, records, bytes."""

    def write(batches):
        files, root = pa.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        held, total = [], 0

        def flush():
            name, data = f"{uuid.uuid4().hex}.warc.zst", pack(held)
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        for batch in batches:
            for page, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers")), strict=True):
                held.append(record(page, url, payload, refers))
                total += len(held[-1])
                if total >= archive_bytes:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload")).withColumn("size", F.length("payload"))
    first = p.where(F.col("size") >= least).groupBy(F.col("sha1").alias("_sha1"), F.col("size").alias("_size")).agg(F.max("page_id").alias("first"), F.lit(True).alias("equal"))
    both = p.join(first, (F.col("sha1") == F.col("_sha1")) & (F.col("size") == F.col("_size")), "left")
    refers = F.when(F.col("equal") & ~F.col("page_id").eqNullSafe(F.col("first")), F.array("first"))
    return written(both.select("page_id", "url", "payload", refers.alias("refers")).mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, archive of every record.

    The digest of a response is checked, and so is the number of records: a reader takes a cut file for a shorter one.
    """

    def read(batches):
        for batch in batches:
            for uri, n in zip(batch.column("archive").to_pylist(), batch.column("records").to_pylist(), strict=True):
                files, path = pa.fs.FileSystem.from_uri(uri)
                rows = {c: [] for c in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "archive")}
                with files.open_input_stream(path) as source:
                    for headers, block in unpack(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        told, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        if kind == "response" and digest(payload) != told:
                            raise ValueError(f"{uri}: the payload of {headers['WARC-Record-ID']} does not have its digest")
                        size = len(payload) if kind == "response" else int(http.rpartition(b"Content-Length: ")[2])
                        for c, v in zip(rows, (_page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, _page(headers.get("WARC-Refers-To")), size, told, uri), strict=True):
                            rows[c].append(v)
                if len(rows["archive"]) != n:
                    raise ValueError(f"{uri} has {len(rows['archive'])} of {n} records")
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string())]))

    n = max(1, manifest.count())
    spread = manifest.repartition(min(n, 10 * manifest.sparkSession.sparkContext.defaultParallelism))
    return spread.mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
