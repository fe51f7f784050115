"""WARC archives: gzip-member-per-record files and a reader that splits them by byte ranges.

The writer puts every page into a record that is a gzip member of its own.  The reader needs no
index: a task takes a byte range, scans it for gzip's magic bytes, tells members from chance
bytes by inflating their start and looking for a record header, and owns the records whose
member *starts* inside its range, whichever range they end in.  So every record is read once,
however the ranges are cut.

Pages whose payloads are equal are deduplicated: the page of the largest id keeps the payload
in a ``response`` record, the others become ``revisit`` records that refer to it.

Files are written and read through ``pyarrow.fs`` by the URI of the shared folder, so any store
that it knows will do.  A file's name holds its partition and attempt; only files of attempts
that the driver heard of are read, so a lost or repeated task leaves nothing behind in the result.

Defined results:

* a null html is an empty payload, and empty payloads equal each other;
* repeated rows (one page_id twice) make a record each; of rows with the largest page_id and equal
  payloads all are responses; a page without id is never the one that others refer to unless all lack ids;
* a page without url gets the target URI ``urn:page:<id>``; line ends in urls are percent-encoded;
* a table without rows gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import support

# The archive format's names and gzip's magic.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"

FILES = "path string, n_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, level: int = 4) -> bytes:
    """One record as a gzip member.  A revisit holds the length and digest of the payload that it leaves out."""
    name = "null" if page_id is None else str(page_id)
    uri = (uri or f"urn:page:{name}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{name}')}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {name}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    body = b"" if revisit else payload
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of an inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def is_member(data: bytes) -> bool:
    """Whether a member that begins here inflates to a record header."""
    try:
        return zlib.decompressobj(31).decompress(data, len(VERSION)).startswith(VERSION[:5])
    except zlib.error:
        return False


def members(handle, start: int, end: int, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The inflated records whose members start in [start, end) of a file; a member may end beyond.

    Memory: one chunk and one record.  When a member ends, the next one is expected right behind
    it; only at the range's start, or after bytes that are no member, is there a search for magic.
    """
    handle.seek(start)
    held, at, over = b"", start, False  # held: bytes from offset ``at`` on

    def more() -> bool:
        nonlocal held, over
        got = handle.read(chunk)
        over = not got
        held += got
        return not over

    while at < end:
        while (i := held.find(MAGIC)) < 0 or len(held) - i < 4096:
            if i < 0 and len(held) > 2:
                at += len(held) - 2
                held = held[-2:]
            if over or at >= end or not more():
                break
        i = held.find(MAGIC)
        if i < 0 or at + i >= end:
            return
        held, at = held[i:], at + i
        if not is_member(held[:4096]):
            held, at = held[1:], at + 1
            continue
        inflater, out = zlib.decompressobj(31), []
        while True:
            out.append(inflater.decompress(held))
            if inflater.eof:
                at += len(held) - len(inflater.unused_data)
                held = inflater.unused_data
                break
            at, held = at + len(held), b""
            if not more():
                raise EOFError("a record's member is cut off")
        yield b"".join(out)


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds payload, digest, revisit and refers_to to page_id, url, html.

    Only digests that more than one page has are joined back; they are sent to all tasks while
    they are few (``FEW`` rows of two short columns), and shuffled with the pages otherwise.
    """
    few = 50_000
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    pages = pages.withColumn("payload", payload).withColumn("sha", F.sha1("payload")).drop("html")
    keyed = pages.where(F.length("payload") >= least_bytes)
    shared = support.cut(keyed.groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    shared = F.broadcast(shared) if shared.count() <= few else shared
    revisit = F.coalesce((F.length("payload") >= least_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return pages.join(shared, "sha", "left").withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("first_id"))).select("page_id", "url", "payload", "revisit", "refers_to")


def write(decided: DataFrame, folder: str) -> DataFrame:
    """Writes an archive for each partition; returns path and size of the files of finished tasks."""

    def task(batches):
        store, root = fs.FileSystem.from_uri(folder)
        out = path = None
        size = 0
        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if out is None:
                    store.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                member = record(page_id, url, payload, digest32(payload), refers_to, revisit)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size])], ["path", "n_bytes"])

    return decided.mapInArrow(task, FILES)


def read(spark: SparkSession, files: DataFrame, folder: str, split_bytes: int = 8 << 20) -> DataFrame:
    """Reads archives by byte ranges of ``split_bytes``; files has path and n_bytes."""
    batch_bytes = 16 << 20

    def task(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for path, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with store.open_input_file(path) as handle:
                    for raw in members(handle, start, end):
                        headers, body = parse(raw)
                        revisit = headers["warc-type"] == "revisit"
                        said = headers["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and digest32(body) != said:
                            raise ValueError(f"a payload in {path} does not match its digest")
                        own = headers.get("x-page-id", "null")
                        rows.append({"page_id": None if own == "null" else int(own), "payload_bytes": int(headers.get("x-payload-length", len(body))) if revisit else len(body), "payload_digest": said, "record_type": headers["warc-type"], "refers_to": int(headers["x-refers-to-page"]) if revisit else None, "target_uri": headers["warc-target-uri"], "payload": None if revisit else body})
                        held += len(body)
                        if held > batch_bytes or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    spark = support.ready(spark)
    ranges = files.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(split_bytes))).alias("start"), "n_bytes").select("path", "start", F.least(F.col("start") + split_bytes, F.col("n_bytes")).alias("end"))
    wanted = max(1, min(ranges.count(), 100_000))
    return ranges.repartition(wanted).mapInArrow(task, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, split_bytes: int = 8 << 20) -> DataFrame:
    """Writes the pages' archives below the shared folder and reads them back."""
    spark = support.ready(pages.sparkSession)
    shared = support.shared_dir(spark)
    folder = folder or f"{shared if '://' in shared else 'file://' + shared}/repograph-warc-{uuid.uuid4().hex}"
    files = support.cut(write(decide(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), least_bytes), folder))
    return read(spark, files, folder, split_bytes)
