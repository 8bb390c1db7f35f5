"""WARC archives: written with an index, read back by coalesced byte ranges.

The index comes first in every read: each written record leaves one index row
(file, offset, length, URL, digest, ...), and a selection of index rows becomes, per
stretch of a file, few sequential reads of sorted and merged byte ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, scratch, written
from .files import OnceFile, store

#: Payloads below this are stored in full each time.
LEAST_SHARED = 1000
#: An archive file is closed when it passes this size.
FILE_BYTES = 1 << 30
#: Index rows of one stretch of a file are read by one task at a time.
STRETCH = 16 << 20
#: Ranges closer than this are read together, up to READ_BYTES.
GAP = 64 << 10
READ_BYTES = 4 << 20
#: Fixed so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("file string, offset bigint, length bigint, url string, digest string, "
         "page_id bigint, record_type string")
RECORD = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, "
          "record_type string, refers_to bigint, payload binary")

SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("record_type", pa.string()),
                    ("refers_to", pa.int64()), ("payload", pa.binary())])


def _header_value(text: str) -> str:
    """A header value on one line: control characters and non-ASCII percent-encoded."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], text.encode()).decode("ascii")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def build_record(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record.  A revisit carries HTTP headers but no payload; its
    digest and ``X-Payload-Length`` are those of the full payload."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    revisit = refers_to is not None
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{b32}", f"X-Payload-Length: {size}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; checks the payload of a response against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size, payload = int(fields["X-Payload-Length"]), None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    long = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": long("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": long("X-Refers-To-Page-ID"), "payload": payload}


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 html_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): payload null on revisits.

    Only payloads that occur more than once enter the lookup; it is written first,
    so that a small one is broadcast by its measured size and a large one is a
    join with plain exchanges, whose hot digest adaptive execution can split.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"),
                             "digest": F.sha1("payload")})
    shared = written(rows.where(F.col("size") >= least).groupBy("digest")
                     .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
                     .where("n > 1 and first is not null").select("digest", "first"), "warc-shared")
    joined = rows.join(shared, (rows["digest"] == shared["digest"]) & (F.col("size") >= least), "left") \
        .drop(shared["digest"])
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest",
        F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", least: int = LEAST_SHARED) -> DataFrame:
    """Write one gzip-compressed record per row of ``pages`` and return the index.

    Of the rows with equal payloads of ``least`` bytes or more, those with the
    largest id are responses (each, should the id repeat) and the rest revisits;
    rows with a null id revisit the largest id, and are responses if there is
    none.  Null html is an empty payload, null URLs leave the header out, an empty
    table writes no file.  The index is written once, as Parquet.
    """
    spark = pages.sparkSession
    bound_batches(spark)

    def write(batches):
        out, at, names = None, 0, ["file", "offset", "length", "url", "digest", "page_id", "record_type"]
        for b in batches:
            rows = []
            for r in zip(*(b.column(i).to_pylist() for i in range(6))):
                page_id, url, payload, size, digest, refers = r
                if out is None:
                    out, at = OnceFile(folder, f"{uuid.uuid4().hex}.warc.gz"), 0
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = build_record(page_id, url, payload, size, digest, refers)
                packed = z.compress(data) + z.flush()
                out.open().write(packed)
                rows.append((out.name, at, len(packed), url, digest, page_id,
                             "response" if refers is None else "revisit"))
                at += len(packed)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
        if out is not None:
            out.close()

    plan = plan_records(pages, id_col, url_col, html_col, least)
    return written(plan.mapInArrow(write, INDEX), "warc-index")


def coalesced(ranges: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, ranges inside) of the reads that cover sorted (offset, length) ranges."""
    start = end = None
    inside: list[tuple[int, int]] = []
    for offset, length in ranges:
        if start is not None and (offset > end + GAP or offset + length - start > READ_BYTES):
            yield start, end, inside
            start = None
        if start is None:
            start, end, inside = offset, offset, []
        inside.append((offset, length))
        end = max(end, offset + length)
    if start is not None:
        yield start, end, inside


def read_warc(spark: SparkSession, folder: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` select, parsed and verified.

    Selected rows are dealt by (file, stretch) and sorted by offset, so a task
    reads its stretch forwards, in merged ranges.  A record selected twice is
    returned twice.  ``payloads`` false leaves payloads out after verification.
    """
    bound_batches(spark)
    where = index.select("file", "offset", "length",
                         F.floor(F.col("offset") / STRETCH).alias("stretch"))
    # the rows are small but stand for archive bytes, so the number of tasks goes by those
    selected = index.agg(F.sum("length")).first()[0] or 0
    dealt = where.repartition(1 + selected // STRETCH, "file", "stretch").sortWithinPartitions("file", "offset")

    def read(batches):
        fs = base = None
        for b in batches:
            files, offsets, lengths = (b.column(i).to_pylist() for i in range(3))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                if fs is None:
                    fs, base = store(folder)
                with fs.open_input_file(f"{base}/{files[i]}") as f:
                    for start, end, inside in coalesced(zip(offsets[i:j], lengths[i:j])):
                        f.seek(start)
                        data = f.read(end - start)
                        out = [parse_record(zlib.decompress(data[o - start:o - start + n], 31))
                               for o, n in inside]
                        if not payloads:
                            for r in out:
                                r["payload"] = None
                        yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
                i = j

    return dealt.mapInArrow(read, RECORD)


def warc_round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write ``pages`` to a new archive folder and read every record back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    index = write_warc(pages, folder, **how)
    return read_warc(spark, folder, index, payloads=False).drop("payload", "url")
