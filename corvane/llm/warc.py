"""WARC archives: write, index, and read selected records by coalesced ranges.

Writing: each task writes one archive of gzip members (one a record) to the
shared folder and returns an index row for each record: archive, offset,
length, URL and digest.  A task that runs again writes another archive; the
index, committed once by Spark, only names the archives of tasks that counted.

Of equal payloads of some size only one is stored; the others become revisit
records that refer to it.  The groups are found from digests alone, so that
payloads are shuffled once, by page, and a hot payload makes no large task.

Reading goes by the index: its rows are dealt by (archive, offset) ranges and
sorted, neighbouring byte ranges are coalesced up to a limit, and each read
serves many records.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

REVISIT_BYTES = 1000
READ_BYTES = 4 << 20  # most bytes of one coalesced read, unless a record is longer
GAP_BYTES = 64 << 10  # bytes that may be read in vain to join two ranges
TASK_BYTES = 64 << 20  # archive bytes that one reading task gets
DATE = "2024-01-01T00:00:00Z"  # the archives' date, a parameter of the writer
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"


def _uri(url: str | None) -> str:
    """A header value: blanks and control characters are percent-encoded, null is about:blank."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else "about:blank"


def _page(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_page(page_id)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_page(refers_to)}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC header fields, HTTP header and payload of one record."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, payload = rest[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    return fields, http, payload


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _with_groups(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """Pages with digest, size and, for revisits, the page that they refer to."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    facts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"),
        F.sha1(html).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"),
    )
    large = facts.filter(F.col("payload_bytes") >= revisit_bytes).select("page_id", "payload_digest")
    owners = large.groupBy("payload_digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).filter("n > 1 and owner is not null")
    later = large.join(owners, "payload_digest").filter(F.coalesce(F.col("page_id") < F.col("owner"), F.lit(True)))
    refers = later.select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), F.col("owner").alias("refers_to")).distinct()
    same = facts["page_id"].eqNullSafe(refers["_p"]) & (facts["payload_digest"] == refers["_d"])
    return facts.join(refers, same, "left").drop("_p", "_d")


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> DataFrame:
    """Writes archives below ``folder`` and returns the index, a row for each row of ``pages`` (page_id, url, html).

    The frame writes when it is evaluated: save it once and use the saved one.
    A null html is an empty payload, a null url about:blank.  Of equal payloads
    of at least ``revisit_bytes`` the records with the largest page_id are
    responses (all of them, if rows repeat it) and the others revisits; a
    null page_id is smaller than any other, and if all are null all are
    responses.  An empty table gives no rows.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = archive = None
        offset = 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, size, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    archive = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    files, path = _open(archive)
                    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = files.open_output_stream(path, compression=None)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = record_bytes(page_id, url, payload, digest, owner, owner is not None, date)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                rows.append((page_id, archive, offset, len(member), url, digest, size, "response" if owner is None else "revisit", owner))
                offset += len(member)
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = [f.split()[0] for f in INDEX.split(", ")]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if out is not None:
            out.close()

    return _with_groups(pages, revisit_bytes).select("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to").mapInArrow(run, INDEX)


def coalesce_ranges(ranges: list[tuple[int, int]], most: int = READ_BYTES, gap: int = GAP_BYTES) -> list[tuple[int, int, int]]:
    """``(start, end, n)`` of reads that serve ``n`` consecutive ranges (offset, length), sorted by offset."""
    reads: list[list[int]] = []
    for offset, length in ranges:
        if reads and offset <= reads[-1][1] + gap and max(offset + length, reads[-1][1]) - reads[-1][0] <= most:
            reads[-1][1] = max(reads[-1][1], offset + length)
            reads[-1][2] += 1
        else:
            reads.append([offset, offset + length, 1])
    return [tuple(r) for r in reads]


def read_records(index: DataFrame, partitions: int | None = None, with_payload: bool = True) -> DataFrame:
    """Reads the records that ``index`` selects, with any subset of its rows.

    Returns ``(page_id, url, payload_bytes, payload_digest, record_type,
    refers_to[, payload])`` from the bytes themselves: a response's digest and
    size are computed from its payload, a revisit's are those of the payload
    that it stands for (its payload here is null).
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    number = lambda text: int(text[10:-1]) if len(text) > 11 else None  # noqa: E731  <urn:page:N>

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(rows):
                until = at
                while until < len(rows) and rows[until][0] == rows[at][0]:
                    until += 1
                files, path = _open(rows[at][0])
                with files.open_input_file(path) as source:
                    for start, end, n in coalesce_ranges([r[1:] for r in rows[at:until]]):
                        data, out = source.read_at(end - start, start), []
                        for _, offset, length in rows[at : at + n]:
                            fields, http, payload = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                            revisit = fields["WARC-Type"] == "revisit"
                            size = int(http.rsplit(b"Content-Length: ", 1)[1]) if revisit else len(payload)
                            digest = fields["WARC-Payload-Digest"][5:] if revisit else hashlib.sha1(payload).hexdigest()
                            refers = number(fields["WARC-Refers-To"]) if revisit else None
                            record = (number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], refers)
                            out.append(record + (None if revisit else payload,) * with_payload)
                        at += n
                        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)]
                        yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    chosen = index.select("archive", "offset", "length")
    if partitions is None:
        total = chosen.agg(F.sum("length")).first()[0] or 0
        partitions = max(chosen.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES + 1)
    dealt = chosen.repartitionByRange(partitions, "archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives in the workspace, saves the index, and reads every record back."""
    ws = Workspace(pages.sparkSession, "warc")
    index = ws.save(write_archives(pages, ws.path("archives")), "index")
    return read_records(index, with_payload=False)
