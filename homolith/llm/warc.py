"""WARC archives: written with an index, read back by coalesced byte ranges of the selected records."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, small_batches, table, written

#: Payloads from this size on are stored once.
LEAST = 1000
#: Ranges that are no further apart than this are read at once, up to so many bytes.
GAP, MOST = 64 << 10, 8 << 20
#: A file is closed once it is this long.
FILE_BYTES = 256 << 20


def classified(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url", least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to). Of equal payloads of `least` bytes or more that
    of the largest id is kept (rows that repeat this id too); the others refer to it. Null html is an empty payload;
    a null id refers to any other, and is kept if there is none; a null url is written as an empty one."""
    p = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    # Counted before anything moves: one row of a task at most for a digest, and only digests that occur again are kept. The
    # size of the written table is known before the join: a small one is broadcast and no payload moves, else AQE splits hot
    # digests. Payloads that are too small to be stored once don't take part.
    again = p.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).filter("n > 1 AND head IS NOT NULL").drop("n")
    again, _ = written(pages.sparkSession, again, "warc-heads")
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest"]
    large = p.filter(F.col("payload_bytes") >= least).join(again, "payload_digest", "left")
    large = large.select(*names, F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")).alias("refers_to"))
    small = p.filter(F.col("payload_bytes") < least).select(*names, F.lit(None).cast(p.schema["page_id"].dataType).alias("refers_to"))
    return large.unionByName(small)


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record, response or revisit. A revisit has the response's head, and so the length of its payload, but not the payload."""
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = page if refers_to is not None else page + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", f"WARC-Target-URI: {' '.join(url.split())}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def packed(data: bytes) -> bytes:
    """A gzip member of its own for each record, so that any record can be read alone."""
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP head and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    page, _, payload = block.partition(b"\r\n\r\n")
    return fields, page, payload


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes classified() rows as archives under folder, and returns the index: file, offset, length, url, digest, page_id.

    A task that runs again writes another file; the index, which Spark commits, names the files that count.
    """
    small_batches(records.sparkSession)
    kind = records.schema["page_id"].dataType.simpleString()
    names = ["file", "offset", "length", "url", "digest", "page_id"]

    def run(batches):
        disk, root = _at(folder)
        disk.create_dir(root, recursive=True)
        part, out, at, name = TaskContext.get().partitionId(), None, 0, ""
        for b in batches:
            rows = []
            for page_id, url, payload, _, digest, refers_to in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = disk.open_output_stream(f"{root}/{name}", compression=None)
                data = packed(record(page_id, url, bytes(payload), digest, refers_to))
                out.write(data)
                rows.append((name, at, len(data), url, digest, page_id))
                at += len(data)
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), b.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        if out is not None:
            out.close()

    return records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, f"file string, offset long, length long, url string, digest string, page_id {kind}")


def ranges(spots: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) as (from, to, spots in it): what is near enough is read at once."""
    out: list[list[int]] = []
    for at, n in spots:
        if out and at - out[-1][1] <= gap and at + n - out[-1][0] <= most:
            out[-1][1], out[-1][2] = max(out[-1][1], at + n), out[-1][2] + 1
        else:
            out.append([at, at + n, 1])
    return [tuple(r) for r in out]


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that rows of the index name: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null for a revisit).

    Rows are sorted by file and offset in each task; a task reads ranges of a few MB. The digest of every payload is checked.
    """
    small_batches(index.sparkSession)
    kind = index.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    # A file of many records is several tasks' work: stretches of FILE_BYTES / 8.
    placed = index.repartition("file", F.floor(F.col("offset") / (FILE_BYTES // 8))).sortWithinPartitions("file", "offset")

    def run(batches):
        disk, root = _at(folder)
        for b in batches:
            files, at, n, ids = (b.column(i).to_pylist() for i in (0, 1, 2, 5))
            i = 0
            while i < len(files):
                j = i
                while j < len(files) and files[j] == files[i]:
                    j += 1
                with disk.open_input_file(f"{root}/{files[i]}") as f:
                    for low, high, many in ranges(list(zip(at[i:j], n[i:j], strict=True))):
                        f.seek(low)
                        data, rows = f.read(high - low), []
                        for k in range(i, i + many):
                            fields, page, payload = parsed(zlib.decompress(data[at[k] - low : at[k] - low + n[k]], 31))
                            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                            full = int(dict(x.split(": ", 1) for x in page.decode().split("\r\n")[1:])["Content-Length"])
                            first = fields["WARC-Type"] == "response"
                            if first and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
                                raise ValueError(f"payload of page {ids[k]} is damaged")
                            to = fields.get("X-Refers-To-Page-ID")
                            rows.append((ids[k], fields["WARC-Target-URI"], fields["WARC-Type"], full, digest, int(to) if to else None, payload if first else None))
                        i += many
                        columns = list(zip(*rows, strict=True))
                        types = (b.schema.field(5).type, pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return placed.select("file", "offset", "length", "url", "digest", "page_id").mapInArrow(run, f"page_id {kind}, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive(pages: DataFrame) -> DataFrame:
    """Pages through archives in the shared folder: what read() finds of what write() stored."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    index, _ = written(spark, write(classified(pages), folder), "warc-index")
    return read(index, folder)


def query(spark, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS head FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest, CASE WHEN head IS NULL OR head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN head <> page_id THEN head END AS refers_to
FROM p LEFT JOIN h ON p.payload_digest = h.payload_digest
"""
