"""WARC archives with revisit resolution.

Records of equal payloads need storing once. Headers (id, digest, length; no payloads) are shuffled by payload digest
and reduced to the one response of each digest: that with the largest id. Every other record of the digest becomes a
revisit that refers to it, found by joining the headers of shared digests to their responses. Then archives are written
with fresh headers: responses carry their payload, revisits only their headers.

Payloads are reduced to one for each digest before and after they are shuffled, so a payload that most pages have moves
once for each task that reads it, and each other payload once; revisits never carry one. Equal rows are one header with
a count until they are written, when the count is spelled out in portions of COPIES that other tasks write. The joins
of headers are inner joins of shuffled sides, which adaptive execution splits where one digest has very many records.

A writer task fills one archive, a gzip member for each record (so readers can seek and skip), under a name of its own
in the shared folder; it is renamed when complete, and only archives listed in the manifest, from tasks that succeeded,
count. A repeated or speculative attempt leaves a file that nobody reads. Files go through pyarrow.fs, so the folder
may be any store it knows. Readers stream one record at a time.

Defined cases: a null payload is empty; payloads shorter than min_payload are always responses; of records with the largest
id of their payload that with the largest url, and of equal rows one, is the response and the others refer to it, so
repeated rows stay; null ids sort below all others; a null url is an empty target; an empty table makes no archive;
other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.shared import fresh_path, map_arrow, table, written

#: Date of all records, as a crawl's own date is not in the input; a parameter.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 1
COPIES = 100_000  # equal rows that one task writes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MANIFEST = "path string, records long, bytes long"
RECORD = "record_id string, page_id long, record_type string, target string, date string, payload_digest string, refers_to_id string, refers_to_target string, refers_to_date string, payload_bytes long, payload binary"


def digest(payload: Column) -> Column:
    """Upper-case base32 of the payload's SHA-1: 20 bytes are four groups of 40 bits, eight digits each."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(headers: DataFrame) -> DataFrame:
    """The revisits among headers (page_id, url, payload_bytes, payload_digest, rows: how many equal ones there are):
    those columns with refers_to, refers_to_url, the first copy that is a revisit, and `rows` of revisits alone."""
    key = ["payload_digest", "payload_bytes"]
    shared = headers.groupBy(*key).agg(F.max(F.struct("page_id", "url")).alias("original"), F.sum("rows").alias("records")).where("records > 1")
    found = headers.join(shared, key)
    original = F.col("page_id").eqNullSafe(F.col("original.page_id")) & (F.col("url") == F.col("original.url"))
    found = found.withColumn("first_copy", original.cast("int")).withColumn("rows", F.col("rows") - F.col("first_copy")).where("rows > 0")
    return found.select("page_id", "url", *key, F.col("original.page_id").alias("refers_to"), F.col("original.url").alias("refers_to_url"), "first_copy", "rows")


def spelled_out(headers: DataFrame) -> DataFrame:
    """Each header as many times as its `rows` says, with `copy` counted from first_copy; portions of COPIES are dealt out."""
    portions = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / COPIES)))
    one = headers.where(f"rows <= {COPIES}").withColumn("_portion", F.lit(0).cast("long"))
    more = headers.where(f"rows > {COPIES}").withColumn("_portion", portions).repartition("payload_digest", "_portion")
    start = F.col("_portion") * COPIES
    copies = F.sequence(start, F.least(start + COPIES, F.col("rows")) - 1)
    return one.unionByName(more).withColumn("_k", F.explode(copies)).withColumn("copy", (F.col("first_copy") + F.col("_k")).cast("long")).drop("_k", "_portion", "rows", "first_copy")


def record_name(page_id: int | None, url: str, copy: int) -> str:
    """A record's id: the same for the same row, whoever writes or refers to it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}\n{copy}\n{url}')}>"


def _target(url: str) -> str:
    """A header value without control characters or spaces."""
    return quote(url, safe="/:?#[]@!$&'()*+,;=%-._~")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record(row: dict) -> bytes:
    """One WARC record, not compressed. row: the columns given to write_archives()."""
    url = row["url"] or ""
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_name(row['page_id'], url, row['copy'])}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_target(url)}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if row["record_type"] == "revisit":
        other = row["refers_to_url"] or ""
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(row['refers_to'], other, 0)}", f"WARC-Refers-To-Target-URI: {_target(other)}", f"WARC-Refers-To-Date: {DATE}"]
        block = HTTP % row["payload_bytes"]
    else:
        payload = row["payload"] or b""
        block = HTTP % len(payload) + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes an archive for each partition of rows and returns the manifest, itself written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = _open(folder)
        name = f"{base}/archive-{task.partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            for k in range(batch.num_rows):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(name + ".open", compression=None)
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                member = gzip.compress(record(row), LEVEL, mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            store.move(name + ".open", name)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "records": [n], "bytes": [size]})

    return written(map_arrow(rows, run, MANIFEST), "warc-manifest")


class _Members:
    """Records of an archive, one after the other, each with its own gzip member; bounded by the longest record."""

    def __init__(self, stream):
        self.stream, self.left = stream, b""

    def __iter__(self) -> Iterator[bytes]:
        while True:
            z, parts = zlib.decompressobj(31), []
            while not z.eof:
                data = self.left or self.stream.read(1 << 18)
                self.left = b""
                if not data:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    return
                parts.append(z.decompress(data))
            self.left = z.unused_data
            yield b"".join(parts)


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != told:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page = fields.get("X-Page-Id")
    return {
        "record_id": fields["WARC-Record-ID"], "page_id": None if page is None else int(page), "record_type": kind, "target": fields["WARC-Target-URI"], "date": fields["WARC-Date"],
        "payload_digest": told, "refers_to_id": fields.get("WARC-Refers-To"), "refers_to_target": fields.get("WARC-Refers-To-Target-URI"), "refers_to_date": fields.get("WARC-Refers-To-Date"),
        "payload_bytes": len(payload) if kind == "response" else None, "payload": payload if kind == "response" else None,
    }


def read_archives(manifest: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The records of the archives in a manifest, RECORD's columns or some of them; a task reads whole archives, streaming."""
    n = max(1, manifest.count())
    kinds = {x.split()[0]: x.split()[1] for x in RECORD.split(", ")}
    columns = columns or list(kinds)
    kind_of = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c, kind_of[kinds[c]]) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = _open(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as stream:
                    for raw in _Members(stream):
                        row = parse(raw)
                        rows.append({c: row[c] for c in columns})
                        size += len(row["payload"] or b"") + 500 if "payload" in columns else 500
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(manifest.select("path").repartition(n), run, ", ".join(f"{c} {kinds[c]}" for c in columns))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records read back, with the page and the payload length that a revisit's original response has. Only revisits
    are joined; responses know theirs."""
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    originals = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"))
    found = revisits.drop("payload_bytes").join(originals, "refers_to_id", "left").withColumnRenamed("_bytes", "payload_bytes")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)


def write_deduplicated(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """pages (page_id, url, html) as deduplicated archives in the folder; returns the manifest."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    size, name = F.octet_length("payload").cast("long").alias("payload_bytes"), digest(F.col("payload")).alias("payload_digest")
    rows = rows.select("page_id", "url", "payload", size, name)
    big, key = rows.where(F.col("payload_bytes") >= min_payload), ["payload_digest", "payload_bytes"]
    heads = big.groupBy("page_id", "url", *key).agg(F.count(F.lit(1)).alias("rows"))
    revisits = spelled_out(resolve(written(heads, "warc-headers")))
    responses = big.groupBy(*key).agg(F.max(F.struct("page_id", "url")).alias("o"), F.first("payload").alias("payload"))
    responses = responses.select("o.page_id", "o.url", *key, F.lit(0).cast("long").alias("copy"), "payload")
    none = lambda kind: F.lit(None).cast(kind)
    names = ["page_id", "url", "copy", *key, "record_type", "refers_to", "refers_to_url", "payload"]
    records = responses.withColumns({"record_type": F.lit("response"), "refers_to": none("long"), "refers_to_url": none("string")}).select(*names)
    records = records.unionByName(revisits.withColumns({"record_type": F.lit("revisit"), "payload": none("binary")}).select(*names))
    if min_payload > 0:
        small = rows.where(F.col("payload_bytes") < min_payload).groupBy("page_id", "url", *key, "payload").agg(F.count(F.lit(1)).alias("rows"))
        small = spelled_out(small.withColumn("first_copy", F.lit(0)))
        records = records.unionByName(small.withColumns({"record_type": F.lit("response"), "refers_to": none("long"), "refers_to_url": none("string")}).select(*names))
    return write_archives(records, folder)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as deduplicated archives, read back: one row for each record."""
    manifest = write_deduplicated(table(spark, sf_dir, "pages").select("page_id", "url", "html"), fresh_path(spark, "warc"))
    names = ["record_id", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to_id"]
    back = resolve_revisits(written(read_archives(manifest, names), "warc-index"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h FROM pages),
  r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS best, sha1(h) AS x FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC)),
  d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM r)
SELECT page_id, strlen(h) AS payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN best END AS refers_to FROM d
"""
