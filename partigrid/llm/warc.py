"""WARC archives with resolved revisits (operator 9).

Payloads never travel. Each task writes the response records of its pages to spool files (of payloads that it meets again
only those that may be kept), with a unique record id each, and hands on their headers. The headers are shuffled by payload
digest to find the record that keeps a payload, the one with the largest page id; the others join it and become revisits.
Then each spool file is read once more beside its own headers: kept responses are copied as they are, the others are written
as revisit records with fresh headers that name the record they refer to. The spool is removed in the end.

Reading back parses the archives member by member, verifies every payload against its digest, and joins each revisit to the
response that it names.

Defined cases: a null payload is empty; repeated rows with the kept id are responses each; null ids are never kept while
their payload has another id, and are written without an id; without any id every row of a payload is a response; a payload
shorter than ``least`` bytes is a response always; an empty table gives no archive and no rows; other columns are never
touched.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partigrid.llm.common import new_file, open_fs, remove_dir, slices, small_batches, stage, work_dir

ARCHIVE_BYTES, ARCHIVE_RECORDS, PIECE = 32_000_000, 200_000, 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = "file string, ord int, page_id long, url string, record_id string, digest string, size long, at long, length long"
_MANIFEST = "file string, records long, bytes long"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, names string, target string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _line(text: str | None) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(c if c.isprintable() else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in text or "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def new_id() -> str:
    return f"<{uuid.uuid4().urn}>"


def make_record(kind: str, record_id: str, date: str, block: bytes, fields: list[tuple[str, str | None]]) -> bytes:
    """One gzipped record; fields without a value are left out."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    lines = ["WARC/1.1", *[f"{k}: {_line(v)}" for k, v in head if v is not None]]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def _page(page_id: int | None, url: str | None, digest: str) -> list[tuple[str, str | None]]:
    own = None if page_id is None else str(page_id)
    return [("WARC-Target-URI", url), ("WARC-Page-ID", own), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def _spool(folder: str, least: int, date: str):
    """Pages to spool files of their response records, and a header row for each page; ``length`` 0: surely a revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, n = None, None, 0, 0
        seen: dict[str, int | None] = {}
        for b in slices(batches, "payload", 8_000_000):
            rows = []
            for page_id, url, payload in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("payload").cast(pa.binary()).to_pylist(), strict=True):
                if out is None:
                    name, at, n, seen = uuid.uuid4().hex, 0, 0, {}
                    out = new_file(f"{folder}/spool/{name}")
                payload = payload or b""
                digest, record_id, length = payload_digest(payload), new_id(), 0
                best = seen.get(digest)
                if len(payload) < least or best is None or page_id is not None and page_id >= best:
                    record = make_record("response", record_id, date, _http(len(payload)) + payload, _page(page_id, url, digest))
                    out.write(record)
                    length = len(record)
                    seen[digest] = page_id if page_id is not None else best
                rows.append((name, n, page_id, url, record_id, digest, len(payload), at, length))
                at, n = at + length, n + 1
                if at >= ARCHIVE_BYTES or n >= ARCHIVE_RECORDS:
                    out.close()
                    out = None
            yield _batch(rows, _HEADERS)
        if out is not None:
            out.close()

    return run


def _write(folder: str, date: str):
    """Header rows, sorted by spool file and place, to archives; one row of the manifest for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, spool, out, n = None, None, None, 0

        def close() -> pa.RecordBatch:
            size = out.tell()
            spool.close()
            out.close()
            return _batch([(final, n, size)], _MANIFEST)

        for b in batches:
            for r in b.to_pylist():
                if r["file"] != name:
                    if name is not None:
                        yield close()
                    name, n = r["file"], 0
                    final = f"{name}-{uuid.uuid4().hex[:8]}.warc.gz"  # another attempt of this task writes another file
                    fs, path = open_fs(f"{folder}/spool/{name}")
                    spool, out = fs.open_input_file(path), new_file(f"{folder}/archives/{final}")
                    out.write(make_record("warcinfo", new_id(), date, b"format: WARC File Format 1.1\r\n", [("WARC-Filename", final), ("Content-Type", "application/warc-fields")]))
                if r["names"] is None:
                    spool.seek(r["at"])
                    out.write(spool.read(r["length"]))
                else:
                    refers = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", r["names"]), ("WARC-Refers-To-Target-URI", r["kept_url"]), ("WARC-Refers-To-Date", date)]
                    out.write(make_record("revisit", r["record_id"], date, _http(r["size"]), [*_page(r["page_id"], r["url"], r["digest"]), *refers]))
                n += 1
        if name is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0, date: str | None = None) -> DataFrame:
    """Write all pages to WARC files in ``folder``; returns the manifest (file, records, bytes), a table that is kept there."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("payload"))
    headers = stage(rows, f"{folder}/headers", _spool(folder, least, date), _HEADERS)
    best = F.max(F.struct("page_id", "record_id", "url"))
    kept = headers.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(best.alias("x"))
    kept = kept.select("digest", F.col("x.page_id").alias("kept"), F.col("x.record_id").alias("kept_id"), F.col("x.url").alias("kept_url"))
    found = headers.join(kept.hint("merge"), "digest", "left")
    revisit = (F.col("size") >= least) & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    found = found.withColumn("names", F.when(revisit, F.col("kept_id"))).drop("kept", "kept_id")
    files = stage(found.repartition(n, "file").sortWithinPartitions("file", "ord"), f"{folder}/manifest", _write(folder, date), _MANIFEST)
    remove_dir(f"{folder}/spool")
    remove_dir(f"{folder}/headers")
    return files


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a gzipped archive, read a piece at a time."""
    held, parts, d = b"", [], zlib.decompressobj(31)
    while True:
        if not held and not (held := stream.read(PIECE)):
            if parts:
                raise ValueError("an archive ends within a record")
            return
        parts.append(d.decompress(held))
        held = d.unused_data if d.eof else b""
        if not d.eof:
            continue
        raw = b"".join(parts)
        parts, d = [], zlib.decompressobj(31)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, rest[: int(fields["content-length"])]


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                fs, path = open_fs(f"{folder}/archives/{name}")
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for fields, block in parse_records(stream):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest, own = fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("warc-page-id")
                        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"{name}: {fields['warc-record-id']} does not fit its digest")
                        rows.append((None if own is None else int(own), size, digest, kind, fields["warc-record-id"], fields.get("warc-refers-to"), fields.get("warc-target-uri")))
                        if len(rows) == 8192:
                            yield _batch(rows, _RECORDS)
                            rows = []
                yield _batch(rows, _RECORDS)

    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, target) of each record of the archives; a revisit whose
    response is missing or differs raises."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("file").repartition(n, "file")
    records = stage(files, work_dir(spark, "warc-index"), _read(folder), _RECORDS)
    responses, revisits = records.where("record_type = 'response'"), records.where("record_type = 'revisit'")
    origins = responses.select(F.col("record_id").alias("names"), "payload_digest", F.col("page_id").alias("refers_to"), F.lit(True).alias("there"))
    found = revisits.join(origins.hint("merge"), ["names", "payload_digest"], "left")
    missing = F.raise_error(F.concat(F.lit("a revisit without its response: "), F.col("record_id")))
    found = found.withColumn("record_type", F.when(F.col("there"), F.col("record_type")).otherwise(missing))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*names).unionByName(found.select(*names))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives with revisits and read back."""
    folder = work_dir(spark, "warc")
    write_archives(small_batches(spark).read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).drop("target")
