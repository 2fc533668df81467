"""WARC archives by a chunked record table.

A payload is cut into rows (record, chunk number, bytes) of at most ``CHUNK`` bytes in the scan, before anything moves, so no
exchange, Python writer or reader ever holds a whole record: the writer streams the chunks into one gzip member a record,
the reader inflates and parses as it goes and carries the SHA-1 of the payload so far from chunk to chunk.  (The scan holds
a row's html once, as Parquet gives it.)

Of records with equal payloads, that with the largest page_id is the response and the others are revisits of it; a
revisit keeps its HTTP header, and so the length of its payload, and no body.  Payloads are equal if length and SHA-1
are; what decides is a table of (page_id, SHA-1) without bodies.  A hot digest's narrow rows meet in a join that adaptive
execution splits; the chunks are joined by page_id and SHA-1.  Archives are written under names of their own by each
attempt of a task; the manifest, which Spark commits, lists those of the attempts that count.  The folder must be one that
pyarrow can open on every executor.

A null payload is empty.  A null page_id is smaller than all others; rows that agree in page_id and payload are all
responses if that page_id is the largest.  A record's id has its page_id and digest, and a number from the second record
with both on, so ids are unique.  A null url is empty.  Columns other than page_id, url and html are left aside.  Without
rows there is no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import new_path, saved

CHUNK, READ, FILE_BYTES = 1 << 18, 1 << 16, 256 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64())])
CHUNKS = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int64()), ("last", pa.bool_()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("header_digest", pa.string()), ("payload_bytes", pa.int64())])
CHUNKS_DDL = "page_id long, record_type string, refers_to long, url string, chunk_no long, last boolean, data binary, bytes_so_far long, digest_so_far string, header_digest string, payload_bytes long"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if re.match(r"\w+://|file:", uri) else (pafs.LocalFileSystem(), uri)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _urn(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{f':{copy}' if copy else ''}>"


def _page(urn: str | None) -> int | None:
    return int(m[1]) if urn and (m := re.match(r"<urn:page:(-?\d+):", urn)) else None


def file_head() -> bytes:
    """The record at the head of an archive, a gzip member of its own."""
    body = b"software: arborflow\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    return zipped.compress(("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n") + zipped.flush()


def head(page_id: int | None, url: str | None, digest: str, n_bytes: int, refers_to: int | None, revisit: bool, copy: int = 0) -> bytes:
    """WARC and HTTP header of a record; the payload (none of a revisit) and two line ends follow."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, digest, copy)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(http) + (0 if revisit else n_bytes)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_chunks(folder: str):
    """Writes chunk rows, in the order of records and chunks, to archives; yields the manifest."""

    def f(batches):
        fs, top = _fs(folder)
        fs.create_dir(top, recursive=True)
        out, path, n, done = None, "", 0, []
        zipped, was, copy = None, None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk_no"] == 0:
                    if out is None or out.tell() > FILE_BYTES:
                        if out is not None:
                            out.close()
                            done.append((path, n))
                        path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(_fs(path)[1], compression=None)
                        out.write(file_head())
                    copy = copy + 1 if (r["page_id"], r["digest"]) == was else 0
                    was = (r["page_id"], r["digest"])
                    zipped, sha = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1()
                    revisit = r["record_type"] == "revisit"
                    out.write(zipped.compress(head(r["page_id"], r["url"], r["digest"], r["payload_bytes"], r["refers_to"], revisit, copy)))
                if not revisit:
                    sha.update(r["data"])
                    out.write(zipped.compress(r["data"]))
                if r["chunk_no"] == r["n_chunks"] - 1:
                    if not revisit and base32(sha.digest()) != r["digest"]:
                        raise ValueError(f"page {r['page_id']}: the chunks do not make up the payload")
                    out.write(zipped.compress(b"\r\n\r\n") + zipped.flush())
                    n += 1
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], schema=MANIFEST)

    return f


class _Stream:
    """Inflated bytes of a file of gzip members, taken piece by piece."""

    def __init__(self, raw):
        self.raw, self.buffer, self.z, self.rest = raw, b"", zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            data = self.rest or self.raw.read(READ)
            self.rest = b""
            if not data:
                return False
            got = self.z.decompress(data, READ)
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            else:
                self.rest = self.z.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def some(self, most: int) -> bytes:
        if not self.buffer and not self.more():
            raise EOFError("an archive ends within a record")
        out, self.buffer = self.buffer[:most], self.buffer[most:]
        return out


def records(raw, with_data: bool, chunk: int = CHUNK):
    """Chunk rows of an open archive: tuples in the order of CHUNKS."""
    s = _Stream(raw)
    while (top := s.until(b"\r\n\r\n")) is not None:
        fields = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
        if fields["WARC-Type"] == "warcinfo":
            left = int(fields["Content-Length"])
            while left:
                left -= len(s.some(left))
            s.until(b"\r\n\r\n")
            continue
        http = s.until(b"\r\n\r\n")
        left = int(fields["Content-Length"]) - len(http) - 4
        size = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
        revisit = fields["WARC-Type"] == "revisit"
        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        base = (_page(fields["WARC-Record-ID"]), fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), fields.get("WARC-Target-URI"))
        sha, at, no = hashlib.sha1(), 0, 0
        while True:
            parts, n = [], 0
            while n < min(chunk, left):
                parts.append(s.some(min(chunk, left) - n))
                n += len(parts[-1])
                sha.update(parts[-1])
            left, at = left - n, at + n
            yield (*base, no, left == 0, b"".join(parts) if with_data else None, at, stated if revisit else base32(sha.digest()), stated, size)
            no += 1
            if not left:
                break
        if s.until(b"\r\n\r\n") is None:
            raise EOFError("an archive ends within a record")


def read_paths(with_data: bool):
    def f(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, p = _fs(path)
                with fs.open_input_stream(p, compression=None) as raw:
                    rows, size = [], 0
                    for r in records(raw, with_data):
                        rows.append(r)
                        size += 200 + len(r[6] or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), CHUNKS, strict=True)], schema=CHUNKS)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), CHUNKS, strict=True)], schema=CHUNKS)

    return f


def _bodies(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    return rows.select("page_id", "url", F.sha1("body").alias("sha1"), F.octet_length("body").cast("long").alias("n"), "body")


def record_plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, sha1, n, record_type and refers_to of each distinct page_id and payload, without bodies."""
    keys = _bodies(pages).select("page_id", "sha1", "n").distinct()
    best = keys.where(F.col("n") >= least).groupBy("sha1", "n").agg(F.max("page_id").alias("best"))
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return keys.join(best, ["sha1", "n"], "left").select("page_id", "sha1", "n", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to"))


def chunk_table(pages: DataFrame, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Rows (record, chunk_no, data), the chunks of a record one after the other in a task; revisits have one, empty."""
    n = F.greatest(F.lit(1), F.ceil(F.col("n") / chunk)).cast("int")
    rows = _bodies(pages).withColumn("uid", F.monotonically_increasing_id()).select("*", n.alias("n_chunks"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    rows = rows.withColumn("data", F.substring("body", F.col("chunk_no") * chunk + 1, F.lit(chunk))).drop("body", "n")
    plan = record_plan(pages, least).select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "n", "record_type", "refers_to")
    # by shuffle, so records with equal page_id and payload meet in a task
    rows = rows.hint("merge").join(plan, F.expr("page_id <=> _id AND sha1 = _sha1"))
    revisit = F.col("record_type") == "revisit"
    rows = rows.where(~revisit | (F.col("chunk_no") == 0)).sortWithinPartitions("page_id", "sha1", "url", "uid", "chunk_no")
    digest = F.concat(*[F.element_at(F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]), (F.shiftright(F.conv(F.substring("sha1", 5 * i + 1, 5), 16, 10).cast("int"), 15 - 5 * j).bitwiseAND(31) + 1)) for i in range(8) for j in range(4)])
    data, n_chunks = F.when(revisit, F.lit(b"")).otherwise(F.col("data")), F.when(revisit, 1).otherwise(F.col("n_chunks"))
    return rows.select("page_id", "url", digest.alias("digest"), F.col("n").alias("payload_bytes"), "record_type", "refers_to", "chunk_no", n_chunks.alias("n_chunks"), data.alias("data"))


def write_warc(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the manifest: path, n_records."""
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = chunk_table(pages, least)
    return saved(rows.mapInArrow(write_chunks(folder), "path string, n_records long"), "manifest")


def read_warc(spark: SparkSession, manifest: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives that a manifest lists; bytes_so_far and digest_so_far run through a payload."""
    n = max(1, manifest.count())
    return manifest.select("path").repartition(min(n, 4096), "path").mapInArrow(read_paths(with_data), CHUNKS_DDL)


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, as read from archives just written."""
    spark = pages.sparkSession
    rows = read_warc(spark, write_warc(pages, least=least), with_data=False).where("last")
    broken = (F.col("record_type") == "response") & ((F.col("digest_so_far") != F.col("header_digest")) | (F.col("bytes_so_far") != F.col("payload_bytes")))
    digest = F.when(broken, F.raise_error(F.concat(F.lit("broken record of page "), F.col("page_id").cast("string")))).otherwise(F.col("digest_so_far"))
    return rows.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
