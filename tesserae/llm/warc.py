"""WARC archives: writing records through Spark's own sink, reading them record by record.

Writer: one gzip member per record. Of the records with equal payloads, the one with the smallest
id is a response that holds the payload; the others are revisits that name it. Spark's text sink
writes the members' bytes, so archives go to any file system that Spark knows; what it puts after
each record is an empty gzip member, which readers pass over.

Which records are revisits is found from ids and digests alone; payloads are joined with that by their
id, so that no key gathers equal payloads. Files hold about `file_bytes` of payload each.

Reader: bytes are decompressed incrementally, a record is framed by its Content-Length, and block
and payload digests are verified. Spark hands a task one archive's bytes at a time, whole (2 GB at
most: archives of other writers must be smaller, the writer's own are bounded); beyond them, memory
holds one record and some decompressed slices, and results leave in batches of bounded size.

Ids may be of any type whose text casts back to it. Nulls: a null payload is empty; a null url leaves
out WARC-Target-URI; rows with a null id are written (as id `null`), and are responses only where no
row with their payload has an id. Repeated rows with the smallest id are responses each. An empty
table gives an empty archive and result. Records of other writers have their own record_id, and no
page_id unless that is one.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import ARROW_BYTES, small_batches

ID = "urn:tesserae:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def gzip_member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = gzip_member(b"", 6)


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def header_safe(value: str) -> str:
    return urllib.parse.quote(value, safe="%/:?#[]@!$&'()*+,;=-._~")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: "null" if i is None else i
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{ID}{name(page_id)}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_32(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_safe(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <{ID}{name(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, least_bytes: int = 0, level: int = 4, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 128 << 20) -> None:
    """Write pages(page_id, url, html) as archives under path; payloads under least_bytes are never revisits."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    slim = rows.select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.octet_length("html").alias("n"))
    size, count = slim.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    first = slim.where(F.col("n") >= least_bytes).groupBy("_sha1").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k").withColumnRenamed("_sha1", "of")
    again = slim.distinct().join(first, F.col("_sha1") == F.col("of")).where(~F.col("_id").eqNullSafe(F.col("first"))).select("_id", "_sha1", "first")
    rows = rows.join(again.withColumn("revisit", F.lit(True)), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left").drop("_id", "_sha1")

    def run(batches):
        for batch in small_batches(batches, "html"):
            out = []
            for page_id, url, html, sha1, first, revisit in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "first", "revisit")], strict=True):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                out.append(gzip_member(record(page_id, url, html.encode(), digest, first, bool(revisit), date), level))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = rows.mapInArrow(run, "member binary").select(F.col("member").cast("string"))
    most = max(1, int(file_bytes * count / size)) if size else max(1, count)
    # Latin-1 turns the separator's characters into the same bytes
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", most).text(path)


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return fields(head.split(b"\r\n")[1:]), body

    def verify(self) -> bool:
        """Whether the digests fit; a revisit's payload digest is that of another record's payload."""
        fine = self.headers.get("warc-block-digest") in (None, "sha1:" + sha1_32(self.block))
        if self.headers.get("warc-type") == "response" and self.block.startswith(b"HTTP/"):
            head, body = self.http
            fine = fine and int(head.get("content-length", len(body))) == len(body) and self.headers.get("warc-payload-digest") in (None, "sha1:" + sha1_32(body))
        return fine


class WarcError(ValueError):
    pass


def fields(lines: Iterable[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, sep, value = line.partition(b":")
        if not sep:
            raise WarcError(f"not a header: {line[:80]!r}")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes | None]:
    """Decompressed bytes of a sequence of gzip members, None where one ends."""
    z, fresh = zlib.decompressobj(31), True
    for chunk in chunks:
        while chunk:
            fresh = False
            data = z.decompress(chunk, 1 << 20)
            if data:
                yield data
            if z.eof:
                yield None
                chunk, z, fresh = z.unused_data, zlib.decompressobj(31), True
            else:
                chunk = z.unconsumed_tail
    if not fresh:
        raise WarcError("the archive ends inside a gzip member")


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """Records of an archive, one to a gzip member, framed by Content-Length."""
    held = bytearray()
    headers, need = None, 0
    for data in inflate(chunks):
        if data is not None:
            held += data
            if headers is None and (end := held.find(b"\r\n\r\n", max(0, len(held) - len(data) - 3))) >= 0:
                first, *rest = bytes(held[:end]).split(b"\r\n")
                if not first.startswith(b"WARC/"):
                    raise WarcError(f"not a record: {first[:80]!r}")
                headers = fields(rest)
                need = int(headers["content-length"])
                del held[: end + 4]
            continue
        if headers is None:
            if held:
                raise WarcError("a gzip member ends inside the headers")
            continue
        if len(held) != need + 4 or held[need:] != b"\r\n\r\n":
            raise WarcError(f"Content-Length says {need}, the member holds {len(held) - 4}")
        yield Record(headers, bytes(held[:need]))
        held, headers = bytearray(), None


def identity(urn: str | None) -> str | None:
    """The id that this writer made a record's URN of."""
    tail = (urn or "").strip("<>")
    return tail.removeprefix(ID) if tail.startswith(ID) and tail != ID + "null" else None


ROWS = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload", T.BinaryType())])
ARROW = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()]


def row_of(r: Record) -> tuple:
    if not r.verify():
        raise WarcError(f"digest of {r.headers['warc-record-id']}")
    kind, h = r.headers.get("warc-type"), r.headers
    head, body = r.http if kind in ("response", "revisit") and r.block.startswith(b"HTTP/") else ({}, r.block)
    digest = h.get("warc-payload-digest", "sha1:").removeprefix("sha1:") or (sha1_32(body) if kind == "response" else None)
    refers = h.get("warc-refers-to") if kind == "revisit" else None
    return h["warc-record-id"].strip("<>"), identity(h["warc-record-id"]), h.get("warc-target-uri"), kind, int(head.get("content-length", len(body))), digest, identity(refers) or refers, None if kind == "revisit" else body


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """A row for each record of the archives under path, with its payload; a broken archive or record fails the job."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = memoryview(content.as_buffer())
                rows, held = [], 0
                for r in read_records(data[i : i + (1 << 16)] for i in range(0, len(data), 1 << 16)):
                    rows.append(row_of(r))
                    held += len(r.block)
                    if held >= ARROW_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), ARROW, strict=True)], names=ROWS.names)

    out = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ROWS)
    return out.withColumns({c: F.col(c).try_cast(id_type) for c in ("page_id", "refers_to")})
