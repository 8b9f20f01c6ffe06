"""WARC archives: writing, normalising monolithic gzip, reading back by a sidecar offset index.

A monolithic archive is one gzip stream over the whole file, so no record can be reached
without inflating all before it. The normaliser inflates that stream once, writes every record as
a gzip member of its own and, beside the file, an index of the members' offsets.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, written

#: Records with equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Uncompressed bytes after which a writer starts its next archive.
ARCHIVE_BYTES = 256 << 20
_CHUNK = 1 << 20


def _open(path: str, write: bool = False):
    where, name = fs.FileSystem.from_uri(path)
    if write:
        where.create_dir(name.rsplit("/", 1)[0], recursive=True)
        return where.open_output_stream(name, compression=None)
    return where.open_input_file(name)


def _publish(part: str, final: str) -> None:
    """Makes a finished file visible under its name, which names the attempt, so no other attempt has it."""
    where, a = fs.FileSystem.from_uri(part)
    where.move(a, fs.FileSystem.from_uri(final)[1])


def _attempt() -> str:
    c = TaskContext.get()
    return f"{c.partitionId():06d}", f"{c.taskAttemptId()}"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record; a revisit carries no payload but the digest and size of the full one."""
    kind = "response" if refers_to is None else "revisit"
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    target = "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in (url or ""))
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(), b"WARC-Target-URI: " + target.encode("utf-8", "surrogatepass"), f"WARC-Payload-Digest: sha1:{sha}".encode(), f"WARC-Payload-Length: {size}".encode()]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + payload + b"\r\n\r\n"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an uncompressed stream that has readline() and read(n)."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.partition(b":")
            headers[name.decode().strip().lower()] = value.strip().decode("utf-8", "surrogatepass")
        n = int(headers["content-length"])
        payload = stream.read(n)
        if len(payload) != n:
            raise EOFError("record cut short")
        yield headers, payload


class _Inflated(io.RawIOBase):
    """Inflates a gzip file of one or many members in bounded pieces."""

    def __init__(self, raw):
        self.raw, self.z, self.rest = raw, zlib.decompressobj(31), b""

    def readable(self):
        return True

    def readinto(self, into):
        while True:
            data = self.rest or self.raw.read(_CHUNK)
            self.rest = b""
            if not data:
                if not self.z.eof and self.fed:
                    raise EOFError("gzip stream cut short")
                return 0
            self.fed = True
            out = self.z.decompress(data, len(into))
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.rest = self.z.unused_data
                self.z, self.fed = zlib.decompressobj(31), False
            if out:
                into[: len(out)] = out
                return len(out)

    fed = False


def with_record_types(pages: DataFrame) -> DataFrame:
    """Adds payload_digest, payload_bytes and refers_to to pages (page_id, url, html). Payloads of
    REVISIT_BYTES or more that occur more than once: the row with the largest page_id keeps the
    payload, the others refer to it. Smaller payloads don't move; the digests that occur again are a table whose
    size Spark knows when it picks the join."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    big = F.col("payload_bytes") >= REVISIT_BYTES
    again = p.where(big).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL")
    again = written(again.select(F.col("payload_digest").alias("_d"), "_first"), "digests")
    j = p.where(big).join(again, F.col("payload_digest") == F.col("_d"), "left").drop("_d").unionByName(p.where(~big).withColumn("_first", F.lit(None).cast("long")))
    refers = F.when(F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("_first"))), F.col("_first"))
    return j.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "payload_digest", "payload_bytes", refers.alias("refers_to"))


def write_monolithic(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``records`` (of with_record_types) as monolithic .warc.gz files in ``folder``, one gzip
    stream each, and returns the manifest (path, records). A file is written under its
    attempt's name and then moved, and the manifest names only files of attempts that ended well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = _attempt()
        done, out, names = 0, None, []

        def close():
            out.write(z.flush())
            out.close()
            final = f"{folder}/{part}-{attempt}-{len(names):04d}.warc.gz"
            _publish(temp, final)
            names.append((final, done))

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    temp = f"{folder}/_{part}-{attempt}-{len(names)}"
                    out, z, size, done = _open(temp, True), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                page_id, url, html, digest, n, refers_to = row
                data = record_bytes(page_id, url, (html or "").encode("utf-8", "surrogatepass"), digest, n, refers_to)
                out.write(z.compress(data))
                size, done = size + len(data), done + 1
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if names:
            yield pa.RecordBatch.from_pydict({"path": pa.array([x[0] for x in names]), "records": pa.array([x[1] for x in names], pa.int64())})

    cols = records.select("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to")
    return written(cols.mapInArrow(run, "path string, records long"), "manifest")


_INDEX = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("digest", pa.string())])


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites the archives (path) into ``folder`` with a gzip member for each record, and returns the
    index: path, offset, length, record_id, record_type, digest. The same lines are beside each
    file as <file>.idx, tab-separated. Each archive is inflated once, as a stream, and
    one record is in memory at a time; there are as many tasks as archives. A file's name begins with its attempt's, and the
    index names only files of attempts that ended well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, attempt = _attempt()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name = path.rsplit("/", 1)[1]
                final, temp, lines, at = f"{folder}/{attempt}-{name}", f"{folder}/_{attempt}-{name}", [], 0
                with _open(path) as raw, _open(temp, True) as out:
                    for headers, payload in read_records(io.BufferedReader(_Inflated(raw), _CHUNK)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in headers.items()) + b"\r\n"
                        member = z.compress(head) + z.compress(payload) + z.compress(b"\r\n\r\n") + z.flush()
                        out.write(member)
                        lines.append((final, at, len(member), headers["warc-record-id"], headers["warc-type"], headers.get("warc-payload-digest")))
                        at += len(member)
                with _open(temp + ".idx", True) as side:
                    for _, *fields in lines:
                        side.write(("\t".join("" if x is None else str(x) for x in fields) + "\n").encode())
                _publish(temp, final)
                _publish(temp + ".idx", final + ".idx")
                for i in range(0, len(lines), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines[i : i + 4096]), _INDEX.types)], schema=_INDEX)

    spread = archives.select("path").repartition(max(1, archives.count()), "path")
    return written(spread.mapInArrow(run, "path string, offset long, length long, record_id string, record_type string, digest string"), "index")


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_by_index(index: DataFrame) -> DataFrame:
    """Reads records back at the offsets of ``index``, in the order of each archive, in as many tasks as a shuffle has; a
    response's payload must have the size and digest that its headers say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows = []
            for p, offset, length in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if p != path:
                    if file:
                        file.close()
                    path, file = p, _open(p)
                file.seek(offset)
                headers, payload = next(read_records(io.BytesIO(zlib.decompress(file.read(length), 31))))
                digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                size = int(headers["warc-payload-length"])
                if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {headers['warc-record-id']} is not what was written")
                rows.append((_number(headers["warc-record-id"]), size, digest, headers["warc-type"], _number(headers.get("warc-refers-to")), headers["warc-target-uri"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _READ.types)], schema=_READ)
        if file:
            file.close()

    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = index.select("path", "offset", "length").repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset")
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op1(spark, sf_dir):
    """Null html is an empty payload, a null url an empty target; rows with equal page_id and payload are
    both responses if theirs is the largest id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    at = new_path(spark, "warc")
    manifest = write_monolithic(with_record_types(pages), f"{at}/monolithic")
    return read_by_index(normalise(manifest, f"{at}/normal"))


OP1_SQL = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to, url
FROM m
"""
