"""WARC archives: a writer with revisit records and a sequential reader.

Every record is a gzip member of its own. The reader takes the stream in chunks through one zlib
decompressor per member, frames the record by its Content-Length, and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import byte_values
from sparkloom.llm.tokenfiles import open_fs
from sparkloom.session import scratch_dir, stored

CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A stream that is not a sound sequence of records."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _value(x) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in str(x))


def record_bytes(kind: str, payload: bytes, record_id: str, fields: dict, date: str) -> bytes:
    """A gzip member with one record; the block of a revisit has the HTTP header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": date, "Content-Type": "application/http;msgtype=response"}
    lines |= {"WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "WARC-Block-Digest": f"sha1:{digest_of(block)}"}
    lines |= {k: v for k, v in fields.items() if v is not None} | ({"WARC-Profile": PROFILE} if kind == "revisit" else {}) | {"Content-Length": len(block)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {_value(v)}\r\n" for k, v in lines.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def read_members(stream) -> Iterator[Iterator[bytes]]:
    """The members of a gzip stream, each as pieces of its content; a member must be read before the next."""
    rest = b""
    while True:
        rest = rest or stream.read(CHUNK)
        if not rest:
            return
        z = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            data = rest
            while True:
                try:
                    out = z.decompress(data, 4 * CHUNK)
                except zlib.error as e:
                    raise WarcError(f"not a gzip member: {e}") from e
                if out:
                    yield out
                if z.eof:
                    rest = z.unused_data
                    return
                data = z.unconsumed_tail or stream.read(CHUNK)
                if not data:
                    raise WarcError("the last member is cut off")

        yield pieces()


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "surrogatepass").partition(":")
        if not colon:
            raise WarcError(f"no header line: {line[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(stream) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """``(WARC fields, HTTP fields, payload)`` of each record in turn, verified."""
    for member in read_members(stream):
        buf = bytearray()
        for piece in member:
            buf += piece
            if (cut := buf.find(b"\r\n\r\n")) >= 0:
                break
        else:
            raise WarcError("a record without an end of header")
        first, *lines = bytes(buf[:cut]).split(b"\r\n")
        if not first.startswith(b"WARC/1."):
            raise WarcError(f"not a record: {first[:40]!r}")
        fields = _headers(lines)
        length = int(fields["content-length"])
        block = bytearray(buf[cut + 4 :])
        for piece in member:
            block += piece
            if len(block) > length + 4:
                break
        if len(block) != length + 4 or block[-4:] != b"\r\n\r\n":
            raise WarcError(f"the block has {len(block) - 4} bytes where Content-Length says {length}")
        body = bytes(block[:-4])
        said = fields.get("warc-block-digest", "").removeprefix("sha1:")
        if said and said != digest_of(body):
            raise WarcError("the block does not have its digest")
        head, _, payload = body.partition(b"\r\n\r\n")
        http = _headers(head.split(b"\r\n")[1:])
        said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if fields["warc-type"] == "response" and (said and said != digest_of(payload) or len(payload) != int(http.get("content-length", len(payload)))):
            raise WarcError("the payload does not have its digest or length")
        yield fields, http, payload


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 1 << 30) -> DataFrame:
    """Write a record per row; the manifest ``(uri, records)``, a row per archive.

    Of rows with equal payloads of at least ``least_bytes``, those with the largest id are responses and
    the others revisit it; rows with smaller payloads are responses. A null payload is empty; a null id
    is below all others; rows that repeat the largest id are all responses. Other columns are ignored.
    Groups of equal payloads are formed over digests alone, with a partial maximum before the shuffle; a
    very large group of rows is split where it joins its one largest id.
    """
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    largest = rows.groupBy("sha").agg(F.max("key").alias("largest"))
    bytes_of = F.octet_length("payload")
    told = rows.join(largest, "sha").withColumn("refers", F.when((bytes_of >= least_bytes) & ~F.col("key").eqNullSafe(F.col("largest")), F.col("largest").cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, seq = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        file, written, records, done = None, 0, 0, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3)]
            for key, url, refers, payload in zip(*columns, byte_values(batch.column(2))):
                if file is None or written >= archive_bytes:
                    if file is not None:
                        file.close()
                        done.append((uri, records))
                    uri = f"{folder}/pages-{part:06d}-{seq:04d}-{name[:12]}.warc.gz"
                    fs, at = open_fs(uri)
                    fs.create_dir(at.rpartition("/")[0], recursive=True)
                    file, written, records, seq = fs.open_output_stream(at, compression=None), 0, 0, seq + 1
                record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}/{seq}/{records}")
                fields = {"WARC-Target-URI": url, "X-Document-ID": key, "X-Refers-To-Document-ID": refers}
                raw = record_bytes("response" if refers is None else "revisit", payload, str(record_id), fields, date)
                file.write(raw)
                written, records = written + len(raw), records + 1
        if file is not None:
            file.close()
            done.append((uri, records))
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["uri", "records"])

    return stored(told.select("id", "url", "payload", "refers").mapInArrow(run, "uri string, records bigint"), "manifest")


def read_archives(manifest: DataFrame, id_col: str = "page_id", id_type: str = "bigint", with_payload: bool = False) -> DataFrame:
    """Every record of the archives in ``manifest``, a task per archive: ``(id_col, url, payload_bytes,
    payload_digest, record_type, refers_to)``, and its payload if asked for. The length and digest of a
    revisit are those of the full payload. A damaged archive fails the job."""
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers"] + ["payload"] * with_payload
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, at = open_fs(uri)
                out: list[tuple] = []
                held = 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for fields, http, payload in read_records(stream):
                        row = (fields.get("x-document-id"), fields.get("warc-target-uri"), int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], fields.get("x-refers-to-document-id"))
                        out.append(row + (payload,) * with_payload)
                        held += len(payload) * with_payload
                        if len(out) >= 2000 or held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    archives = manifest.select("uri").repartition(max(1, manifest.count()))
    found = archives.mapInArrow(run, "id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers string" + ", payload binary" * with_payload)
    return found.select(F.col("id").cast(id_type).alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type).alias("refers_to"), *["payload"] * with_payload)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{scratch_dir(spark)}/warc")
    return read_archives(manifest).drop("url")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
g AS (SELECT x, max(page_id) AS largest FROM p GROUP BY x)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (1 + (((('0x' || substr(x, (5 * (i // 4) + 1)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM p JOIN g USING (x)
"""
