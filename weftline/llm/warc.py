"""WARC archives with resolved revisits: written with fresh headers, and read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written
from .files import dealt, read_file, write_file

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def resolve_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, sha1 (hex), refers_to, refers_to_url.

    Of the pages with equal payloads of at least min_bytes bytes the smallest page_id is the original, the others revisit
    it. Only headers (id, digest) are shuffled by digest; payloads move once, by id, to where they are written. A null
    payload is empty; a null id is never an original, so it revisits one if there is any; rows that repeat an original
    are originals too; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    headers = rows.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "url", "sha1")
    originals = headers.groupBy("sha1").agg(F.min("page_id").alias("refers_to"), F.min_by("url", "page_id").alias("refers_to_url"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = headers.select("page_id", "sha1").join(originals, "sha1").filter(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    revisits = revisits.withColumnsRenamed({"page_id": "r_page_id", "sha1": "r_sha1"})
    resolved = rows.join(revisits, rows.page_id.eqNullSafe(F.col("r_page_id")) & (rows.sha1 == F.col("r_sha1")), "left")
    return resolved.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "payload_bytes", "sha1", "refers_to", "refers_to_url")


def _uri(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id, url, payload, payload_bytes, sha1, refers_to, refers_to_url, date: str) -> bytes:
    """One WARC record. payload is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + payload.encode() if payload is not None else http
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
        if refers_to_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(refers_to_url)}")
    head += [f"X-Payload-Length: {payload_bytes}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(resolved: DataFrame, path: str | None = None, date: str = "2000-01-01T00:00:00Z", file_bytes: int = 32_000_000, level: int = 4) -> DataFrame:
    """Write what resolve_revisits() gives as .warc.gz files (a gzip member per record) and return their manifest: file, n_records.

    A task writes files of about file_bytes bytes, one after the other; each is moved into place when whole. Every attempt
    of a task names its files anew, and the manifest has those of the attempts that count, so neither a lost executor nor
    a folder that is written to twice gives a record twice.
    """
    spark, root = resolved.sparkSession, path or new_path(resolved.sparkSession, "warc")

    def write(batches):
        name, part, members, held, n = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", 0, [], 0, 0

        def flush():
            file = f"{root}/pages-{name}-{part:04d}.warc.gz"
            info = f"software: weftline\r\nformat: WARC File Format 1.1\r\nrecords: {n}\r\n".encode()
            first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:{name}-{part}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"
            write_file(file, b"".join([gzip.compress(first, level, mtime=0), *members]))
            return pa.RecordBatch.from_pydict({"file": [file], "n_records": [n]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                members.append(gzip.compress(record(*row, date), level, mtime=0))
                held, n = held + len(members[-1]), n + 1
                if held >= file_bytes:
                    yield flush()
                    part, members, held, n = part + 1, [], 0, 0
        if members:
            yield flush()

    files = resolved.select("page_id", "url", "payload", "payload_bytes", "sha1", "refers_to", "refers_to_url").mapInArrow(write, "file string, n_records long")
    return written(files, "warc-manifest")


def parse(data: bytes):
    """(headers, block) of each record of a .warc.gz file."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read_warc(archives: DataFrame) -> DataFrame:
    """One row per response or revisit record of the archives, a table with a column `file`: write_warc()'s manifest, or other archives' paths.

    A payload that doesn't match its digest raises, as does a file that is missing.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows = []
                for headers, block in parse(read_file(file)):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest, n = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != n:
                            raise ValueError(f"the payload of {headers['warc-record-id']} doesn't match its headers")
                    rows.append({"page_id": _page_id(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": _page_id(headers.get("warc-refers-to"))})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return dealt(archives.select("file")).mapInArrow(read, RECORD_SCHEMA)
