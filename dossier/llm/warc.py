"""WARC archives: a writer with one gzip member per record, and a sequential, verifying reader.

The writer finds records with equal payloads from digests alone (native SHA-256, a partial minimum per digest), so the first
of them is a ``response`` and later ones are ``revisit`` records that carry headers only. Digests of over a thousandth of all
rows, fewer than a thousand, are broadcast; the others meet their rows in a join in which no key holds more than that share.
Every task writes archives of at most ``ARCHIVE_BYTES`` compressed bytes under names of its own attempt and lists them in a
manifest table; a repeated or speculative attempt writes other names, and only listed archives are read. Archives go through
Arrow's file systems, so the folder may be local or in an object store or HDFS; a path without a scheme lies in Spark's default
file system.

The reader takes one archive at a time, reads it in pieces, inflates member after member incrementally, frames blocks by
Content-Length while they are inflated, and checks block and payload digests; a payload is held only if it is asked for. A
broken record is returned with ``error`` set, never dropped. After a damaged member the reader looks for the next member
that inflates whole; one row with error ``gzip`` stands for the stretch between, its length in ``skipped``.

Defined results: a null payload counts as empty; payloads under ``least`` bytes are never revisits; rows that repeat (equal
id and payload) are all responses and share a record id; rows without an id are written under an empty id and come back as
null; white space in addresses is percent-encoded; payloads may be as long as a binary value; an empty table gives no archive
and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import materialize, scratch, table

LEAST, HOT, ARCHIVE_BYTES, PIECE = 100, 1000, 256 << 20, 1 << 20
RECORD = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, offset long, archive string, error string, skipped long"
_PREFIX, _DATE = "urn:page:", "2024-01-01T00:00:00Z"
#: Kept as they are in addresses; white space and other characters are percent-encoded.
_ADDRESS = ":/?#[]@!$&'()*+,;=%-._~"
_MAGIC = b"\x1f\x8b\x08"


def planned(pages: DataFrame, id_col: str, payload_col: str, url_col: str, least: int = LEAST) -> DataFrame:
    """(id, url, payload, digest, n, first): first is the id of the response that a row revisits, else null."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    groups = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    often = groups.where(F.col("rows") > rows.count() // HOT)  # fewer than HOT digests
    hot = F.broadcast(often.select("digest", F.col("first").alias("hot")))
    rows = rows.join(hot, "digest", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))))
    rows = rows.join(groups.select(F.col("digest").alias("key"), "first"), "key", "left").withColumn("first", F.coalesce("hot", "first"))
    return rows.withColumn("first", F.when((F.col("n") >= least) & (F.col("first") < F.col("id")), F.col("first"))).drop("key", "hot")


def record(row_id, url: str | None, payload: bytes, digest: str, first) -> bytes:
    """One WARC record, uncompressed."""
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_PREFIX}{'' if row_id is None else row_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=_ADDRESS)}",
        f"WARC-Date: {_DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_PREFIX}{first}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _qualified(spark, path: str) -> str:
    """The path with the scheme of its file system, in a form that Arrow reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def write(pages: DataFrame, id_col: str, payload_col: str, url_col: str, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the archives below folder; their manifest (archive, bytes, records), materialised."""
    limit, folder = ARCHIVE_BYTES, _qualified(pages.sparkSession, folder)

    def save(frames):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task, part, out, size, n = TaskContext.get(), 0, None, 0, 0
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{part:04d}.warc.gz"
                    out, size, n = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                first, rid = (None if pd.isna(x) else int(x) for x in (r.first, r.id))
                data = _member(record(rid, r.url, bytes(r.payload), r.digest, first))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= limit:
                    out.close()
                    yield pd.DataFrame({"archive": [f"{folder}/{name}"], "bytes": [size], "records": [n]})
                    out, part = None, part + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    rows = planned(pages, id_col, payload_col, url_col, least).select("id", "url", "payload", "digest", "first")
    return materialize(rows.mapInPandas(save, "archive string, bytes long, records long"), "manifest")


def _headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _id(value: str | None) -> int | None:
    digits = (value or "").strip("<>").removeprefix(_PREFIX)
    return int(digits) if digits.lstrip("-").isdigit() else None


class Framer:
    """One record, framed and digested while its bytes arrive; the payload is held only if it is wanted."""

    def __init__(self, payloads: bool) -> None:
        self.payloads, self.head, self.rest, self.http = payloads, b"", b"", b""
        self.headers: dict[str, str] | None = None
        self.size, self.left, self.length, self.parts = -1, 0, 0, []
        self.block, self.payload, self.inside = hashlib.sha256(), hashlib.sha256(), False

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            self.head += data
            head, found, data = self.head.partition(b"\r\n\r\n")
            if not found:
                return
            self.head, self.headers = head, _headers(head)
            size = self.headers.get("content-length", "")
            self.size = self.left = int(size) if size.isdigit() else -1
        data, after = (data[: self.left], data[self.left :]) if self.left > 0 else (b"", data)
        self.left -= len(data)
        self.rest = (self.rest + after)[:8]
        self.block.update(data)
        if not self.inside:
            self.http += data
            head, found, data = self.http.partition(b"\r\n\r\n")
            if not found:
                return
            self.http, self.inside = head, True
        self.payload.update(data)
        self.length += len(data)
        if self.payloads:
            self.parts.append(data)

    def result(self) -> dict:
        """The record's fields, the payload, and what is wrong with it."""
        h = self.headers or {}
        kind, digest = h.get("warc-type", ""), h.get("warc-payload-digest", "").removeprefix("sha256:")
        error = None
        if not self.head.startswith(b"WARC/") or self.size < 0 or self.left or self.rest != b"\r\n\r\n":
            error = "framing"
        elif self.block.hexdigest() != h.get("warc-block-digest", "").removeprefix("sha256:"):
            error = "block digest"
        elif kind == "response" and self.payload.hexdigest() != digest:
            error = "payload digest"
        told = _headers(self.http).get("content-length", "")
        full = self.length if kind == "response" else int(told) if told.isdigit() else 0
        return {"page_id": _id(h.get("warc-record-id")), "record_type": kind, "refers_to": _id(h.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": full, "payload": b"".join(self.parts) if self.payloads else None, "error": error}


def parse(data: bytes, payloads: bool = True) -> dict:
    framer = Framer(payloads)
    framer.feed(data)
    return framer.result()


def members(stream, piece: int = PIECE, start=lambda: None) -> Iterator[tuple[int, object, int]]:
    """(offset, sink, bytes) of each gzip member, read and inflated in pieces of bounded size.

    start() gives the sink of a member, whose feed() takes its bytes. A damaged stretch gives one sink of None.
    """
    data, at, bad = b"", 0, -1  # bytes read but not used, their offset, start of a damaged stretch
    end = False
    while True:
        if not data and not end:
            data = stream.read(piece)
            end = not data
        if not data:
            break
        inflate, sink, raw, begin = zlib.decompressobj(31), start(), [], at
        whole, given = False, data
        while given or not end:
            if not given:
                given = stream.read(piece)
                end = not given
                if end:
                    break
            raw.append(given)
            out = b""
            try:
                while given or out:
                    out = inflate.decompress(given, piece)
                    sink.feed(out)
                    given = inflate.unconsumed_tail
            except zlib.error:
                break
            if inflate.eof:
                whole = True
                break
        if whole:
            if bad >= 0:
                yield bad, None, begin - bad
                bad = -1
            read = sum(map(len, raw))
            data = inflate.unused_data
            at = begin + read - len(data)
            yield begin, sink, at - begin
            continue
        bad = begin if bad < 0 else bad
        data, at = b"".join(raw), begin
        while True:  # to the next place that may start a member
            found = data.find(_MAGIC, 1)
            if found > 0:
                data, at = data[found:], at + found
                break
            more = b"" if end else stream.read(piece)
            if not more:
                end = True
                at, data = at + len(data), b""
                break
            keep = data[-2:]
            at, data = at + len(data) - len(keep) - 1, b"\0" + keep + more
    if bad >= 0:
        yield bad, None, at - bad


def read(manifest: DataFrame, payloads: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """All records (columns of RECORD) of the archives named in a table with a column `archive`; payload is null unless asked for."""

    def load(frames):
        for pdf in frames:
            for name in pdf["archive"]:
                fs, path = pafs.FileSystem.from_uri(name if ":/" in name else f"file://{name}")
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for offset, sink, n in members(stream, PIECE, lambda: Framer(payloads)):
                        row = sink.result() if sink is not None else {"error": "gzip", "skipped": n}
                        size += n + len(row.get("payload") or b"")
                        rows.append(row | {"offset": offset, "archive": name})
                        if size >= batch_bytes or len(rows) >= 5000:
                            yield _frame(rows)
                            rows, size = [], 0
                    if rows:
                        yield _frame(rows)

    n = max(1, manifest.count())
    return manifest.select("archive").repartition(min(n, 10_000), "archive").mapInPandas(load, RECORD)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64", "offset": "Int64", "skipped": "Int64"})


def op2_warc(spark, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write(table(spark, sf_dir, "pages"), "page_id", "html", "url", folder)
    return read(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to, NULL::VARCHAR AS error FROM f
"""
