"""WARC archives with segmented records: writing, reading back and putting segments together.

A response is an HTTP message in chunked transfer coding. Blocks above SEGMENT bytes are cut: the first part stays the response, the
others are continuation records that name it as their origin and carry segment numbers; the last one states the total length.
Reading parses archives as streams, groups segments by origin, orders them by number, checks numbers and total length, and
decodes the chunks. A page whose payload an earlier page has becomes a revisit record without payload.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteval.llm.common import table
from siteval.llm.tokens import files_in, opened
from siteval.runtime import scratch_path

SEGMENT, CHUNK = 16_384, 4_096
#: payloads below this many bytes are never revisits
REVISIT_BYTES = 100
DATE = "2020-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + CHUNK]), payload[i : i + CHUNK]) for i in range(0, len(payload), CHUNK)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None where the framing is broken or does not end. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip()
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record without the two line ends that close it. Line ends in field values are blanks."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {' '.join(v.splitlines())}\r\n".encode() for k, v in head) + b"\r\n" + block


def _records(segment: int):
    def run(batches):
        for b in batches:
            out, held = [], 0
            for page, url, payload, digest, first, row in zip(*(c.to_pylist() for c in b.columns)):
                name = f"urn:page:{'null' if page is None else page}:{row}"
                fields = [("WARC-Payload-Digest", f"sha256:{digest}")] + ([("WARC-Target-URI", url)] if url else [])
                if first is not None:
                    out.append(record("revisit", name, [*fields, ("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b""))
                    continue
                block = _HTTP + chunked(payload)
                parts = [block[i : i + segment] for i in range(0, len(block), segment)]
                if len(parts) == 1:
                    out.append(record("response", name, [*fields, ("Content-Type", "application/http;msgtype=response")], block))
                for i, part in enumerate(parts if len(parts) > 1 else ()):
                    own = [("WARC-Segment-Number", str(i + 1))] + ([("WARC-Segment-Origin-ID", f"<{name}>")] if i else [*fields, ("Content-Type", "application/http;msgtype=response")])
                    own += [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) - 1 else []
                    out.append(record("continuation" if i else "response", f"{name}:{i + 1}" if i else name, own, part))
                held += len(block)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])
    return run


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT) -> None:
    """Gzipped archives, one per input partition, written by Spark's text writer: its line separator is the two line ends after a record.

    Of equal payloads of REVISIT_BYTES or more the smallest id is written whole, the others as revisits to it; rows that
    repeat that id and payload, and rows with a null id, are written whole. A null payload is empty."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    big = rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
    first = big.groupBy("digest").agg(F.min("page").alias("first"), F.max("page").alias("last")).filter("first < last").select("digest", "first")
    told = rows.join(first, "digest", "left").withColumn("refers", F.when(F.col("page") > F.col("first"), F.col("first")))
    held = told.select("page", "url", "payload", "digest", "refers", F.monotonically_increasing_id().alias("row")).mapInArrow(_records(segment), "record binary")
    held.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


_FIELDS = {b"warc-type": "kind", b"warc-record-id": "name", b"warc-segment-origin-id": "origin", b"warc-segment-number": "number", b"warc-segment-total-length": "total",
           b"warc-refers-to": "refers", b"warc-target-uri": "url", b"warc-payload-digest": "digest"}
_SCHEMA = pa.schema([("kind", pa.string()), ("name", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("refers", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("block", pa.binary())])


def parse(stream):
    """The records of an archive, read from a stream one at a time; what follows a broken header is not read."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line.startswith(b"WARC/"):
            return
        row, size = dict.fromkeys(_SCHEMA.names), 0
        while (line := stream.readline()).strip():
            name, _, value = line.partition(b":")
            name, value = name.strip().lower(), value.strip()
            if name == b"content-length":
                size = int(value)
            elif name in _FIELDS:
                text = value.decode("utf-8", "replace").strip("<>") if name != b"warc-target-uri" else value.decode("utf-8", "replace")
                row[_FIELDS[name]] = int(text) if name in (b"warc-segment-number", b"warc-segment-total-length") else text
        row["block"] = stream.read(size)
        if len(row["block"]) < size:
            return
        yield row


def _parsed(batches):
    for b in batches:
        for path in b.column(0).to_pylist():
            with opened(path) as raw, (gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw) as f:
                rows, held = [], 0
                for r in parse(f):
                    rows.append(r)
                    held += len(r["block"])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _decoded(batches):
    """(name, kind, refers, url, payload, digest) of whole records; a payload that cannot be put together is null."""
    for b in batches:
        rows = []
        for name, kind, refers, url, total, numbers, parts in zip(*(c.to_pylist() for c in b.columns)):
            block, payload = b"".join(parts), None
            whole = numbers is None or numbers == list(range(1, len(parts) + 1)) and total == len(block)
            head, sep, body = block.partition(b"\r\n\r\n")
            if kind == "response" and whole and sep:
                payload = unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body
            rows.append({"name": name, "kind": kind, "refers": refers, "url": url, "payload": payload, "payload_bytes": None if payload is None else len(payload),
                         "payload_digest": None if payload is None else hashlib.sha256(payload).hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, schema=_WHOLE)


_WHOLE = pa.schema([("name", pa.string()), ("kind", pa.string()), ("refers", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, refers, url, payload, payload_bytes, payload_digest) of the responses and revisits under ``path``.

    Segments may lie in any archive and any order. A response whose segments do not run from 1 without gap or repeat, whose lengths
    do not add up to the stated total, or whose chunks are broken, has a null payload. Continuations without a
    first segment are returned with a null kind."""
    records = files_in(spark, path).select("path").mapInArrow(_parsed, "kind string, name string, origin string, number int, total long, refers string, url string, digest string, block binary")
    single = records.filter("number is null").select("name", "kind", "refers", "url", "total", F.lit(None).cast("array<int>").alias("numbers"), F.array("block").alias("parts"))
    parts = F.sort_array(F.collect_list(F.struct("number", "block")))
    mine = F.coalesce("origin", "name")
    grouped = records.filter("number is not null").groupBy(mine.alias("name")).agg(F.max(F.when(F.col("number") == 1, F.col("kind"))).alias("kind"), F.max("refers").alias("refers"),
                                                                                    F.max("url").alias("url"), F.max("total").alias("total"), parts.alias("p"))
    joined = grouped.select("name", "kind", "refers", "url", "total", F.col("p.number").alias("numbers"), F.col("p.block").alias("parts"))
    return single.unionByName(joined).mapInArrow(_decoded, "name string, kind string, refers string, url string, payload binary, payload_bytes long, payload_digest string")


def page_of(name: Column) -> Column:
    return F.regexp_extract(name, r"^urn:page:(-?\d+)", 1).try_cast("long")


def query(spark, sf_dir):
    """Every page as the archives hold it: a revisit has the payload of the response that it refers to."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    got = read_archives(spark, path).select(page_of(F.col("name")).alias("page_id"), "kind", page_of(F.col("refers")).alias("refers_to"), "payload_bytes", "payload_digest")
    whole = got.filter("kind = 'response'")
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to"]
    meant = whole.groupBy(F.col("page_id").alias("refers_to")).agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("p"))
    again = got.filter("kind = 'revisit'").drop("payload_bytes", "payload_digest").join(meant, "refers_to", "left").select("page_id", "kind", "refers_to", "p.payload_bytes", "p.payload_digest")
    return whole.select(*columns).unionByName(again.select(*columns))
