"""WARC archives: written by Spark's text writer, read back by segment reassembly.

A record is one string whose end (CR LF CR LF) is the writer's line separator, so the files are plain WARC/1.1 in gzip. Long blocks are
cut into segments: the first in the record itself, the others in continuation records that name it as their origin. Reading parses
the files record by record; complete records are done at once, and only segmented ones are grouped by origin, put in order of their
segment number, checked against the total length, and freed of chunked framing.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelrisk.llm.common import Scratch

CRLF = "\r\n"
PARSED = "type string, record_id string, uri string, refers_to string, digest string, segment int, origin string, total long, block binary"


def record_id(key: Column, digest: Column, copy: Column) -> Column:
    """A page_id, null among them, may come with several payloads, and each of these more than once."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(":"), copy.cast("string"), F.lit(">"))


def joined_bytes(parts: Column) -> Column:
    """Strings of one character a byte as one binary, in time linear in its length."""
    return F.encode(F.array_join(parts, ""), "ISO-8859-1")


def header(*fields: tuple[str, Column]) -> Column:
    """A field whose value is null is left out."""
    return F.concat(F.lit("WARC/1.1" + CRLF), *[F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF)), F.lit("")) for k, v in fields], F.lit(CRLF))


def classify(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, html (never null), digest (SHA-256), bytes, copy: 1, 2, ... among the rows of one page_id and payload, first: the smallest page_id with an equal payload of at least ``least_bytes`` if it is less than the row's, else null."""
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    long = p.filter(F.col("bytes") >= least_bytes).select("page_id", "digest")
    groups = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first")
    later = long.join(groups, "digest").filter("page_id > first").select("page_id", "digest", "first").distinct()
    return p.join(later, ["page_id", "digest"], "left").withColumn("copy", F.row_number().over(W.partitionBy("page_id", "digest").orderBy("url")))


def records(pages: DataFrame, segment_bytes: int = 16_384, chunk_bytes: int = 4_096) -> DataFrame:
    """One string per WARC record of the classified pages. Blocks are HTTP responses with chunked bodies; what is longer than ``segment_bytes`` continues in further records. Cuts fall on bytes, not on letters."""
    raw = F.col("html").cast("binary")

    def frame(i: Column) -> Column:
        piece = F.substring(raw, i * chunk_bytes + 1, F.lit(chunk_bytes))
        return F.concat(F.lower(F.hex(F.octet_length(piece).cast("long"))), F.lit(CRLF), F.decode(piece, "ISO-8859-1"), F.lit(CRLF))

    count = F.ceil(F.octet_length("html") / chunk_bytes).cast("int")
    frames = F.when(count > 0, joined_bytes(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), frame))).otherwise(F.lit("").cast("binary"))
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Transfer-Encoding: chunked{CRLF}{CRLF}").cast("binary")
    full = F.concat(http, frames, F.lit(f"0{CRLF}{CRLF}").cast("binary"))
    empty = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}").cast("binary")
    p = pages.withColumn("block", F.when(F.col("first").isNull(), full).otherwise(empty)).withColumn("length", F.octet_length("block"))
    p = p.withColumn("segments", F.greatest(F.ceil(F.col("length") / segment_bytes).cast("int"), F.lit(1)))
    p = p.withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("segments"))))
    part = F.substring("block", (F.col("segment") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    own, begins, several = record_id(F.col("page_id"), F.col("digest"), F.col("copy")), F.col("segment") == 1, F.col("segments") > 1
    head = header(
        ("WARC-Type", F.when(~begins, "continuation").when(F.col("first").isNull(), "response").otherwise("revisit")),
        ("WARC-Record-ID", F.when(begins, own).otherwise(F.concat(F.rtrim(own, F.lit(">")), F.lit(":segment:"), F.col("segment").cast("string"), F.lit(">")))),
        ("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        ("WARC-Target-URI", F.when(begins, F.regexp_replace("url", r"[\r\n\s]", "%20"))),
        ("WARC-Payload-Digest", F.when(begins, F.concat(F.lit("sha256:"), F.col("digest")))),
        ("WARC-Profile", F.when(begins & F.col("first").isNotNull(), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(begins, record_id(F.col("first"), F.col("digest"), F.lit(1)))),
        ("WARC-Segment-Number", F.when(several, F.col("segment"))),
        ("WARC-Segment-Origin-ID", F.when(~begins, own)),
        ("WARC-Segment-Total-Length", F.when(several & (F.col("segment") == F.col("segments")), F.col("length"))),
        ("Content-Type", F.when(begins, "application/http; msgtype=response")),
        ("Content-Length", F.octet_length(part)),
    )
    return p.select(F.concat(head.cast("binary"), part).cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, file_rows: int = 2_000) -> None:
    """Writes classified pages as gzip WARC files of at most ``file_rows`` records each, so that a reader holds one bounded file."""
    records(pages).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", file_rows).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of an archive's records."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"record at byte {at} is cut off")
        yield fields, block
        at = end + 4 + size + 4


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives under ``path`` (gzip or plain)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PARSED.split(", ")]
        for b in batches:
            for cell in b.column(0):
                data = cell.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows: list[tuple] = []
                for h, block in parse(data):
                    number, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
                    digest = h.get("warc-payload-digest", "").rpartition(":")[2] or None
                    rows.append((h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, int(number) if number else None, h.get("warc-segment-origin-id"), int(total) if total else None, block))
                    if len(rows) == 500:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    return files.mapInArrow(run, PARSED)


TYPES = [pa.string()] * 5 + [pa.int32(), pa.string(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names)


def dechunk(body: bytes) -> bytes:
    """Body without chunked transfer framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + size


def payload(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, _, body = block.partition(b"\r\n\r\n")
    chunked = any(line.split(b":")[0].strip().lower() == b"transfer-encoding" and b"chunked" in line.lower() for line in head.split(b"\r\n")[1:])
    return dechunk(body) if chunked else body


def reassemble(parsed: DataFrame) -> DataFrame:
    """record_id, type, uri, refers_to, digest, block of whole records. A record whose segments are missing, doubled or add up to another length than its total fails."""
    whole = ["record_id", "type", "uri", "refers_to", "digest", "block"]
    parts = parsed.filter("segment IS NOT NULL").withColumn("of", F.coalesce("origin", "record_id"))
    piece = F.struct("segment", "total", "block", "type", "uri", "refers_to", "digest")
    grouped = parts.groupBy("of").agg(F.array_sort(F.collect_list(piece)).alias("s"))
    joined = joined_bytes(F.transform("s", lambda x: F.decode(x["block"], "ISO-8859-1")))
    numbers_fit = F.expr("forall(sequence(1, size(s)), i -> element_at(s, i).segment = i)")
    last, first = F.element_at("s", -1), F.element_at("s", 1)
    grouped = grouped.withColumn("block", joined)
    fits = numbers_fit & F.coalesce(last["total"] == F.octet_length("block"), F.lit(False))
    block = F.when(fits, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments do not fit: "), F.col("of"))).cast("binary"))
    segmented = grouped.select(F.col("of").alias("record_id"), first["type"].alias("type"), first["uri"].alias("uri"), first["refers_to"].alias("refers_to"), first["digest"].alias("digest"), block.alias("block"))
    return parsed.filter("segment IS NULL").select(*whole).union(segmented)


def payload_facts(recs: DataFrame) -> DataFrame:
    """record_id, type, refers_to, stated digest, and the size and SHA-256 of the decoded payload (of a revisit: of nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = [payload(x) for x in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(map(len, bodies), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in bodies])], ["record_id", "type", "refers_to", "digest", "bytes", "sha256"])

    return recs.select("record_id", "type", "refers_to", "digest", "block").mapInArrow(run, "record_id string, type string, refers_to string, digest string, bytes long, sha256 string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives in the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. A revisit has no payload of its own: it takes size and digest from the record it refers to, which
    must agree with the digest it states. Every row is a record of its own, also where its page_id is null or comes more than once.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_archives(classify(pages), scratch.path("archives"))
    facts = scratch.write(payload_facts(reassemble(read_archives(spark, scratch.path("archives")))), "facts")
    of = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+|null):", 1).try_cast("long")
    responses = facts.filter("type = 'response'").select(of("record_id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("sha256").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = facts.filter("type = 'revisit'").select(of("record_id").alias("page_id"), F.col("refers_to").alias("target"), "digest")
    seen = facts.filter("type = 'response'").select(F.col("record_id").alias("target"), F.col("bytes").alias("payload_bytes"), "sha256")
    named = revisits.join(seen, "target", "left")
    checked = F.when(F.col("digest") == F.col("sha256"), F.col("sha256")).otherwise(F.raise_error(F.lit("a revisit and its response differ")).cast("string"))
    return responses.union(named.select("page_id", "payload_bytes", checked.alias("payload_digest"), F.lit("revisit"), of("target")))
