"""WARC archives: writing with revisits and segments, reading with segment reassembly.

Writing: of records with equal payloads of ``LEAST_REVISIT`` bytes or more the one with the
smallest page_id is a response and the others are revisits of it.  A response's block (an
HTTP message in chunked transfer framing) is cut into segments; the first is the response
record, the others are continuation records that name their origin and their number, and the
last one gives the total length.  Spark's own writer puts the records into files, so any
store that Spark can write will do, and a file holds ``RECORDS_A_FILE`` records at most.

Reading: files are parsed by their Content-Length fields (gzip members are opened);
continuations are grouped by origin, ordered by number, held against the total length, and
the chunked framing is decoded.  Only segmented records are shuffled, and a group is as large
as its one record.

Defined cases: a null html is an empty payload; payloads below the limit are all responses;
rows that repeat the smallest page_id of a payload are all responses; a null page_id is the
largest and stays null; records with missing segments, a wrong total or bad framing come out
with ``complete`` false and a null payload; control characters in a url are percent-coded.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_REVISIT = 100
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
RECORDS_A_FILE = 1_000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest and, for revisits, refers_to."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("held"))
    firsts = firsts.where("held > 1").select("digest", "first")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return rows.join(firsts, "digest", "left").withColumn("refers_to", refers).drop("first")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        if end < 0:
            return None
        if size == 0:
            return b"".join(parts)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        parts.append(part)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP message; None where it is broken."""
    head, found, body = block.partition(_END)
    if not found:
        return None
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block


def records_of(page_id, url: str | None, payload: bytes, digest: str, refers_to, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page, without the two line ends that close each."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or None
    own = f"<urn:uuid:{uuid.uuid4()}>"
    common = [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=response")]
    described = [("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", len(payload)), ("Page-ID", page_id)]
    if refers_to is not None:
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + _END
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *described, ("WARC-Profile", _PROFILE), ("Refers-To-Page-ID", refers_to)], head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + _END + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *described], block)
        return
    cuts = range(0, len(block), segment_bytes)
    for number, at in enumerate(cuts, 1):
        part, last = block[at : at + segment_bytes], at == cuts[-1]
        if number == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *described, ("WARC-Segment-Number", 1)], part)
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number)]
            yield _record([*fields, ("WARC-Segment-Total-Length", len(block) if last else None)], part)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_a_file: int = RECORDS_A_FILE, compression: str = "gzip") -> None:
    """Writes ``pages`` (page_id, url, html) as WARC files below ``path``, each compressed as a whole (or "none")."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready, size = [], 0
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                for record in records_of(*values, segment_bytes=segment_bytes):
                    ready.append(record)
                    size += len(record)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ready, pa.binary())], names=["record"])
                    ready, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ready, pa.binary())], names=["record"])

    rows = with_revisits(pages).select("page_id", "url", "payload", "digest", "refers_to")
    records = rows.mapInArrow(build, "record binary")
    # A string column holds any bytes; the line separator closes each record.
    text = records.select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_a_file).option("compression", compression).text(path)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(_END, at)
        if not content.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = content[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + len(_END)
        stop = start + int(fields["content-length"])
        yield fields, content[start:stop]
        at = stop + len(_END)


_FIELDS = ["warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "payload-length", "page-id", "refers-to-page-id", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length"]
_COLUMNS = [f.removeprefix("warc-").replace("-", "_") for f in _FIELDS]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``: header fields as strings and ``block``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*_COLUMNS, "block"]
        for batch in batches:
            for content in batch.column(0):
                rows = [(*(fields.get(f) for f in _FIELDS), block) for fields, block in parse_archive(content.as_py())]
                columns = list(zip(*rows)) if rows else [()] * len(names)
                types = [pa.string()] * len(_COLUMNS) + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, ", ".join(f"{c} string" for c in _COLUMNS) + ", block binary")


def reassembled(records: DataFrame) -> DataFrame:
    """Logical records: header fields, ``payload`` and ``complete`` (segments, length and framing hold)."""

    @F.pandas_udf("payload binary, complete boolean")
    def whole(blocks: pd.Series, totals: pd.Series, in_order: pd.Series) -> pd.DataFrame:
        payloads = []
        for parts, total, ordered in zip(blocks, totals, in_order):
            block = b"".join(parts)
            payloads.append(payload_of(block) if ordered and (pd.isna(total) or int(total) == len(block)) else None)
        return pd.DataFrame({"payload": pd.Series(payloads, dtype=object), "complete": [p is not None for p in payloads]})

    number = F.col("segment_number").cast("int")
    single = records.where("segment_number is null").withColumns({"blocks": F.array("block"), "total": F.lit(None).cast("long"), "in_order": F.lit(True)})
    parts = records.where("segment_number is not null").withColumn("origin", F.coalesce("segment_origin_id", "record_id"))
    first = F.struct(*[c for c in _COLUMNS])
    grouped = parts.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct(number.alias("n"), "block"))).alias("parts"),  # one record's segments
        F.max(F.col("segment_total_length").cast("long")).alias("total"),
        F.min(F.when(number == 1, first)).alias("head"),
    )
    numbers = F.transform("parts", lambda p: p["n"])
    ordered = (numbers == F.sequence(F.lit(1), F.size("parts"))) & F.col("total").isNotNull()
    segmented = grouped.select("head.*", F.transform("parts", lambda p: p["block"]).alias("blocks"), "total", ordered.alias("in_order"))
    both = single.select(*_COLUMNS, "blocks", "total", "in_order").unionByName(segmented)
    return both.withColumn("_whole", whole("blocks", "total", "in_order")).select(*_COLUMNS, "_whole.payload", "_whole.complete")


def page_report(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits give what their headers say."""
    revisit = F.col("type") == "revisit"
    return records.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.when(revisit, F.col("payload_length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to_page_id").cast("long").alias("refers_to"),
        "complete",
    )
