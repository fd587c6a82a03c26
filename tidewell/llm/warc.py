"""WARC archives: writing pages with segmented records, and reading them back by reassembly.

Writing: every page becomes a response record whose HTTP message has its body in chunked transfer framing. A message longer than
SEGMENT bytes is cut: the response holds the first segment, continuation records the others, each with its segment number
and the first record's id as origin, the last with the total length. Of pages with equal payloads of MIN_REVISIT bytes or
more, the one with the smallest page_id is the response; the others are revisit records without a body that refer to it.

Reading: records are parsed by their Content-Length. Whole ones are decoded where they are read; segments are grouped by
origin, ordered by number, checked against the total length, and then decoded. Revisits take their payload's length from
the record that they refer to.

Defined cases: a null html is an empty payload; null urls have no target header; a null page_id is written without its
header and read back as null, and sorts after all others when the response of equal payloads is chosen; rows with the
same page_id are told apart by a row number in their record id, and the first is the response; an empty table gives an empty
archive and result; other columns are ignored. Missing or repeated segments and lengths that differ raise an error.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import fresh_path, numbered, table, written

#: Bytes of a segment and of a chunk, least payload that may be a revisit, records of a file.
SEGMENT, CHUNK, MIN_REVISIT, FILE_RECORDS = 8192, 4096, 100, 5_000
#: Repeated digests that are broadcast at most.
BROADCAST_ROWS = 500_000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = "kind string, record_id string, page_id long, refers string, digest string, number int, origin string, total long, block binary, payload binary"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The body of chunked transfer framing; ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        at = end + 2
        parts.append(framed[at : at + size])
        if len(parts[-1]) != size or framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at += size + 2


def http_payload(message: bytes) -> bytes:
    head, _, body = message.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?i)^transfer-encoding:\s*chunked\s*$", head, re.M) else body


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends after its block, which the writer of lines adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_records(record_id: str, page_id: int | None, url: str | None, html: bytes, digest: str, refers: str | None, segment: int = SEGMENT) -> list[bytes]:
    uri = None if url is None else re.sub(r"[\r\n]", "%0A", url)
    head = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id}>"), *head, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{refers}>")], b"")]
    message = HTTP + chunked(html)
    parts = [message[i : i + segment] for i in range(0, len(message), segment)]
    whole = len(parts) == 1
    kind = ("Content-Type", "application/http; msgtype=response")
    out = [_record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{record_id}>"), *head, kind, ("WARC-Segment-Number", None if whole else 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(message) if k == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id}:{k}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part))
    return out


def write_archive(pages: DataFrame, path: str, segment: int = SEGMENT) -> str:
    """Writes pages (page_id, url, html) as gzipped WARC files to the new folder path."""
    rows = numbered(pages.select("page_id", "url", "html"))
    keyed = rows.select("doc.page_id", "doc.url", F.coalesce("doc.html", F.lit("")).alias("html"), F.col("row").alias("n"))
    keyed = keyed.withColumns({"digest": F.sha2("html", 256), "record_id": F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("n").cast("string"))})
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("p"), F.col("n").alias("n"))
    groups = keyed.filter(F.octet_length("html") >= MIN_REVISIT).groupBy("digest").agg(F.count("*").alias("c"), F.min_by("record_id", order).alias("first"))
    repeats = written(groups.filter("c > 1").select("digest", "first"), "repeated-payloads")
    # only payloads that occur twice are looked up, so that pages aren't shuffled for it while their list fits a checked size
    side = F.broadcast(repeats) if repeats.count() <= BROADCAST_ROWS else repeats
    joined = keyed.join(side, "digest", "left").withColumn("refers", F.when(F.col("first") != F.col("record_id"), F.col("first")))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["record_id"], b["page_id"].astype("Int64"), b["url"], b["html"], b["digest"], b["refers"], strict=True)
            yield pd.DataFrame({"record": [x for i, p, u, h, d, r in rows for x in page_records(i, None if pd.isna(p) else int(p), u, h.encode("utf-8", "surrogatepass"), d, r, segment)]})

    records = joined.select("record_id", "page_id", "url", "html", "digest", "refers").mapInPandas(build, "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


def parse(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        headers = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = file.read(size)
        if len(block) != size:
            raise ValueError("a block is cut short")
        yield headers, block


def records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """Records of the archives at path, as rows of RECORD: those of segments, with their blocks, or the others, decoded."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows: list[tuple] = []
                for h, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    number = h.get("warc-segment-number")
                    if (number is not None) != segmented:
                        continue
                    kind, record_id = h["warc-type"], h["warc-record-id"].strip("<>")
                    payload = None if segmented or kind != "response" else http_payload(block)
                    if payload is not None and hashlib.sha256(payload).hexdigest() != h["warc-payload-digest"].removeprefix("sha256:"):
                        raise ValueError(f"the payload of {record_id} differs from its digest")
                    page = h.get("warc-page-id")
                    rows.append((kind, record_id, None if page is None else int(page), h.get("warc-refers-to", "").strip("<>") or None, h.get("warc-payload-digest", "").removeprefix("sha256:") or None, int(number or 1), h.get("warc-segment-origin-id", h["warc-record-id"]).strip("<>"), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, block if segmented else None, payload))
                    if len(rows) == 256:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(read, RECORD)


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD.split(", ")]).astype({"page_id": "Int64", "total": "Int64", "number": "int32"})


def reassembled(segments: DataFrame) -> DataFrame:
    """record_id, page_id, payload of every record that was cut, from its segments by origin."""
    parts = F.sort_array(F.collect_list(F.struct("number", "block")))
    whole = segments.groupBy("origin").agg(parts.alias("parts"), F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("total").alias("total"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            payloads = []
            for origin, parts, total, digest in zip(b["origin"], b["parts"], b["total"], b["digest"], strict=True):
                message = b"".join(p["block"] for p in parts)
                if [p["number"] for p in parts] != [*range(1, len(parts) + 1)] or pd.isna(total) or len(message) != total:
                    raise ValueError(f"the segments of {origin} are not complete")
                payloads.append(http_payload(message))
                if hashlib.sha256(payloads[-1]).hexdigest() != digest:
                    raise ValueError(f"the payload of {origin} differs from its digest")
            yield pd.DataFrame({"record_id": b["origin"], "page_id": b["page_id"].astype("Int64"), "payload": payloads})

    return whole.mapInPandas(join, "record_id string, page_id long, payload binary")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """record_id, page_id, payload of all response records."""
    whole = records(spark, path, segmented=False).filter("kind = 'response'").select("record_id", "page_id", "payload")
    return whole.unionByName(reassembled(records(spark, path, segmented=True)))


def op4_segment_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each page: payload length and digest, record type, and the page referred to."""
    path = write_archive(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    found = read_responses(spark, path).select("record_id", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    found = written(found, "responses")
    revisits = records(spark, path, segmented=False).filter("kind = 'revisit'").select("page_id", F.col("refers").alias("record_id"), F.col("digest").alias("payload_digest"))
    resolved = revisits.join(found.select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes"), "record_id")
    columns = ["page_id", "payload_bytes", "payload_digest"]
    return found.select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(resolved.select(*columns, F.lit("revisit").alias("record_type"), "refers_to"))
