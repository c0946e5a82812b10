"""WARC archives: pages to records, records to archives, archives to pages.

Writing: a page becomes a ``response`` record holding an HTTP message; a page whose payload another
page with a smaller id has already becomes a ``revisit`` record that refers to it. Payloads above
``chunk_bytes`` are framed with chunked transfer coding; record blocks above ``segment_bytes`` are cut
into a first segment and ``continuation`` records. Spark's own text writer puts the records into
files, with the two line ends that close a record as its line separator, so a written archive is plain
WARC (gzipped by Spark's codec), commits atomically and can live in any store Spark reaches.

Reading: files are parsed record by record; segmented records are grouped by their origin's
identifier, ordered by segment number, checked for gaps and against the total length, and joined;
then the transfer framing is taken off. ``problem`` says what is wrong with a record (null: nothing).

Nulls: a null payload is empty, a null url is left out, a null id comes back as null and ranks after all
others. Ids may be any text. Pages with the same id and payload are all responses if that id is the smallest.
Very long payloads become many segments, which meet in one row when read. An empty table gives an archive
without records, read back as no rows. Other columns are not looked at, whatever they are called.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
RECORDS_PER_FILE = 2000
END = b"\r\n\r\n"
#: Payloads of at least so many bytes can become revisits.
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"


def b32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(first: str, fields: list[tuple[str, object]]) -> bytes:
    lines = [first, *(f"{k}: {v}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body (extensions and trailers are skipped); ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is cut off")
        n = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at : at + n])
        at += n + 2


def records_of(
    page: object, uid: int, url: str | None, payload: bytes, refers: object, revisit: bool, segment_bytes: int, chunk_bytes: int
) -> Iterator[bytes]:
    """The records of one page, without the line ends that close them."""
    name = lambda p, part="": f"<urn:page:{'!' if p is None else quote(str(p), safe='')}{part}>"
    own = name(page, f":{uid}")
    url = None if url is None else "".join(c for c in url if c not in "\r\n")
    plain = len(payload) <= chunk_bytes or revisit
    http = _head(
        "HTTP/1.1 200 OK",
        [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload)) if plain else ("Transfer-Encoding", "chunked")],
    )
    block = http if revisit else http + (payload if plain else chunked(payload, chunk_bytes))
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + b32_sha1(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers)),
        ]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        if k > 1:
            fields = [
                ("WARC-Type", "continuation"), ("WARC-Record-ID", name(page, f":{uid}:{k}")), ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", own),
            ]
        number = [("WARC-Segment-Number", k)] if len(parts) > 1 else []
        total = [("WARC-Segment-Total-Length", len(block))] if len(parts) > 1 and k == len(parts) else []
        yield _head("WARC/1.1", [*fields, *number, *total, ("Content-Length", len(part))]) + part


def write_archives(
    pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html",
    segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> None:
    """Write all pages as archives below path."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    # only payloads that occur more than once have partners; a hot payload is one row here
    first = rows.groupBy("digest", "bytes").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("copies"))
    first = first.where((F.col("copies") > 1) & (F.col("bytes") >= min_revisit_bytes)).select("digest", "bytes", "first")
    rows = rows.join(first, ["digest", "bytes"], "left")
    rows = rows.select("page", F.monotonically_increasing_id().alias("uid"), "url", "payload", "first")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for page, uid, link, body, first_page in zip(*batch.columns, strict=True):
                page, first_page = page.as_py(), first_page.as_py()
                revisit = first_page is not None and page != first_page
                for record in records_of(page, uid.as_py(), link.as_py(), body.as_py(), first_page, revisit, segment_bytes, chunk_bytes):
                    out.append(record)
                    held += len(record)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = rows.mapInArrow(build, "value binary").select(F.col("value").cast("string"))
    records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record."""
    at = 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(END, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start, n = end + 4, int(head["content-length"])
        if start + n > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield head, data[start : start + n]
        at = start + n


FIELDS = {
    "record_id": "warc-record-id", "warc_type": "warc-type", "origin_id": "warc-segment-origin-id", "number": "warc-segment-number",
    "total": "warc-segment-total-length", "url": "warc-target-uri", "digest": "warc-payload-digest", "refers": "warc-refers-to",
}


def read_records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """Either the records that are segments of larger ones, or the others."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*FIELDS, "block"]
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = zlib.decompress(data, 47) if data[:2] == b"\x1f\x8b" else data
                rows, held = [], 0
                for head, block in parse(data):
                    if ("warc-segment-number" in head) == segmented:
                        rows.append([head.get(v) for v in FIELDS.values()] + [block])
                        held += len(block)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([*((n, pa.string()) for n in FIELDS), ("block", pa.binary())])
    return files.mapInArrow(run, ", ".join(f"{n} string" for n in FIELDS) + ", block binary")


def page_of(record_id: str | None) -> str | None:
    """The page's id in a record's name; other archives' names are given as they are."""
    if record_id is None or not record_id.startswith("<urn:page:"):
        return record_id
    page = record_id.removeprefix("<urn:page:").removesuffix(">").split(":")[0]
    return None if page == "!" else unquote(page)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id (text), record_type, url, payload (null for revisits), payload_bytes, payload_digest, refers_to (text), problem."""
    own = [F.col(c) for c in ("record_id", "warc_type", "url", "digest", "refers")]
    whole = read_records(spark, path, False).select(*own, F.array("block").alias("blocks"), F.lit(None).cast("string").alias("problem"))
    parts = read_records(spark, path, True).withColumn("number", F.col("number").cast("int"))
    parts = parts.groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(
        *[F.max(F.when(F.col("origin_id").isNull(), F.col(c))).alias(c) for c in ("warc_type", "url", "digest", "refers")],
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max(F.col("total").cast("long")).alias("total"),
    )
    lengths = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    gaps = F.exists(F.transform("parts", lambda p, i: p["number"] != i + 1), lambda x: x)
    problem = (
        F.when(F.col("warc_type").isNull(), "first segment is missing").when(gaps, "segments are missing or repeated")
        .when(F.col("total").isNull(), "last segment is missing").when(F.col("total") != lengths, "length differs from the total")
    )
    parts = parts.select(*own, F.transform("parts", lambda p: p["block"]).alias("blocks"), problem.alias("problem"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for row in batch.slice(at, 500).to_pylist():
                    block, problem, payload, n = b"".join(row["blocks"]), row["problem"], None, None
                    head, _, body = block.partition(END)
                    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
                    if row["warc_type"] == "revisit":
                        n, digest = int(http.get(b"content-length", -1)), (row["digest"] or "").removeprefix("sha1:")
                    else:
                        try:
                            payload = unchunked(body) if http.get(b"transfer-encoding") == b"chunked" else body
                        except ValueError as e:
                            payload, problem = body, problem or str(e)
                        n, digest = len(payload), b32_sha1(payload)
                        if row["digest"] and row["digest"] != f"sha1:{digest}":
                            problem = problem or "digest differs"
                    ids = [page_of(x) for x in (row["record_id"], row["refers"])]
                    out.append([ids[0], row["warc_type"], row["url"], payload, n, digest, ids[1], problem])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["page_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "problem"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
    schema = "page_id string, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to string, problem string"
    return whole.unionByName(parts).mapInArrow(decode, schema)


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pages = scratch(spark, "warc"), table(spark, sf_dir, "pages")
    write_archives(pages, path)
    ids = [F.col(c).cast(pages.schema["page_id"].dataType).alias(c) for c in ("page_id", "refers_to")]
    return read_archives(spark, path).select(ids[0], "payload_bytes", "payload_digest", "record_type", ids[1], "problem")


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), v AS (
  SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, (5 * g + 1)::INT, 5))::INT) AS parts FROM p
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(parts, lambda x:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1)
         || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, NULL::VARCHAR AS problem
FROM v
"""
