"""WARC archives with segmented records: writing, reading, segment reassembly.

Writing: a page's response is an HTTP message whose body is framed in chunks; a block longer than `segment_bytes`
is split into a first record and continuation records. Equal payloads are stored once: the page with the largest
id is the response, the others are revisit records that refer to its record id. Archives are gzip files of at most
FILE_RECORDS whole records of at most `segment_bytes` (so some 33 MB before compression), written
by Spark's text writer (record bytes are its lines, the record's closing two line ends its separator).

Reading: archives are read once and parsed record by record by Content-Length; continuation records are grouped by the
origin's identifier, ordered by segment number, and checked for gaps and against the total length; chunked framing is
decoded and the payload's digest is verified. A revisit is joined to the record that it refers to: its length and digest are
those of the payload read there, and must be those that it gives itself.

Defined results: a null payload is empty (all empty payloads are equal); a null page_id counts as smaller than
any other; rows that repeat a page with the same payload are of the same type (revisits refer to the first of them); page ids are kept as numbers; a
record that fails a check is returned with verified = false; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, small, store, tidied

#: A block above SEGMENT_BYTES is segmented; bodies are framed in chunks of CHUNK_BYTES; records a file.
SEGMENT_BYTES, CHUNK_BYTES, FILE_RECORDS = 32 << 10, 8 << 10, 1000
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(framed: bytes) -> bytes | None:
    """The body of chunked framing; None if the framing is broken."""
    out, p = [], 0
    while True:
        line = framed.find(b"\r\n", p)
        try:
            n = int(framed[p:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            return None
        if n < 0 or line + 2 + n + 2 > len(framed) or framed[line + 2 + n : line + 4 + n] != b"\r\n" and n:
            return None
        if n == 0:
            return b"".join(out)
        out.append(framed[line + 2 : line + 2 + n])
        p = line + 4 + n


def record(kind: str, ident: str, block: bytes, **more) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in more.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _line(value: str | None) -> str | None:
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A").strip()


def cited_id(page_id: int | None, digest: str) -> str:
    """Record id of a response that revisits refer to."""
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


def page_records(page_id: int | None, serial: str, url: str | None, payload: bytes, response: int | None, cited: bool, segment_bytes: int) -> list[bytes]:
    """The WARC records of one page. response: the response's page id if this one is a revisit; cited: revisits refer to it."""
    sha1 = base32_sha1(payload)
    ident, digest = cited_id(page_id, sha1 if cited else serial), "sha1:" + sha1
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: %d\r\nTransfer-Encoding: chunked\r\n\r\n" % len(payload)
    named = {"WARC_Target_URI": _line(url), "WARC_Payload_Digest": digest, "Content_Type": "application/http; msgtype=response"}
    if response is not None:
        return [record("revisit", ident, head, WARC_Refers_To=f"<{cited_id(response, sha1)}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **named)]
    block = head + chunked(payload)
    if len(block) <= segment_bytes:
        return [record("response", ident, block, **named)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record("response", ident, parts[0], WARC_Segment_Number=1, **named)]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(record("continuation", f"{ident}:{k}", part, WARC_Segment_Origin_ID=f"<{ident}>", WARC_Segment_Number=k, WARC_Segment_Total_Length=total))
    return out


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record."""
    p = 0
    while p < len(archive):
        if not archive.startswith(b"WARC/", p) or (end := archive.find(END, p)) < 0:
            raise ValueError(f"no WARC record at byte {p}")
        head = dict(x.split(": ", 1) for x in archive[p:end].decode("utf-8", "replace").split("\r\n")[1:])
        head = {k.lower(): v for k, v in head.items()}
        begin = end + 4
        stop = begin + int(head["content-length"])
        if archive[stop : stop + 4] != END:
            raise ValueError(f"the record at byte {p} is not as long as its header says")
        yield head, archive[begin:stop]
        p = stop + 4


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes pages (page_id, url, html) as WARC files under path."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # only digests that come more than once, with the largest id and the number of rows that have it
    same = own.filter(F.octet_length("payload") >= min_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("rows"))
    repeated = same.groupBy("digest").agg(F.max(F.struct("page_id", "rows")).alias("r"), F.sum("rows").alias("n")).filter("n > 1 and r.page_id is not null")
    repeated = store(repeated.select("digest", F.col("r.page_id").alias("response"), F.col("r.rows").alias("rows")), "repeated")
    joined = own.join(F.broadcast(repeated) if small(repeated) else repeated, "digest", "left")
    is_response = F.coalesce(F.col("page_id") == F.col("response"), F.lit(False))
    typed = joined.select("page_id", "url", "payload", "digest", F.when(~is_response, F.col("response")).alias("refers_to"), is_response.alias("cited"), "rows")
    if repeated.filter("rows > 1").limit(1).count():  # the response's row stands there several times: one of them is referred to
        several = F.col("cited") & (F.col("rows") > 1)
        rows = store(typed.filter(several).withColumn("row", F.monotonically_increasing_id()), "repeated-rows")
        first = rows.groupBy("digest").agg(F.min("row").alias("first"))
        chosen = rows.join(first, "digest").withColumn("cited", F.col("row") == F.col("first")).drop("row", "first")
        typed = typed.filter(~several).unionByName(chosen)
    typed = typed.select("page_id", "url", "payload", "refers_to", "cited")
    schema = T.StructType([T.StructField("record", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, held = [], 0
            for page_id, url, body, response, cited in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += page_records(page_id, f"{part}-{n}", url, body, response, cited, segment_bytes)
                n, held = n + 1, held + len(body)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])

    lines = typed.mapInArrow(tidied(run), schema).select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


#: A record that is a segment (record_id: the origin's).
RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("segment", T.IntegerType()),
        T.StructField("total", T.LongType()),
        T.StructField("block", T.BinaryType()),
    ]
)
#: A page, with its record's id and the one that it refers to.
PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("verified", T.BooleanType()),
    ]
)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _page(ident: str, kind: str, url: str | None, digest: str | None, refers: str | None, block: bytes, good: bool, payloads: bool) -> tuple:
    """A row of PAGE. A revisit's length and digest are those that its own record gives."""
    head, _, body = block.partition(END)
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    said, mine = (digest or "").removeprefix("sha1:"), ident.split(":")[2]
    mine = int(mine) if mine else None
    if kind == "revisit":
        return mine, url, kind, ident, refers.strip("<>"), None, int(fields["X-Payload-Length"]), said, good
    payload = dechunk(body) if fields.get("Transfer-Encoding") == "chunked" else body
    got = base32_sha1(payload or b"")
    return mine, url, kind, ident, None, payload if payloads else None, len(payload or b""), got, good and payload is not None and got == said


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The archives' records, each archive read once: whole ones as `page` (PAGE), segments as `part` (RECORD)."""
    schema = T.StructType([T.StructField("page", PAGE), T.StructField("part", RECORD)])
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(pages: list, parts: list) -> pa.RecordBatch:
            named = lambda rows, s: [None if r is None else dict(zip(s.names, r, strict=True)) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(named(pages, PAGE), out.field(0).type), pa.array(named(parts, RECORD), out.field(1).type)], schema=out)

        for batch in batches:
            for i in range(batch.num_rows):
                pages, parts, held = [], [], 0
                for head, block in parse(zlib.decompress(batch.column(0)[i].as_py(), 47)):
                    number = head.get("warc-segment-number")
                    origin = head.get("warc-segment-origin-id", head["warc-record-id"]).strip("<>")
                    about = origin, head["warc-type"], head.get("warc-target-uri"), head.get("warc-payload-digest"), head.get("warc-refers-to")
                    if number is None:
                        pages.append(_page(*about, block, True, payloads))
                        parts.append(None)
                    else:
                        total = head.get("warc-segment-total-length")
                        pages.append(None)
                        parts.append((*about, int(number), total and int(total), block))
                    held += len(block)
                    if held > 8 << 20:
                        yield emit(pages, parts)
                        pages, parts, held = [], [], 0
                if pages:
                    yield emit(pages, parts)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(tidied(run), schema)


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records of segments: grouped by origin, in segment order. `parts` holds the blocks; `whole` tells whether
    the segments run from 1 without gaps and add up to the total length."""
    got = segments.groupBy("record_id").agg(
        F.max(F.when(F.col("record_type") != "continuation", F.col("record_type"))).alias("record_type"),
        F.max("url").alias("url"),
        F.max("digest").alias("digest"),
        F.max("refers_to").alias("refers_to"),
        F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    numbers = F.transform("parts", lambda x: x["segment"])
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["block"]))
    whole = (numbers == F.sequence(F.lit(1), F.size("parts"))) & (length == F.col("total")) & F.col("record_type").isNotNull()
    return got.select("record_id", "record_type", "url", "digest", "refers_to", F.transform("parts", lambda x: x["block"]).alias("parts"), F.coalesce(whole, F.lit(False)).alias("whole"))


def read_pages(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to (a page id), payload, payload_bytes, payload_digest, verified of every page in the
    archives. A revisit's payload is null; its length and digest are those of the record that it refers to, null
    if there is none. Without `payloads` they are left out (null) once their length and digest are known."""
    records = store(read_records(spark, path, payloads), "records")
    out = _arrow(PAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ident, kind, url, digest, refers, parts, good = (c[i].as_py() for c in batch.columns)
                row = _page(ident, kind, url, digest, refers, b"".join(parts), good, payloads)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out, strict=True)], schema=out)

    whole = reassemble(records.filter("part is not null").select("part.*"))
    pages = records.filter("page is not null").select("page.*").unionByName(whole.mapInArrow(tidied(run), PAGE))
    names = ("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "verified")
    responses = pages.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*names)
    # only the responses that revisits refer to have a digest in their id
    cited = pages.filter("record_type = 'response' and endswith(record_id, concat(':', payload_digest))").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes"), F.col("payload_digest").alias("to_digest"), F.col("verified").alias("to_verified")
    )
    joined = pages.filter("record_type = 'revisit'").join(cited, "refers_to", "left")
    same = F.col("to_verified") & (F.col("to_bytes") == F.col("payload_bytes")) & (F.col("to_digest") == F.col("payload_digest"))
    revisits = joined.withColumns({"verified": F.coalesce(F.col("verified") & same, F.lit(False)), "refers_to": F.col("to_page"), "payload_bytes": F.col("to_bytes"), "payload_digest": F.col("to_digest")})
    return responses.unionByName(revisits.select(*names))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """op3: every page written to WARC files in the shared folder and read back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    return read_pages(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def sql_base32_sha1(hex_digest: str) -> str:
    """DuckDB expression: base 32 of a SHA-1 given in hex (eight groups of 20 bits, four letters each)."""
    group = f"('0x' || substr({hex_digest}, 5 * g + 1, 5))::INTEGER"
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    return f"list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda d: substr({letters}, (({group} >> (15 - 5 * d)::INTEGER) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '')"


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS response FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {sql_base32_sha1("hex")} AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to, TRUE AS verified
FROM r
"""
