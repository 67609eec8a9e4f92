"""Signature sniffing of media columns.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a value; the format's validator then
walks its structure and gives the exact length, or rejects the hit. What lies at offset 0 is the value's type, and
corrects the declared one; valid hits further on are carved as embedded media (those inside another carved one aren't
reported again).

Defined results: a null value is empty; an empty or unknown value keeps its declared type, has length 0 and is not
valid; truncated structures are rejected; rows and their order are kept.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from io import BytesIO

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import duckbytes
from .common import store

#: Magic bytes and the formats they announce.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"P5": "image/x-portable-graymap",
    b"RIFF": "riff",
    b"OggS": "audio/ogg",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
}
#: RIFF form types.
RIFF_FORMS = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}

RATE = 8000
ALIGN = 576


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def _png(d: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(d):
        size, name = struct.unpack_from(">I4s", d, p)
        if p + 12 + size > len(d) or first != (name == b"IHDR") or zlib.crc32(d[p + 4 : p + 8 + size]) != struct.unpack_from(">I", d, p + 8 + size)[0]:
            return 0
        p, first = p + 12 + size, False
        if name == b"IEND":
            return p - at
    return 0


def _jpeg(d: bytes, at: int) -> int:
    p, frame = at + 2, False
    while p + 4 <= len(d):
        if d[p] != 0xFF:
            return 0
        mark = d[p + 1]
        if mark == 0xFF:
            p += 1
            continue
        if mark == 0xD9:
            return p + 2 - at if frame else 0
        size = struct.unpack_from(">H", d, p + 2)[0]
        if size < 2 or p + 2 + size > len(d):
            return 0
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next marker that is neither stuffing nor a restart
            while (p := d.find(b"\xff", p)) >= 0 and p + 1 < len(d) and (d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(d):
                return 0
            if d[p + 1] == 0xD9:
                return p + 2 - at if frame else 0
    return 0


def _gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    flags = d[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += d[p] + 1
        return p + 1

    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            p = blocks(p + 11 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _bmp(d: bytes, at: int) -> int:
    if at + 30 > len(d):
        return 0
    size, reserved, data, header = struct.unpack_from("<IIII", d, at + 2)
    if reserved or header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= data <= size or at + size > len(d):
        return 0
    planes = struct.unpack_from("<H", d, at + (22 if header == 12 else 26))[0]
    return size if planes == 1 else 0


def _pgm(d: bytes, at: int) -> int:
    head = d[at : at + 64].split(None, 4)
    if len(head) < 4 or head[0] != b"P5" or not all(x.isdigit() for x in head[1:4]):
        return 0
    width, height, top = (int(x) for x in head[1:4])
    begin = d.index(head[3], d.index(head[2], d.index(head[1], at + 2) + len(head[1])) + len(head[2])) + len(head[3]) + 1
    end = begin + width * height * (2 if top > 255 else 1)
    return end - at if width and height and 0 < top < 65536 and end <= len(d) else 0


def _riff(d: bytes, at: int) -> int:
    if at + 12 > len(d):
        return 0
    size = struct.unpack_from("<I", d, at + 4)[0]
    end = at + 8 + size
    if d[at + 8 : at + 12] not in RIFF_FORMS or size < 4 or end > len(d):
        return 0
    p, names = at + 12, set()
    while p + 8 <= end:
        names.add(d[p : p + 4])
        p += 8 + (n := struct.unpack_from("<I", d, p + 4)[0]) + (n & 1)
    return end - at if p == end and (d[at + 8 : at + 12] != b"WAVE" or {b"fmt ", b"data"} <= names) else 0


def _ogg(d: bytes, at: int) -> int:
    p = at
    while p + 27 <= len(d) and d[p : p + 4] == b"OggS" and d[p + 4] == 0:
        n = d[p + 26]
        if p + 27 + n > len(d):
            return 0
        end = p + 27 + n + sum(d[p + 27 : p + 27 + n])
        if end > len(d):
            return 0
        if d[p + 5] & 4:
            return end - at
        p = end
    return 0


PDF_LENGTH = re.compile(rb"/Linearized\b(?:(?!endobj).)*?/L\s+(\d+)", re.S)
PDF_END = re.compile(rb"startxref\s+(\d+)\s+%%EOF")
PDF_XREF = re.compile(rb"\s*(?:xref\b|\d+\s+\d+\s+obj\b)")


def _pdf(d: bytes, at: int) -> int:
    if not d[at + 5 : at + 6].isdigit() or d[at + 6 : at + 7] != b"." or (p := d.find(b"startxref", at)) < 0 or (end := d.find(b"%%EOF", p)) < 0:
        return 0
    end += 5
    # linearized: the first section ends early, the whole has the length it declares, or ends at the next section
    if (said := PDF_LENGTH.search(d, at, at + 1024)) and end <= (whole := at + int(said[1])) <= len(d) and d[max(end - 5, whole - 16) : whole].rstrip().endswith(b"%%EOF"):
        end = whole
    elif said and (first := PDF_END.match(d, p)) and int(first[1]) == 0 and (last := PDF_END.search(d, end)):
        end = last.end()
    # incremental updates: each has its own cross-references, behind what was there before
    for m in PDF_END.finditer(d, end):
        if end <= at + int(m[1]) < m.start() and PDF_XREF.match(d, at + int(m[1])):
            end = m.end()
    return end - at


def _zip(d: bytes, at: int) -> int:
    p = at
    while (p := d.find(b"PK\x05\x06", p + 4)) >= 0 and p + 22 <= len(d):
        size, begin, note = struct.unpack_from("<IIH", d, p + 12)
        if at + begin + size == p and p + 22 + note <= len(d) and d[at + begin : at + begin + 4] == b"PK\x01\x02":
            return p + 22 + note - at
    return 0


def _gzip(d: bytes, at: int) -> int:
    if d[at + 3 : at + 4] > b"\x1f":
        return 0
    stream, source = zlib.decompressobj(31), BytesIO(memoryview(d)[at:])
    try:
        while not stream.eof and (part := stream.unconsumed_tail or source.read(1 << 16)):
            stream.decompress(part, 1 << 20)  # at most 1 MB in memory, however much it expands
    except zlib.error:
        return 0
    return source.tell() - len(stream.unused_data) if stream.eof else 0


VALIDATORS = {
    "image/png": _png,
    "image/jpeg": _jpeg,
    "image/gif": _gif,
    "image/bmp": _bmp,
    "image/x-portable-graymap": _pgm,
    "riff": _riff,
    "audio/ogg": _ogg,
    "application/pdf": _pdf,
    "application/zip": _zip,
    "application/gzip": _gzip,
}


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every valid medium: the one at 0 if any, and those embedded in it or beside it."""
    found, last, carved = [], -1, 0
    for end, (n, kind) in automaton().iter(data.decode("latin-1")):
        at = end - n + 1
        if at < carved or at == last:
            continue
        if length := VALIDATORS[kind](data, at):
            found.append((RIFF_FORMS.get(data[at + 8 : at + 12], kind) if kind == "riff" else kind, at, length))
            last = at
            if at:  # the outermost value is looked into, embedded ones aren't
                carved = at + length
    return found


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM."""
    pad = b"\0" * (len(payload) & 1)
    return (
        b"RIFF" + struct.pack("<I", 36 + len(payload) + len(pad)) + b"WAVE"
        + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8)
        + b"data" + struct.pack("<I", len(payload)) + payload + pad
    )


def wav_samples(media: bytes) -> bytes:
    """The data chunk of a RIFF/WAVE value."""
    p = 12
    while p + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, p)
        if name == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    return b""


def describe(samples: bytes) -> str:
    """Mean, entropy and sign changes of 8-bit samples around their middle."""
    x = np.frombuffer(samples, np.uint8)
    if not len(x):
        return "mean=0;entropy=0;crossings=0"
    counts = np.bincount(x, minlength=256)
    share = counts / len(x)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    return f"mean={counts @ np.arange(256) / len(x):.4f};entropy={abs(entropy):.4f};crossings={np.count_nonzero((x[1:] > 127) != (x[:-1] > 127))}"


EMBEDDED = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))


def _batches(df: DataFrame, schema: T.StructType, row, most: int = 8 << 20) -> DataFrame:
    """mapInArrow over rows of (kept columns, binary, string): row(value, declared) -> the further columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    keep = len(df.columns) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begin, held = [], 0, 0
            for i in range(batch.num_rows):
                value = batch.column(keep)[i].as_py() or b""
                rows.append(row(value, batch.column(keep + 1)[i].as_py()))
                held += len(value)
                if held > most or i == batch.num_rows - 1:
                    kept = [batch.column(j).slice(begin, i + 1 - begin) for j in range(keep)]
                    made = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(out)[keep:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*kept, *made], schema=out)
                    rows, begin, held = [], i + 1, 0

    return df.mapInArrow(run, schema)


def sniff_frame(df: DataFrame, media: str = "media", declared: str = "declared", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """type (corrected), valid, length, embedded (what was carved), media, and samples (of 8-bit audio; else null)."""
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + [
            T.StructField("type", T.StringType()),
            T.StructField("valid", T.BooleanType()),
            T.StructField("length", T.LongType()),
            T.StructField("embedded", EMBEDDED),
            T.StructField("samples", T.BinaryType()),
            T.StructField("description", T.StringType()),
        ]
    )

    def row(value: bytes, said: str | None) -> tuple:
        found = sniff(value)
        own = found[0] if found and found[0][1] == 0 else None
        inside = [{"type": k, "offset": a, "length": n} for k, a, n in found if a]
        samples = wav_samples(value) if own and own[0] == "audio/wav" else None
        return own[0] if own else said, own is not None, own[2] if own else 0, inside, samples, describe(samples or b"")

    return _batches(df.select(*keep, F.col(media).cast("binary"), F.col(declared).cast("string")), schema, row)


def media_table(documents: DataFrame) -> DataFrame:
    """Stored table of every text as 8-bit audio: doc_id, n_bytes, declared (often wrong, as in the wild) and media."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(text)
    said = F.element_at(F.array(F.lit("audio/wav"), F.lit("image/png"), F.lit("application/octet-stream")), (n % 3 + 1).cast("int"))
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("declared", T.StringType()), T.StructField("media", T.BinaryType())])

    def row(value: bytes, said: str | None) -> tuple:
        return said, wav(value + b"\xff" * (max(ALIGN, -(-len(value) // ALIGN) * ALIGN) - len(value)))

    return store(_batches(documents.select("doc_id", n.cast("long").alias("n_bytes"), text, said), schema, row), "media")


def _tail(samples: Column) -> Column:
    return F.crc32(F.substring(samples, -32, 32))


def media_digest(documents: DataFrame) -> DataFrame:
    """op5: the texts stored as media, sniffed and read back, as digests."""
    stored = media_table(documents)
    whole = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    found = sniff_frame(whole, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        _tail(F.col("samples")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(";", "type", F.col("length").cast("string"), "description", F.concat(F.lit("embedded="), F.size("embedded").cast("string"))).alias("feature"),
    )


#: Holds for texts that have no medium embedded in them: carving isn't expressible.
ORACLE = f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n_bytes, greatest({ALIGN}, ceil(octet_length(b) / {ALIGN}) * {ALIGN})::BIGINT AS n, hex(b) AS h FROM t),
s AS (SELECT doc_id, n_bytes, n, unhex(h || repeat('FF', n - n_bytes)) AS samples FROM p),
m AS (SELECT *, {duckbytes.byte_list("samples")} AS l,
  unhex('52494646' || {duckbytes.little_endian("36 + n")} || '57415645666D74201000000001000100' || {duckbytes.little_endian(RATE)} || {duckbytes.little_endian(RATE)} || '0100080064617461' || {duckbytes.little_endian("n")} || hex(samples)) AS media FROM s)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(samples) AS payload_sha256, {duckbytes.crc32("l[-32:]")} AS tail_crc32, octet_length(media) AS media_bytes, sha256(media) AS media_sha256,
  printf('audio/wav;%d;mean=%.4f;entropy=%.4f;crossings=%d;embedded=0', octet_length(media), list_avg(l), abs(list_entropy(l)),
    len(regexp_extract_all(array_to_string(list_transform(l, lambda x: CASE WHEN x > 127 THEN '1' ELSE '0' END), ''), '0+|1+')) - 1) AS feature
FROM m, {duckbytes.CRC_TABLE}
"""
