"""Token files: concatenated ids with Elias-Fano document boundaries.

Documents are put into ascending doc_id order by ranges; every task encodes its range and writes it as shards, one file
each, of about SHARD_IDS ids. A shard holds its ids as 16-bit numbers (32-bit where the vocabulary asks for it), the
documents' ends and the documents' ids. Both lists ascend, so they are Elias-Fano coded: the low bits of each number packed,
its high part as ones in a bit vector, about 2 + log2(range / count) bits a document. The place of every SAMPLE-th one is
kept (32 bits, inside the bit vector), so `select` reaches any boundary by looking at one stretch of the vector; no table
of 64-bit offsets exists, neither in the file nor in memory. Offsets are relative to the shard; where a shard begins in the
whole array follows from sums over the shards before it.

Texts are encoded by the tokenizers library. The vocabulary's splitting never joins characters across a space, and in Latin-1
it is a plain pattern, so the library merges each distinct match once per worker; the results are kept in a bounded cache.

Layout of a shard, little-endian: MAGIC, bytes of an id (u8), 3 bytes of padding, range (u32), shard in the range (u32),
documents (u32), of them without doc_id (u32, they come first), bytes of the ends (u32), bytes of the doc_ids (u32), CRC-32 of
what follows (u32), ids (u64); then ends, doc_ids, ids. What Spark's writer adds after a row (a line end) is not read.

Defined results: a null or empty text has the end id only; rows without doc_id come first; rows with the same doc_id follow
each other in the order of the input; very long texts are encoded in pieces cut at spaces; an empty table gives no files and no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_chars, slices
from .common import delete, new_path, small_batches, store, tidied

MAGIC = b"DQTOKEN1"
HEADER = struct.Struct("<8sB3xIIIIIIIQ")
#: About so many ids to a shard.
SHARD_IDS = 8 << 20
#: Every so many-th boundary's place in the bit vector is kept.
SAMPLE = 256
#: Characters cut at once, and entries of each cache; what is longer than CACHED_CHARS isn't kept.
PIECE_CHARS, CACHE_ENTRIES, CACHED_CHARS = 1 << 20, 600_000, 48


class EliasFano:
    """Ascending unsigned 64-bit numbers, coded in bytes; numbers may repeat."""

    HEADER = struct.Struct("<QIBxxxII")

    def __init__(self, raw: bytes | memoryview):
        self.base, self.n, self.width, low, high = self.HEADER.unpack_from(raw)
        at = self.HEADER.size
        self.low = np.frombuffer(raw, np.uint8, low, at)
        self.high = np.frombuffer(raw, np.uint8, high, at + low)
        self.samples = np.frombuffer(raw, "<u4", -(-self.n // SAMPLE), at + low + high)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls.HEADER.pack(0, 0, 0, 0, 0)
        base, spread = int(values[0]), int(values[-1] - values[0])
        width = max((spread // n).bit_length() - 1, 0)
        rest = values - np.uint64(base)
        ones = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, bool)
        bits[ones] = True
        low = (rest[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low, high = np.packbits(low.astype(bool).ravel(), bitorder="little"), np.packbits(bits, bitorder="little")
        return cls.HEADER.pack(base, n, width, len(low), len(high)) + low.tobytes() + high.tobytes() + ones[::SAMPLE].astype("<u4").tobytes()

    def select(self, i: int) -> int:
        """Place of the i-th one in the bit vector: within the stretch from its sample to the next."""
        k = i // SAMPLE
        begin = int(self.samples[k])
        end = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        stretch = np.unpackbits(self.high[begin // 8 : end // 8 + 1], bitorder="little")[begin % 8 :]
        return begin + int(np.flatnonzero(stretch)[i % SAMPLE])

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.width
        raw = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8].tobytes(), "little")
        return self.base + ((self.select(i) - i) << self.width) + (raw >> first % 8 & (1 << self.width) - 1)

    def all(self) -> np.ndarray:
        """Every number at once."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        out = np.uint64(self.base) + (high.astype(np.uint64) << np.uint64(self.width))
        if self.width:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.width).reshape(self.n, self.width)
            for k in range(self.width):
                out += bits[:, k].astype(np.uint64) << np.uint64(k)
        return out


#: Signed doc_ids as unsigned numbers in the same order.
SIGN = 1 << 63


class TokenShard:
    """One shard: documents by place or by doc_id, without decoding the others."""

    def __init__(self, raw: bytes):
        magic, self.id_bytes, self.range, self.shard, self.n, self.unnamed, ends, names, crc, total = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.total, view, at = total, memoryview(raw), HEADER.size
        size = ends + names + total * self.id_bytes
        if len(raw) < at + size or zlib.crc32(view[at : at + size]) != crc:
            raise ValueError("a token file is cut or damaged")
        self.ends, self.names = EliasFano(view[at : at + ends]), EliasFano(view[at + ends : at + ends + names])
        self.ids = np.frombuffer(raw, f"<u{self.id_bytes}", total, at + ends + names)

    @staticmethod
    def encode(range_: int, shard: int, names: list[int | None], packed: list[bytes], id_bytes: int) -> bytes:
        known = [x for x in names if x is not None]
        sizes = np.array([len(p) // id_bytes for p in packed], np.int64)
        ends = EliasFano.encode(np.cumsum(sizes).astype(np.uint64))
        ids = EliasFano.encode(np.array([x + SIGN for x in known], np.uint64))
        body = b"".join([ends, ids, *packed])
        return HEADER.pack(MAGIC, id_bytes, range_, shard, len(names), len(names) - len(known), len(ends), len(ids), zlib.crc32(body), int(sizes.sum())) + body

    def bounds(self, i: int) -> tuple[int, int]:
        """First id and end of the i-th document within the shard."""
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def document(self, i: int) -> np.ndarray:
        begin, end = self.bounds(i)
        return self.ids[begin:end]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.unnamed else self.names[i - self.unnamed] - SIGN

    def find(self, doc_id: int) -> int | None:
        """Place of the first document of that id, by binary search over the coded ids."""
        low, high = 0, len(self.names)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.names[middle] - SIGN < doc_id else (low, middle)
        return self.unnamed + low if low < len(self.names) and self.names[low] - SIGN == doc_id else None


# How the vocabulary splits lower-case Latin-1 (contractions, letters, single digits, other marks).
LETTERS, DIGITS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
MATCH = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\t-\r \x85\xa0{LETTERS}{DIGITS}]+")
#: Special tokens begin so; with them, or with separators that count as white space in some libraries, a text is left whole.
SPECIAL, ODD = "<|", re.compile("[\x1c-\x1f]")


class Remembered(dict):
    """Packed ids of short texts by `find`; long ones come back rarely and aren't kept."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, text: str) -> bytes:
        found = self.find(text)
        if len(text) <= CACHED_CHARS:
            self[text] = found
        return found


class Encoder:
    """Ids of texts, packed, by a tokenizers file whose splitting keeps to the stretches between spaces and which works on lower
    case. Latin-1 is cut into the vocabulary's matches here, and the library's BPE model merges each match once; other
    stretches, and texts with special tokens, go through the whole library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.to_chars = self.tokenizer.model, dict(enumerate(byte_chars()))
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.matches, self.stretches = Remembered(self._merged), Remembered(self._stretch)

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _merged(self, match: str) -> bytes:
        return self._packed([t.id for t in self.model.tokenize(match.encode().decode("latin-1").translate(self.to_chars))])

    def _whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _latin(self, text: str) -> bytes:
        return b"".join(map(self.matches.__getitem__, MATCH.findall(text.lower())))

    def _stretch(self, stretch: str) -> bytes:
        return self._latin(stretch) if is_latin(stretch) else self._whole(stretch)

    def _piece(self, text: str) -> bytes:
        if SPECIAL in text or ODD.search(text):
            return self._whole(text)
        return self._latin(text) if is_latin(text) else b"".join(map(self.stretches.__getitem__, text.split(" ")))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text (self.dtype)."""
        out = []
        for text in texts:
            for known in (self.matches, self.stretches):
                if len(known) > CACHE_ENTRIES:
                    known.clear()
            out.append(self._piece(text) if len(text) <= PIECE_CHARS else b"".join(map(self._piece, pieces(text))))
        return out


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """A long text cut at spaces (which are left out) into pieces of at least `most` characters, the last one apart."""
    begin = 0
    while (cut := text.find(" ", begin + most)) >= 0:
        yield text[begin:cut]
        begin = cut + 1
    yield text[begin:]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)


def write_token_files(documents: DataFrame, path: str, vocabulary: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Writes the shards of all documents into the folder `path`, in ascending doc_id order."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, range_, shard = encoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        names, packed, held = [], [], 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([TokenShard.encode(range_, shard, names, packed, enc.dtype.itemsize)], pa.binary())], names=["file"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for name, raw in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    if held and held + len(raw) > shard_ids * enc.dtype.itemsize:
                        yield file()
                        shard, names, packed, held = shard + 1, [], [], 0
                    names.append(name)
                    packed.append(raw + end)
                    held += len(packed[-1])
        if names:
            yield file()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")
    # one row is one file; the writer puts a row's bytes down as they are, and a line end after them
    rows.mapInArrow(tidied(run), "file binary").select(F.col("file").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_token_files(spark: SparkSession, path: str, fields: str, rows: Callable[[TokenShard], list[tuple]]) -> DataFrame:
    """Rows (of `fields`) that rows(shard) makes of each file in the folder."""
    small_batches(spark)
    schema = T.StructType.fromDDL(fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                if raw.as_buffer().size:  # a task without rows may leave an empty file
                    made = rows(TokenShard(raw.as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(tidied(run), schema)


def _digests(shard: TokenShard) -> list[tuple]:
    ends = shard.ends.all().astype(np.int64)
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    names = [None] * shard.unnamed + [int(x) - SIGN for x in shard.names.all().tolist()]
    raw = memoryview(shard.ids.astype("<u4")).cast("B") if len(shard.ids) else b""
    return [(shard.range, shard.shard, name, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for name, a, b in zip(names, begins.tolist(), ends.tolist(), strict=True)]


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and CRC-32 of each document, read from the files.
    start is the place in the shard plus the ids of the shards before: of those of the same range, and of the ranges before."""
    found = store(read_token_files(spark, path, "range int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long", _digests), "token-digests")
    shards = found.groupBy("range", "shard").agg(F.sum("n_tokens").alias("n"))
    before = lambda part, by: F.coalesce(F.sum("n").over(part.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = shards.groupBy("range").agg(F.sum("n").alias("n")).select("range", before(Window.partitionBy(), "range").alias("base"))
    begins = shards.select("range", "shard", before(Window.partitionBy("range"), "shard").alias("within")).join(ranges, "range")
    return found.join(begins, ["range", "shard"]).select("doc_id", (F.col("base") + F.col("within") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_file_round_trip(documents: DataFrame) -> DataFrame:
    """op12: all documents encoded by word_bpe_49k.json, each ended by id 2, written as token files and read back."""
    spark = documents.sparkSession
    path = new_path(spark, "tokens")
    write_token_files(documents, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    found = document_digests(spark, path)
    delete(spark, path)  # the digests are stored
    return found
