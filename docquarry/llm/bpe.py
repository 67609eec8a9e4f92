"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut by the vocabulary's split pattern; each distinct match is mapped byte by byte to the
vocabulary's printable characters and encoded once per worker by the tokenizers library, then reused
from a bounded cache. Decoding joins the tokens' bytes, so a character whose bytes lie in several tokens
comes back whole.

Defined results: a null text counts as empty; an empty text has no ids, no offsets and empty bytes; row order
and repeated rows are kept; other columns of the input are left out unless named in `keep`.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of the cache of distinct matches; longer matches than CACHED_CHARS aren't kept.
CACHE_ENTRIES, CACHED_CHARS = 400_000, 64
#: Characters handled at once inside an Arrow batch.
SLICE_CHARS = 4_000_000


@lru_cache(1)
def byte_chars() -> list[str]:
    """Byte -> printable character: printable Latin-1 stands for itself, the others follow from 256 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class ByteBPE:
    """Encoder and decoder of one vocabulary file (.tiktoken ranks or .json)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.special: dict[str, int] = {}
        chars = byte_chars()
        self.to_chars = dict(enumerate(chars))
        to_byte = {c: b for b, c in enumerate(chars)}
        if path.endswith(".json"):
            spec = json.load(open(path, encoding="utf-8"))
            vocab = spec["model"]["vocab"]
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
            self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            model = BPE(vocab, merges)
        else:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in open(path, "rb") if line.strip())}
            vocab = {self.chars(t): r for t, r in ranks.items()}
            merges = [
                (self.chars(t[:i]), self.chars(t[i:]))
                for t, _ in sorted(ranks.items(), key=lambda x: x[1])
                if len(t) > 1
                for i in range(1, len(t))
                if t[:i] in ranks and t[i:] in ranks
            ]
            model = BPE(vocab, merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.decimal = [str(i) for i in range(self.size)]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        #: Packed ids of matches, and of stretches that begin with a space (which the key leaves out).
        self.cache: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}

    def chars(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self.to_chars)

    def pieces(self, text: str) -> list[str]:
        """The matches of the split pattern; with a .json vocabulary, its special tokens come as matches of their own."""
        if self.split_special and any(s in text for s in self.special):
            return list(chain.from_iterable([p] if p in self.special else self.split(p) for p in self.split_special(text)))
        return self.split(text)

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of distinct matches, by the library where the cache lacks them."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache.clear()
        missing = [p for p in set(pieces) if p not in self.cache]
        plain = [p for p in missing if p not in self.special]
        found = self.tokenizer.encode_batch_fast([self.chars(p.encode("utf-8")) for p in plain], add_special_tokens=False)
        self.cache.update((p, self.pack(e.ids)) for p, e in zip(plain, found, strict=True))
        self.cache.update((p, self.pack([self.special[p]])) for p in missing if p in self.special)
        return self.cache

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed (self.dtype).

        Where a text has only single spaces, a match never reaches over the end of the stretch before a space, so
        whole stretches (a space and what follows up to the next) are looked up, and cut into matches only when new."""
        stretched = [t.split(" ") if not (("  " in t) or t.endswith(" ") or any(s in t for s in self.special)) else None for t in texts]
        if len(self.stretches) > CACHE_ENTRIES:
            self.stretches.clear()
        new: set[str] = set()
        for parts in stretched:
            if parts:
                new.update(parts[1:])
        known = self.stretches
        new = {p for p in new if p not in known}
        cut = {p: self.split(" " + p) for p in new}
        whole = [self.pieces(t) if parts is None else self.split(parts[0]) for t, parts in zip(texts, stretched, strict=True)]
        of = self.learn(chain(chain.from_iterable(cut.values()), chain.from_iterable(whole))).__getitem__
        known.update((p, b"".join(map(of, pieces))) for p, pieces in cut.items())
        of_stretch = known.__getitem__
        packed = [b"".join(map(of, w)) + (b"".join(map(of_stretch, parts[1:])) if parts else b"") for w, parts in zip(whole, stretched, strict=True)]
        for cache in (self.cache, known):  # what is long comes back rarely
            for p in [p for p in (new if cache is known else cut) if len(p) > CACHED_CHARS]:
                cache.pop(p, None)
        return packed

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def unpack(self, packed: bytes) -> list[int]:
        return np.frombuffer(packed, self.dtype).tolist()

    def encode(self, text: str) -> list[int]:
        return self.unpack(self.encode_packed([text])[0])

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [self.unpack(p) for p in self.encode_packed(texts)]

    def offsets(self, ids: list[int]) -> list[int]:
        """Byte offset at which each token starts, then the length."""
        return [0, *accumulate(len(self.bytes_of[i]) for i in ids)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(4)
def vocabulary(path: str) -> ByteBPE:
    """One per Python worker and file."""
    return ByteBPE(path)


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= most:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_frame(
    df: DataFrame,
    path: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    finish: Callable[[ByteBPE, list[int]], tuple] | None = None,
    fields: list[T.StructField] | None = None,
) -> DataFrame:
    """Encodes a text column. Without `finish`: ids, byte offsets of the tokens (and the end), and the decoded bytes.
    `finish(bpe, ids)` instead derives its own values (of `fields`) in the same pass."""
    fields = fields or [
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("offsets", T.ArrayType(T.IntegerType(), False)),
        T.StructField("decoded", T.BinaryType()),
    ]
    finish = finish or (lambda bpe, ids: (ids, bpe.offsets(ids), bpe.decode(ids)))
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in slices(texts):
                rows = [finish(bpe, bpe.unpack(packed)) for packed in bpe.encode_packed(texts[a:b])]
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                made = [pa.array([r[i] for r in rows], out.field(len(keep) + i).type) for i in range(len(fields))]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=out)

    return df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text")).mapInArrow(run, schema)


def decode_frame(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Bytes and text of an ids column; bytes that aren't UTF-8 become replacement characters in the text. Null ids give nulls."""
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("decoded", T.BinaryType()), T.StructField("text", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            raw = [None if x is None else bpe.decode(x) for x in batch.column(len(keep)).to_pylist()]
            text = [None if x is None else x.decode("utf-8", "replace") for x in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(raw, pa.binary()), pa.array(text, pa.string())], schema=out)

    return df.select(*keep, ids).mapInArrow(run, schema)


def _digest(bpe: ByteBPE, ids: list[int]) -> tuple:
    return (
        len(ids),
        hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest(),
        hashlib.sha256(bpe.decode(ids)).hexdigest(),
    )


def round_trip(documents: DataFrame) -> DataFrame:
    """op9: every text encoded by the ranks of byte_bpe_50k.tiktoken and decoded again, as digests."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return encode_frame(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), finish=_digest, fields=fields)
