"""Exact substring dedup by recompression.

Words get global names (64-bit hashes, the same on every executor). Every round names the runs of equal neighbours (symbol and
length) and then the pairs whose left symbol falls on the left side of the alphabet and whose right symbol on the right
side; a new symbol's name is a hash of its parts, so the naming is global without a table of symbols. Equal substrings
therefore break into the same symbols apart from their ends.

* The first ROUNDS_NEAR rounds name pairs only, so that windows inside a run find borders too. A border between their symbols
  depends on three words on either side and no symbol is longer than four words, so every 13-word window has a border at one of
  its places 5 to 8. The pair around a border, popped or filled up to five words on either side, lies in the window.
* The later rounds give high symbols, those of WINDOW words or more.

1. Every document's pairs around borders and its high symbols are grouped by name. Pairs that stand in several documents are
   shared. A high symbol that also stands in a document with a smaller id, with the same length and the same check sum of its
   words, verifies a long repeat: all of its windows are removed.
2. What is left are windows across the ends of high symbols, or in repeats too short for one: windows whose borders at
   places 5 to 8 are all shared and that no high symbol has verified. They are compared by 96 bits; one that also
   starts in a document with a smaller id is removed. (Windows that were verified needn't be sent: the document that they were
   verified against holds them too, with a smaller id, and the least such document sends them.)
3. Documents that lose words are read once more for the words they keep.

Names travel in sorted blocks, a row per slice of documents and bucket of names; where there are many buckets they are dealt in
two steps, coarse ones first, so that blocks don't get too small. A slice sends a name only for its smallest
document and answers for the others itself, so a passage in a third of all documents costs one entry per slice.

Defined results: a null or empty text has no words; text unchanged but for removed words, kept words joined by one
space; a null doc_id is larger than any other (its windows are removed if they stand anywhere else with an id);
rows that repeat a doc_id are never duplicates of each other; rows repeated whole give repeated results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, small, store, stored_bytes, tidied, tidy
from .wordnames import M1, M2, documents, grams, mix, word_names

WINDOW = 13
#: Rounds without runs, and after which rounds high symbols are published (a round shortens a text by a quarter, so
#: these have some 20 and 70 words on average).
ROUNDS_NEAR, PUBLISHED = 2, (11, 15)
#: The pair at a border covers NAMED words on either side; the border stands at one of the places FIRST to LAST of a window.
NAMED, FIRST, LAST = 5, 5, 8
#: Words of a slice, bytes of names that a bucket aims at, least buckets, and most that a slice is dealt to in one step.
SLICE_WORDS, BUCKET_BYTES, LEAST_BUCKETS, FAN = 400_000, 4 << 20, 16, 2048
#: Bytes of names that are dealt again at once in the second step.
AGAIN_BYTES = 32 << 20
LAST_ID = np.iinfo(np.int64).max


def pair_round(at: np.ndarray, symbol: np.ndarray, first: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round of pairs: positions, names and whether they begin a document, of the symbols after it."""
    right = (mix(symbol ^ np.uint64(number * 0x9E3779B9)) & np.uint64(1)) != 0
    joined = np.zeros(len(symbol), bool)
    joined[1:] = ~right[:-1] & right[1:] & ~first[1:]
    begins = np.flatnonzero(~joined)
    paired = np.zeros(len(symbol), bool)
    paired[:-1] = joined[1:]
    name, pairs = symbol[begins], paired[begins]
    name[pairs] = mix(name[pairs] * M1 + symbol[begins[pairs] + 1] * M2 + np.uint64(1))
    return at[begins], name, first[begins]


def run_round(at: np.ndarray, symbol: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round of runs: equal neighbours become one symbol, named by symbol and length."""
    again = np.zeros(len(symbol), bool)
    again[1:] = (symbol[1:] == symbol[:-1]) & ~first[1:]
    if not again.any():
        return at, symbol, first
    begins = np.flatnonzero(~again)
    length = np.diff(np.r_[begins, len(symbol)]).astype(np.uint64)
    name, runs = symbol[begins], length > 1
    name[runs] = mix(name[runs] * M2 + length[runs] * M1 + np.uint64(2))
    return at[begins], name, first[begins]


def near_symbols(names: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, names and document beginnings of the symbols after the first rounds. start: whether a word begins a document."""
    found = np.arange(len(names)), names, start
    for number in range(1, ROUNDS_NEAR + 1):
        found = pair_round(*found, number)
    return found


def high_symbols(names: np.ndarray, near: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(name, check sum of the words, words, position) of the symbols of WINDOW words or more after the published rounds."""
    total = np.r_[np.uint64(0), np.cumsum(mix(names ^ M2))]
    out, seen = [], np.zeros(0, np.int64)
    found = near
    for number in range(ROUNDS_NEAR + 1, PUBLISHED[-1] + 1):
        found = pair_round(*run_round(*found), number)
        if number in PUBLISHED:
            at, symbol, _ = found
            end = np.r_[at[1:], len(names)]
            extent = at * (len(names) + 1) + end
            new = (end - at >= WINDOW) & ~np.isin(extent, seen)  # a symbol that no round since has changed is sent once
            seen, at, end = extent, at[new], end[new]
            out.append((symbol[new], (total[end] - total[at]) >> np.uint64(32), end - at, at))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pack(ordinals: np.ndarray) -> bytes:
    """Whole numbers, as deltas."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(ordinals.astype(np.int64), prepend=0).astype("<i4").tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i4").astype(np.int64))


def _first(base: np.ndarray) -> np.ndarray:
    """Whether a word is the first of its document."""
    first = np.zeros(int(base[-1]), bool)
    first[base[:-1][base[1:] > base[:-1]]] = True
    return first


#: kind 0: a document (doc_id, hash, base, n_words, sha); the kinds of names for a bucket; answers: ordinals of shared borders
#: (SHARED), extents of verified high symbols (VERIFIED), starts of removed windows (REMOVED).
BORDERS, SYMBOLS, WINDOWS, SHARED, VERIFIED, REMOVED = 1, 2, 3, 4, 5, 6
#: Columns of the names of a kind, besides their ordinals.
COLUMNS = {BORDERS: ("<u4", "u1"), SYMBOLS: ("<u8", "<u4", "<i8", "<u4"), WINDOWS: ("<u8", "<u4", "<i8")}
FLOW = T.StructType(
    [
        T.StructField("bucket", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("slice", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("hash", T.LongType()),
        T.StructField("base", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("sha", T.StringType()),
        T.StructField("blob", T.BinaryType()),
    ]
)


def _flow(rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(FLOW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _row(bucket: int, kind: int, number: int | None, blob: bytes) -> tuple:
    return bucket, kind, number, None, None, None, None, None, blob


def _sliced(batches: Iterator[pa.RecordBatch], kept: int, digest: bool, slice_words: int) -> Iterator[tuple[int, list[tuple], np.ndarray, np.ndarray]]:
    """(slice number, rows, names of all words, words before each row) of about slice_words words at a time. Rows are the
    first `kept` columns, and with digest the SHA-256 of the words joined by one space; the text is the last column."""
    part, number = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    names, counts, held = [], [], 0

    def done():
        return (part << 24) + number, rows, np.concatenate(names), np.r_[0, np.cumsum(np.concatenate(counts))]

    for batch in batches:
        for a, b, raw, edges in documents(batch, batch.num_columns - 1):
            found, base = word_names(raw, edges)
            values = zip(*(batch.column(i).slice(a, b - a).to_pylist() for i in range(kept)), strict=True)
            if digest:
                whole, at = raw.tobytes(), edges.tolist()
                shas = [hashlib.sha256(b" ".join(whole[x:y].split())).hexdigest() for x, y in zip(at, at[1:], strict=False)]
                rows += [(*v, s) for v, s in zip(values, shas, strict=True)]
            else:
                rows += values
            names.append(found)
            counts.append(np.diff(base))
            held += len(found)
            if held >= slice_words:
                yield done()
                number, rows, names, counts, held = number + 1, [], [], [], 0
    if rows:
        yield done()


def _bucket(upper: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of names by their upper 32 bits."""
    return (upper.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _block(upper: np.ndarray | None, columns: list[np.ndarray], numbers: np.ndarray, ordinals: np.ndarray) -> bytes:
    """Names as columns, with the upper halves of their hashes if they are to be dealt again, then the slices that they come
    from, one after another, and the ordinals there."""
    begin = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
    counts = np.diff(np.r_[begin, len(numbers)])
    head = np.array([len(numbers), len(begin)], "<i4").tobytes() + numbers[begin].astype("<i8").tobytes() + counts.astype("<i4").tobytes()
    return b"".join([head, *(c.tobytes() for c in ([] if upper is None else [upper.astype("<u4")])), *(c.tobytes() for c in columns), _pack(ordinals)])


def _read(blobs: list[bytes], kinds: tuple[str, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns of all blocks, their ordinals, and the slice that each entry is from."""
    columns, ordinals, numbers = [[] for _ in kinds], [], []
    for blob in blobs:
        (n, m), p = np.frombuffer(blob, "<i4", 2).tolist(), 8
        numbers.append(np.repeat(np.frombuffer(blob, "<i8", m, p), np.frombuffer(blob, "<i4", m, p + 8 * m)))
        p += 12 * m
        for c, kind in zip(columns, kinds, strict=True):
            c.append(np.frombuffer(blob, kind, n, p))
            p += np.dtype(kind).itemsize * n
        ordinals.append(_unpack(blob[p:]))
    return [np.concatenate(c) for c in columns], np.concatenate(ordinals), np.concatenate(numbers)


def _deal(kind: int, upper: np.ndarray, columns: list[np.ndarray], numbers: np.ndarray, ordinals: np.ndarray, bucket: np.ndarray, again: bool) -> Iterator[tuple]:
    """A row per bucket."""
    order = np.argsort(bucket, kind="stable")
    found = bucket[order]
    edges = np.flatnonzero(np.r_[True, found[1:] != found[:-1], True]) if len(found) else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        at = order[a:b]
        yield _row(int(found[a]), kind, None, _block(upper[at] if again else None, [c[at] for c in columns], numbers[at], ordinals[at]))


class Buckets:
    """How names are dealt: `total` buckets, in one step, or first to `coarse` groups of buckets that lie next to each other."""

    def __init__(self, total: int, fan: int = FAN):
        self.total = max(total, LEAST_BUCKETS)
        self.fine = 1
        while -(-self.total // self.fine) > fan:
            self.fine *= 2
        self.coarse = -(-self.total // self.fine)
        self.total = self.coarse * self.fine

    def first(self, kind: int, upper: np.ndarray, columns: list[np.ndarray], number: int, ordinals: np.ndarray) -> Iterator[tuple]:
        numbers = np.full(len(ordinals), number, np.int64)
        return _deal(kind, upper, columns, numbers, ordinals, _bucket(upper, self.coarse), self.fine > 1)

    def second(self, rows: DataFrame) -> DataFrame:
        """Deals the names again, to the buckets within their group."""
        if self.fine == 1:
            return rows
        total = self.total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[bytes]] = {k: [] for k in COLUMNS}
            size = 0

            def flush() -> Iterator[pa.RecordBatch]:
                for kind, blobs in held.items():
                    if blobs:
                        (upper, *columns), ordinals, numbers = _read(blobs, ("<u4", *COLUMNS[kind]))
                        out = list(_deal(kind, upper, columns, numbers, ordinals, _bucket(upper, total), False))
                        for i in range(0, len(out), 256):
                            yield _flow(out[i : i + 256])
                        blobs.clear()

            for batch in batches:
                kind = batch.column(1).to_numpy()
                others = batch.filter(pa.array(~np.isin(kind, list(COLUMNS))))
                if others.num_rows:
                    yield others
                for k, blob in zip(kind.tolist(), batch.column(8).to_pylist(), strict=True):
                    if k in COLUMNS:
                        held[k].append(blob)
                        size += len(blob)
                if size >= AGAIN_BYTES:
                    yield from flush()
                    size = 0
            yield from flush()

        return rows.repartition(F.col("bucket")).mapInArrow(tidied(run), FLOW)


def _spread(rows: list[tuple], number: int, base: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The slice's documents, in a row each; values are doc_id, hash and, if it is known, the digest."""
    for a in range(0, len(rows), 4096):
        part = rows[a : a + 4096]
        yield _flow([(i % buckets, 0, number, r[0], r[1], int(base[i]), int(base[i + 1] - base[i]), r[2] if len(r) > 2 else None, None) for i, r in enumerate(part, a)])


def _ids(rows: list[tuple], doc: np.ndarray) -> np.ndarray:
    return np.array([LAST_ID if r[0] is None else r[0] for r in rows], np.int64)[doc] if len(doc) else np.zeros(0, np.int64)


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the columns (the first is the main one), where groups of equal ones but for the last begin in it, and their sizes."""
    order = np.lexsort(columns[::-1])
    n = len(order)
    change = np.zeros(n, bool)
    change[:1] = True
    for c in columns[:-1]:
        c = c[order]
        change[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(change)
    return order, begin, np.diff(np.r_[begin, n])


def _name_all(buckets: Buckets, slice_words: int):
    """Pass 1: documents, pairs around borders and high symbols for the buckets, and what is shared inside the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, h, base in _sliced(batches, 2, True, slice_words):
            yield from _spread(rows, number, base, buckets.coarse)
            if not len(h):
                continue
            near = near_symbols(h, _first(base))
            at = near[0]
            doc = np.searchsorted(base, at, side="right") - 1
            fits = (at - NAMED >= base[doc]) & (at + NAMED <= base[doc + 1])
            at, doc = at[fits], doc[fits]
            key = grams(h, 2 * NAMED, M1)[at - NAMED] if len(at) else np.zeros(0, np.uint64)
            order, begin, sizes = _groups(key, at)
            key, at, doc = key[order], at[order], doc[order]
            lead = np.repeat(doc[begin], sizes) == doc  # in the first document of the slice that has the name
            within = np.repeat(np.maximum.reduceat(doc, begin) != doc[begin], sizes) if len(begin) else lead
            out = []
            if within.any():
                out.append(_row(number % buckets.coarse, SHARED, number, _pack(np.sort(at[within]))))
            key, at = key[lead], at[lead]
            order = np.argsort(at)
            key, at, upper = key[order], at[order], (key[order] >> np.uint64(32)).astype("<u4")
            # five bytes of the name besides the bits that choose the bucket: a false agreement costs a check in pass 2, no more
            out += buckets.first(BORDERS, upper, [key.astype("<u4"), (upper & np.uint32(0xFF)).astype("u1")], number, at)
            # high symbols
            one, two, size, at = high_symbols(h, near)
            ids = _ids(rows, np.searchsorted(base, at, side="right") - 1)
            order, begin, sizes = _groups(one, two, size, ids)
            one, two, size, at, ids = one[order], two[order], size[order], at[order], ids[order]
            least = np.repeat(ids[begin], sizes)
            later = ids > least
            if later.any():
                out.append(_row(number % buckets.coarse, VERIFIED, number, _extents(at[later], size[later])))
            order = np.flatnonzero(~later)[np.argsort(at[~later], kind="stable")]
            one, two, size, at, ids = one[order], two[order], size[order], at[order], ids[order]
            out += buckets.first(SYMBOLS, (one >> np.uint64(32)).astype("<u4"), [one, two.astype("<u4"), ids, size.astype("<u4")], number, at)
            for i in range(0, len(out), 256):
                yield _flow(out[i : i + 256])

    return run


def _extents(at: np.ndarray, size: np.ndarray) -> bytes:
    order = np.argsort(at, kind="stable")
    a, b = _pack(at[order]), size[order].astype("<u4").tobytes()
    return len(a).to_bytes(4, "little") + a + zstandard.ZstdCompressor(level=1).compress(b)


def _read_extents(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    return _unpack(raw[4 : 4 + n]), np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[4 + n :]), "<u4").astype(np.int64)


def _by_slice(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order, begin, sizes = _groups(numbers, np.arange(len(numbers)))
    for a, n in zip(begin.tolist(), sizes.tolist(), strict=True):
        yield int(numbers[order[a]]), order[a : a + n]


def _match(key: tuple, group: pa.Table) -> pa.Table:
    """One bucket: border pairs that come from several slices are shared; of equal high symbols and windows, all but
    those of the smallest document are verified repeats."""
    kind = group["kind"].to_numpy()
    out = [group.filter(pa.array(~np.isin(kind, list(COLUMNS)))).combine_chunks()]
    made = []
    for k, columns in COLUMNS.items():
        blobs = group.filter(pa.array(kind == k))["blob"].to_pylist()
        if not blobs:
            continue
        found, ordinals, numbers = _read(blobs, columns)
        if k == BORDERS:
            value = (found[1].astype(np.uint64) << np.uint64(32)) | found[0]
            order, begin, sizes = _groups(value, numbers)
            s = numbers[order]
            hit = order[np.repeat(s[begin] != s[begin + sizes - 1], sizes)] if len(begin) else order
            made += [_row(0, SHARED, n, _pack(np.sort(ordinals[hit[at]]))) for n, at in _by_slice(numbers[hit])]
            continue
        ids = found[2]
        order, begin, sizes = _groups(*(found[i] for i in ((0, 1, 3, 2) if k == SYMBOLS else (0, 1, 2))))
        hit = order[ids[order] > np.repeat(ids[order[begin]], sizes)]
        for n, at in _by_slice(numbers[hit]):
            at = hit[at]
            made.append(_row(0, VERIFIED, n, _extents(ordinals[at], found[3][at])) if k == SYMBOLS else _row(0, REMOVED, n, _pack(np.sort(ordinals[at]))))
    if made:
        out.append(pa.Table.from_batches([_flow(made)]))
    tidy()
    return pa.concat_tables(out)


def _name_windows(buckets: Buckets, slice_words: int):
    """Pass 2: windows all of whose borders are shared and that aren't verified. Rows: doc_id, hash, shared borders, verified
    extents (both by positions), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, h, base in _sliced(batches, 4, False, slice_words):
            yield from _spread([r[:2] for r in rows], number, base, buckets.coarse)
            n = len(h)
            border, shared, verified = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
            border[near_symbols(h, _first(base))[0]] = 1
            for i, (_, _, blob, extents) in enumerate(rows):
                shared[base[i] + _unpack(blob)] = 1
                if extents is not None:
                    at, size = _read_extents(extents)
                    np.add.at(verified, base[i] + at, 1)
                    np.add.at(verified, base[i] + at + size - WINDOW + 1, -1)
            # windows that lie in one document, with a border at places FIRST to LAST, each of them shared
            count = max(n - WINDOW + 1, 0)
            begin = np.arange(count)
            within = lambda x: (lambda c: c[begin + LAST + 1] - c[begin + FIRST])(np.r_[0, np.cumsum(x)])
            doc = np.searchsorted(base, begin, side="right") - 1
            k = within(border)
            done = np.cumsum(verified)[:count] > 0
            at = begin[(begin + WINDOW <= base[doc + 1]) & (k > 0) & (within(shared) == k) & ~done]
            out = []
            if done.any():
                out.append(_row(number % buckets.coarse, REMOVED, number, _pack(np.flatnonzero(done))))
            one, two = grams(h, WINDOW, M1)[at], grams(h, WINDOW, M2)[at]
            ids = _ids(rows, doc[at])
            order, begin, sizes = _groups(one, two, ids)
            one, two, at, ids = one[order], two[order], at[order], ids[order]
            least = np.repeat(ids[begin], sizes)
            if (ids > least).any():
                out.append(_row(number % buckets.coarse, REMOVED, number, _pack(np.sort(at[ids > least]))))
            lead = np.flatnonzero(ids == least)
            lead = lead[np.argsort(at[lead], kind="stable")]
            one, two, at, ids = one[lead], two[lead], at[lead], ids[lead]
            out += buckets.first(WINDOWS, (one >> np.uint64(32)).astype("<u4"), [one, (two >> np.uint64(32)).astype("<u4"), ids], number, at)
            for i in range(0, len(out), 256):
                yield _flow(out[i : i + 256])

    return run


def _by_document(key: tuple, group: pa.Table) -> pa.Table:
    """A slice's answers dealt to its documents: positions inside each, of shared borders or removed windows, and extents of
    verified symbols."""
    kind = group["kind"].to_numpy()
    docs, answers = group.filter(pa.array(kind == 0)).sort_by("base"), group.filter(pa.array(kind > 0))
    kind, blobs = answers["kind"].to_numpy(), answers["blob"].to_pylist()
    at = [_unpack(b) for b, k in zip(blobs, kind, strict=True) if k != VERIFIED]
    at = np.unique(np.concatenate(at)) if at else np.zeros(0, np.int64)
    extents = [_read_extents(b) for b, k in zip(blobs, kind, strict=True) if k == VERIFIED]
    begin, size = (np.concatenate(c) for c in zip(*extents, strict=True)) if extents else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(begin, kind="stable")
    begin, size = begin[order], size[order]
    base, n = docs["base"].to_numpy(), docs["n_words"].to_numpy()
    a, b = np.searchsorted(at, base), np.searchsorted(at, base + n)
    c, d = np.searchsorted(begin, base), np.searchsorted(begin, base + n)
    keep = np.flatnonzero(b > a)
    made = [docs["doc_id"].take(keep), docs["hash"].take(keep), pa.array([_pack(at[a[i] : b[i]] - base[i]) for i in keep], pa.binary())]
    made.append(pa.array([_extents(begin[c[i] : d[i]] - base[i], size[c[i] : d[i]]) if d[i] > c[i] else None for i in keep], pa.binary()))
    tidy()
    return pa.table(made, schema=pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("at", pa.binary()), ("verified", pa.binary())]))


FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("verified", T.BinaryType())])


def _with_text(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The texts of found documents, with what was found; a row for each row of the input. What was found grows with the
    corpus, so both sides are shuffled by document at every size (sorted by it, so a retried task makes the same slices)."""
    right = found.select(F.col("doc_id").alias("__d"), F.col("hash").alias("__h"), "at", "verified")
    return texts.join(right, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("hash") == F.col("__h"))).select("doc_id", "hash", "at", "verified", "text")


def _search(docs: DataFrame, slice_words: int = SLICE_WORDS, fan: int = FAN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, documents, removed): doc_id, hash, n_words and sha of every document, and the places where removed windows
    start, by doc_id and hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    buckets = Buckets(int(1.2 * stored_bytes(docs) // BUCKET_BYTES), fan)
    grouped = lambda named: buckets.second(named).groupBy("bucket").applyInArrow(_match, FLOW).drop("bucket")
    first = store(grouped(texts.mapInArrow(tidied(_name_all(buckets, slice_words)), FLOW)), "borders")
    shared = store(first.drop("sha").groupBy("slice").applyInArrow(_by_document, FOUND).dropDuplicates(["doc_id", "hash"]), "shared")
    known = store(first.filter("kind = 0").select("doc_id", "hash", "n_words", "sha"), "documents")
    discard(first)
    second = store(grouped(_with_text(texts, shared).mapInArrow(tidied(_name_windows(buckets, slice_words)), FLOW)).drop("sha"), "windows")
    discard(shared)
    removed = store(second.groupBy("slice").applyInArrow(_by_document, FOUND).dropDuplicates(["doc_id", "hash"]).drop("verified"), "removed")
    discard(second)
    return texts, known, removed


def keep_words(text: str, at: bytes) -> tuple[bytes, int, int]:
    """The words that no window starting at these places covers, joined by one space; how many words there are, and are gone."""
    words = text.encode("utf-8", "surrogatepass").split()
    gone, at = np.zeros(len(words) + 1, int), _unpack(at)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + WINDOW, -1)
    gone = np.cumsum(gone)[:-1] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]), len(words), int(gone.sum())


def _joined(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs (doc_id, hash, ...) with __at, the places of its removed windows, or null."""
    right = removed.select(F.col("doc_id").alias("__d"), F.col("hash").alias("__h"), F.col("at").alias("__at"))
    return docs.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("hash") == F.col("__h")), "left").drop("__d", "__h")


def substring_dedup(docs: DataFrame, slice_words: int = SLICE_WORDS, fan: int = FAN) -> DataFrame:
    """doc_id, hash (of the text), n_words, n_removed, kept_sha256, kept (the words kept, joined by one space; null if
    nothing was removed)."""
    texts, known, removed = _search(docs, slice_words, fan)
    schema = T.StructType(
        [*FOUND.fields[:2], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                d, h, blob, body = (c[i].as_py() for c in batch.columns)
                kept, n, gone = keep_words(body, blob)
                rows.append((d, h, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
                held += len(body)
                if held > 4 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows, held = [], 0

    changed = _with_text(texts, removed.withColumn("verified", F.lit(None))).drop("verified").mapInArrow(tidied(cut), schema)
    whole = _joined(known, removed).filter("__at is null")
    whole = whole.select("doc_id", "hash", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    return whole.unionByName(changed)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with the repeated words gone from their texts."""
    _, known, removed = _search(docs)
    discard(known)
    right = removed.select(F.col("doc_id").alias("__d"), F.col("hash").alias("__h"), F.col("at").alias("__at"))
    right = F.broadcast(right) if small(removed) else right
    names = docs.columns
    own = docs.toDF(*[name if name in ("doc_id", "text") else f"__{i}" for i, name in enumerate(names)])  # names may clash with ours
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    joined = own.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (text_hash == F.col("__h")), "left")

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else keep_words(t, a)[0].decode("utf-8", "surrogatepass") for t, a in zip(texts, at, strict=True)])

    # texts that stay as they are aren't sent to Python
    lost = cut(F.when(F.col("__at").isNotNull(), F.col("text")), "__at")
    return joined.withColumn("text", F.when(F.col("__at").isNull(), F.col("text")).otherwise(lost)).select(own.columns).toDF(*names)


def substring_digest(docs: DataFrame) -> DataFrame:
    """op2: words left after removing repeated 13-word windows."""
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
     u AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
     win AS (SELECT doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS gram FROM u WHERE i + {WINDOW - 1} <= len(ws)),
     hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS least FROM win) WHERE least < doc_id),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM hit),
     kept AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
                     list_filter(ws, lambda x, j: NOT list_contains(coalesce(g.at, []::BIGINT[]), j)) AS left_over
              FROM w LEFT JOIN (SELECT doc_id, list(i) AS at FROM gone GROUP BY doc_id) g USING (doc_id))
SELECT doc_id, n_words, n_words - len(left_over)::BIGINT AS n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept
"""
