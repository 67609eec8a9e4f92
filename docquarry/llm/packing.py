"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens (its documents one after another, each ended by id 0). In each round a window of
`window` tokens is dealt: queue s earns window * N_s / T tokens on its deficit counter, sends the whole tokens of
it, and carries the fraction on. After w rounds queue s has therefore sent floor(w * window * N_s / T) tokens, which
any task can compute for any round: the deficits carry over windows and partitions without a sequential pass. With
target weights, queue s earns its weight's share of the window instead, and when a queue runs dry the others share what
it would have earned by their weights; between two such moments the closed form is the same. A window holds its queues' stretches one after another; windows follow each other without gaps and are cut into
sequences of `length` tokens. The last, shorter sequence is cut at powers of two, so no padding is left at all.

Up to `max_queues` sources, every task derives the windows' layout from the list of the queues' totals; with more, the
layout is a stored table of the stretches dealt, which gives the same rows.

Defined results: a null text is empty (one token, id 0); a null source shares the queue of the empty one; repeated rows
are packed once each; a null doc_id is carried along; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
from bisect import bisect_right
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate
from math import ceil, lcm

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import small, store, tidied

SEPARATOR = 0
#: Most queues whose totals are sent to every task.
MAX_QUEUES = 4096
#: Windows whose places are summed up together where the layout is a table.
SPAN = 4096


@lru_cache(2)
def _encoding(path: str, json_path: str):
    """The rank file's encoding, with the special tokens of the JSON file of the same vocabulary."""
    import tiktoken

    special = {t["content"]: t["id"] for t in json.load(open(json_path, encoding="utf-8"))["added_tokens"]}

    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), list(special)


def byte_bpe_ids(texts: list[str]) -> list[np.ndarray]:
    """The ids that tokenizers gives for byte_bpe_50k.json with add_special_tokens=False. The rank file is the same
    vocabulary, and its library gives the same ids in a quarter of the time (tests compare the two)."""
    enc, special = _encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array(enc.encode(t, allowed_special="all") if any(x in t for x in special) else enc.encode_ordinary(t), "<u4") for t in texts]


def token_queues(documents: DataFrame, ids: Callable[[list[str]], list[np.ndarray]]) -> DataFrame:
    """Stored table of the documents' ids with their place among the tokens of the same queue in the same part:
    part, queue, doc_id, n, at (tokens of the queue before it in the part), ids (packed little-endian uint32)."""
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("queue", T.StringType()),
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("at", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sent = TaskContext.get().partitionId(), {}
        for batch in batches:
            doc_ids, queues, texts = (batch.column(i) for i in range(3))
            queues, texts = queues.to_pylist(), texts.to_pylist()
            for a, b in slices(texts):
                made, at = [np.append(x, SEPARATOR).astype("<u4") for x in ids(texts[a:b])], []
                for q, x in zip(queues[a:b], made, strict=True):
                    at.append(sent.get(q, 0))
                    sent[q] = at[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * (b - a), pa.int32()), pa.array(queues[a:b], pa.string()), doc_ids.slice(a, b - a), pa.array([len(x) for x in made], pa.int64()), pa.array(at, pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())],
                    schema=out,
                )

    source = F.coalesce(F.col("source"), F.lit("")) if "source" in documents.columns else F.lit("")
    return store(documents.select("doc_id", source.alias("queue"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(tidied(run), schema), "queues")


def dealt(k: int, end: int, total: int, everything: int, window: int) -> Iterator[tuple[int, int, int]]:
    """(window, first token, length) of the stretches of the tokens k to end of a queue of total tokens."""
    while k < end:
        need = -(-(k + 1) * everything // total)  # tokens that must have been earned for token k to be sent
        w = -(-need // window) - 1
        stop = min(end, min((w + 1) * window, everything) * total // everything)
        yield w, k, stop - k
        k = stop


class Rounds:
    """The deficit round-robin's state after any number of rounds. Weights are positive integers (default: the totals)."""

    def __init__(self, totals: list[int], window: int, weights: list[int] | None = None):
        self.totals, self.all, self.window = totals, sum(totals), window
        self.weights = weights = weights or totals
        # phases between the moments when queues run dry: tokens earned a unit of weight and place in the stream at the
        # beginning, tokens of the queues that are dry, weight of the others
        dry, rest, phases = 0, sum(weights), {Fraction(0): (0, 0, sum(weights))}
        for earned, s in sorted((Fraction(n, weights[s]), s) for s, n in enumerate(totals)):
            begin = dry + rest * earned
            dry, rest = dry + totals[s], rest - weights[s]
            phases[earned] = (ceil(begin), dry, rest)
        self.earned, self.phases = list(phases), list(phases.values())
        self.begins = [begin for begin, _, _ in self.phases]
        self.round = lru_cache(64)(self.round)

    def sent(self, s: int, w: int) -> int:
        """Tokens of queue s in the first w windows."""
        at = w * self.window
        if at >= self.all:
            return self.totals[s]
        _, dry, rest = self.phases[bisect_right(self.begins, at) - 1]
        return min(self.totals[s], self.weights[s] * (at - dry) // rest)

    def round(self, w: int) -> list[int]:
        """Where the queues' stretches of window w begin in the whole stream."""
        before = [self.sent(s, w) for s in range(len(self.totals))]
        sizes = [self.sent(s, w + 1) - x for s, x in enumerate(before)]
        return list(accumulate(sizes[:-1], initial=sum(before)))

    def stretches(self, s: int, k: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(window, first token of the queue, its place in the stream, length) of the tokens k to end of queue s."""
        while k < end:
            _, dry, rest = self.phases[bisect_right(self.earned, Fraction(k + 1, self.weights[s])) - 1]
            need = dry - (-rest * (k + 1) // self.weights[s])  # place in the stream from which token k has been earned
            w = -(-need // self.window) - 1
            stop = min(end, self.sent(s, w + 1))
            yield w, k, self.round(w)[s] + k - self.sent(s, w), stop - k
            k = stop


def _weights(queues: list[str], targets: dict[str, float]) -> list[int]:
    """The queues' targets as whole numbers in the same proportions."""
    if wrong := [q for q in queues if not targets.get(q, 0) > 0]:
        raise ValueError(f"sources without a positive target: {wrong[:10]}")
    shares = [Fraction(targets[q]) for q in queues]
    whole = lcm(*(x.denominator for x in shares))
    return [int(x * whole) for x in shares]


def tail_blocks(rest: int) -> list[int]:
    """Powers of two that add up to rest, largest first."""
    return [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def cut(place: int, size: int, length: int, total: int) -> Iterator[tuple[int, int, int, int]]:
    """(sequence, offset there, offset in the piece, size) for a piece at a place of the stream."""
    full = total // length
    edges = [full * length, *accumulate(tail_blocks(total - full * length), initial=full * length)][1:]
    done = 0
    while done < size:
        p = place + done
        if p < full * length:
            seq, begin, end = p // length, p // length * length, (p // length + 1) * length
        else:
            i = next(i for i in range(len(edges) - 1) if p < edges[i + 1])
            seq, begin, end = full + i, edges[i], edges[i + 1]
        take = min(size - done, end - p)
        yield seq, p - begin, done, take
        done += take


def _through(df: DataFrame, schema: T.StructType, rows: Callable[..., Iterator[tuple]], most: int = 16 << 20) -> DataFrame:
    """mapInArrow over rows whose last column is binary: rows(*row) -> the rows made of it; batches hold `most` bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = lambda made: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)
        for batch in batches:
            made, held = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in rows(*row):
                    made.append(r)
                    held += 64 + len(r[-1] or b"")
                    if held > most:
                        yield emit(made)
                        made, held = [], 0
            if made:
                yield emit(made)

    return df.mapInArrow(tidied(run), schema)


def _by_table(docs: DataFrame, totals: DataFrame, everything: int, window: int, length: int, schema: T.StructType) -> DataFrame:
    """pack() for any number of queues. docs: doc_id, queue, k, total, n, ids; totals: queue, n."""
    long = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    queue, raw = T.StructField("queue", T.StringType()), T.StructField("ids", T.BinaryType())
    sizes = T.StructType([queue, *long("window", "first", "size"), T.StructField("none", T.BinaryType())])
    sent = _through(totals.select("queue", "n", F.lit(None).cast("binary")), sizes, lambda q, n, _: ((q, w, first, size, None) for w, first, size in dealt(0, n, n, everything, window)))
    sent = store(sent.drop("none"), "sent")
    # where a window begins in the stream: spans of windows first, then windows within their span
    span = F.floor(F.col("window") / SPAN)
    sums = store(sent.groupBy("window").agg(F.sum("size").alias("size")).withColumn("span", span), "windows")
    before = lambda part, by: F.coalesce(F.sum("size").over(part.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sums.groupBy("span").agg(F.sum("size").alias("size")).select("span", before(Window.partitionBy(), "span").alias("base"))
    begins = sums.withColumn("within", before(Window.partitionBy("span"), "window")).join(spans, "span").select("window", (F.col("base") + F.col("within")).alias("begin"))
    # where a queue's stretch begins: after those of smaller names in the window
    starts = sent.withColumn("within", before(Window.partitionBy("window"), "queue")).join(begins, "window").select("queue", "window", "first", (F.col("begin") + F.col("within")).alias("place"))
    cuts = T.StructType([schema["doc_id"], queue, *long("doc_tokens", "window", "start", "token"), raw])

    def stretches(doc, q, k, total, n, raw):
        for w, first, size in dealt(k, k + n, total, everything, window):
            yield doc, q, n, w, first - k, first, raw[4 * (first - k) : 4 * (first - k + size)]

    pieces = _through(docs, cuts, stretches).join(store(starts, "starts"), ["queue", "window"])
    pieces = pieces.select("doc_id", "queue", "doc_tokens", "window", "start", (F.col("place") + F.col("token") - F.col("first")).alias("place"), "ids")

    def pieces_of(doc, q, n, w, start, place, raw):
        for seq, offset, done, take in cut(place, len(raw) // 4, length, everything):
            yield doc, start + done, take, n, seq, offset, q, w, raw[4 * done : 4 * (done + take)]

    return _through(pieces, schema, pieces_of)


def pack(documents: DataFrame, ids: Callable[[list[str]], list[np.ndarray]] = byte_bpe_ids, length: int = 1024, window_sequences: int = 64, max_queues: int = MAX_QUEUES, targets: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, queue, window, ids (packed uint32).
    targets: a positive weight for every source (default: its tokens, the corpus shares)."""
    docs = token_queues(documents, ids)
    by_part = docs.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("n").over(Window.partitionBy("queue"))
    bases = store(by_part.select("queue", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), whole.alias("total")), "bases")
    bases_small = F.broadcast(bases) if small(bases) else bases
    placed = docs.join(bases_small, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("at")).alias("k"), "total", "n", "ids")
    by_queue = bases.select("queue", F.col("total").alias("n")).distinct()
    totals = sorted((r["queue"], int(r["n"])) for r in by_queue.limit(max(max_queues, len(targets or ())) + 1).collect())
    number = {q: i for i, (q, _) in enumerate(totals)}
    sizes = [n for _, n in totals]
    schema = T.StructType(
        [T.StructField("doc_id", documents.schema["doc_id"].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("queue", T.StringType()), T.StructField("window", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    weights = _weights([q for q, _ in totals], targets) if targets is not None else None
    if weights is None and len(totals) > max_queues:
        everything = int(by_queue.agg(F.sum("n")).first()[0])
        return _by_table(placed, by_queue, everything, window_sequences * length, length, schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = Rounds(sizes, window_sequences * length, weights)
        for batch in batches:
            rows, held = [], 0
            for doc, q, k, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for w, first, place, size in rounds.stretches(number[q], k, k + n):
                    for seq, offset, done, take in cut(place, size, length, rounds.all):
                        start = first - k + done
                        rows.append((doc, start, take, n, seq, offset, q, w, raw[4 * start : 4 * (start + take)]))
                held += len(raw)
                if held > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return placed.drop("total").mapInArrow(tidied(run), schema)


def pack_digest(documents: DataFrame) -> DataFrame:
    """op1: pieces with the CRC-32 of their ids."""
    pieces = pack(documents)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.col("queue").alias("source"), "window")
