"""Exact Jaccard join on word n-gram sets with adaptive multi-match prefixes.

Documents with equal sets are one class. In a global order of the n-grams (rare ones first), two sets that reach the threshold
share at least k n-grams within their k-prefixes: the first |x| - ceil(t |x|) + k of each. Every document chooses
its own k by the estimated cost of its candidates: where its prefix holds frequent n-grams, a longer prefix that asks
for more shared n-grams before a pair is verified is cheaper. A pair has to share as many as the smaller k of its two.

Links are wanted as components, so a group of near copies isn't expanded into pairs: (1) in long lists, each document
is verified against one leader; (2) what that leaves in different components in a list is paired exactly: documents
outside the leader's component against the list's others in different components, counting all shared prefix n-grams.
Every linked pair is either verified or in one component already, so no link is lost.

N-grams are named by 64-bit hashes; sets are compared on 48 of the bits, sorted.

Defined results: a text shorter than n words is one n-gram of all its words; a null text or one without words has the
empty set, n_shingles 0, and is its own component; a null doc_id can't lead a component (it is its own if alone); rows that
repeat a doc_id are separate documents and repeated rows link with each other; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, small, store, tidied, tidy
from .graph import connected_components
from .wordnames import M1, documents, grams, word_names

#: Words of an n-gram and threshold in hundredths (the operator's contract).
WORDS, PERCENT = 4, 85
#: Frequent n-grams kept as hints for the order (a bound on the broadcast, not on the lists), and their least counts in a
#: slice and in all.
HINTS, SLICE_COUNT, LEAST_COUNT = 100_000, 4, 12
#: A pair of sets of n is asked to share n / LEAST_PART n-grams of the prefixes at least (3 if the sets are large enough for it),
#: and EXTRA more at most; other documents expected in the list of an n-gram without a hint.
LEAST_PART, EXTRA, BY_CHANCE = 50, 4, 0.3
#: Lists longer than SHORT_LIST are linked through their leader first; what is left of those longer than HOT_LIST is
#: counted in blocks of BLOCK documents; before that, those longer than HOT_LIST get up to STARS leaders, one after another.
SHORT_LIST, HOT_LIST, BLOCK, STARS = 4, 64, 256, 2


def _need(n: int, percent: int) -> int:
    """N-grams that a set of n must share with any partner."""
    return -(-percent * n // 100)


def least_shared(n: int, percent: int) -> int:
    """The least k that a set of n chooses; grows with n."""
    return max(1, min(max(3, n // LEAST_PART), _need(n, percent) // 4))


def shingle_sets(raw: np.ndarray, edges: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram names of each text."""
    names, base = word_names(raw, edges, fold_case=True)
    whole, base = grams(names, n, M1), base.tolist()
    out = []
    for a, b in zip(base, base[1:], strict=False):
        if b - a >= n:
            s = np.sort(whole[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        else:
            out.append(grams(names[a:b], b - a, np.uint64(int(M1) + 2 * (b - a))) if b > a else names[:0])
    return out


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


READ = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("hash", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("sign", T.BinaryType()),
        T.StructField("gram", T.LongType()),
        T.StructField("count", T.LongType()),
    ]
)


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple]:
    for batch in batches:
        for found in documents(batch, text):
            yield (batch, *found)


def _read(n: int):
    """Pass 1: size and signature of each set, and n-grams that come often in a slice (row is null there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(READ)
        for batch, a, b, raw, edges in _slices(batches, 3):
            sets = shingle_sets(raw, edges, n)
            sign = [len(s).to_bytes(4, "little") + _fingerprint(s) for s in sets]
            none = pa.nulls(b - a, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sign, pa.binary()), none, none], schema=schema)
            everything = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            gram, count = np.unique(everything, return_counts=True)
            gram, count = gram[count >= SLICE_COUNT], count[count >= SLICE_COUNT]
            if len(gram):
                none = pa.nulls(len(gram), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(gram), pa.binary()), pa.array(gram.view(np.int64)), pa.array(count)], schema=schema)

    return run


def _fingerprint(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefix(s: np.ndarray, hints: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """The n-grams of a set's chosen prefix, rare ones first, the number k that it stands for, and how much of the set
    is frequent, in thousandths (the least edited of many near copies makes the best leader)."""
    n, need, core = len(s), _need(len(s), percent), 0
    first, low = n - need, least_shared(n, percent)
    most = min(low + EXTRA, need)
    others = np.full(n, BY_CHANCE)
    if len(hints):
        at = np.minimum(np.searchsorted(hints, s), len(hints) - 1)
        known = hints[at] == s
        others[known] = counts[at[known]] - 1
        core = int(1000 * known.mean())
        order = np.lexsort((s, others))[: first + most]
    else:
        order = np.arange(min(first + most, n))
    # lists read, and pairs verified: those that share k n-grams by chance fall quickly with k
    k = np.arange(low, most + 1)
    total = np.cumsum(others[order])[first + k - 1]
    k = int(k[np.argmin(total * (1 + 8 / k**2))])
    return s[order[: first + k]], k, core


def _prefixes(n: int, percent: int, hints):
    """Pass 2: the prefixes of all documents that have n-grams."""
    long = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([long("doc_id"), long("hash"), long("n"), T.StructField("k", T.IntegerType()), T.StructField("core", T.IntegerType()), T.StructField("grams", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, counts = hints.value
        out = _arrow(schema)
        for batch, a, b, raw, edges in _slices(batches, 2):
            sets = shingle_sets(raw, edges, n)
            kept = [i for i, s in enumerate(sets) if len(s)]
            made = [prefix(sets[i], often, counts, percent) for i in kept]
            flat = np.concatenate([m[0] for m in made]).view(np.int64) if made else np.zeros(0, np.int64)
            ends = np.r_[0, np.cumsum([len(m[0]) for m in made])].astype(np.int32)
            at = pa.array([a + i for i in kept], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    pa.array([len(sets[i]) for i in kept], pa.int64()),
                    pa.array([m[1] for m in made], pa.int32()),
                    pa.array([m[2] for m in made], pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(flat)).cast(out.field(5).type),
                ],
                schema=out,
            )

    return run, schema


def _sets(n: int):
    """Pass over the documents to verify: their sets, six bytes an n-gram."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("grams", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b, raw, edges in _slices(batches, 1):
            sets = [s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for s in shingle_sets(raw, edges, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], schema=_arrow(schema))

    return run, schema


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _verify(percent: int):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            a, b, ga, gb = batch.columns
            keep = []
            for i in range(batch.num_rows):
                raw = ga[i].as_py()
                if raw is not last and raw != last:
                    last, x = raw, _unpack(raw)
                y = _unpack(gb[i].as_py())
                both = len(x) + len(y)
                union = len(np.union1d(x, y)) if both else 0
                keep.append(100 * (both - union) >= percent * union and both > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], schema=_arrow(schema))

    return run, schema


class _Join:
    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.n, self.percent, self.spark = n, percent, docs.sparkSession
        text = F.coalesce(F.col("text"), F.lit(""))
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
        self.read = store(self.texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "hash", "text").mapInArrow(tidied(_read(n)), READ), "read")
        self.rows = self.read.filter("row is not null").select("row", "doc_id", "hash", "n", "sign")

    def classes(self) -> DataFrame:
        """One row per different set: (row, doc_id, hash) of a representative, and its signature."""
        full = self.rows.filter("n > 0").groupBy("sign").agg(F.min(F.struct("row", "doc_id", "hash", "n")).alias("r"))
        return store(full.select("sign", "r.row", "r.doc_id", "r.hash", "r.n"), "classes")

    def of_classes(self, rows: DataFrame, classes: DataFrame) -> DataFrame:
        """Rows of the classes' representatives among rows with doc_id and hash; as many as the corpus has, so both sides are
        shuffled at every size."""
        right = classes.select("row", F.col("doc_id").alias("__d"), F.col("hash").alias("__h"))
        return rows.join(right, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("hash") == F.col("__h"))).drop("__d", "__h", "doc_id", "hash")

    def text_of(self, chosen: DataFrame) -> DataFrame:
        """row, text of chosen classes (a stored table); equal rows of the input are read once."""
        right = chosen.select("row", F.col("doc_id").alias("__d"), F.col("hash").alias("__h"))
        right = F.broadcast(right) if small(chosen) else right
        found = self.texts.join(right, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("hash") == F.col("__h")))
        return found.select("row", "text")

    def hints(self):
        """The most frequent n-grams, sorted, with their counts: at most HINTS."""
        often = self.read.filter("row is null").groupBy("gram").agg(F.sum("count").alias("count")).filter(F.col("count") >= LEAST_COUNT)
        got = often.orderBy(F.desc("count"), "gram").limit(HINTS).toPandas()
        gram, count = got["gram"].to_numpy(np.int64).view(np.uint64), got["count"].to_numpy(np.int64)
        order = np.argsort(gram)
        return self.spark.sparkContext.broadcast((gram[order], count[order]))

    def verified(self, pairs: DataFrame, classes: DataFrame, label: str) -> DataFrame:
        """Linked pairs among (a, b); the classes named in them are read again for their sets."""
        pairs = store(pairs, f"{label}-pairs")
        wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
        chosen = store(classes.join(wanted, "row", "left_semi").select("row", "doc_id", "hash"), f"{label}-chosen")
        run, schema = _sets(self.n)
        sets = store(self.text_of(chosen).mapInArrow(tidied(run), schema), f"{label}-sets")  # a row repeated whole comes twice, harmlessly
        both = pairs.join(sets.select(F.col("row").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("row").alias("b"), F.col("grams").alias("gb")), "b")
        run, schema = _verify(self.percent)
        links = store(both.select("a", "b", "ga", "gb").mapInArrow(tidied(run), schema), f"{label}-links")
        discard(pairs, chosen, sets)
        return links


def _fits(a: str, b: str, percent: int):
    """Sizes that can reach the threshold at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _blocks():
    """Documents of one block gathered: their rows, components, sizes, numbers k and prefixes."""
    schema = T.StructType([T.StructField("block", T.StringType()), T.StructField("leader", T.LongType()), T.StructField("band", T.LongType()), T.StructField("sub", T.LongType()), T.StructField("packed", T.BinaryType())])

    def gather(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        grams = group["grams"].combine_chunks()
        sizes = np.diff(grams.offsets.to_numpy())
        packed = pickle.dumps([*(group[c].to_numpy() for c in ("row", "component", "n", "k")), sizes, grams.flatten().to_numpy()])
        leader, band, sub = (k.as_py() for k in key)
        tidy()
        return pa.table([pa.array([f"{leader}/{band}/{sub}"]), pa.array([leader]), pa.array([band]), pa.array([sub]), pa.array([packed], pa.binary())], schema=_arrow(schema))

    return gather, schema


def _shared(m1: np.ndarray, g1: np.ndarray, m2: np.ndarray, g2: np.ndarray) -> np.ndarray:
    """How many n-grams each document of one block shares with each of another (lengths and n-grams, one document after another)."""
    own1, own2 = np.repeat(np.arange(len(m1)), m1), np.repeat(np.arange(len(m2)), m2)
    both = np.intersect1d(g1, g2)
    at1, at2 = np.searchsorted(both, g1), np.searchsorted(both, g2)
    in1, in2 = at1 < len(both), at2 < len(both)
    in1[in1], in2[in2] = both[at1[in1]] == g1[in1], both[at2[in2]] == g2[in2]
    own1, at1, own2, at2 = own1[in1], at1[in1], own2[in2], at2[in2]
    o1, o2 = np.argsort(at1, kind="stable"), np.argsort(at2, kind="stable")
    own1, at1, own2, at2 = own1[o1], at1[o1], own2[o2], at2[o2]
    met = np.zeros((len(m1), len(m2)), np.float32)
    for begin in range(0, len(both), 4096):
        a, b = np.searchsorted(at1, [begin, begin + 4096])
        x = np.zeros((len(m1), 4096), np.float32)
        x[own1[a:b], at1[a:b] - begin] = 1
        a, b = np.searchsorted(at2, [begin, begin + 4096])
        y = np.zeros((len(m2), 4096), np.float32)
        y[own2[a:b], at2[a:b] - begin] = 1
        met += x @ y.T
    return met


def block_candidates(one: list, two: list, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs between two blocks (rows, components, sizes, k, prefix lengths, prefixes) in different components that share as
    many n-grams of their prefixes as the smaller k of the two, and whose sizes can reach the threshold."""
    (r1, c1, n1, k1, m1, g1), (r2, c2, n2, k2, m2, g2) = one, two
    met = _shared(m1, g1, m2, g2)
    least, most = np.minimum(n1[:, None], n2[None]), np.maximum(n1[:, None], n2[None])
    hit = (met >= np.minimum(k1[:, None], k2[None])) & (100 * least >= percent * most) & (c1[:, None] != c2[None])
    i, j = np.nonzero(hit)
    return np.minimum(r1[i], r2[j]), np.maximum(r1[i], r2[j])


def block_links(one: tuple, two: tuple, percent: int) -> list[tuple[int, int]]:
    """Enough linked pairs between two blocks (rows, components, sizes, sets) to connect all that are linked and lie in
    different components."""
    (r1, c1, n1, g1), (r2, c2, n2, g2) = one, two
    met = np.rint(_shared(n1, g1, n2, g2)).astype(np.int64)
    hit = (100 * met >= percent * (n1[:, None] + n2[None] - met)) & (c1[:, None] != c2[None]) & (met > 0)
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
        a, b = find(int(c1[i])), find(int(c2[j]))
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((int(r1[i]), int(r2[j])))
    return out


def _block_pairs(pairs: DataFrame, blocks: DataFrame, schema: T.StructType, rows) -> DataFrame:
    """rows(left block, right block) -> columns, for stored pairs (a, b) of stored blocks."""
    both = pairs.join(blocks.select(F.col("block").alias("a"), F.col("packed").alias("pa")), "a").join(blocks.select(F.col("block").alias("b"), F.col("packed").alias("pb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, one, two in zip(*(c for c in batch.columns), strict=True):
                made = rows(a.as_py(), b.as_py(), pickle.loads(one.as_py()), pickle.loads(two.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, _arrow(schema), strict=True)], schema=_arrow(schema))

    width = max(1, pairs.sparkSession.sparkContext.defaultParallelism * 4)
    return both.select("a", "b", "pa", "pb").repartition(width, "a", "b").mapInArrow(tidied(compare), schema)


def _hot_pairs(join: _Join, hot: DataFrame, members: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(candidate pairs, links) among documents that share a long list and lie in different components. Documents with the
    same leader are dealt to blocks by size band (linked sizes lie in the same band or in neighbouring ones) and hash, and
    the n-grams that their prefixes share are counted for pairs of blocks. Where that gives few candidates, they are verified
    like others; two blocks with more candidates than documents (a group of copies that differ more than
    the threshold allows) are verified as a whole, which gives no more links than documents."""
    percent = join.percent
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent)))).cast("long")
    banded = hot.withColumn("band", band)
    sizes = banded.groupBy("leader", "band").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    dealt = banded.join(sizes, ["leader", "band"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("blocks")
    # a document's n-grams in lists with several components: a part of its prefix
    prefixes = members.groupBy("row").agg(F.collect_set("gram").alias("grams"), F.max("many").alias("longest")).filter(F.col("longest") > HOT_LIST).drop("longest")
    gather, schema = _blocks()
    full = dealt.join(prefixes, "row").select("leader", "band", "sub", "row", "component", "n", "k", "grams")
    blocks = store(full.groupBy("leader", "band", "sub").applyInArrow(gather, schema), "hot-blocks")
    ids = blocks.select("block", "leader", "band", "sub")
    left = ids.select(F.col("block").alias("a"), "leader", F.col("sub").alias("sa"), F.col("band").alias("ba"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).withColumn("band", F.col("ba") + F.col("up"))
    pairs = left.join(ids.select(F.col("block").alias("b"), "leader", "band", F.col("sub").alias("sb")), ["leader", "band"]).filter((F.col("up") == 1) | (F.col("sa") <= F.col("sb"))).select("a", "b")
    pairs = store(pairs, "hot-pairs")
    long, text = (lambda name: T.StructField(name, T.LongType())), (lambda name: T.StructField(name, T.StringType()))

    def candidates(a: str, b: str, one: list, two: list) -> list:
        x, y = block_candidates(one, two, percent)
        if len(x) > len(one[0]) + len(two[0]):
            return [[None], [None], [a], [b]]
        return [x, y, [None] * len(x), [None] * len(x)]

    found = store(_block_pairs(pairs, blocks, T.StructType([long("a"), long("b"), text("left"), text("right")]), candidates).distinct(), "hot-candidates")
    discard(blocks, pairs)
    dense = found.filter("left is not null").select(F.col("left").alias("a"), F.col("right").alias("b"))
    if not dense.limit(1).count():
        return found.select("a", "b"), None
    wanted = dense.select(F.col("a").alias("block")).union(dense.select("b")).distinct()
    inside = store(dealt.withColumn("block", F.concat_ws("/", "leader", "band", "sub")).join(wanted, "block", "left_semi").select("block", "row", "component"), "dense")
    chosen = store(classes.join(inside.select("row").distinct(), "row", "left_semi").select("row", "doc_id", "hash"), "dense-chosen")
    run, schema = _sets(join.n)
    sets = store(join.text_of(chosen).mapInArrow(tidied(run), schema).dropDuplicates(["row"]), "dense-sets")
    whole = T.StructType([text("block"), T.StructField("packed", T.BinaryType())])

    def gather_sets(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        each = [_unpack(g) for g in group["grams"].to_pylist()]
        packed = pickle.dumps((group["row"].to_numpy(), group["component"].to_numpy(), np.array([len(x) for x in each]), np.concatenate(each)))
        tidy()
        return pa.table([pa.array([key[0].as_py()]), pa.array([packed], pa.binary())], schema=_arrow(whole))

    filled = store(inside.join(sets, "row").select("block", "row", "component", "grams").groupBy("block").applyInArrow(gather_sets, whole), "dense-blocks")
    verified = lambda a, b, one, two: list(zip(*block_links(one, two, percent), strict=True)) or [[], []]
    links = store(_block_pairs(dense, filled, T.StructType([long("a"), long("b")]), verified), "dense-links")
    discard(inside, chosen, sets, filled)
    pairs = store(found.filter("a is not null").select("a", "b"), "hot-candidates")
    discard(found)
    return pairs, links


def _star(join: _Join, lists: DataFrame, leaders: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links of documents with the leaders of their lists."""
    met = lists.groupBy("leader", "row").agg(F.count("*").alias("met"), F.first("n").alias("n"), F.first("k").alias("k")).filter("met >= k")
    met = met.join(leaders, "leader").filter(_fits("n", "leader_n", join.percent))
    return join.verified(met.select(F.col("leader").alias("a"), F.col("row").alias("b")), classes, "star")


def ngram_join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, hash (of the text), n_shingles, component_id and root (the component's own number, null for documents without
    n-grams) of every document."""
    join = _Join(docs, n, percent)
    classes = join.classes()
    run, schema = _prefixes(n, percent, hints := join.hints())
    prefixes = store(join.of_classes(join.texts.mapInArrow(tidied(run), schema), classes), "prefixes")
    hints.destroy()
    lists = prefixes.select("row", F.explode("grams").alias("gram"))
    # a class whose representative's row is repeated whole in the input has its list twice; that adds no partner
    heads = store(lists.groupBy("gram").agg(F.count("*").alias("many")).filter("many > 1").select("gram"), "heads")
    listed = store(lists.join(heads, "gram"), "listed")  # as many rows as prefixes have: shuffled at every size
    # a document that shares fewer n-grams with any others than it has to share with one has no partner; a partner's k is
    # at least that of the smallest set that could be one
    least = F.ceil(F.col("n") * percent / F.lit(100))
    fewest = F.greatest(F.lit(1), F.least(F.greatest(F.lit(3), F.floor(least / LEAST_PART)), F.floor(F.ceil(least * percent / F.lit(100)) / 4)))
    facts = prefixes.select("row", "n", "k", "core").dropDuplicates(["row"])
    open_rows = listed.groupBy("row").agg(F.count("*").alias("met")).join(facts, "row").filter(F.col("met") >= fewest)
    open_rows = store(open_rows.drop("met"), "open-rows")
    opened = store(listed.join(F.broadcast(open_rows) if small(open_rows) else open_rows, "row"), "open")
    discard(prefixes, heads, listed, open_rows)
    lead = opened.groupBy("gram").agg(F.max(F.struct("core", (-F.col("row")).alias("m"))).alias("best"), F.count("*").alias("many")).filter("many > 1")
    lead = store(lead.select("gram", (-F.col("best.m")).alias("leader"), "many"), "leads")
    shared = store(opened.join(lead, "gram"), "shared")
    discard(opened, lead)
    # (1) long lists: each document against the leader, counted over the lists they share
    leaders = classes.select(F.col("row").alias("leader"), F.col("n").alias("leader_n"))
    leaders = F.broadcast(leaders) if small(classes) else leaders
    found = [_star(join, shared.filter((F.col("many") > SHORT_LIST) & (F.col("row") != F.col("leader"))), leaders, classes)]
    led = [store(shared.filter(F.col("many") > HOT_LIST).select("gram", "leader").distinct(), "led")]
    for number in range(STARS):
        component = connected_components(reduce(DataFrame.union, found))
        named = component.withColumnRenamed("node", "row")
        labelled = store(shared.join(named, "row", "left").withColumn("component", F.coalesce("component", "row")), "labelled")
        main = F.max(F.when(F.col("row") == F.col("leader"), F.col("component")))
        mixed = labelled.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), main.alias("main")).filter("low < high")
        mixed = store(mixed.select("gram", "main"), "mixed")
        members = labelled.join(F.broadcast(mixed) if small(mixed) else mixed, "gram").withColumn("outside", F.col("component") != F.col("main"))
        members = store(members.select("gram", "row", "n", "k", "core", "component", "outside", "leader", "many"), "members")
        discard(labelled, mixed)
        if number + 1 == STARS:
            discard(component)
            break
        # the longest lists get another leader, from a component that none of their leaders is in
        tried = reduce(DataFrame.union, led).join(component.select(F.col("node").alias("leader"), "component"), "leader", "left")
        tried = tried.select("gram", F.coalesce("component", "leader").alias("component")).distinct()
        long_lists = members.filter(F.col("many") > HOT_LIST).drop("leader")
        best = F.max(F.struct("core", (-F.col("row")).alias("m"), "component")).alias("best")
        more = long_lists.filter("outside").join(tried, ["gram", "component"], "left_anti").groupBy("gram").agg(best)
        more = store(more.select("gram", (-F.col("best.m")).alias("leader"), F.col("best.component").alias("own")), "led")
        found.append(_star(join, long_lists.join(more, "gram").filter("component <> own"), leaders, classes))
        led.append(more.select("gram", "leader"))
        led[-1].stored_at = more.stored_at
        discard(component)
        if not found[-1].limit(1).count():  # these members are the last ones: no new link changes a component
            break
        discard(members)
    discard(shared, *led)
    # (2) short lists: pairs in different components, counted over all the lists they share
    cold = members.filter(F.col("many") <= HOT_LIST)
    one = cold.filter("outside").select("gram", F.col("row").alias("r1"), F.col("n").alias("n1"), F.col("k").alias("k1"), F.col("component").alias("c1"))
    two = cold.select("gram", F.col("row").alias("r2"), F.col("n").alias("n2"), F.col("k").alias("k2"), F.col("component").alias("c2"), F.col("outside").alias("o2"))
    once = ~F.col("o2") | (F.col("r1") < F.col("r2"))
    met = one.join(two, "gram").filter((F.col("c1") != F.col("c2")) & once & _fits("n1", "n2", percent))
    counted = met.groupBy(F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b")).agg(F.count("*").alias("met"), F.min(F.least("k1", "k2")).alias("need"))
    candidates = counted.filter("met >= need").select("a", "b")
    # and pairs that share a long list, counted block by block
    hot = store(members.filter(F.col("many") > HOT_LIST).select("leader", "row", "n", "k", "component").distinct(), "hot")
    if hot.limit(1).count():
        blockwise, links = _hot_pairs(join, hot, members, classes)
        candidates = candidates.union(blockwise).distinct()
        found += [] if links is None else [links]
    found.append(join.verified(candidates, classes, "rest"))
    discard(members, hot)
    # (3) the components of all links
    final = connected_components(reduce(DataFrame.union, found))
    by_class = classes.select("sign", "row").join(final.withColumnRenamed("node", "row"), "row", "left").select("sign", F.coalesce("component", "row").alias("root"))
    by_class = store(by_class, "by-class")
    discard(*found, classes, final)
    known = join.rows.join(F.broadcast(by_class) if small(by_class) else by_class, "sign", "left")
    least = store(known.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    out = known.join(F.broadcast(least) if small(least) else least, "root", "left")
    return out.select("doc_id", "hash", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "root")


def ngram_digest(docs: DataFrame) -> DataFrame:
    """op10: 4-word shingles, 85 hundredths."""
    return ngram_join(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = f"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i : i + {WORDS - 1}], ' ')) END) AS grams FROM w),
s AS (SELECT doc_id, len(grams)::BIGINT AS n, unnest(grams) AS gram FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS met FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * met >= {PERCENT} * (na + nb - met)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM g UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT g.doc_id, len(g.grams)::BIGINT AS n_shingles, m.component_id FROM g JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) m ON m.node = g.doc_id
"""
