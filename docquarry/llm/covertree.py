"""Exact near-duplicate vectors by dual traversal of cover trees.

Equal vectors are one point with a multiplicity. Points are dealt to blocks of nearby points: to the nearest of a bounded
set of pivots, and where a cell grows too large, to the nearest of pivots of its own. A block's cover tree has nested levels whose radii halve down to
half the threshold distance; each node knows its true covering radius. Two blocks (found by their balls, in chunks), and then pairs of nodes level by
level, are dropped when the distance of their centres less both radii exceeds the threshold distance, and taken
as linked throughout when it stays within it with both radii added; only what is left at the bottom is compared point
by point, in double precision. So a dense group costs its centres, not all its pairs, and no link is missed.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and are
their own component; vectors of different lengths don't link; scaled copies have cosine 1 and link; a null
vec_id is kept and can't lead a component; rows that repeat a vec_id count once each as partners.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, small, store, tidied, tidy
from .graph import connected_components

#: Cosine threshold; least points and most bytes of a block (in between an eighth of all points: larger blocks are sent
#: fewer times); pivots at first and in a cell that is too large, and bytes of those (bounded samples that only decide which
#: block); balls of blocks compared at once.
COSINE, BLOCK, BLOCK_BYTES, PIVOTS, MORE_PIVOTS, PIVOT_BYTES, BALLS = 0.9, 1500, 8 << 20, 512, 64, 16 << 20, 4096
#: Node pairs looked at at once, and from how many on two nodes' children are compared as a table.
PAIRS, TABLE = 1 << 20, 1 << 12
#: Bounds are widened by this, so rounding can't drop or take a pair that the exact cosine would decide otherwise.
SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (first by their largest component: squares neither overflow nor vanish)."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def chord(cosine: np.ndarray | float) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * np.asarray(cosine), 0))


class CoverTree:
    """Levels from the root down: centres (indices into points), true radii, children's ranges. Points are reordered
    so that the members of every node stand together."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, counts: np.ndarray, cosine: float = COSINE):
        bottom = float(chord(cosine)) / 2
        radii = [bottom]
        while radii[-1] < 1:
            radii.append(radii[-1] * 2)
        # node of each point at each level, from the top; a node's centre is its first point not yet covered
        order = np.zeros((len(points), len(radii)), int)
        group = np.zeros(len(points), int)
        self.centres: list[np.ndarray] = []
        for level, radius in enumerate(reversed(radii)):
            centres, label = self._net(points, group, radius)
            order[:, level], group = label, label
            self.centres.append(centres)
        rank = np.lexsort(order.T[::-1])
        back = np.empty(len(points), int)
        back[rank] = np.arange(len(points))
        self.points, self.ids, self.counts = points[rank], ids[rank], counts[rank]
        self.begins, self.radii = [], []
        for level in range(len(radii)):
            label = order[rank, level]
            begin = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            centres = back[self.centres[level][label[begin]]]
            far = chord(np.einsum("ij,ij->i", self.points, self.points[np.repeat(centres, np.diff(np.r_[begin, len(label)]))]))
            self.centres[level], self.radii = centres, [*self.radii, np.maximum.reduceat(far, begin)]
            self.begins.append(np.r_[begin, len(label)])

    @staticmethod
    def _net(points: np.ndarray, group: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Centres such that every point is within radius of one of its own group, and the points' labels."""
        least = 1 - radius * radius / 2
        label = np.full(len(points), -1)
        centres: list[int] = []
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1], True])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            left = order[a:b]
            while len(left):
                c = left[0]
                near = points[left] @ points[c] >= least if len(left) > 1 else np.ones(1, bool)
                near[0] = True
                label[left[near]] = len(centres)
                centres.append(c)
                left = left[~near]
        return np.array(centres), label

    @property
    def levels(self) -> int:
        return len(self.begins)


def _children(tree: CoverTree, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First child and number of children, at level + 1, of the nodes of a level."""
    first = np.searchsorted(tree.begins[level + 1], tree.begins[level])
    return first[:-1], np.diff(first)


class Forest:
    """Union-find over two trees' points."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], ..., first[i] + count[i] - 1 for every i, one after another."""
    total = int(count.sum())
    start = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count)
    return start + np.arange(total)


def dual(one: CoverTree, two: CoverTree, same: bool, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Numbers of linked points in the other tree (with multiplicities) for both trees' points, and enough linked pairs
    (indices) to connect all that are linked. With same, both are one tree: each pair counts for both of its points."""
    reach = float(chord(cosine))
    n1, n2 = np.zeros(len(one.points), np.int64), np.zeros(len(two.points), np.int64)
    forest, pairs = Forest(len(one.points) + (0 if same else len(two.points))), []
    shift = 0 if same else len(one.points)

    def link(i: int, j: int) -> None:
        if i != j + shift and forest.join(i, j + shift):
            pairs.append((i, j))

    def members(a: int, b: int, c: int, d: int) -> None:
        """Points a..b of one against c..d of two."""
        for x in range(a, b, 2048):
            y = min(x + 2048, b)
            hit = one.points[x:y] @ two.points[c:d].T >= cosine
            if same and c < y and x < d:  # a point isn't its own partner, and a pair in one node is met once from each side
                idx = np.arange(max(x, c), min(y, d))
                hit[idx - x, idx - c] = False
            n1[x:y] += hit @ two.counts[c:d]
            if not (same and a == c):
                n2[c:d] += one.counts[x:y] @ hit
            # each point with its first partner, and partners among each other through the rows they share
            for i, j in zip(*_forest_pairs(hit), strict=True):
                link(x + i, c + j)

    def all_linked(a: int, b: int, c: int, d: int) -> None:
        if same and a == c:
            n1[a:b] += one.counts[a:b].sum() - one.counts[a:b]
            for i in range(a + 1, b):
                link(a, i)
            return
        n1[a:b] += two.counts[c:d].sum()
        n2[c:d] += one.counts[a:b].sum()
        for i in range(a, b):
            link(i, c)
        for j in range(c, d):
            link(a, j)

    def settle(level: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of node pairs within reach, those linked throughout are taken, and points compared at the bottom; the others go on."""
        r1, r2 = one.radii[level], two.radii[level]
        whole = d + r1[i] + r2[j] <= reach - SLACK
        if same:  # inside one node two points may be as far apart as twice its radius
            whole |= (i == j) & (2 * r1[i] <= reach - SLACK)
        for p, q in zip(i[whole].tolist(), j[whole].tolist(), strict=True):
            all_linked(*one.begins[level][p : p + 2], *two.begins[level][q : q + 2])
        i, j = i[~whole], j[~whole]
        if level + 1 < one.levels:
            return i, j
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            members(*one.begins[level][p : p + 2], *two.begins[level][q : q + 2])
        return i[:0], j[:0]

    def table(level: int, a: int, b: int, c: int, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes a..b of one against c..d of two, in strips."""
        c1, c2 = one.points[one.centres[level]], two.points[two.centres[level][c:d]]
        r1, r2 = one.radii[level], two.radii[level][c:d]
        strip = max(1, PAIRS // (d - c))
        for x in range(a, b, strip):
            y = min(x + strip, b)
            # d <= reach + r1 + r2 by the cosine, which falls with the distance
            most = np.minimum(reach + SLACK + r1[x:y, None] + r2[None], 2)
            cosine = c1[x:y] @ c2.T
            near = cosine >= 1 - most * most / 2 - SLACK
            if same and a == c:
                near &= np.arange(x, y)[:, None] <= np.arange(c, d)[None]
            i, j = np.nonzero(near)
            yield settle(level, i + x, j + c, chord(cosine[i, j]))

    def pairs_of(level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Single node pairs."""
        c1, c2 = one.points[one.centres[level]], two.points[two.centres[level]]
        d = chord(np.einsum("ij,ij->i", c1[i], c2[j]))
        near = d - one.radii[level][i] - two.radii[level][j] <= reach + SLACK
        return settle(level, i[near], j[near], d[near])

    found = [table(0, 0, len(one.centres[0]), 0, len(two.centres[0]))]
    for level in range(one.levels):
        kept = [p for part in found for p in part if len(p[0])]
        if level + 1 == one.levels or not kept:
            break
        left, right = (np.concatenate(x) for x in zip(*kept, strict=True))
        (f1, m1), (f2, m2) = _children(one, level), _children(two, level)
        found, size = [], m1[left] * m2[right]
        for p, q in zip(left[size >= TABLE].tolist(), right[size >= TABLE].tolist(), strict=True):
            found.append(table(level + 1, f1[p], f1[p] + m1[p], f2[q], f2[q] + m2[q]))
        left, right, size = left[size < TABLE], right[size < TABLE], size[size < TABLE]
        ends = np.cumsum(size)
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PAIRS, int(ends[-1]) + PAIRS, PAIRS)), len(left)]) if len(left) else []
        for x, y in zip(cuts, cuts[1:], strict=False):
            a, b = left[x:y], right[x:y]
            rows = np.repeat(np.arange(len(a)), m1[a])
            i = _spread(f1[a], m1[a])
            first, count = f2[b[rows]], m2[b[rows]]
            own = np.repeat(a[rows] == b[rows], count)
            i, j = np.repeat(i, count), _spread(first, count)
            if same:
                i, j = i[~own | (i <= j)], j[~own | (i <= j)]
            found.append([pairs_of(level + 1, i, j)])
    return n1, n2, pairs


def _forest_pairs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hits that connect all rows and columns that hits connect: each row's first column, and for each column its first row
    and the rows whose first column differs from an earlier one's."""
    rows, cols = np.nonzero(hit)
    if len(rows) <= 4 * sum(hit.shape):
        return rows, cols
    forest, n = Forest(sum(hit.shape)), hit.shape[0]
    kept = [k for k, (r, c) in enumerate(zip(rows.tolist(), cols.tolist(), strict=True)) if forest.join(r, n + c)]
    return rows[kept], cols[kept]


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _pivots(points: DataFrame, wanted: int) -> dict[int, np.ndarray]:
    """A bounded sample of the points as unit vectors, by length."""
    by_dim: dict[int, list] = {}
    for r in points.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("dim", "v").collect():
        by_dim.setdefault(r["dim"], []).append(unit(np.array([r["v"]]))[0])
    return {d: np.array(v) for d, v in by_dim.items()}


def _deal(points: DataFrame, n: int, block: int) -> DataFrame:
    """Stored rep, copies, v (unit vector, packed doubles) and cell of every point: the nearest pivot's, and in cells that are
    too large for a block, the nearest one's of the cell's own pivots."""
    dealt = T.StructType([T.StructField("cell", T.StringType()), T.StructField("rep", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("v", T.BinaryType())])
    by_dim = _pivots(points, int(min(PIVOTS, max(1, round(n / block)))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy(zero_copy_only=False)
            flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum(dims)
            cells, made = [None] * len(dims), [None] * len(dims)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                u = unit(flat[(ends[at] - d)[:, None] + np.arange(d)])
                nearest = (u @ by_dim[d].T).argmax(axis=1) if d in by_dim else np.zeros(len(at), int)
                for i, k, row in zip(at.tolist(), nearest.tolist(), u, strict=True):
                    cells[i], made[i] = f"{d}.{k}", row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), batch.column(0), batch.column(1), pa.array(made, pa.binary())], schema=_arrow(dealt))

    placed = store(points.select("rep", "copies", "v", "dim").mapInArrow(tidied(deal), dealt), "dealt")
    large = placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > block).collect()  # at most a row per pivot
    if not large:
        return placed
    bytes_each = 8 * max(int(r["cell"].split(".")[0]) for r in large)
    share = max(2, min(MORE_PIVOTS, PIVOT_BYTES // (bytes_each * len(large))))
    wanted = {r["cell"]: min(share, -(-r["n"] // block) + 1) for r in large}
    rate = {r["cell"]: 8 * wanted[r["cell"]] / r["n"] for r in large}
    # about eight times the wanted points by hash, the least hashes of them
    chance = F.create_map(*(F.lit(x) for kv in rate.items() for x in kv))
    drawn = placed.withColumn("h", F.xxhash64("rep", F.lit("more"))).filter(F.col("h") <= F.element_at(chance, F.col("cell")) * F.lit(2.0**64) - F.lit(2.0**63))
    more: dict[str, list] = {}
    for r in drawn.select("cell", "h", "v").orderBy("cell", "h").toLocalIterator():
        if len(more.setdefault(r["cell"], [])) < wanted[r["cell"]]:
            more[r["cell"]].append(np.frombuffer(r["v"], float))
    own = {c: np.array(v) for c, v in more.items()}

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0).to_pylist()
            u = [np.frombuffer(v, float) if c in own else None for c, v in zip(cells, batch.column(3).to_pylist(), strict=True)]
            cells = [c if v is None else f"{c}.{int((own[c] @ v).argmax())}" for c, v in zip(cells, u, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.string()), *batch.columns[1:]], schema=_arrow(dealt))

    out = store(placed.mapInArrow(tidied(again), dealt), "dealt")
    discard(placed)
    return out


def _near_blocks(balls: DataFrame, reach: float) -> DataFrame:
    """Pairs (a, b) of blocks whose covering balls come within reach. Balls are gathered in chunks of some BALLS, and pairs
    of chunks are compared as tables."""
    many = balls.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(BALLS)).cast("long").alias("chunks"))
    sized = balls.join(F.broadcast(many), "dim").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))  # one row a length
    packed = T.StructType([T.StructField("dim", T.LongType()), T.StructField("chunks", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("balls", T.BinaryType())])

    def gather(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        tops = np.frombuffer(b"".join(group["top"].to_pylist()), float).reshape(group.num_rows, -1)
        return pa.table([pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array([pickle.dumps((group["id"].to_pylist(), tops))], pa.binary())], schema=_arrow(packed))

    chunks = store(sized.groupBy("dim", "chunks", "chunk").applyInArrow(gather, packed), "balls")
    left = chunks.select("dim", F.col("balls").alias("one"), F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("chunk"), F.col("chunk").alias("first"))
    both = left.join(chunks.select("dim", "chunk", F.col("balls").alias("two")), ["dim", "chunk"]).select((F.col("first") == F.col("chunk")).alias("same"), "one", "two")
    pair = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (a, x), (b, y) = pickle.loads(one), pickle.loads(two)
                hit = chord(x[:, :-1] @ y[:, :-1].T) - x[:, -1:] - y[:, -1:].T <= reach + SLACK
                i, j = np.nonzero(np.triu(hit) if same else hit)
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in i.tolist()], pa.string()), pa.array([b[k] for k in j.tolist()], pa.string())], schema=_arrow(pair))

    return both.mapInArrow(tidied(near), pair)


def near_links(vectors: DataFrame, cosine: float = COSINE, block: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, counts, edges): points has a row per vector with its representative `rep` (null if it links with nothing)
    and copies; counts the number of vectors linked with a representative besides its copies; edges connect
    representatives (enough of them for the components)."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    key = F.when(good, F.sha2(F.array_join(F.transform(e, lambda x: (x + F.lit(0.0)).cast("string")), ","), 256))
    rows = store(vectors.select("vec_id", "embedding").withColumn("key", key).withColumn("row", F.monotonically_increasing_id()), "vectors")
    reps = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    reps = store(reps, "reps")
    keys = F.broadcast(reps) if small(reps) else reps
    points = rows.join(keys, "key", "left").select("vec_id", "row", "rep", "copies")
    one = rows.join(keys, "key").filter("row = rep").select("rep", "copies", F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.size("embedding").alias("dim"))
    one = store(one, "points")
    n, dims = one.agg(F.count("*"), F.max("dim")).first()
    dims = int(dims or 1)
    block = block or int(min(max(BLOCK, -(-n // 8)), max(BLOCK, BLOCK_BYTES // (8 * dims))))
    placed = _deal(one, n, block)
    discard(one)
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
    split = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / F.lit(block))))  # one row a cell
    packed = T.StructType([T.StructField("dim", T.LongType()), T.StructField("id", T.StringType()), T.StructField("top", T.BinaryType()), T.StructField("tree", T.BinaryType())])

    def build(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("rep")
        points = np.frombuffer(b"".join(group["v"].to_pylist()), float).reshape(group.num_rows, -1)
        tree = CoverTree(points, group["rep"].to_numpy(), group["copies"].to_numpy(), cosine)
        middle = points.mean(axis=0)
        size = np.sqrt(middle @ middle)
        middle = middle / size if size > 0 else points[0]
        top = np.r_[middle, float(chord(points @ middle).max())]
        tidy()
        return pa.table([pa.array([points.shape[1]], pa.int64()), pa.array([f"{key[0].as_py()}-{key[1].as_py()}"]), pa.array([top.tobytes()], pa.binary()), pa.array([pickle.dumps(tree)], pa.binary())], schema=_arrow(packed))

    trees = store(split.select("cell", "part", "rep", "copies", "v").groupBy("cell", "part").applyInArrow(build, packed), "trees")
    discard(placed)
    pairs = store(_near_blocks(trees.select("dim", "id", "top"), float(chord(cosine))), "pairs")
    found = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("n", T.LongType())])

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        held = dict(zip(group["id"].to_pylist(), group["tree"].to_pylist(), strict=True))
        a, b = (k.as_py() for k in key)
        one = pickle.loads(held[a])
        two = one if a == b else pickle.loads(held[b])
        n1, n2, edges = dual(one, two, a == b, cosine)
        if a == b:
            n1, n2 = n1 + n2, np.zeros(0, int)
        i, j = np.flatnonzero(n1), np.flatnonzero(n2)
        first = [*one.ids[i].tolist(), *two.ids[j].tolist(), *(int(one.ids[x]) for x, _ in edges)]
        second = [None] * (len(i) + len(j)) + [int(two.ids[y]) for _, y in edges]
        number = [*n1[i].tolist(), *n2[j].tolist()] + [None] * len(edges)
        tidy()
        return pa.table([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(number, pa.int64())], schema=_arrow(found))

    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).join(trees.select("id", "tree"), "id")
    result = store(sides.select("a", "b", "id", "tree").groupBy("a", "b").applyInArrow(compare, found), "found")
    discard(trees, pairs)
    counts = result.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    return points, counts, result.filter("n is null").select("a", "b")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """op8: one row per vector: vec_id, n_links, component_id, kept."""
    points, counts, edges = near_links(vectors, cosine, block)
    components = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    known = points.join(counts, "rep", "left").join(components, "rep", "left")
    known = known.withColumn("root", F.coalesce("root", "rep"))
    known = store(known, "known")
    names = known.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    names = store(names, "names")
    names = F.broadcast(names) if small(names) else names
    n_links = F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long")
    out = known.join(names, "root", "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select("vec_id", n_links.alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = f"""
WITH RECURSIVE
v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
      WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= {COSINE}),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN c ON c.node = v.vec_id
"""
