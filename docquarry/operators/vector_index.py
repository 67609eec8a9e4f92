"""A stored index of vectors in cells, and exact top lists that read only the cells which may hold a better item.

Build: centres are a bounded sample (CELLS at most, the smallest hashes of item_seq); every vector goes to its nearest centre. A cell
knows its centre, the greatest distance of its members and their number; its vectors are stored in blocks of about BLOCK, so a cell
of any size is read in parts. Search: an inner product in a cell is at most question . centre + |question| * radius. Each
question first visits the cells of greatest bound that together hold enough items; the k-th best score found there is a
floor, and the second round visits just the other cells whose bound reaches it. Questions stay a distributed side: they
are gathered by block, never on the driver.

Vectors that are null, empty, of another length than most of the sample or hold null, NaN or infinite numbers are not indexed; such
questions get no hits. Ties in score go to the smaller item_seq. Fewer than k items give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Most cells, vectors to a block, and questions to a group that meets a block.
CELLS, BLOCK, QUESTIONS = 2048, 4096, 2048
#: Rounding of a bound against a score, as a share of their size.
SLACK = 1e-9


@dataclass
class VectorIndex:
    """Stored tables: cells (cell, centre, radius, n) and blocks (cell, block, ids, vectors by rows); the vectors' length and number."""

    cells: DataFrame
    blocks: DataFrame
    size: int
    n: int


def sound(vector: Column, size: int) -> Column:
    """Whether a vector has `size` finite numbers."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == size) & finite, F.lit(False))


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size)


def build(vectors: DataFrame, cells: int | None = None) -> VectorIndex | None:
    """The index of item_seq and embedding; None if no vector is sound. cells: default the square root of the number."""
    spark = vectors.sparkSession
    items = vectors.select(F.col("item_seq").cast("long").alias("item_seq"), "embedding")
    first = items.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if first is None:
        return None
    size = first["size"]
    good = items.filter(sound(F.col("embedding"), size))
    n = good.count()
    if not n:
        return None
    most = min(CELLS, cells or max(1, round(n**0.5)))
    sample = good.orderBy(F.xxhash64("item_seq"), "item_seq").limit(most).collect()
    centres = spark.sparkContext.broadcast(np.array([r["embedding"] for r in sample], float))  # CELLS rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        own = (c * c).sum(axis=1)
        for batch in batches:
            x = _rows(batch.column(1), size)
            near = (own[None] - 2 * x @ c.T).argmin(axis=1)
            away = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(away)], names=["item_seq", "embedding", "cell", "away"])

    kind = dict(vectors.dtypes)["embedding"]
    dealt = stored(good.mapInArrow(assign, f"item_seq long, embedding {kind}, cell int, away double"), "dealt")
    known = spark.createDataFrame([(i, [float(v) for v in r["embedding"]]) for i, r in enumerate(sample)], "cell int, centre array<double>")
    table = stored(dealt.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).join(known, "cell"), "cells")
    parts = F.ceil(F.col("n") / BLOCK)
    placed = dealt.join(F.broadcast(table.select("cell", "n")), "cell").withColumn("block", F.pmod(F.xxhash64("item_seq"), parts).cast("int"))
    blocks = placed.groupBy("cell", "block").agg(F.collect_list(F.struct("item_seq", "embedding")).alias("v"))
    return VectorIndex(table, stored(blocks.select("cell", "block", F.col("v.item_seq").alias("ids"), F.flatten("v.embedding").alias("vectors")), "blocks"), size, n)


def _bounds(questions: DataFrame, index: VectorIndex) -> DataFrame:
    """question_id, cell, bound, n of every question and cell, as arrays in order of bound."""
    rows = index.cells.orderBy("cell").collect()  # CELLS rows at most
    centres = index.cells.sparkSession.sparkContext.broadcast((np.array([r["cell"] for r in rows], np.int32), np.array([r["centre"] for r in rows], float), np.array([r["radius"] for r in rows]), np.array([r["n"] for r in rows])))
    size = index.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, c, radius, n = centres.value
        for batch in batches:
            q = _rows(batch.column(1), size)
            norm = np.sqrt((q * q).sum(axis=1))
            bound = q @ c.T + norm[:, None] * radius[None]
            bound += SLACK * (1 + np.abs(bound))
            order = np.argsort(-bound, axis=1, kind="stable")
            fixed = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), fixed(cell[order], pa.int32()), fixed(np.take_along_axis(bound, order, 1), pa.float64()), fixed(n[order].astype(np.int64), pa.int64())], names=["question_id", "cells", "bounds", "sizes"])

    return questions.select("question_id", "embedding").mapInArrow(run, "question_id long, cells array<int>, bounds array<double>, sizes array<long>")


def _visit(questions: DataFrame, visits: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """question_id, item_seq, score: the best k of each question in each group of questions and block that meet.
    visits: question_id, cell."""
    size = index.size
    loads = visits.groupBy("cell").agg(F.count("*").alias("asked"))
    here = visits.join(loads, "cell").withColumn("part", F.pmod(F.xxhash64("question_id"), F.ceil(F.col("asked") / QUESTIONS)).cast("int"))
    groups = here.join(questions.select("question_id", "embedding"), "question_id").groupBy("cell", "part").agg(F.collect_list(F.struct("question_id", "embedding")).alias("q"))
    met = groups.join(index.blocks, "cell").select(F.col("q.question_id").alias("questions"), F.flatten("q.embedding").alias("asked"), "ids", "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                flat = [batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in range(4)]
                asked, ids = flat[0].astype(np.int64), flat[2].astype(np.int64)
                scores = flat[1].astype(float).reshape(len(asked), size) @ flat[3].astype(float).reshape(len(ids), size).T
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, order.shape[1])), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(scores, order, 1).ravel())], names=["question_id", "item_seq", "score"])

    return met.mapInArrow(run, "question_id long, item_seq long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "item_seq")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(questions: DataFrame, index: VectorIndex | None, k: int) -> tuple[DataFrame, DataFrame]:
    """(question_id, item_seq, semantic_score, rank) of the exact k best items, and (question_id, cells, points) visited.
    questions: question_id, embedding."""
    asked = questions.select(F.col("question_id").cast("long").alias("question_id"), "embedding")
    if index is None:
        none = asked.sparkSession.createDataFrame([], "question_id long, item_seq long, semantic_score double, rank int")
        return none, none.select("question_id", F.lit(0).cast("long").alias("cells"), F.lit(0).cast("long").alias("points"))
    asked = stored(asked.filter(sound(F.col("embedding"), index.size)), "asked")
    bounds = stored(_bounds(asked, index).select("question_id", F.posexplode(F.arrays_zip("cells", "bounds", "sizes")).alias("place", "c")).select("question_id", "place", "c.*"), "bounds")
    before = F.coalesce(F.sum("sizes").over(Window.partitionBy("question_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = bounds.withColumn("before", before)
    first = stored(placed.filter(F.col("before") < k), "first")
    found = stored(_best(_visit(asked, first.select("question_id", F.col("cells").alias("cell")), index, k), k), "found")
    floor = found.filter(F.col("rank") == k).select("question_id", F.col("score").alias("floor"))
    rest = placed.filter(F.col("before") >= k).join(floor, "question_id").filter(F.col("bounds") >= F.col("floor"))
    second = stored(rest.select(first.columns), "second")
    more = _visit(asked, second.select("question_id", F.col("cells").alias("cell")), index, k)
    best = _best(found.drop("rank").unionByName(more), k).withColumnRenamed("score", "semantic_score")
    visited = first.unionByName(second).groupBy("question_id").agg(F.count("*").alias("cells"), F.sum("sizes").alias("points"))
    return best, visited
