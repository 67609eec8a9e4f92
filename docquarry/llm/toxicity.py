"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Model: P(grade <= k) = sigmoid(theta_k - x.w), one weight vector shared by all ordered thresholds theta. Features are
words and the beginnings of words (4 to 6 letters; insults are inflected and compounded), each as log(1 + count).
It is fitted on a bounded sample of labelled documents (`sample` rows, those with the smallest hash of their id): a
first pass counts each feature's documents by label, those with enough evidence are kept (all of them: the sample bounds
their number), and the regression runs on the sample's sparse counts; texts that repeat in it count once, and clean and toxic documents weigh alike in all. Labels are binary, so severity grades are made from them: 0 for clean documents, 1 to 3
for toxic ones by thirds of how much telling language they have, on the features' own scale (both cuts come from the sample).

Defined results: a null or empty text, or one without words, has only the thresholds to go by; labels that are null or
whose document is missing aren't used; a text with several labels counts once for each different one; without any toxic or any
clean label nothing is rejected (severity 0). Repeated rows are scored alike; columns of the input are kept.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, store, tidied

SAMPLE, GRADES = 20_000, 4
STEMS = (4, 5, 6)
#: A word of the telling ones is this many times likelier (log odds) in toxic documents; a feature needs so much evidence
#: (the likelihood ratio statistic of its documents by label), since many are tried.
TELLING, EVIDENCE = 3.0, 20.0
WORDS = re.compile(r"[^\W\d_]+").findall
CACHE_ENTRIES = 100_000


def features_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in STEMS if len(word) > n)]


@dataclass
class OrdinalModel:
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES - 1, np.inf))
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def counts(self, text: str) -> dict[int, int]:
        """Feature -> count, over the whole text."""
        cache, index, found = self.cache, self.index, defaultdict(int)
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        for word, n in Counter(WORDS(text.lower())).items():
            hits = cache.get(word)
            if hits is None:
                hits = cache[word] = tuple(index[f] for f in features_of(word) if f in index)
            for i in hits:
                found[i] += n
        return found

    def score(self, text: str) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        w = self.weights
        s = sum(w[i] * np.log1p(n) for i, n in sorted(self.counts(text).items()))
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds - s))


def fit(rows: list[tuple[dict[int, float], int]], index: dict[str, int], grades: int = GRADES, l2: float = 1e-4, steps: int = 500, rate: float = 0.1, balanced: bool = True) -> OrdinalModel:
    """Penalized maximum likelihood by Adam over the whole sample. rows: (feature -> value, grade). balanced: clean
    (grade 0) and other rows weigh as much as each other in all."""
    y = np.array([g for _, g in rows])
    weight = np.where(y == 0, 1 / max((y == 0).sum(), 1), 1 / max((y > 0).sum(), 1)) / 2 if balanced else np.full(len(y), 1 / len(y))
    lengths = np.array([len(x) for x, _ in rows])
    col = np.array([i for x, _ in rows for i in sorted(x)], int)
    val = np.array([x[i] for x, _ in rows for i in sorted(x)], float)
    row = np.repeat(np.arange(len(rows)), lengths)
    w = np.zeros(len(index))
    below = np.array([np.clip(weight[y < k].sum(), 1e-3, 1 - 1e-3) for k in range(1, grades)])
    start = np.log(below / (1 - below))
    # thresholds: the first, then steps that stay positive
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    p, m, v = np.concatenate([w, t]), np.zeros(len(w) + len(t)), np.zeros(len(w) + len(t))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, steps + 1):
        w, t = p[: len(index)], p[len(index) :]
        theta = np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])
        eta = np.bincount(row, val * w[col], len(rows))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        upper, lower = edges[y + 1] - eta, edges[y] - eta
        cu, cl = sigmoid(upper), sigmoid(lower)
        cu[y == grades - 1], cl[y == 0] = 1.0, 0.0
        prob = np.maximum(cu - cl, 1e-12)
        du, dl = cu * (1 - cu) / prob, cl * (1 - cl) / prob
        du, dl = du * weight, dl * weight
        grad_eta = du - dl  # of the mean negative log likelihood
        g_theta = np.array([dl[y == k + 1].sum() - du[y == k].sum() for k in range(grades - 1)])
        g_w = np.bincount(col, val * grad_eta[row], len(index)) + l2 * w
        g_t = np.concatenate([[g_theta.sum()], np.array([g_theta[k:].sum() * np.exp(t[k]) for k in range(1, grades - 1)])])
        g = np.concatenate([g_w, g_t])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, t = p[: len(index)], p[len(index) :]
    return OrdinalModel(index, w, np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))]))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, hash_seed: str = "toxicity") -> OrdinalModel:
    """Fits the model; the driver gets the names of the features and the sample's sparse rows, both bounded by the sample."""
    spark = documents.sparkSession
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(hash_seed), "__id"), "__id").limit(sample)
    taught = store(documents.select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "__id").select("text", "toxic").dropDuplicates(), "taught")
    kinds = {r["toxic"]: r["n"] for r in taught.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not kinds.get(0) or not kinds.get(1):
        discard(taught)
        return OrdinalModel()
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("toxic", T.LongType()), T.StructField("clean", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[toxic].update({f for w in set(WORDS(text.lower())) for f in features_of(w)})
        names = list(by[0] | by[1])
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([by[1][f] for f in part], pa.int64()), pa.array([by[0][f] for f in part], pa.int64())], names=["feature", "toxic", "clean"])

    odds = lambda n, of: F.log((n + 0.5) / (F.lit(of) - n + 0.5))
    counted = taught.mapInArrow(tidied(count), schema).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    scored = counted.withColumn("odds", odds(F.col("toxic"), kinds[1]) - odds(F.col("clean"), kinds[0]))
    n, docs = F.col("toxic") + F.col("clean"), kinds[0] + kinds[1]
    part = lambda seen, of, total: F.when(seen > 0, seen * F.log(seen * docs / (of * total))).otherwise(F.lit(0.0))
    evidence = 2 * (part(F.col("toxic"), n, kinds[1]) + part(F.col("clean"), n, kinds[0]) + part(kinds[1] - F.col("toxic"), docs - n, kinds[1]) + part(kinds[0] - F.col("clean"), docs - n, kinds[0]))
    kept = scored.withColumn("evidence", evidence).filter(F.col("evidence") >= EVIDENCE).orderBy(F.desc("evidence"), "feature").select("feature", "odds").collect()
    index = {r["feature"]: i for i, r in enumerate(kept)}
    telling = {index[r["feature"]] for r in kept if r["odds"] >= TELLING}
    model, pairs = OrdinalModel(index), T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("n", T.ArrayType(T.IntegerType()))])
    held = spark.sparkContext.broadcast(model)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = [held.value.counts(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))],
                names=["toxic", "at", "n"],
            )

    rows = [(r["toxic"], dict(zip(r["at"], r["n"], strict=True))) for r in taught.mapInArrow(tidied(sparse), pairs).toLocalIterator()]
    held.destroy()
    discard(taught)
    rows.sort(key=lambda r: (r[0], sorted(r[1].items())))  # the same sums whatever order the rows come in
    values = [(toxic, {i: float(np.log1p(n)) for i, n in x.items()}) for toxic, x in rows]
    amount = lambda x: sum(v for i, v in sorted(x.items()) if i in telling)
    cuts = np.quantile([amount(x) for toxic, x in values if toxic], [1 / 3, 2 / 3])
    graded = [(x, 0 if not toxic else 1 + int(np.searchsorted(cuts, amount(x)))) for toxic, x in values]
    return fit(graded, index)


GRADED = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def grade(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """The documents with severity (expected grade), grade (the likeliest), p_toxic (P(grade >= 1)) and rejected (p_toxic >= 0.5).
    Columns of these names in the input are replaced."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    base = documents.drop(*GRADED.names)
    schema = T.StructType([*base.schema.fields, *GRADED.fields])
    at = base.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            above = [model.score(t or "") for t in batch.column(at).to_pylist()]
            each = [-np.diff(np.concatenate([[1.0], p, [0.0]])) for p in above]
            made = [
                pa.array([float(p.sum()) for p in above], pa.float64()),
                pa.array([int(e.argmax()) for e in each], pa.int32()),
                pa.array([float(p[0]) for p in above], pa.float64()),
                pa.array([bool(p[0] >= 0.5) for p in above], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)
        model.cache.clear()

    return base.mapInArrow(tidied(run), schema)


def not_rejected(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """The documents that the model doesn't reject, their columns as they are, whatever their names."""
    names = documents.columns
    own = [name if name == "text" else f"__{i}" for i, name in enumerate(names)]
    return grade(documents.toDF(*own), model).filter(~F.col("rejected")).select(own).toDF(*names)


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """op4: every document's severity."""
    return grade(documents.select("doc_id", "text"), train(documents, labels)).drop("text")
