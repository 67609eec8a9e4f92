"""The training-corpus pipeline. Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept;
all but the last return the columns of documents.

1. toxicity: documents that the ordinal model rejects (P(grade >= 1) >= 0.5) go; the model is fitted on labelled
   documents among those given.
2. near duplicates: 5-word shingles, Jaccard 0.8 or more; of each component one document stays, that with the smallest
   id (null ids come last; if an id stands on several texts, the smallest hash; rows repeated whole: one of them).
3. repeated passages: words covered by a 13-word window that also starts in a document with a smaller id go from the
   text, whose other words are joined by one space; texts without any stay as they are, n_chars follows the text.
4. packing: sequences of 1024 tokens, mixed by source.

Empty and null texts pass every stage; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import ngramjoin, packing, recompress, toxicity
from docquarry.llm.common import discard, small, store, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.not_rejected(docs, model)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined = ngramjoin.ngram_join(docs, n=5, percent=80)
    texts = joined.groupBy("root", "doc_id", "hash").agg(F.count("*").alias("copies"))
    alone = F.when(F.col("root").isNull(), F.struct("doc_id", "hash"))  # without n-grams a document has no partner
    least = texts.groupBy("root", alone.alias("alone")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "copies")).alias("l"))
    leaders = store(least.select(F.col("l.doc_id").alias("__d"), F.col("l.hash").alias("__h"), F.col("l.copies").alias("__copies")), "leaders")
    kept = F.broadcast(leaders) if small(leaders) else leaders
    names = docs.columns
    own = docs.toDF(*[name if name in ("doc_id", "text") else f"__{i}" for i, name in enumerate(names)])
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    found = own.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (text_hash == F.col("__h")))
    once = found.filter("__copies = 1").select(own.columns)
    repeated = found.filter("__copies > 1").dropDuplicates(["__d", "__h"]).select(own.columns)
    return (once.unionByName(repeated) if leaders.filter("__copies > 1").limit(1).count() else once).toDF(*names)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recompress.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_digest(docs)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", no_near_duplicates),
    ("substring_dedup", no_repeated_passages),
    ("packing", packed),
]

#: The stages aren't expressible in SQL (a fitted model, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
