"""Content items: construction, chunking, dedup, counts, centroids, saving and loading."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import text as X
from . import versions

#: Columns of a content item; a branch that lacks one gets nulls.
ITEM = ("item_seq", "source_id", "document_id", "file", "doc_type", "page_start", "page_end", "content_type", "text_for_embedding", "text_for_llm", "extraction_method", "confidence",)


def make_items(df: DataFrame, content_type: str, method: str, confidence: float | Column = 1.0, *extra: str) -> DataFrame:
    """Items of a frame with document_id, file, doc_type, page, ordinal, text_for_embedding, text_for_llm.
    The id is a digest of what names the item, so a repeated run gives the same ids."""
    key = F.concat_ws("\x1f", "document_id", F.col("page").cast("string"), F.lit(content_type), F.col("ordinal").cast("string"))
    strip = lambda c: X.strip(X.text(c))
    return df.select(
        F.concat_ws("_", F.lit(content_type), F.substring(F.sha1(key), 1, 16)).alias("source_id"),
        "document_id",
        "file",
        "doc_type",
        F.col("page").alias("page_start"),
        F.col("page").alias("page_end"),
        F.lit(content_type).alias("content_type"),
        strip(F.col("text_for_embedding")).alias("text_for_embedding"),
        strip(F.col("text_for_llm")).alias("text_for_llm"),
        F.lit(method).alias("extraction_method"),
        F.lit(confidence).alias("confidence"),
        "ordinal",
        *extra,
    )


def page_items(pages: DataFrame, method: str = "pymupdf_text") -> DataFrame:
    """A text item per page that isn't blank."""
    shown = pages.filter(X.collapse(X.text(F.col("text"))) != "").withColumn("ordinal", F.lit(1))
    return make_items(shown.withColumn("text_for_embedding", F.col("text")).withColumn("text_for_llm", F.col("text")), "text", method)


def chunk_items(items: DataFrame, chunking: config.Chunking = config.Chunking()) -> DataFrame:
    """Text and OCR text in overlapping chunks, with parent, index from 1 and count; other items pass."""
    textual = F.col("content_type").isin("text", "ocr_text")
    cut = items.filter(textual).withColumn("pieces", X.chunks(F.col("text_for_embedding"), chunking.size, chunking.overlap))
    out = cut.select("*", F.posexplode("pieces").alias("i", "piece")).withColumns(
        {
            "parent_source_id": F.col("source_id"),
            "chunk_index": F.col("i") + 1,
            "num_chunks_from_parent": F.size("pieces"),
            "source_id": F.concat_ws("_", "source_id", F.format_string("%04d", F.col("i") + 1)),
            "extraction_method": F.concat("extraction_method", F.lit("_chunked")),
            "text_for_embedding": F.col("piece"),
            "text_for_llm": F.col("piece"),
        }
    )
    return out.drop("pieces", "i", "piece").unionByName(items.filter(~textual), allowMissingColumns=True)


def union_items(branches: list[DataFrame]) -> DataFrame:
    """Branches in fixed order; the order is kept in `branch`."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)))


def signature(text: Column) -> Column:
    return F.sha1(X.normalize_retrieval(text))


def dedup_items(items: DataFrame, order: list[str], cross_type: bool = False, columns: list[str] | None = None) -> DataFrame:
    """The first item of each (document, page, type, normalized text). Groups are decided on digests
    and order columns with a partial aggregate; the texts aren't sorted by group. Where `columns` (short ones) are all that is asked
    of an item, the aggregate carries them, and the items are read once."""
    keys = ["document_id", "page_start", *([] if cross_type else ["content_type"])]
    marked = items.withColumn("__sig", signature(F.col("text_for_embedding")))
    if columns is not None:
        least = F.min(F.struct(F.struct(*order).alias("order"), F.struct(*columns).alias("item")))
        return marked.groupBy(*keys, "__sig").agg(least.alias("first")).select("first.item.*")
    first = marked.groupBy(*keys, "__sig").agg(F.min(F.struct(*order)).alias("first"))
    renamed = first.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__sig").alias("__same"), F.col("first").alias("__first"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__sig") == F.col("__same"), F.struct(*order).eqNullSafe(F.col("__first"))]
    return marked.join(renamed, reduce(lambda a, b: a & b, same), "left_semi").drop("__sig")


def counts_by_type(items: DataFrame) -> DataFrame:
    """Items of each document by content type."""
    each = [F.count_if(F.col("content_type") == t).alias(t) for t in config.CONTENT_TYPES]
    return items.groupBy("document_id").agg(*each, F.count("*").alias("total"))


def coverage(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every registered document with its counts (0 where it has none)."""
    joined = documents.join(counts_by_type(items), "document_id", "left")
    return joined.withColumns({t: F.coalesce(F.col(t), F.lit(0)) for t in (*config.CONTENT_TYPES, "total")})


def registry_totals(covered: DataFrame) -> DataFrame:
    """A06."""
    return covered.agg(F.count("*").alias("documents"), *(F.sum(t).alias(t) for t in (*config.CONTENT_TYPES, "total")))


# Labels of the counts in a registry's summary.
SUMMARY = {"num_pages": "Pages/sheets", "text": "Text chunks", "table": "Digital tables", "ocr_text": "OCR text items", "ocr_table": "OCR tables", "plot_table": "Plot tables"}


def registry_report(covered: DataFrame) -> DataFrame:
    """The whole summary as lines in order (document_id is null for the head and the totals; sort by part, document_id, i).
    covered: coverage(), with num_pages where units are known."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string") if c in covered.columns else F.lit("0")
    own = [F.concat(F.lit("- "), "file"), F.concat(F.lit("  - ID: "), "document_id"), F.concat(F.lit("  - Kind: "), "file_kind"), F.concat(F.lit("  - Type: "), "doc_type")]
    own += [F.concat(F.lit(f"  - {label}: "), n(c)) for c, label in SUMMARY.items()]
    lines = covered.select(F.lit(1).alias("part"), "document_id", F.posexplode(F.array(*own, F.lit(""))).alias("i", "line"))
    sums = covered.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) if c in covered.columns else F.lit(0).alias(c) for c in SUMMARY))
    none = F.lit(None).cast("string")
    head = F.when(F.col("documents") == 0, F.array(F.lit("No documents processed yet."))).otherwise(F.array(F.concat(F.lit("Documents processed: "), F.col("documents").cast("string")), F.lit("")))
    totals = F.array(F.lit("Overall totals:"), *(F.concat(F.lit(f"- {label}: "), F.col(c).cast("string")) for c, label in SUMMARY.items()), F.concat(F.lit("- Scaling guidance: "), X.scaling_advice(F.col("documents"))))
    first = sums.select(F.lit(0).alias("part"), none.alias("document_id"), F.posexplode(head).alias("i", "line"))
    last = sums.filter("documents > 0").select(F.lit(2).alias("part"), none.alias("document_id"), F.posexplode(totals).alias("i", "line"))
    return first.unionByName(lines).unionByName(last)


def registry_summary(covered: DataFrame) -> DataFrame:
    """A line per document."""
    line = F.format_string("%s | %s | %s | text %d | tables %d | OCR %d | OCR tables %d | plots %d", "document_id", "file", "doc_type", *config.CONTENT_TYPES[:2], *config.CONTENT_TYPES[2:])
    return covered.select("document_id", line.alias("line"))


def processing_status(items: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """Counts by type, then warnings, as lines in order."""
    lines = items.groupBy("content_type").agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.concat_ws(": ", "content_type", F.col("n").cast("string")).alias("line"))
    if warnings is not None:
        lines = lines.union(warnings.select(F.lit(1), F.concat(F.lit("Warning: "), F.col("warning"))))
    return lines


def filter_choices(df: DataFrame, column: str, wildcard: str) -> DataFrame:
    """F16: the wildcard, then the column's values in order."""
    values = df.select(F.col(column).alias("choice")).filter("choice is not null").distinct().withColumn("rank", F.lit(1))
    return values.unionByName(df.sparkSession.createDataFrame([(wildcard, 0)], "choice string, rank int")).orderBy("rank", "choice").select("choice")


#: Keys whose sums a task holds at most before it passes them on.
PARTIAL_KEYS = 1 << 12


def _sums(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, sums and counts: the numbers of the vectors by place, added up in each task."""
    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def told(kind: pa.DataType) -> pa.RecordBatch:
            rows = [pa.array([k for k, _ in held], kind), pa.array([s for s, _ in held.values()], pa.list_(pa.float64())), pa.array([n for _, n in held.values()], pa.list_(pa.int64()))]
            held.clear()
            return pa.RecordBatch.from_arrays(rows, names=schema.names)

        for batch in batches:
            coded, column = batch.column(0).dictionary_encode(), batch.column(1)
            keys = [*coded.dictionary.to_pylist(), None]
            codes = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == size)
                at = at[np.argsort(codes[at], kind="stable")]
                flat = column.take(pa.array(at)).flatten()
                values = pc.fill_null(pc.cast(flat, pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(-1, size)
                there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)
                begins = np.flatnonzero(np.diff(codes[at], prepend=-1))
                for code, s, n in zip(codes[at][begins].tolist(), np.add.reduceat(values, begins), np.add.reduceat(there, begins), strict=True):
                    before = held.get((keys[code], size), (0.0, 0))
                    held[keys[code], size] = before[0] + s, before[1] + n
            if len(held) >= PARTIAL_KEYS:
                yield told(batch.column(0).type)
        if held:
            yield told(batch.column(0).type)

    return vectors.select(key, vector).mapInArrow(run, schema)


def centroids(vectors: DataFrame, key: str = "document_id", vector: str = "embedding") -> DataFrame:
    """Mean vector of each key, scaled to length 1 unless it is zero. Tasks add up whole vectors; only their sums are
    exploded, and only the means are gathered, one row a place."""
    places = _sums(vectors, key, vector).select(key, F.posexplode(F.arrays_zip("sums", "counts")).alias("pos", "p"))
    means = places.groupBy(key, "pos").agg(F.try_divide(F.sum("p.sums"), F.sum("p.counts")).alias("m"))
    gathered = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
    centre = gathered.select(key, F.transform("c", lambda x: x["m"]).alias("c"))
    size = X.norm(F.col("c"))
    return centre.select(key, F.when(size > 0, F.transform("c", lambda x: x / size)).otherwise(F.col("c")).cast("array<float>").alias("centroid"))


def save_corpus(directory: str, items: DataFrame, documents: DataFrame, embeddings: DataFrame, by_type: bool = False) -> int:
    """Items, registry, embeddings and centroids as one version of the folder; returns its number. embeddings: document_id
    and embedding beside what names the item."""
    tables = {"items": items, "registry": documents, "embeddings": embeddings, "centroids": lambda written: centroids(written["embeddings"])}
    return versions.commit(directory, tables, {"items": ["content_type"]} if by_type else None)


def load_corpus(spark: SparkSession, directory: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version (default: the last), as they were saved; items and embeddings must be as many."""
    entry = versions.manifest(spark, directory, version)["tables"]
    if entry["items"]["rows"] != entry["embeddings"]["rows"]:
        raise RuntimeError("saved embeddings and items are misaligned")
    return versions.load(spark, directory, version)


def chat_markdown(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """A conversation as Markdown, a heading for each turn."""
    block = F.concat(F.lit("## "), F.initcap(X.text(F.col("role"))), F.lit("\n\n"), X.text(F.col("text")))
    grouped = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, block.alias("b")))).alias("t"))
    return grouped.select(key, F.array_join(F.transform("t", lambda t: t["b"]), "\n\n---\n\n").alias("markdown"))


def display_score(*columns: Column) -> Column:
    """P10: the first score that is a number, else 0."""
    return F.coalesce(*(c.try_cast("double") for c in columns), F.lit(0.0))


def source_page(*columns: Column) -> Column:
    """P11."""
    return F.coalesce(*(c.cast("string") for c in columns), F.lit("Unknown"))


def source_line(rank: Column, file: Column, page: Column, content_type: Column, score: Column) -> Column:
    return F.format_string("%d. %s | page %s | %s | score: %s", rank, F.coalesce(file, F.lit("Unknown file")), source_page(page), F.coalesce(content_type, F.lit("unknown")), X.fixed(score, 4))


def source_lines(hits: DataFrame, key: str = "question_id", rank: str = "rank") -> DataFrame:
    """The sources of each question, one line a hit."""
    line = source_line(F.col(rank), F.col("file"), F.col("page_start"), F.col("content_type"), F.col("score"))
    grouped = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("line")))).alias("l"))
    return grouped.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("sources"))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def public_answer(answer: Column, confidence: Column, route: Column, sources: Column) -> Column:
    """The answer, and its technical details folded away and escaped."""
    details = F.concat_ws("\n", F.concat(F.lit("Confidence: "), confidence), F.concat(F.lit("Route: "), route), sources)
    return F.concat(answer, F.lit("\n\n<details><summary>Sources</summary>\n<pre>"), escape_html(details), F.lit("</pre>\n</details>"))


#: Rules of the prompt, for questions with and without context.
RULES = ("- Give only the requested fact or facts.", "- Do not repeat the context.", "- Do not invent or substitute related information.", "- Preserve exact identifiers, dates, units, signs, and product names.")
NO_CONTEXT_RULES = ("- Give only the requested fact.", "- Do not repeat the context.", "- Do not invent information.")
ABSENT_RULE = "- If the answer is absent, say:\n  " + config.NOT_FOUND
SEVERAL_RULE = "- Return every requested value that is explicitly present in the retrieved context; do not substitute nearby values."


def prompt_block(rank: Column, file: Column, page: Column, content_type: Column, text: Column) -> Column:
    """What a prompt shows of a hit."""
    return F.concat_ws("\n", F.format_string("[CONTEXT %d]", rank), F.concat(F.lit("File: "), file), F.concat(F.lit("Page: "), page.cast("string")), F.concat(F.lit("Type: "), content_type), F.btrim(X.text(text)))


def prompt(question: Column, context: Column) -> Column:
    """A question's prompt; context: the blocks of its hits, null without any."""
    head = F.lit("Answer the question using only the context.\n\nRules:\n")
    several = F.when(X.wants_several_values(question), F.lit("\n" + SEVERAL_RULE)).otherwise(F.lit(""))
    tail = F.concat(F.lit("\n\nQuestion:\n"), question, F.lit("\n\nContext:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nAnswer:"))
    full = F.concat(head, F.lit("\n".join((*RULES, ABSENT_RULE))), several, tail)
    none = F.concat(head, F.lit("\n".join((*NO_CONTEXT_RULES, ABSENT_RULE))), tail)
    return F.when(context.isNull(), none).otherwise(full)


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """A prompt per question (question_id, question) from its hits in rank order."""
    block = prompt_block(F.col("rank"), F.col("file"), F.col("page_start"), F.col("content_type"), F.col("text_for_llm"))
    context = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("c"))
    context = context.select("question_id", F.array_join(F.transform("c", lambda x: x["b"]), "\n\n").alias("context"))
    return questions.join(context, "question_id", "left").select("question_id", prompt(F.col("question"), F.col("context")).alias("prompt"))
