"""The whole way in and out: files and decoded pages to a corpus (E06, S16), and questions to answers.

Decoders hand in frames; every frame is optional. Content that a decoder couldn't read is a warning of its document, not a
failure of the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..session import stored
from ..sources import files as S
from . import charts, corpus, digitize, ocr, retrieval, routes, tables
from .numbering import numbered
from .providers import Embedder, Generator, OcrProvider

ITEM_ORDER = ["branch", "document_id", "page_start", "ordinal", "chunk_index", "source_id"]
#: Confidence of a plot whose reader gives none.
PLOT_CONFIDENCE = 0.8


@dataclass
class Decoded:
    """What decoders found, by document_id and page: digital page text, layout lines and words, OCR tokens, plots that were read
    elsewhere (plot_rows, series_names, confidence), and images of charts (chart_id and the columns of digitize) with their
    OCR tokens, which are digitized here."""

    pages: DataFrame | None = None
    lines: DataFrame | None = None
    words: DataFrame | None = None
    ocr_tokens: DataFrame | None = None
    plots: DataFrame | None = None
    chart_images: DataFrame | None = None
    chart_tokens: DataFrame | None = None


@dataclass
class Corpus:
    documents: DataFrame
    items: DataFrame
    vectors: DataFrame
    centroids: DataFrame
    warnings: DataFrame
    persisted_to: str | None = None


def _known(df: DataFrame, documents: DataFrame) -> DataFrame:
    return df.join(documents.select("document_id", "file", "doc_type"), "document_id")


def _texts(df: DataFrame, text: str = "text"):
    return df.withColumn("text_for_embedding", F.col(text)).withColumn("text_for_llm", F.col(text))


@dataclass
class Parts:
    """What files hold, each decoded once: text files, DOCX files and sheets (kind: csv or xlsx)."""

    plain: DataFrame
    docx: DataFrame
    sheets: DataFrame


def file_parts(files: DataFrame, documents: DataFrame) -> Parts:
    """Decoded TXT, DOCX, CSV and XLSX files, stored. files: file_path, content."""
    own = documents.join(files.select("file_path", "content"), "file_path")
    kind = lambda k: own.filter(F.col("file_kind") == k).select("document_id", "content")
    plain = kind("txt").select("document_id", F.lit(1).alias("page"), S.decode_text(F.col("content")).alias("text"))
    sheets = S.read_xlsx(kind("xlsx")).withColumn("kind", F.lit("xlsx")).unionByName(S.read_csv_content(kind("csv")).withColumn("kind", F.lit("csv")))
    return Parts(plain, stored(S.read_docx(kind("docx")), "docx"), stored(sheets, "sheets"))


def registered(files: DataFrame, decoded: Decoded) -> tuple[DataFrame, Parts]:
    """The registry with types from text samples (PDF files by their first pages) and numbers of pages or sheets,
    and the decoded parts."""
    documents = stored(S.registry(S.validate(files)), "registry")
    parts = file_parts(files, documents)
    samples = parts.docx.select("document_id", S.text_sample(F.col("text")).alias("sample"))
    units = parts.sheets.filter("error IS NULL AND kind = 'xlsx'").select("document_id")
    if decoded.pages is not None:
        samples = samples.unionByName(S.page_sample(decoded.pages.join(samples.select("document_id"), "document_id", "left_anti")))
        units = units.unionByName(decoded.pages.select("document_id", "page").distinct().select("document_id"))
    return stored(S.unit_counts(S.typed(documents, samples), units), "registry"), parts


def file_items(parts: Parts, documents: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Items of TXT, DOCX, CSV and XLSX files, and warnings (document_id, warning)."""
    plain, docx = parts.plain, parts.docx
    words = docx.select("document_id", F.lit(1).alias("page"), "text")
    texts = [corpus.page_items(_known(plain, documents), "text_file"), corpus.page_items(_known(words, documents), "python_docx")]
    cells = docx.select("document_id", F.lit(1).alias("page"), F.posexplode("tables").alias("i", "matrix")).select("document_id", "page", (F.col("i") + 1).alias("table_index"), "matrix")
    cells = cells.withColumn("matrix", tables.normalize_matrix(F.col("matrix"))).filter((F.size("matrix") >= 2) & (F.size(F.get("matrix", F.lit(0))) >= 2))
    of = lambda k: parts.sheets.filter((F.col("kind") == k) & F.col("error").isNull() & (F.size("matrix") >= 2))
    sheets, sheet = (of(k).select("document_id", "page", F.lit(1).alias("table_index"), "matrix") for k in ("xlsx", "csv"))
    box = F.lit(None).cast("array<double>").alias("bbox")
    found = [tables.table_items(t.select("*", box), documents, "table", method) for t, method in ((cells, "docx_table"), (sheets, "xlsx_sheet"), (sheet, "csv_file"))]
    failed = docx.withColumn("kind", F.lit("docx")).select("document_id", "kind", "error").unionByName(parts.sheets.select("document_id", "kind", "error"))
    return [*texts, *found], failed.filter("error IS NOT NULL").select("document_id", F.concat_ws(": ", "kind", "error").alias("warning"))


def build(files: DataFrame, decoded: Decoded = Decoded(), embedder: Embedder = Embedder(), enable_ocr: bool = True, enable_plots: bool = True, ocr_provider: OcrProvider | None = None, persist_to: str | None = None) -> Corpus:
    """Registry, items of all branches in fixed order, chunks, dedup, vectors, counts and centroids.
    files: input_pos, file_path, size_bytes, content. ocr_provider reads image files (S15); without one they are registered
    with a warning. persist_to: a folder in which the corpus is saved. Files without any content to search are an error."""
    documents, parts = registered(files, decoded)
    branches, warnings = file_items(parts, documents)
    if decoded.pages is not None:
        branches.insert(0, corpus.page_items(_known(decoded.pages, documents)))
    if decoded.lines is not None and decoded.words is not None:
        branches.append(tables.table_items(tables.detect(decoded.lines, decoded.words), documents))
    images = documents.filter("file_kind = 'image'").join(files.select("file_path", "content"), "file_path")
    tokens = decoded.ocr_tokens
    if ocr_provider is not None:
        seen = ocr_provider.tokens(images.select("document_id", F.lit(1).alias("page"), "content"))
        tokens = seen if tokens is None else tokens.unionByName(seen, allowMissingColumns=True)
    else:
        known = images if tokens is None else images.join(tokens.select("document_id"), "document_id", "left_anti")
        warnings = warnings.unionByName(known.select("document_id", F.lit("image: no OCR provider is configured").alias("warning")))
    if tokens is not None:
        read = ocr.lines(tokens)
        if enable_ocr:
            branches.append(corpus.make_items(_known(_texts(ocr.page_text(read)), documents).withColumn("ordinal", F.lit(1)), "ocr_text", "tesseract_ocr"))
        shaped = ocr.table_matrix(read).select("document_id", "page", F.lit(1).alias("table_index"), "matrix", F.lit(None).cast("array<double>").alias("bbox"))
        branches.append(tables.table_items(shaped, documents, "ocr_table", "ocr_geometry"))
    plots = decoded.plots
    if decoded.chart_images is not None and decoded.chart_tokens is not None and enable_plots:
        found = digitize.digitize(decoded.chart_images, decoded.chart_tokens)
        found = found.join(decoded.chart_images.select("chart_id", "document_id", "page"), "chart_id").select("document_id", "page", "plot_rows", "series_names", "confidence")
        plots = found if plots is None else plots.unionByName(found, allowMissingColumns=True)
    if plots is not None and enable_plots:
        matrix, lines = charts.plot_texts(F.col("plot_rows"), F.col("series_names"))
        sure = F.coalesce(F.col("confidence"), F.lit(PLOT_CONFIDENCE)) if "confidence" in plots.columns else F.lit(PLOT_CONFIDENCE)
        shown = _known(plots.withColumn("confidence", sure), documents).withColumn("matrix", matrix).withColumn("text_for_embedding", lines)
        shown = shown.withColumn("text_for_llm", F.concat(F.lit("[PLOT-DERIVED TABLE — APPROXIMATE]\n\n"), tables.header_markdown(F.col("matrix"))))
        shown = shown.withColumn("ordinal", F.row_number().over(Window.partitionBy("document_id", "page").orderBy("text_for_embedding")))
        branches.append(corpus.make_items(shown, "plot_table", "chart_digitization", F.col("confidence"), "plot_rows", "series_names"))
    chunks = stored(corpus.chunk_items(corpus.union_items(branches)), "chunks")
    items = corpus.dedup_items(chunks, ITEM_ORDER)
    # numbers in the order of the branches, documents, pages and chunks: ties in scores go by them; stored, since all else reads them
    items = stored(numbered(retrieval.check_index(items), ITEM_ORDER, "item_seq"), "items")
    if items.isEmpty():
        raise ValueError("No searchable content was extracted from the uploaded files.")
    vectors = stored(items.select("item_seq", "document_id", embedder.column(F.col("text_for_embedding")).alias("embedding")), "vectors")
    covered = stored(corpus.coverage(documents, items), "covered")
    if persist_to is not None:
        corpus.save_corpus(persist_to, items, covered, vectors)
    return Corpus(covered, items, vectors, corpus.centroids(vectors), warnings, persist_to)


def ask(questions: DataFrame, found: Corpus, top_k: int = 2, embedder: Embedder = Embedder(), generator: Generator = Generator()) -> DataFrame:
    """Answers to a batch of questions (question_id, question, and optional filters) over a corpus."""
    asked = questions.withColumn("embedding", embedder.column(X.text(F.col("question"))))
    items = found.items
    for name, kind in (("table_structure_type", "string"), ("structured_data", "array<array<string>>"), ("plot_rows", f"array<{charts.ROW}>"), ("series_names", "array<string>")):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    hits = retrieval.hybrid(asked, items, found.vectors.select("item_seq", "embedding"), max(1, top_k))
    valid = items.filter(charts.plot_valid(F.col("content_type"), F.col("plot_rows"), F.col("confidence")))
    shown = valid.withColumn("search_text", charts.search_text(F.col("file"), F.col("text_for_embedding"), F.col("text_for_llm"), F.col("series_names")))
    ranked = retrieval.plot_hits(asked, shown.withColumn("embedding", embedder.column(F.col("search_text"))), top_k)
    plots = ranked.join(valid.select("item_seq", "plot_rows", "series_names", "confidence"), "item_seq")
    return routes.answers(questions, hits, plots, generator)
