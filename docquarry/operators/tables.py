"""Tables: cleaning and classifying matrices (expressions), and finding them in page geometry (per page).

A matrix is array<array<string>>. Everything that looks at one matrix is a higher-order expression. The geometric detector
is order-dependent (a line joins the first row it fits): it folds a page's sorted lines with `aggregate`, cuts tables by a window
over the page's rows and meets the words above them in a range join, all inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..session import stored

SETTINGS = config.Tables()


def normalize_matrix(m: Column) -> Column:
    """Clean cells, rows that aren't blank, padded to one width."""
    clean = F.filter(F.transform(m, lambda r: F.transform(r, X.clean_cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = lambda k: F.coalesce(F.array_max(F.transform(k, lambda r: F.size(r))), F.lit(0))
    return X.let(clean, lambda k: X.let(width(k), lambda w: F.transform(k, lambda r: F.concat(r, F.array_repeat(F.lit(""), w - F.size(r))))))


def _colon(c: Column) -> Column:
    return F.rlike(c, F.lit("[:：]$"))


def looks_like_label(c: Column) -> Column:
    """F04, for a clean cell."""
    words = F.split(c, " ")
    measured = F.rlike(c, F.lit(r"^[\d\s./+\-–—%°A-Za-z]+$")) & F.rlike(c, F.lit(r"\d"))
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]+", ""))
    known = F.arrays_overlap(bare, X.lit_array(config.LABEL_TOKENS))
    return F.when(c == "", False).when(_colon(c), True).when(measured | (F.size(words) > 7), False).otherwise(known)


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def structure(m: Column) -> Column:
    """key_value or header_table, for a normalized matrix."""
    first = F.filter(F.transform(m, lambda r: F.get(r, F.lit(0))), lambda c: c != "")
    n = F.size(first)
    ratio = lambda test: _count(first, test) / F.greatest(n, F.lit(1))
    pairs = (F.size(F.get(m, F.lit(0))) == 2) & (n > 0)
    is_pairs = _colon(F.get(F.get(m, F.lit(0)), F.lit(0))) | (ratio(_colon) >= 0.40) | (ratio(looks_like_label) >= 0.75)
    return F.when(F.coalesce(pairs & is_pairs, F.lit(False)), F.lit("key_value")).otherwise(F.lit("header_table"))


def looks_like_data(m: Column) -> Column:
    """whether the first row of a normalized matrix is data, not headers."""
    row = F.get(m, F.lit(0))
    filled = F.filter(row, lambda c: c != "")
    symbols = _count(filled, lambda c: F.rlike(c, F.lit(r"^[\s+\-–—✓✗xX]+$")))
    numbers = _count(filled, lambda c: F.rlike(c, F.lit(r"^[\d\s.,/%°+\-–—]+$")))
    unlabelled = (_count(filled, looks_like_label) == 0) & (F.size(row) >= 3)
    return F.coalesce((symbols >= 1) | (numbers >= F.greatest(F.lit(1), F.floor(F.size(row) / 2))) | unlabelled, F.lit(False))


def valid_header(header: Column, m: Column) -> Column:
    """whether a recovered row can be a header of a normalized matrix."""
    cells = F.transform(header, X.clean_cell)
    filled = F.filter(cells, lambda c: c != "")
    whole = F.array_join(filled, " ")
    refused = (
        F.rlike(whole, F.lit(r"^\s*\d+(?:\.\d+)*[.)]?\s+"))
        | F.rlike(whole, F.lit(r"(?i)^\s*(section|chapter|appendix|figure|table)\s+[A-Za-z0-9IVX.-]+\b"))
        | (F.size(F.split(whole, r"\s+")) > 10)
        | F.rlike(whole, F.lit("[.;]$"))
        | F.rlike(F.get(filled, F.lit(0)), F.lit(r"^\s*\d+(?:\.\d+)*[.)]?"))
        | (cells == F.get(m, F.lit(0)))
    )
    return F.coalesce((F.size(filled) >= 2) & ~refused, F.lit(False))


def _pipe(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def _markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _headers(m: Column) -> Column:
    return F.transform(F.get(m, F.lit(0)), lambda c, i: F.when(c == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(c))


def _body(m: Column) -> Column:
    return F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))


def header_markdown(m: Column) -> Column:
    """P05."""
    rule = F.transform(F.get(m, F.lit(0)), lambda c: F.lit("---"))
    rows = F.concat(F.array(F.transform(_headers(m), _pipe), rule), F.transform(_body(m), lambda r: F.transform(r, _pipe)))
    return F.when(F.size(m) > 0, F.array_join(F.transform(rows, _markdown_row), "\n")).otherwise(F.lit(""))


def _pair(r: Column) -> tuple[Column, Column]:
    return X.strip_label(F.get(r, F.lit(0))), X.clean_cell(F.get(r, F.lit(1)))


def pairs_markdown(m: Column) -> Column:
    """P06."""
    rows = F.transform(m, lambda r: F.struct(_pair(r)[0].alias("f"), _pair(r)[1].alias("v")))
    kept = F.filter(rows, lambda p: (p["f"] != "") | (p["v"] != ""))
    lines = F.transform(kept, lambda p: F.concat(F.lit("| "), _pipe(p["f"]), F.lit(" | "), _pipe(p["v"]), F.lit(" |")))
    return F.when(F.size(m) > 0, F.array_join(F.concat(F.array(F.lit("| Field | Value |"), F.lit("| --- | --- |")), lines), "\n")).otherwise(F.lit(""))


def header_embedding(m: Column) -> Column:
    """P07."""
    headers = _headers(m)
    line = lambda r: F.array_join(F.filter(F.zip_with(headers, r, lambda h, v: F.when(v != "", F.concat(h, F.lit(": "), v))), lambda x: x.isNotNull()), "; ")
    rows = F.filter(F.transform(_body(m), line), lambda x: x != "")
    return F.when(F.size(rows) > 0, F.array_join(rows, "\n")).otherwise(F.array_join(F.transform(m, lambda r: F.array_join(r, " | ")), "\n"))


def pairs_embedding(m: Column) -> Column:
    """P08."""
    rows = F.transform(m, lambda r: F.concat_ws(": ", F.nullif(_pair(r)[0], F.lit("")), F.nullif(_pair(r)[1], F.lit(""))))
    return F.array_join(F.filter(rows, lambda x: x != ""), "\n")


def formatted(df: DataFrame, matrix: str = "matrix") -> DataFrame:
    """Matrix (normalized), structure, embedding_text and markdown of each table."""
    m = df.withColumn(matrix, normalize_matrix(F.col(matrix))).withColumn("structure", structure(F.col(matrix)))
    pairs = F.col("structure") == "key_value"
    c = F.col(matrix)
    return m.withColumns({"embedding_text": F.when(pairs, pairs_embedding(c)).otherwise(header_embedding(c)), "markdown": F.when(pairs, pairs_markdown(c)).otherwise(header_markdown(c))})


def column_anchors(xs: Column, tolerance: float = SETTINGS.x_tolerance) -> Column:
    """Means of clusters of sorted positions; a position joins the last cluster within tolerance of its running mean."""
    cluster = "struct<s:double,n:double>"
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.abs(x - F.element_at(acc, -1)["s"] / F.element_at(acc, -1)["n"]) <= tolerance),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((F.element_at(acc, -1)["s"] + x).alias("s"), (F.element_at(acc, -1)["n"] + 1.0).alias("n")))),
    ).otherwise(F.concat(acc, F.array(F.struct(x.alias("s"), F.lit(1.0).alias("n")))))
    sorted_xs = F.array_sort(F.transform(xs, lambda x: x.cast("double")))
    folded = F.aggregate(sorted_xs, F.array().cast(f"array<{cluster}>"), lambda acc, x: step(acc, x).cast(f"array<{cluster}>"))
    return F.transform(folded, lambda c: c["s"] / c["n"])


def nearest_anchor(x: Column, anchors: Column) -> Column:
    """Index (from 0) of the nearest anchor; of two as near, the left one."""
    return F.array_min(F.transform(anchors, lambda a, i: F.struct(F.abs(x - a).alias("d"), i.alias("i"))))["i"]


def box_union(boxes: Column) -> Column:
    """The box around all boxes that have four numbers; null if there is none."""
    good = F.filter(boxes, lambda b: b.isNotNull() & (F.size(b) == 4))
    side = lambda f, k: f(F.transform(good, lambda b: F.get(b, F.lit(k))))
    return F.when(F.size(good) > 0, F.array(side(F.array_min, 0), side(F.array_min, 1), side(F.array_max, 2), side(F.array_max, 3)))


def words_above(tables: DataFrame, words: DataFrame, gap: float = SETTINGS.header_gap) -> DataFrame:
    """Words of the page in the band above each table that overlap it sideways. An equi-join on the page with a
    range condition; tables have left, top, right, words x0, y0, x1, y1."""
    t, w = tables.alias("t"), words.alias("w")
    on = (F.col("t.document_id") == F.col("w.document_id")) & (F.col("t.page") == F.col("w.page"))
    band = (F.col("w.y1") <= F.col("t.top")) & (F.col("w.y0") >= F.greatest(F.lit(0.0), F.col("t.top") - gap))
    across = (F.col("w.x1") >= F.col("t.left")) & (F.col("w.x0") <= F.col("t.right"))
    return t.join(w, on & band & across & (X.clean_cell(F.col("w.text")) != "")).select("t.table_id", "w.*")


def segments(df: DataFrame, keys: list[str], start: str, end: str, gap: float = SETTINGS.gap, ties: Sequence[str] = ()) -> DataFrame:
    """Rows in order of start (then of ties, else of end), cut where the next start lies more than gap behind the last end
    (segment from 0)."""
    w = Window.partitionBy(*keys).orderBy(start, *(ties or [end]))
    new = F.coalesce((F.col(start) - F.lag(end).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


# -- page geometry: folds over a page's sorted lines, in expressions -------------------------------------------------

CELL = "struct<x0:double,place:bigint,y0:double,x1:double,y1:double,text:string>"


def _cells(order: str) -> Column:
    """A page's lines or words as one array, by `order`."""
    number = lambda c: F.col(c).cast("double").alias(c)
    place = F.col(order).cast("bigint").alias("place")
    return F.array_sort(F.collect_list(F.struct(place, number("x0"), number("y0"), number("x1"), number("y1"), F.col("text"))))


def _as_cells(lines: Column) -> Column:
    """The elements with x0 first, so that sorting goes by x0 and then by reading order."""
    return F.transform(lines, lambda c: F.struct(c["x0"].alias("x0"), c["place"].alias("place"), c["y0"].alias("y0"), c["x1"].alias("x1"), c["y1"].alias("y1"), c["text"].alias("text")))


def first_fit(cells: Column, near, start, joined, state: str) -> Column:
    """Rows of cells, in the order in which they begin: a cell joins the first row that it is near to, else it begins one.
    near(row, cell), start(cell) and joined(row, cell) work on rows of the struct type `state`."""
    rows = f"array<{state}>"

    def step(acc: Column, cell: Column) -> Column:
        grown = lambda at: F.transform(acc, lambda r, i: F.when(i + 1 == at, joined(r, cell).cast(state)).otherwise(r))
        taken = lambda at: F.when(at == 0, F.concat(acc, F.array(start(cell)).cast(rows))).otherwise(grown(at)).cast(rows)
        return X.let(F.array_position(F.transform(acc, lambda r: near(r, cell)), True), taken)

    return F.aggregate(cells, F.array().cast(rows), step)


def visual_lines(cells: Column, tolerance: float) -> Column:
    """Rows of cells whose y0 lies near that of a row's first cell."""
    return F.transform(
        first_fit(
            cells,
            lambda r, c: F.abs(c["y0"] - r["y"]) < tolerance,
            lambda c: F.struct(c["y0"].alias("y"), F.array(c).alias("cells")),
            lambda r, c: F.struct(r["y"].alias("y"), F.concat(r["cells"], F.array(c)).alias("cells")),
            f"struct<y:double,cells:array<{CELL}>>",
        ),
        lambda r: r["cells"],
    )


def header_lines(cells: Column, tolerance: float) -> Column:
    """Rows of words near to the running mean of a row's y0."""
    return F.transform(
        first_fit(
            cells,
            lambda r, c: F.abs(c["y0"] - r["y"] / r["n"]) <= tolerance,
            lambda c: F.struct(c["y0"].alias("y"), F.lit(1.0).alias("n"), F.array(c).alias("cells")),
            lambda r, c: F.struct((r["y"] + c["y0"]).alias("y"), (r["n"] + 1.0).alias("n"), F.concat(r["cells"], F.array(c)).alias("cells")),
            f"struct<y:double,n:double,cells:array<{CELL}>>",
        ),
        lambda r: r["cells"],
    )


def placed(cells: Column, anchors: Column) -> Column:
    """A row's texts by their nearest column; several in one column are joined."""
    dealt = F.transform(cells, lambda c: F.struct(nearest_anchor(c["x0"], anchors).alias("i"), X.clean_cell(c["text"]).alias("t")))
    return X.let(dealt, lambda d: F.transform(anchors, lambda a, i: F.array_join(F.transform(F.filter(d, lambda c: (c["i"] == i) & (c["t"] != "")), lambda c: c["t"]), " ")))


def _around(cells: Column) -> Column:
    side = lambda f, k: f(F.transform(cells, lambda c: c[k]))
    return F.array(side(F.array_min, "x0"), side(F.array_min, "y0"), side(F.array_max, "x1"), side(F.array_max, "y1"))


def page_tables(lines: DataFrame, settings: config.Tables = SETTINGS) -> DataFrame:
    """document_id, page, table_index, matrix, anchors, bbox of the tables in each page's lines: rows of several
    lines that are aligned with others, cut at wide gaps."""
    page = ["document_id", "page"]
    # by page, whatever the lines come by: pages of few large documents go to many tasks
    read = lines.filter(F.btrim(F.coalesce("text", F.lit(""))) != "").repartition(*page).groupBy(*page).agg(_cells("line_no").alias("c"))
    wide = lambda r: F.transform(F.filter(r, lambda x: F.size(x) > 1), lambda x: F.array_sort(x))
    starts = lambda r: F.flatten(F.transform(r, lambda x: F.transform(x, lambda c: c["x0"])))
    shared = lambda c, xs: F.size(F.filter(xs, lambda x: F.abs(x - c["x0"]) <= settings.x_tolerance)) > 1
    fitting = lambda r: X.let(starts(r), lambda xs: F.filter(r, lambda x: F.exists(x, lambda c: shared(c, xs))))
    rows = X.let(wide(visual_lines(_as_cells(F.col("c")), settings.y_tolerance)), fitting)
    # one expression a step and outer generators: a filter that is pushed through would hold copies of all that its columns come from
    aligned = read.select(*page, F.posexplode_outer(rows).alias("row_no", "cells")).filter("row_no IS NOT NULL")
    head = F.get("cells", F.lit(0))
    cut = segments(aligned.select(*page, "row_no", "cells", head["y0"].alias("start"), head["y1"].alias("end")), page, "start", "end", settings.gap, ["row_no"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "row_no", "cells"))), lambda r: r["cells"])
    grouped = cut.groupBy(*page, "segment").agg(ordered.alias("rows")).filter(F.size("rows") >= settings.min_rows)
    anchored = F.struct("rows", column_anchors(F.transform(F.flatten("rows"), lambda c: c["x0"]), settings.x_tolerance).alias("anchors"), _around(F.flatten("rows")).alias("bbox"))
    matrix = lambda t: F.filter(F.transform(t["rows"], lambda r: placed(r, t["anchors"])), lambda r: F.exists(r, lambda c: c != ""))
    columned = F.filter(F.array(anchored), lambda t: F.size(t["anchors"]) >= settings.min_columns)
    shaped = F.transform(columned, lambda t: F.struct(matrix(t).alias("matrix"), t["anchors"].alias("anchors"), t["bbox"].alias("bbox")))
    kept = F.filter(shaped, lambda t: F.size(t["matrix"]) >= settings.min_rows)
    found = grouped.select(*page, "segment", F.inline_outer(kept)).filter("matrix IS NOT NULL")
    index = F.row_number().over(Window.partitionBy(*page).orderBy("segment"))
    return found.select(*page, index.alias("table_index"), "matrix", "anchors", "bbox")


def header_candidates(found: DataFrame, words: DataFrame, settings: config.Tables = SETTINGS) -> DataFrame:
    """document_id, page, table_index and candidates (header, bbox) of the tables that have words above them, the
    nearest row first. found: page_tables()."""
    key = ["document_id", "page", "table_index"]
    side = lambda k: F.get("bbox", F.lit(k))
    boxes = found.select(F.struct(*key).alias("table_id"), "document_id", "page", side(0).alias("left"), side(1).alias("top"), side(2).alias("right"))
    above = words_above(boxes, words, settings.header_gap).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in ("y0", "x0")), F.col("word_no").cast("bigint").alias("place"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1")), "text"))).alias("words"))
    rows = above.select("table_id.*", F.posexplode_outer(header_lines(_as_cells(F.col("words")), settings.header_y_tolerance)).alias("row_no", "cells")).filter("row_no IS NOT NULL")
    met = rows.join(found.select(*key, "anchors", side(1).alias("top")), key)
    boxed = met.withColumns({"cells": F.array_sort("cells"), "box": _around(F.col("cells"))}).filter((F.col("top") - F.get("box", F.lit(3))).between(0, settings.header_gap))
    one = F.struct((-F.get("box", F.lit(1))).alias("up"), "row_no", placed(F.col("cells"), F.col("anchors")).alias("header"), F.col("box").alias("bbox"))
    return boxed.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(one)), lambda c: F.struct(c["header"].alias("header"), c["bbox"].alias("bbox"))).alias("candidates"))


def detect(lines: DataFrame, words: DataFrame, settings: config.Tables = SETTINGS) -> DataFrame:
    """The tables of every page: document_id, page, table_index, matrix, bbox, header_recovered.
    lines: document_id, page, line_no, text, x0, y0, x1, y1; words alike with word_no. Lines and words without a place
    (nulls) fit nothing; blank ones are left out; a page is folded as one array, pages are independent."""
    whole = lambda df: df.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("x0", "y0", "x1", "y1")))
    found = stored(page_tables(whole(lines), settings), "tables")  # used three times
    above = header_candidates(found, whole(words), settings)
    m = found.join(above, ["document_id", "page", "table_index"], "left").withColumn("matrix", normalize_matrix(F.col("matrix")))
    good = F.filter("candidates", lambda c: valid_header(c["header"], F.col("matrix")))
    first = F.when(looks_like_data(F.col("matrix")), F.get(good, F.lit(0)))
    return (
        m.withColumn("first", first)
        .withColumn("header_recovered", F.col("first").isNotNull())
        .withColumn("matrix", F.when(F.col("header_recovered"), normalize_matrix(F.concat(F.array(F.col("first")["header"]), F.col("matrix")))).otherwise(F.col("matrix")))
        .withColumn("bbox", F.when(F.col("header_recovered"), box_union(F.array(F.col("bbox"), F.col("first")["bbox"]))).otherwise(F.col("bbox")))
        .select("document_id", "page", "table_index", "matrix", "bbox", "header_recovered")
    )


def with_fallback(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """A second detector's tables, on pages where the first found none."""
    pages = found.select("document_id", "page").distinct()
    return found.unionByName(fallback.join(pages, ["document_id", "page"], "left_anti"), allowMissingColumns=True)


def table_items(found: DataFrame, documents: DataFrame, content_type: str = "table", method: str = "geometric_table_detection", confidence: float = 1.0) -> DataFrame:
    """Table items with structure and sizes."""
    from .corpus import make_items

    shaped = formatted(found).join(documents.select("document_id", "file", "doc_type"), "document_id")
    sized = shaped.withColumns(
        {
            "ordinal": F.col("table_index"),
            "text_for_embedding": F.col("embedding_text"),
            "text_for_llm": F.concat(F.lit("[TABLE]\nSource: "), "file", F.lit(", page "), F.col("page").cast("string"), F.lit("\n\n"), "markdown"),
            "table_structure_type": F.col("structure"),
            "total_rows": F.size("matrix"),
            "header_rows": F.when(F.col("structure") == "header_table", 1).otherwise(0),
            "data_rows": F.size("matrix") - F.when(F.col("structure") == "header_table", 1).otherwise(0),
            "columns": F.size(F.get("matrix", F.lit(0))),
            "structured_data": F.col("matrix"),
        }
    )
    return make_items(sized, content_type, method, confidence, "table_index", "table_structure_type", "total_rows", "header_rows", "data_rows", "columns", "structured_data", "bbox")
