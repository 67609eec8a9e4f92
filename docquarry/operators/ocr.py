"""OCR geometry: tokens to lines, lines to borderless tables, numeric tokens. The OCR engine itself is a provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .routes import settled
from .tables import nearest_anchor, normalize_matrix

MIN_CONFIDENCE, NUMERIC_CONFIDENCE = 35.0, 20.0
LINE = ["document_id", "page", "block_num", "par_num", "line_num"]


def needs_ocr(chars: Column, image_area: Column, page_area: Column) -> Column:
    """F02, as it works out: no text, or images over 45 hundredths of the page (an area of 1 at least)."""
    return (chars == 0) | (image_area / F.greatest(page_area, F.lit(1.0)) >= 0.45)


def pages_for_ocr(pages: DataFrame, images: DataFrame) -> DataFrame:
    """The pages to hand to an OCR provider. images: document_id, page, width, height."""
    area = images.groupBy("document_id", "page").agg(F.sum(F.col("width") * F.col("height")).alias("image_area"))
    joined = pages.join(area, ["document_id", "page"], "left").withColumn("image_area", F.coalesce("image_area", F.lit(0.0)))
    chars = F.char_length(F.btrim(X.text(F.col("text"))))
    return joined.filter(needs_ocr(chars, F.col("image_area"), F.col("page_area")))


def kept_tokens(tokens: DataFrame) -> DataFrame:
    """tokens with text and enough confidence."""
    t = tokens.withColumn("text", F.btrim(F.col("text").cast("string"))).withColumn("conf", F.col("conf").try_cast("double"))
    return t.filter(F.col("text").isNotNull() & (F.col("text") != "") & (F.coalesce("conf", F.lit(-1.0)) >= MIN_CONFIDENCE))


def lines(tokens: DataFrame) -> DataFrame:
    """A line per (block, paragraph, line): text by left edge, box, mean confidence, words, and line_no in the
    order of the lines' first words."""
    word = F.struct("left", "top", "width", "height", "text", "conf")
    grouped = kept_tokens(tokens).groupBy(*LINE).agg(
        F.array_sort(F.collect_list(word)).alias("words"),
        F.min("left").alias("x0"),
        F.min("top").alias("y0"),
        F.max(F.col("left") + F.col("width")).alias("x1"),
        F.max(F.col("top") + F.col("height")).alias("y1"),
        F.avg("conf").alias("confidence"),
        F.min(F.struct("top", "left")).alias("first"),
    )
    order = Window.partitionBy("document_id", "page").orderBy("first", "block_num", "par_num", "line_num")
    return grouped.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), " ")).withColumn("line_no", F.row_number().over(order)).drop("first")


def _cells(words: Column) -> Column:
    """A line's words cut into cells where the gap is wide: array of (x, text)."""
    step = lambda acc, w: F.when(
        (F.size(acc) > 0)
        & (w["left"] - F.element_at(acc, -1)["right"] <= F.greatest(F.lit(24.0), 1.8 * F.greatest(w["height"], F.element_at(acc, -1)["height"], F.lit(1)))),
        F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["x"].alias("x"), F.concat_ws(" ", F.element_at(acc, -1)["text"], w["text"]).alias("text"), (w["left"] + w["width"]).cast("double").alias("right"), w["height"].cast("double").alias("height"))),
        ),
    ).otherwise(F.concat(acc, F.array(F.struct(w["left"].cast("double").alias("x"), w["text"].alias("text"), (w["left"] + w["width"]).cast("double").alias("right"), w["height"].cast("double").alias("height")))))
    kind = "array<struct<x:double,text:string,right:double,height:double>>"
    return F.aggregate(words, F.array().cast(kind), lambda acc, w: step(acc, w).cast(kind))


def pair_anchors(xs: Column, tolerance: float = 35.0) -> Column:
    """Anchors of sorted positions; a position within tolerance of the last anchor moves it half way."""
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(
        F.array_sort(xs),
        F.array().cast("array<double>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.abs(x - last(acc)) <= tolerance), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array((last(acc) + x) / 2))).otherwise(F.concat(acc, F.array(x))),
    )


def table_matrix(ocr_lines: DataFrame) -> DataFrame:
    """The borderless table of each page, if its lines show one: document_id, page, matrix."""
    rows = settled(ocr_lines, cells=_cells(F.col("words"))).filter(F.size("cells") >= 2)
    page = rows.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "cells"))).alias("rows"), F.flatten(F.collect_list(F.transform("cells", lambda c: c["x"]))).alias("xs"))
    # each step is settled: a filter on it would else carry its expression into the next step's lambdas, to be worked out for every cell
    page = settled(page.filter(F.size("rows") >= 2), anchors=pair_anchors(F.col("xs"))).filter(F.size("anchors").between(2, 10))
    n = F.sequence(F.lit(0), F.size("anchors") - 1)
    placed = F.transform("rows", lambda r: F.transform(r["cells"], lambda c: F.struct(nearest_anchor(c["x"], F.col("anchors")).alias("k"), c["text"].alias("text"))))
    cell = lambda r, k: F.array_join(F.transform(F.filter(r, lambda c: c["k"] == k), lambda c: c["text"]), " ")
    page = settled(page, placed=placed)
    matrix = F.transform("placed", lambda r: F.transform(n, lambda k: cell(r, k)))
    page = settled(page, m=F.filter(matrix, lambda r: F.size(F.filter(r, lambda c: c != "")) >= 2)).filter(F.size("m") >= 2)
    full = F.filter(n, lambda k: F.size(F.filter("m", lambda r: F.get(r, k) != "")) >= 2)
    page = settled(page, keep=full).filter(F.size("keep") >= 2)
    return page.select("document_id", "page", normalize_matrix(F.transform("m", lambda r: F.transform("keep", lambda k: F.get(r, k)))).alias("matrix"))


def page_text(ocr_lines: DataFrame) -> DataFrame:
    """The OCR text of each page, with the mean confidence of its lines (0 to 1)."""
    grouped = ocr_lines.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"), (F.avg("confidence") / 100).alias("confidence"))
    return grouped.select("document_id", "page", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"), "confidence")


def numeric_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens that are numbers (O read for 0, commas dropped, percentages left out), with their centres."""
    raw = F.btrim(X.text(F.col("text")))
    clean = F.translate(raw, "Oo,", "00")
    number = F.when(F.rlike(clean, F.lit(r"^[-+]?\d+(?:\.\d+)?$")), clean.cast("double"))
    t = tokens.withColumn("value", number).filter(~F.contains(raw, F.lit("%")) & F.col("value").isNotNull() & (F.coalesce(F.col("conf").try_cast("double"), F.lit(0.0)) >= NUMERIC_CONFIDENCE))
    return t.withColumn("x", F.col("left") + F.col("width") / 2).withColumn("y", F.col("top") + F.col("height") / 2)
