"""From images of charts and their OCR tokens to plot rows. One image is one row; all else are joins and aggregates.

images: chart_id, width, height, rgb (width * height * 3 bytes by rows) and context (the page's text); tokens: chart_id and
OCR tokens (block_num, par_num, line_num, text, conf, left, top, width, height in the image). Images without two axes, with a
scale that the calibration refuses, or without a series that has three values give no row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import charts, lines, ocr
from .routes import settled

# Words of lines that are no legend entries, and how many entries there are at most.
NO_ENTRY = ("week", "trial duration", "symptom score", "figure")
MOST_ENTRIES = 6
#: Pixels between the topmost y tick and the top of the plot.
ABOVE_TICKS = 55


def axis_boxes(images: DataFrame, groups: DataFrame) -> DataFrame:
    """chart_id, left, top, right, bottom, method: the best pair of lines, else what both axes' ticks span. images may be what
    lines.seen() found in them."""
    seen = images if "lines" in images.columns else lines.seen(images)
    pairs = stored(lines.axis_pairs(seen.select("chart_id", "width", "height", F.inline("lines"))), "axes").withColumn("method", F.lit("lines"))
    spanned = charts.axis_box(groups).withColumn("method", F.lit("ticks"))
    return pairs.unionByName(spanned.join(pairs, "chart_id", "left_anti"))


def scales(images: DataFrame, tokens: DataFrame) -> DataFrame:
    """chart_id, box (left, top, right, bottom), the unrefined box as found (by lines, or by ticks where there
    are no two axes), x values and pixels, the y line, points, and reason (accepted or why not). Images are read once."""
    seen = stored(lines.seen(images, "context"), "lines")
    sizes = seen.select("chart_id", F.col("width").alias("w"), F.col("height").alias("h"), "context")
    numbers = ocr.numeric_tokens(tokens).select("chart_id", "value", "x", "y").join(sizes.drop("context"), "chart_id")
    groups = stored(charts.tick_groups(numbers.select("chart_id", "value", "x", "y", F.col("w").alias("width"), F.col("h").alias("height"))), "ticks")
    found = axis_boxes(seen, groups)
    fits = charts.fit_axes(groups.select("chart_id", "axis", F.explode("ticks").alias("t")).select("chart_id", "axis", F.col("t.along").alias("pixel"), F.col("t.value").alias("value")))
    x = charts.fill_ticks(fits, found).join(fits.filter("axis = 'x'").select("chart_id", F.col("points").alias("x_points")), "chart_id")
    y = fits.filter("axis = 'y'").select("chart_id", "slope", "intercept", "rmse", F.col("points").alias("y_points"), F.col("tick_values").alias("y_values"), F.col("tick_pixels").alias("y_pixels"))
    base = groups.filter("axis = 'x'").select("chart_id", F.get("ticks", F.lit(0))["across"].alias("base"))
    met = settled(x, values=F.col("values"), pixels=F.col("pixels")).join(y, "chart_id").join(found.select("chart_id", F.struct("left", "top", "right", "bottom").alias("found")), "chart_id").join(base, "chart_id").join(sizes, "chart_id")
    whole = lambda c: F.rint(c).cast("int")
    box = F.struct(whole(F.array_min("pixels")).alias("left"), F.greatest(F.lit(0), whole(F.array_min("y_pixels") - ABOVE_TICKS)).alias("top"), whole(F.array_max("pixels")).alias("right"), whole(F.col("base")).alias("bottom"))
    reason = charts.calibration(F.col("values"), F.col("pixels"), F.col("y_values"), F.col("rmse"), F.col("context"))
    return settled(met, box=box, reason=reason).select("chart_id", "box", "found", "values", "pixels", "slope", "intercept", "rmse", F.least("x_points", "y_points").alias("points"), "reason")


def _pixels(rgb: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(rgb, np.uint8).reshape(height, width, 3)


def _entry(text: str) -> str | None:
    """A legend line's text, or None if it can't be one."""
    line = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text)).strip(" -|")
    if len(re.findall("[A-Za-z]", line)) < 5 or any(word in line.lower() for word in NO_ENTRY):
        return None
    return re.sub("^[^A-Za-z]+", "", line)


def legend_lines(tokens: DataFrame, accepted: DataFrame) -> DataFrame:
    """chart_id, lines (top, bottom, text, edge, axis): the words in the lower left of the plot and beside it."""
    placed = tokens.join(accepted.select("chart_id", "box"), "chart_id")
    width, height = F.col("box.right") - F.col("box.left"), F.col("box.bottom") - F.col("box.top")
    edge = F.greatest(F.lit(0), (F.col("box.left") - 0.5 * width).cast("int"))
    inside = (F.col("left") >= edge) & (F.col("left") + F.col("width") <= F.col("box.left") + 0.58 * width) & (F.col("top") >= F.col("box.top") + 0.45 * height) & (F.col("top") + F.col("height") <= F.col("box.bottom"))
    read = placed.filter(inside & (F.btrim("text") != "")).groupBy("chart_id", "block_num", "par_num", "line_num")
    line = read.agg(F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.array_sort(F.collect_list(F.struct("left", "text"))).alias("t"), F.first(edge).alias("edge"), F.first("box.left").alias("axis"))
    return line.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("top", "bottom", F.array_join("t.text", " ").alias("text"), "edge", "axis"))).alias("lines"))


def _series(pixels: np.ndarray, box: dict, xs: list[float]) -> Iterator[tuple]:
    """label_hint, colour and samples (y in the box at each tick) of each series."""
    crop = pixels[box["top"] : box["bottom"] + 1, max(0, box["left"]) : box["right"] + 1]
    at = [float(x) - box["left"] for x in xs]
    for m in charts.colour_masks(crop) if crop.size else []:
        yield m["label_hint"], *(m["center_rgb"] or (None, None, None)), charts.sample_series(m["mask"], at)


def _entries(pixels: np.ndarray, lines: list[dict]) -> Iterator[tuple]:
    """Text and colour of the swatch (None without one) of each legend entry."""
    seen = []
    for e in lines:
        text = _entry(e["text"])
        if not text or text in seen or len(seen) == MOST_ENTRIES:
            continue
        seen.append(text)
        middle, half = (e["top"] + e["bottom"]) // 2, max(4, (e["bottom"] - e["top"]) // 4)
        swatch = pixels[max(0, middle - half) : middle + half, e["edge"] : e["edge"] + max(40, e["axis"] - e["edge"])].reshape(-1, 3).astype(float)
        strong = swatch[charts._saturated(swatch, 60, (60, 252))] if len(swatch) else swatch
        yield text, *(np.median(strong, axis=0).tolist() if len(strong) >= 10 else (None, None, None)), None


def measured(images: DataFrame, tokens: DataFrame, accepted: DataFrame) -> DataFrame:
    """C06-C09, from one look at each image: chart_id, what (series or entry), pos (from 1), text (a series' label_hint, an entry's
    text), r, g, b (null where there is no colour) and samples (of series)."""
    kind = "chart_id string, what string, pos int, text string, r double, g double, b double, samples array<double>"

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                pixels = _pixels(row.rgb, row.width, row.height)
                out.extend((row.chart_id, "series", i, *s) for i, s in enumerate(_series(pixels, row.box, row.pixels), 1))
                out.extend((row.chart_id, "entry", i, *e) for i, e in enumerate(_entries(pixels, row.lines if row.lines is not None else ()), 1))
            yield pd.DataFrame(out, columns=["chart_id", "what", "pos", "text", "r", "g", "b", "samples"])

    asked = accepted.select("chart_id", "box", "pixels").join(legend_lines(tokens, accepted), "chart_id", "left")
    whole = images.hint("merge").join(asked, "chart_id").select("chart_id", F.col("width").cast("int"), F.col("height").cast("int"), "rgb", "box", "pixels", "lines")
    return whole.mapInPandas(look, kind)


def digitize(images: DataFrame, tokens: DataFrame) -> DataFrame:
    """chart_id, plot_rows, series_names, confidence and box of every chart that could be read. What images show is small and
    used by several branches: it is stored, so the images are read twice (for lines, then for series and legend) and no more. Images
    are never broadcast (a merge is asked for): compressed, a thousand of them look small."""
    accepted = stored(scales(images, tokens).filter("reason = 'accepted'"), "scales")
    looked = stored(measured(images, tokens, accepted), "looked")
    entries = looked.filter("what = 'entry'").select("chart_id", F.col("pos").alias("entry_pos"), "text", "r", "g", "b")
    at = F.transform("pixels", lambda x: x - F.col("box.left"))
    width = (F.col("box.right") - F.col("box.left") + 1).cast("double")
    read = looked.filter("what = 'series'").select("chart_id", F.col("pos").alias("series_pos"), F.col("text").alias("label_hint"), "r", "g", "b", "samples").join(accepted.select("chart_id", "box", "pixels"), "chart_id")
    series = charts.distinct_series(read.withColumn("quality", charts.series_quality(F.col("samples"), at, width)).filter("quality > 0").drop("box", "pixels"))
    n = entries.groupBy("chart_id").agg(F.count("*").alias("n"))
    best = Window.partitionBy("chart_id").orderBy(F.desc("quality"), "series_pos")
    kept = series.join(n, "chart_id", "left").withColumn("place", F.row_number().over(best)).filter("n IS NULL OR place <= n").drop("n", "place")
    named = charts.assign_labels(kept, entries).join(kept.select("chart_id", "series_pos", "samples"), ["chart_id", "series_pos"])
    values = charts.to_values(F.col("samples"), F.col("box.top"), F.col("slope"), F.col("intercept"))
    valued = settled(named.join(accepted, "chart_id"), samples=F.col("samples")).select("*", values.alias("v"), F.size(F.filter("samples", lambda y: y.isNotNull())).alias("n"))
    level = F.get(F.array_sort(F.filter("samples", lambda y: y.isNotNull())), F.floor(F.col("n") / 2).cast("int"))
    shown = F.array_sort(F.collect_list(F.struct(level.alias("level"), "series_pos", "label", "v", "n")))
    one = valued.groupBy("chart_id").agg(shown.alias("s"), F.first("values").alias("xs"), F.first("points").alias("points"), F.first("box").alias("box"))
    row = lambda x, i: F.struct(x.alias("x"), F.transform("s", lambda c: F.get(c["v"], i)).alias("values"), F.lit(charts.NOTE).alias("uncertainty_note"))
    repaired = settled(settled(one, rows=F.transform("xs", row)), rows=charts.repair_baseline(F.col("rows")))
    full = lambda c: c["n"] >= 3
    only = lambda r: F.struct(r["x"].alias("x"), F.filter(r["values"], lambda v, i: full(F.get("s", i))).alias("values"), r["uncertainty_note"].alias("uncertainty_note"))
    named_ = F.transform(F.filter("s", full), lambda c: c["label"])
    covered = F.aggregate(F.filter("s", full), F.lit(0.0), lambda a, c: a + c["n"] / F.size("xs")) / F.greatest(F.size(F.filter("s", full)), F.lit(1))
    out = repaired.select("chart_id", F.transform("rows", only).alias("plot_rows"), named_.alias("series_names"), charts.chart_confidence(F.col("points"), covered).alias("confidence"), "box")
    return out.filter(F.size("series_names") >= 1)
