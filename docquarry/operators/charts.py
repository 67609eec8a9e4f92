"""Charts from decoded measurements: tick groups, axis fits, calibration checks, series sampling, plot rows and their answers.

Plot rows are array<struct<x: double, values: array<double>, uncertainty_note: string>>, values in the order of series_names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X

NOTE = "Approximate; digitized from rendered plot pixels"
INFERRED = "; overlapping baseline marker inferred from the shared visible point because individual series colors were occluded"
ROW = "struct<x:double,values:array<double>,uncertainty_note:string>"


# -- axes --------------------------------------------------------------------------------------------------------------


def coordinate_groups(values: list[float], tolerance: float) -> list[int]:
    """Group number of each of the sorted values; a value joins the first group whose median is within tolerance."""
    groups: list[list[float]] = []  # sorted, as the values are
    out = []
    for v in values:
        at = next((i for i, g in enumerate(groups) if abs(v - (g[(len(g) - 1) // 2] + g[len(g) // 2]) / 2) <= tolerance), None)
        if at is None:
            at = len(groups)
            groups.append([])
        groups[at].append(v)
        out.append(at)
    return out


def tick_groups(tokens: DataFrame) -> DataFrame:
    """The best x and y tick group of each chart. tokens: chart_id, value, x, y, width, height (of the image). Charts are
    gathered to a row each and go through Python by the batch."""
    kind = pa.list_(pa.struct([("axis", pa.string()), ("grp", pa.int32()), ("value", pa.float64()), ("x", pa.float64()), ("y", pa.float64())]))

    def one(t: list[dict], w: float, h: float) -> list[dict]:
        out = []
        for axis, along, tolerance in (("x", "y", max(10, int(h * 0.012))), ("y", "x", max(12, int(w * 0.012)))):
            s = sorted(t, key=lambda r: r[along])
            out.extend({"axis": axis, "grp": g, **r} for r, g in zip(s, coordinate_groups([r[along] for r in s], tolerance), strict=True))
        return out

    @F.arrow_udf("array<struct<axis:string,grp:int,value:double,x:double,y:double>>")
    def group(t: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([one(*row) for row in zip(t.to_pylist(), w.to_pylist(), h.to_pylist(), strict=True)], kind)

    number = lambda c: F.col(c).cast("double").alias(c)
    gathered = tokens.groupBy("chart_id").agg(F.collect_list(F.struct(number("value"), number("x"), number("y"))).alias("t"), F.first("width").alias("width"), F.first("height").alias("height"))
    dealt = gathered.select("chart_id", "width", "height", group("t", F.col("width").cast("double"), F.col("height").cast("double")).alias("g")).select("chart_id", "width", "height", F.inline("g"))
    is_x = F.col("axis") == "x"
    along, across = F.when(is_x, F.col("x")).otherwise(F.col("y")), F.when(is_x, F.col("y")).otherwise(F.col("x"))
    extent, other = F.when(is_x, F.col("width")).otherwise(F.col("height")), F.when(is_x, F.col("height")).otherwise(F.col("width"))
    w = Window.partitionBy("chart_id", "axis", "grp").orderBy("along", "value")
    steps = dealt.withColumns({"along": along, "across": across, "extent": extent, "other": other}).withColumn("next", F.lead("value").over(w))
    orderly = F.when(is_x, F.col("next") >= F.col("value")).otherwise(F.col("next") <= F.col("value"))
    groups = steps.groupBy("chart_id", "axis", "grp").agg(
        F.count_distinct("value").alias("unique"),
        (F.max("along") - F.min("along")).alias("span"),
        F.first("extent").alias("extent"),
        F.first("other").alias("other"),
        (F.count_if(orderly) / F.greatest(F.count("next"), F.lit(1))).alias("orderly"),
        F.median("across").alias("middle"),
        F.array_sort(F.collect_list(F.struct("along", "across", "value"))).alias("ticks"),
    )
    is_x = F.col("axis") == "x"
    fits = F.when(is_x, (F.col("unique") >= 4) & (F.col("span") >= 0.20 * F.col("extent")) & (F.col("orderly") >= 0.70)).otherwise((F.col("unique") >= 3) & (F.col("span") >= 0.12 * F.col("extent")) & (F.col("orderly") >= 0.60))
    place = F.col("middle") / F.greatest("other", F.lit(1.0))
    score = F.col("unique") + F.col("span") / F.greatest("extent", F.lit(1.0)) + F.when(is_x, place).otherwise(1.0 - place)
    best = groups.filter(fits).withColumn("score", score)
    w = Window.partitionBy("chart_id", "axis").orderBy(F.desc("score"), "grp")
    return best.withColumn("r", F.row_number().over(w)).filter("r = 1").select("chart_id", "axis", "ticks")


def axis_box(groups: DataFrame) -> DataFrame:
    """C03, the fallback without line detection: the box spanned by both axes' ticks."""
    side = lambda axis: groups.filter(F.col("axis") == axis).select("chart_id", F.col("ticks").alias(f"{axis}t"))
    both = side("x").join(side("y"), "chart_id")
    xs, ys = F.transform("xt", lambda t: t["along"]), F.transform("yt", lambda t: t["along"])
    across = F.array_sort(F.transform("xt", lambda t: t["across"]))
    n = F.size(across)
    middle = (F.get(across, F.floor((n - 1) / 2).cast("int")) + F.get(across, F.floor(n / 2).cast("int"))) / 2
    return both.select("chart_id", F.array_min(xs).cast("int").alias("left"), F.array_min(ys).cast("int").alias("top"), F.array_max(xs).cast("int").alias("right"), (middle - 18).cast("int").alias("bottom"))


def contiguous(ticks: DataFrame, keys: list[str], pixel: str = "pixel") -> DataFrame:
    """The longest run of ticks without a wide gap (over 45 pixels and three times the median gap); the first of equally long."""
    w = Window.partitionBy(*keys).orderBy(pixel)
    gaps = ticks.withColumn("gap", F.col(pixel) - F.lag(pixel).over(w))
    typical = gaps.groupBy(*keys).agg(F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("typical"), F.count("*").alias("n"))
    cut = gaps.join(typical, keys).withColumn("new", F.coalesce(((F.col("n") >= 3) & (F.col("gap") > F.greatest(F.lit(45.0), 3.0 * F.col("typical")))).cast("int"), F.lit(0)))
    runs = cut.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy(*keys, "run").agg(F.count("*").alias("size"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("size", (-F.col("run")).alias("m"))).alias("b")).select(*keys, (-F.col("b.m")).alias("run"))
    return runs.join(best, [*keys, "run"], "left_semi").drop("gap", "typical", "n", "new", "run")


def fit_axes(ticks: DataFrame) -> DataFrame:
    """A straight line from pixels to values for each chart and axis. ticks: chart_id, axis, pixel, value.
    Two-digit readings of y ticks (20 to 99) are cut to their first digit where they are half of all; repeated ticks count once."""
    run = contiguous(ticks, ["chart_id", "axis"])
    odd = (F.col("value") >= 20) & (F.col("value") < 100)
    shares = run.groupBy("chart_id", "axis").agg(F.avg(odd.cast("double")).alias("odd"))
    fixed = run.join(shares, ["chart_id", "axis"]).withColumn("value", F.when((F.col("axis") == "y") & (F.col("odd") >= 0.5) & odd, F.floor(F.col("value") / 10).cast("double")).otherwise(F.col("value")))
    once = fixed.withColumn("k1", F.round("pixel", 1)).withColumn("k2", F.round("value", 6)).groupBy("chart_id", "axis", "k1", "k2").agg(F.min("pixel").alias("pixel"), F.first("value").alias("value"))
    fits = once.groupBy("chart_id", "axis").agg(
        F.regr_slope("value", "pixel").alias("slope"),
        F.regr_intercept("value", "pixel").alias("intercept"),
        F.count("*").alias("points"),
        (F.max("pixel") - F.min("pixel")).alias("spread"),
        F.array_sort(F.collect_list(F.struct("pixel", "value"))).alias("ticks"),
    )
    off = lambda t: F.col("slope") * t["pixel"] + F.col("intercept") - t["value"]
    rmse = F.sqrt(F.aggregate("ticks", F.lit(0.0), lambda s, t: s + off(t) * off(t)) / F.size("ticks"))
    good = fits.filter((F.col("points") >= 2) & (F.col("spread") >= 20)).withColumn("rmse", rmse)
    return good.select("chart_id", "axis", "slope", "intercept", "points", "rmse", F.transform("ticks", lambda t: t["pixel"]).alias("tick_pixels"), F.transform("ticks", lambda t: t["value"]).alias("tick_values"))


#: Pixels by which a tick may lie outside the plot's box.
BOX_MARGIN = 12


def fill_ticks(fits: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Evenly spaced x ticks from the least to the greatest in the smallest step, if these are 3 to 30; pixels by the fit.
    boxes (chart_id, left, right): only ticks inside the plot's box stay, and charts with fewer than 3 of them are out."""
    x = fits.filter("axis = 'x'").withColumn("u", F.array_sort(F.array_distinct(F.transform("tick_values", lambda v: F.round(v, 6)))))
    steps = F.filter(F.transform(F.slice("u", 2, F.size("u")), lambda v, i: v - F.get("u", i)), lambda d: d > 1e-8)
    x = x.withColumn("step", F.array_min(steps)).withColumn("n", F.round((F.array_max("u") - F.array_min("u")) / F.col("step")).cast("int") + 1)
    even = F.col("n").between(3, 30)
    values = F.when(even, F.transform(F.sequence(F.lit(0), F.greatest("n", F.lit(1)) - 1), lambda i: F.array_min("u") + F.col("step") * i)).otherwise(F.array_sort("tick_values"))
    pixels = F.when(even, F.transform(values, lambda v: (v - F.col("intercept")) / F.col("slope"))).otherwise(F.array_sort("tick_pixels"))
    ticks = x.select("chart_id", values.alias("values"), pixels.alias("pixels"))
    if boxes is None:
        return ticks
    inside = F.filter(F.arrays_zip("values", "pixels"), lambda t: t["pixels"].between(F.col("left") - BOX_MARGIN, F.col("right") + BOX_MARGIN))
    kept = ticks.join(boxes.select("chart_id", "left", "right"), "chart_id").withColumn("t", inside).filter(F.size("t") >= 3)
    return kept.select("chart_id", F.col("t.values").alias("values"), F.col("t.pixels").alias("pixels"))


def _steps(v: Column) -> Column:
    return F.transform(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda x, i: x - F.get(v, i))


def variation(v: Column) -> Column:
    """A10: standard deviation of the steps over their mean."""
    s = _steps(v)
    n = F.greatest(F.size(s), F.lit(1))
    mean = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(s, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.sqrt(var) / F.greatest(F.abs(mean), F.lit(1e-9))


def chart_context(text: Column) -> Column:
    """F14."""
    return X.contains_any(X.normalize_rag(text), config.CHART_CONTEXT)


def calibration(values: Column, pixels: Column, y_values: Column, y_rmse: Column, context: Column) -> Column:
    """C11: why a chart is refused, or "accepted"."""
    n = F.size(values)
    finite = F.forall(F.concat(values, pixels), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    distinct = F.size(F.array_distinct(F.transform(values, lambda v: F.round(v, 8)))) == n
    rising = F.forall(_steps(values), lambda d: d > 0) & F.forall(_steps(pixels), lambda d: d > 0)
    y_range = F.when(F.size(y_values) >= 2, F.array_max(y_values) - F.array_min(y_values)).otherwise(F.lit(0.0))
    return (
        F.when((n < 4) | (F.size(pixels) != n), "too_few_x_ticks")
        .when(~finite, "non_finite_ticks")
        .when(~distinct, "duplicate_x_ticks")
        .when(~rising, "non_monotonic_x_ticks")
        .when((variation(values) > 0.35) | (variation(pixels) > 0.30), "irregular_tick_spacing")
        .when(y_range <= 0, "invalid_y_range")
        .when(F.coalesce(y_rmse, F.lit(float("inf"))) / y_range > 0.12, "poor_y_calibration")
        .when(~chart_context(context), "no_chart_context")
        .otherwise("accepted")
    )


# -- series ------------------------------------------------------------------------------------------------------------


def sample_series(mask: np.ndarray, xs: list[float], radius: int = 7) -> list[float | None]:
    """Y of a series at each x, from right to left, following the band nearest to the last one."""
    out: list[float | None] = []
    last = None
    for x in reversed(xs):
        a, b = max(0, round(x) - radius), min(mask.shape[1] - 1, round(x) + radius)
        ys = np.nonzero(mask[:, a : b + 1])[0]
        if not len(ys):
            out.append(None)
            continue
        levels = np.unique(ys)
        bands = np.split(levels, np.flatnonzero(np.diff(levels) > 3) + 1)
        centres = [float(np.median(b)) for b in bands]
        last = max(centres, key=lambda c: int((np.abs(ys - c) <= 3).sum())) if last is None else min(centres, key=lambda c: abs(c - last))
        out.append(last)
    return out[::-1]


def series_quality(samples: Column, xs: Column, width: Column) -> Column:
    """Coverage and span; 0 with too few samples."""
    valid = F.filter(F.arrays_zip(samples.alias("y"), xs.alias("x")), lambda p: p["y"].isNotNull())
    n, of = F.size(valid), F.size(xs)
    at = F.transform(valid, lambda p: p["x"])
    enough = n >= F.greatest(F.lit(3), F.ceil(of * 0.45))
    return F.when(enough, n / F.greatest(of, F.lit(1)) + (F.array_max(at) - F.array_min(at)) / F.greatest(width, F.lit(1.0))).otherwise(F.lit(0.0))


# Pixels that belong to a series. Saturation and brightness count to 255.
SATURATION, BRIGHT = 45, (45, 252)
COLOURED_LEAST, MASK_LEAST, NEAR_COLOUR = 60, 25, 34.0
GRAY_SPREAD, GRAY = 16, (105, 195)


def _saturated(p: np.ndarray, least: int, bright: tuple[int, int]) -> np.ndarray:
    high, low = p.max(axis=-1), p.min(axis=-1)
    return ((high - low) * 255 >= least * np.maximum(high, 1)) & (high >= bright[0]) & (high <= bright[1])


def closed(mask: np.ndarray) -> np.ndarray:
    """Holes of a mask filled by a square of 3: dilated, then eroded (by rows, then by columns)."""
    wide = np.pad(mask, 1)
    wide = wide[:-2] | wide[1:-1] | wide[2:]
    grown = wide[:, :-2] | wide[:, 1:-1] | wide[:, 2:]
    wide = np.pad(grown, 1, constant_values=True)
    wide = wide[:-2] & wide[1:-1] & wide[2:]
    return wide[:, :-2] & wide[:, 1:-1] & wide[:, 2:]


def _centres(colours: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """k-means over distinct colours (sorted) with their counts, from the most frequent and then the farthest ones."""
    apart = lambda c: ((colours[:, None] - c[None]) ** 2).sum(axis=2)
    centres = colours[[n.argmax()]]
    while len(centres) < min(k, len(colours)):
        centres = np.vstack([centres, colours[apart(centres).min(axis=1).argmax()]])
    for _ in range(60):
        label = apart(centres).argmin(axis=1)
        moved = np.array([np.average(colours[label == i], axis=0, weights=n[label == i]) if (label == i).any() else c for i, c in enumerate(centres)])
        if np.abs(moved - centres).max() <= 0.6:
            return moved
        centres = moved
    return centres


def colour_masks(rgb: np.ndarray) -> list[dict]:
    """C07, without an image library: saturated pixels clustered by colour, a mask around each centre, and a mask of gray ones. All
    is decided once for each distinct colour; pixels look their colour up."""
    wide = rgb.astype(np.int32)
    codes = (wide[:, :, 0] << 16) | (wide[:, :, 1] << 8) | wide[:, :, 2]
    seen = np.unique(codes)
    at = np.searchsorted(seen, codes)
    p = np.stack([seen >> 16, (seen >> 8) & 255, seen & 255], axis=1).astype(float)
    n = np.bincount(at.ravel(), minlength=len(seen))
    coloured, out = _saturated(p, SATURATION, BRIGHT), []
    total = int(n[coloured].sum())
    if total >= COLOURED_LEAST:
        for i, c in enumerate(_centres(p[coloured], n[coloured], min(5, max(2, round(total / 3500)))), 1):
            near = (np.sqrt(((p - c) ** 2).sum(axis=1)) <= NEAR_COLOUR) & coloured
            out.append({"mask": closed(near[at]), "center_rgb": c.tolist(), "label_hint": f"Series {i}"})
    mean = p.mean(axis=1)
    gray = (p.max(axis=1) - p.min(axis=1) <= GRAY_SPREAD) & (mean >= GRAY[0]) & (mean <= GRAY[1])
    out.append({"mask": closed(gray[at]), "center_rgb": None, "label_hint": "Series gray"})
    return [m for m in out if m["mask"].sum() >= MASK_LEAST]


def _less(quality) -> tuple:
    """Sort key of a quality, best first, unknown ones last."""
    return (1, 0.0) if quality is None or quality != quality else (0, -quality)


def distinct_series(series: DataFrame, most: int = 6) -> DataFrame:
    """C14: the best series first, without those that run along a better one (median distance up to 4 pixels on 3 joint samples).
    series: chart_id, series_pos, quality, samples. Charts are gathered to a row each and go through Python by the batch."""

    @F.arrow_udf("array<int>")
    def pick(charts: pa.Array) -> pa.Array:
        def one(rows: list[dict]) -> list[int]:
            kept: list[tuple[int, np.ndarray]] = []
            for row in sorted(rows, key=lambda r: (_less(r["quality"]), r["series_pos"])):
                y = np.array([np.nan if v is None else v for v in row["samples"]], float)
                joint = [np.abs(y - k)[np.isfinite(y) & np.isfinite(k)] for _, k in kept]
                if not any(len(d) >= 3 and np.median(d) <= 4 for d in joint):
                    kept.append((row["series_pos"], y))
            return [p for p, _ in kept[:most]]

        return pa.array([one(rows) for rows in charts.to_pylist()], pa.list_(pa.int32()))

    rows = F.struct(*(F.col(c) for c in series.columns if c != "chart_id"))
    gathered = series.groupBy("chart_id").agg(F.collect_list(rows).alias("s"))
    seen = F.transform("s", lambda s: F.struct(*(s[c].alias(c) for c in ("series_pos", "quality", "samples"))))
    chosen = gathered.withColumn("kept", pick(seen))
    return chosen.select("chart_id", F.inline(F.filter("s", lambda s: F.array_contains("kept", s["series_pos"])))).select(series.columns)


def assign_labels(series: DataFrame, legend: DataFrame) -> DataFrame:
    """Legend texts to series by nearest colour, each used once; what is left over goes by order of height.
    series: chart_id, series_pos, label_hint, r, g, b, samples; legend: chart_id, entry_pos, text, r, g, b (null: no colour).
    Charts are gathered to a row each and go through Python by the batch."""
    label_type = pa.list_(pa.struct([("series_pos", pa.int32()), ("label", pa.string())]))
    none = lambda v: v is None or v != v

    def one(s: list[dict], texts: list[dict]) -> list[dict]:
        middle = lambda row: float(np.median([v for v in row["samples"] if v is not None]))
        rows = sorted(s, key=lambda row: (middle(row), row["series_pos"]))
        texts = sorted(texts, key=lambda e: e["entry_pos"])
        coloured = [e for e in texts if not none(e["r"])]
        label: dict[int, str] = {}
        free = [e["text"] for e in texts]
        if coloured:
            near = sorted((((a["r"] - e["r"]) ** 2 + (a["g"] - e["g"]) ** 2 + (a["b"] - e["b"]) ** 2, i, e["entry_pos"], a["series_pos"], e["text"]) for i, a in enumerate(rows) if not none(a["r"]) for e in coloured), key=lambda x: x[:3])
            taken: set = set()
            for _, _, pos, own, text in near:
                if own not in label and pos not in taken:
                    label[own] = text
                    taken.add(pos)
            free = [e["text"] for e in texts if e["entry_pos"] not in taken]
        elif len(texts) < len(rows):
            free = []
        for i, a in enumerate(rows, 1):
            if a["series_pos"] not in label:
                label[a["series_pos"]] = free.pop(0) if free else (a["label_hint"] or f"Series {i}")
        return [{"series_pos": p, "label": t} for p, t in label.items()]

    @F.arrow_udf("array<struct<series_pos:int,label:string>>")
    def assign(s: pa.Array, entries: pa.Array) -> pa.Array:
        return pa.array([one(a, e or []) for a, e in zip(s.to_pylist(), entries.to_pylist(), strict=True)], label_type)

    number = lambda c: F.col(c).cast("double").alias(c)
    told = series.groupBy("chart_id").agg(F.collect_list(F.struct("series_pos", "label_hint", number("r"), number("g"), number("b"), "samples")).alias("s"))
    entries = legend.groupBy(F.col("chart_id").alias("of")).agg(F.collect_list(F.struct("entry_pos", "text", number("r"), number("g"), number("b"))).alias("e"))
    met = told.join(entries, F.col("chart_id").eqNullSafe(F.col("of")), "left")
    return met.withColumn("l", assign("s", "e")).select("chart_id", F.inline("l"))


def to_values(samples: Column, top: Column, slope: Column, intercept: Column) -> Column:
    """Pixels of the plot region to data values."""
    return F.transform(samples, lambda y: slope * (y + top) + intercept)


def chart_confidence(points: Column, coverage: Column) -> Column:
    """A12."""
    return F.least(F.lit(0.90), 0.40 + 0.04 * points + 0.20 * coverage)


def repair_baseline(rows: Column) -> Column:
    """A first value far below a falling curve's second one is a covered marker: it takes the highest credible
    first value, if that lies above all second values, and the row says so."""
    at = lambda i: F.get(rows, F.lit(i))["values"]
    first, second, third = at(0), at(1), at(2)
    kind = F.transform(
        first,
        lambda v, i: F.when(v.isNull() | F.get(second, i).isNull() | F.get(third, i).isNull(), F.lit("none"))
        .when((F.get(third, i) < F.get(second, i)) & (F.get(second, i) > v) & (F.abs(F.get(second, i) - v) > 1.0), F.lit("hidden"))
        .otherwise(F.lit("credible")),
    )
    baseline = F.array_max(F.filter(first, lambda v, i: F.get(kind, i) == "credible"))
    moved = F.transform(first, lambda v, i: (F.get(kind, i) == "hidden") & (F.abs(v - baseline) >= 1.0))
    high = F.array_max(F.filter(second, lambda v: v.isNotNull()))
    go = (F.size(rows) >= 3) & (F.size(first) >= 2) & baseline.isNotNull() & F.exists(moved, lambda m: m) & (baseline >= high - 0.25)
    fixed = F.transform(first, lambda v, i: F.when(F.get(moved, i), baseline).otherwise(v))
    head = F.struct(F.get(rows, F.lit(0))["x"].alias("x"), fixed.alias("values"), F.concat(F.get(rows, F.lit(0))["uncertainty_note"], F.lit(INFERRED)).alias("uncertainty_note"))
    return F.when(F.coalesce(go, F.lit(False)), F.concat(F.array(head), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))))).otherwise(rows)


def rows_valid(rows: Column) -> Column:
    """at least 3 rows, x rising, and two series with two numbers."""
    xs = F.transform(rows, lambda r: r["x"])
    numbers = F.transform(F.sequence(F.lit(0), F.greatest(F.size(F.get(rows, F.lit(0))["values"]), F.lit(1)) - 1), lambda k: F.size(F.filter(rows, lambda r: F.get(r["values"], k).isNotNull())))
    return F.coalesce((F.size(rows) >= 3) & F.forall(xs, lambda x: x.isNotNull()) & F.forall(_steps(xs), lambda d: d > 0) & (F.size(F.filter(numbers, lambda n: n >= 2)) >= 2), F.lit(False))


def plot_valid(content_type: Column, rows: Column, confidence: Column) -> Column:
    """F13."""
    return (F.lower(content_type) == "plot_table") & rows_valid(rows) & (F.coalesce(confidence, F.lit(0.0)) >= 0.70)


def row_at(rows: Column, x: Column) -> Column:
    """The row nearest to x (the earlier of two as near), if within 0.25 and 0.3 of the median step."""
    best = F.array_min(F.transform(rows, lambda r, i: F.struct(F.abs(r["x"] - x).alias("d"), i.alias("i"))))
    sorted_xs = F.array_sort(F.array_distinct(F.transform(rows, lambda r: r["x"])))
    steps = X.let(sorted_xs, lambda v: F.array_sort(_steps(v)))
    half = lambda s, n: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    median = X.let(steps, lambda s: F.when(F.size(s) > 0, half(s, F.size(s))).otherwise(F.lit(1.0)))
    return X.let(best, lambda b: F.when(b["d"] <= F.greatest(F.lit(0.25), 0.30 * median), F.get(rows, b["i"])))


def match_series(question: Column, names: Column) -> Column:
    """Index of the series asked for: placebo, then a dose of the named product, then most shared words (the first wins)."""
    return X.let(F.struct(X.normalize_plot(question).alias("q"), F.transform(names, X.normalize_series).alias("n")), lambda s: _matched(s["q"], s["n"]))


def _matched(q: Column, normal: Column) -> Column:
    where = lambda test: F.nullif(F.array_position(F.transform(normal, test), F.lit(True)), F.lit(0).cast("bigint")) - 1
    dose = F.nullif(F.regexp_extract(q, r"\b(25|50)\s*mg\b", 1), F.lit(""))
    placebo = F.when(F.contains(q, F.lit("placebo")), where(lambda n: F.contains(n, F.lit("placebo"))))
    dosed = X.let(dose, lambda d: F.when(d.isNotNull(), where(lambda n: F.contains(n, d) & F.contains(n, F.lit("luminara")))))
    shared = lambda n: F.size(F.array_intersect(F.split(q, " "), F.split(n, " ")))
    best = F.array_min(F.transform(normal, lambda n, i: F.struct((-shared(n)).alias("m"), i.alias("i"))))
    return F.coalesce(placebo, dosed, X.let(best, lambda b: F.when(b["m"] < 0, b["i"].cast("bigint")))).cast("int")


def plot_answer(question: Column, rows: Column, names: Column) -> Column:
    """(answer, route) for the lowest, the highest or a named series at the x asked for, else null."""
    asked = F.struct(X.requested_x(question).alias("x"), X.normalize_plot(question).alias("q"))
    point = lambda v, i: F.struct(v.alias("v"), i.alias("i"))
    points = lambda x: X.let(row_at(rows, x), lambda r: F.filter(F.transform(r["values"], point), lambda p: p["v"].isNotNull() & ~F.isnan(p["v"])))
    found = lambda a: X.let(points(a["x"]), lambda p: F.when((F.size(p) > 0) & a["x"].isNotNull(), _plot_answer(question, a["x"], a["q"], p, names)))
    return X.let(asked, found)


def _plot_answer(question: Column, x: Column, q: Column, points: Column, names: Column) -> Column:
    give = lambda text, route: F.struct(text.alias("answer"), F.lit(route).alias("route"))
    at = F.concat(F.lit("At Week "), X.plot_value(x), F.lit(", "))
    said = lambda what, p: F.concat(at, F.get(names, p["i"]), F.lit(f" has the {what} mean Neuropathy Symptom Score, approximately "), X.plot_value(p["v"]), F.lit("."))
    low = X.let(F.array_min(points), lambda p: said("lowest", p))
    first_high = F.array_max(F.transform(points, lambda p: F.struct(p["v"].alias("v"), (-p["i"]).alias("m"), p["i"].alias("i"))))
    high = X.let(first_high, lambda p: said("highest", p))
    own = X.let(match_series(question, names), lambda i: F.get(F.filter(points, lambda p: p["i"] == i), F.lit(0)))
    named = lambda p: F.concat(at, F.lit("the mean Neuropathy Symptom Score for "), F.get(names, p["i"]), F.lit(" is approximately "), X.plot_value(p["v"]), F.lit("."))
    return (
        F.when(X.contains_any(q, config.LOWEST_TERMS), give(low, "deterministic_plot_lowest"))
        .when(X.contains_any(q, config.HIGHEST_TERMS), give(high, "deterministic_plot_highest"))
        .otherwise(X.let(own, lambda p: F.when(p.isNotNull(), give(named(p), "deterministic_plot_exact_value"))))
    )


def plot_texts(rows: Column, names: Column) -> tuple[Column, Column]:
    """(matrix, embedding text) of plot rows."""
    cell = lambda v: F.coalesce(X.significant(v), F.lit(""))
    matrix = F.concat(F.array(F.concat(F.array(F.lit("x")), names, F.array(F.lit("uncertainty_note")))), F.transform(rows, lambda r: F.concat(F.array(X.significant(r["x"])), F.transform(r["values"], cell), F.array(r["uncertainty_note"]))))
    pairs = lambda r: F.filter(F.transform(r["values"], lambda v, i: F.when(v.isNotNull(), F.concat(F.get(names, i), F.lit("="), X.significant(v)))), lambda t: t.isNotNull())
    line = lambda r: F.concat(F.array_join(F.concat(F.array(F.concat(F.lit("x="), X.significant(r["x"]))), pairs(r)), ", "), F.lit(" (approximate)"))
    return matrix, F.array_join(F.transform(rows, line), "\n")


def search_text(file: Column, embedding_text: Column, llm_text: Column, names: Column) -> Column:
    """X25."""
    return F.concat_ws(" ", F.nullif(file, F.lit("")), F.nullif(embedding_text, F.lit("")), F.nullif(llm_text, F.lit("")), F.nullif(F.array_join(names, " "), F.lit("")))
