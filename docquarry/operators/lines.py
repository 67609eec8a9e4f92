"""Straight lines in images by voting, and the axes of a chart as the best pair of them.

Every image gives an edge map (gradient, hysteresis, thinned across the edge). Edge pixels vote for lines y = offset + slope * x
(verticals alike, with x and y exchanged) over a fan of small slopes; the accumulator's peaks are taken in order, the
pixels along a peak are cut into stretches at wide gaps, and pixels that a line has used vote no more. Axes are then
chosen by Spark's array functions from the segments of each chart.

Images without pixels or with a buffer of another size than width * height * 3 give no segments; charts without an
L-shaped pair give no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Edge thresholds, votes, lengths and gaps in pixels or shares of the image's width and height.
EDGE_LOW, EDGE_HIGH = 40, 140
VOTES_LEAST, VOTES_SHARE = 45, 24
LENGTH_LEAST, LENGTH_SHARE = 70, 7
GAP_MOST = 24
TILT_MOST = 7
HORIZONTAL_SHARE, VERTICAL_SHARE = 0.16, 0.10
CORNER_LEAST, CORNER_SHARE = 55, 0.05
AXIS_X_SHARE, AXIS_Y_SHARE = 0.20, 0.10
CORNER_WEIGHT = 4.0
#: Slopes tried on each side of the level, and share of a stretch's pixels that must be edges (scattered dots are no line).
FAN, FILLED = 4, 0.5


def _gradients(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel differences along x and y; the border is repeated."""
    p = np.pad(gray, 1, mode="edge")
    across = p[:-2] + 2 * p[1:-1] + p[2:]
    down = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return across[:, 2:] - across[:, :-2], down[2:] - down[:-2]


def _reached(strong: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Weak pixels that touch strong ones, step by step; a step looks at the pixels around those of the last one only."""
    now, open_ = (np.pad(m, 1).ravel() for m in (strong, weak & ~strong))
    wide = strong.shape[1] + 2
    around = np.array([i * wide + j for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    front = np.flatnonzero(now)
    while len(front):
        near = (front[:, None] + around).ravel()
        front = np.unique(near[open_[near]])
        open_[front], now[front] = False, True
    return now.reshape(strong.shape[0] + 2, wide)[1:-1, 1:-1]


def edges(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps of edges that run along x and along y, a pixel thick."""
    gx, gy = _gradients(gray.astype(float))
    size = np.abs(gx) + np.abs(gy)
    out = []
    at = np.nonzero(size >= EDGE_LOW)  # the few pixels that can be edges
    here = size[at]
    for g, other, axis in ((gy, gx, 0), (gx, gy, 1)):
        own = g[at]
        crest = np.abs(own) >= np.abs(other[at])
        for step in (-1, 1):  # only edges to the same side compete: else one beside a thin line would take the line's place
            beside = list(at)
            beside[axis] = (at[axis] + step) % gray.shape[axis]
            rival = np.where(np.sign(g[tuple(beside)]) == np.sign(own), size[tuple(beside)], 0)
            crest &= here > rival if step < 0 else here >= rival
        strong, weak = np.zeros(gray.shape, bool), np.zeros(gray.shape, bool)
        weak[at] = crest
        strong[at] = crest & (here >= EDGE_HIGH)
        out.append(_reached(strong, weak))
    return out[0], out[1]


def stretches(along: np.ndarray, least: int) -> list[np.ndarray]:
    """Sorted positions cut at gaps wider than GAP_MOST; indices of the parts that are long and filled enough."""
    parts = np.split(np.arange(len(along)), np.flatnonzero(np.diff(along) > GAP_MOST) + 1)
    long = [p for p in parts if len(p) and along[p[-1]] - along[p[0]] >= least]
    return [p for p in long if len(np.unique(along[p])) >= FILLED * (along[p[-1]] - along[p[0]])]


def level_lines(edge: np.ndarray, votes_least: int, length_least: int) -> list[tuple[int, int, int, int]]:
    """Segments (x1, y1, x2, y2) of nearly level lines; y rises or falls by TILT_MOST at most over the map's width. Used pixels vote no
    more, but a later line that they lie on, too, runs on through them: else a line beside an axis would cut pieces out of it."""
    height, width = edge.shape
    ys, xs = np.nonzero(edge)
    slopes = np.linspace(-TILT_MOST, TILT_MOST, 2 * FAN + 1) / max(width - 1, 1)
    found = []
    pad = TILT_MOST + 1
    fresh = np.ones(len(xs), bool)
    while fresh.sum() >= votes_least:
        offsets = np.rint(ys[None, fresh] - slopes[:, None] * xs[None, fresh]).astype(int) + pad
        votes = np.stack([np.bincount(o, minlength=height + 2 * pad) for o in offsets])
        order = np.argsort(-votes, axis=None, kind="stable")
        used = np.zeros(len(xs), bool)
        for peak in order:
            slope, offset = divmod(int(peak), votes.shape[1])
            if votes[slope, offset] < votes_least:
                break
            near = np.flatnonzero(np.abs(ys - slopes[slope] * xs - (offset - pad)) <= 1)
            if used[near].any():  # votes are counted again first
                break
            near = near[np.argsort(xs[near], kind="stable")]
            for p in stretches(xs[near], length_least):
                if fresh[near[p]].sum() >= min(votes_least, len(p)):
                    ends = near[[p[0], p[-1]]]
                    found.append((int(xs[ends[0]]), int(ys[ends[0]]), int(xs[ends[1]]), int(ys[ends[1]])))
            used[near[fresh[near]]] = True
        if not used.any():
            break
        fresh &= ~used
    return found


def segments_of(rgb: np.ndarray) -> list[tuple[str, int, int, int, int]]:
    """('h' or 'v', x1, y1, x2, y2) of the image's long lines."""
    gray = rgb.astype(float) @ np.array([0.299, 0.587, 0.114])
    along_x, along_y = edges(gray)
    height, width = gray.shape
    votes, length = max(VOTES_LEAST, width // VOTES_SHARE), max(LENGTH_LEAST, width // LENGTH_SHARE)
    level = [("h", *s) for s in level_lines(along_x, votes, length)]
    upright = [("v", y1, x1, y2, x2) for x1, y1, x2, y2 in level_lines(along_y.T, votes, length)]
    return level + upright


SEGMENT = "struct<kind:string,x1:int,y1:int,x2:int,y2:int>"


def seen(images: DataFrame, *columns: str) -> DataFrame:
    """A row for each image that has a width and a height: chart_id, width, height, the columns named, and lines (its segments)."""

    @F.arrow_udf(f"array<{SEGMENT}>")
    def found(rgb: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        out = []
        for pixels, w, h in zip(rgb, width.to_pylist(), height.to_pylist(), strict=True):
            known = pixels.is_valid and w > 0 and h > 0 and len(buffer := pixels.as_buffer()) == 3 * w * h
            out.append([dict(zip(("kind", "x1", "y1", "x2", "y2"), s, strict=True)) for s in segments_of(np.frombuffer(buffer, np.uint8).reshape(h, w, 3))] if known else [])
        return pa.array(out, kind)

    kind = pa.list_(pa.struct([("kind", pa.string()), *((c, pa.int32()) for c in ("x1", "y1", "x2", "y2"))]))
    rows = images.filter("width IS NOT NULL AND height IS NOT NULL").withColumns({"width": F.col("width").cast("int"), "height": F.col("height").cast("int")})
    return rows.select("chart_id", "width", "height", *columns, found("rgb", "width", "height").alias("lines"))


def segments(images: DataFrame) -> DataFrame:
    """chart_id, kind (h or v), x1, y1, x2, y2 and the image's width and height."""
    return seen(images).select("chart_id", "width", "height", F.inline("lines"))


def axis_pairs(found: DataFrame) -> DataFrame:
    """The L-shaped pair of each chart with the greatest length of both less four times the gap at the corner: chart_id, left,
    top, right, bottom. found: segments()."""
    w, h = F.col("width"), F.col("height")
    tilt = F.when(F.col("kind") == "h", F.abs(F.col("y2") - F.col("y1"))).otherwise(F.abs(F.col("x2") - F.col("x1"))) <= TILT_MOST
    long = F.when(F.col("kind") == "h", F.abs(F.col("x2") - F.col("x1")) >= F.greatest(HORIZONTAL_SHARE * w, AXIS_X_SHARE * w)).otherwise(F.abs(F.col("y2") - F.col("y1")) >= F.greatest(VERTICAL_SHARE * h, AXIS_Y_SHARE * h))
    kept = found.filter(tilt & long)
    line = F.struct(F.least("x1", "x2").alias("left"), F.greatest("x1", "x2").alias("right"), F.least("y1", "y2").alias("top"), F.greatest("y1", "y2").alias("bottom"), "x1", "y1")
    # an image holds few lines that are so long; its two lists stay small
    both = kept.groupBy("chart_id").agg(F.first("width").alias("width"), *(F.array_sort(F.collect_list(F.when(F.col("kind") == k, line))).alias(k) for k in ("h", "v")))
    gap = lambda a, b: F.abs(b["x1"] - a["left"]) + F.abs(a["y1"] - b["bottom"])
    score = lambda a, b: (a["right"] - a["left"]) + (b["bottom"] - b["top"]) - CORNER_WEIGHT * gap(a, b)
    most = F.greatest(F.lit(CORNER_LEAST), (CORNER_SHARE * w).cast("int"))
    pair = lambda a, b: F.when(gap(a, b) <= most, F.struct(score(a, b).alias("score"), b["x1"].alias("left"), b["top"].alias("top"), a["right"].alias("right"), a["y1"].alias("bottom")))
    pairs = F.flatten(F.transform("h", lambda a: F.transform("v", lambda b: pair(a, b))))
    best = both.select("chart_id", F.array_max(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).filter("p IS NOT NULL")
    return best.select("chart_id", "p.left", "p.top", "p.right", "p.bottom")
