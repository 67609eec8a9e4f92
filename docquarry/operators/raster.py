"""Line charts drawn into pixels, with the tokens that an OCR engine would read on them: the way back from plot rows to images,
so that digitizing can be checked as a round trip.

charts: chart_id, xs (array<double>, at least 4 ascending values), series (array<struct<name: string, values: array<double>>>, at
most 5) and context. The y axis runs from 0 to `top`. A null or missing value leaves a gap in the line. Null xs or series give a
chart with axes only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Four hues that lie far apart, and a gray.
COLOURS = ((204, 51, 51), (51, 85, 204), (51, 153, 68), (204, 136, 34), (150, 150, 150))
#: Images that a task hands on at once.
AT_ONCE = 8


@dataclass(frozen=True)
class Layout:
    """Pixels of a chart: its size, the axes' box, the height of the y axis and the thickness of lines and markers."""

    width: int = 520
    height: int = 400
    left: int = 110
    top: int = 60
    right: int = 490
    bottom: int = 345
    y_top: int = 5
    thick: int = 9
    marker: int = 9

    def row(self, value: float) -> int:
        return round(self.bottom - (self.bottom - self.top) * value / self.y_top)

    def rows(self, values: np.ndarray) -> np.ndarray:
        return np.rint(self.bottom - (self.bottom - self.top) * values / self.y_top).astype(int)

    def column(self, xs: np.ndarray, x: float) -> float:
        return self.left + 10 + (self.right - self.left - 20) * (x - xs[0]) / (xs[-1] - xs[0])

    def legend_row(self, place: int) -> int:
        return self.bottom - 20 - 22 * place


def draw(layout: Layout, xs: list[float], series: list[list[float | None]]) -> np.ndarray:
    """The pixels of one chart, without its words and numbers."""
    rgb = np.full((layout.height, layout.width, 3), 255, np.uint8)
    half = layout.thick // 2
    at = np.array(xs, float)
    for values, colour in zip(series, COLOURS, strict=False):
        points = [(layout.column(at, x), v) for x, v in zip(at, values, strict=False)] if len(at) > 1 else []
        for (x1, v1), (x2, v2) in zip(points, points[1:], strict=False):
            if v1 is not None and v2 is not None:
                x = np.arange(round(x1), round(x2) + 1)
                y = layout.rows(v1 + (v2 - v1) * (x - x1) / (x2 - x1)) + np.arange(-half, half + 1)[:, None]
                inside = (y >= 0) & (y < layout.height)
                rgb[y[inside], np.broadcast_to(x, y.shape)[inside]] = colour
        for x, v in points:
            if v is not None:
                y, x = layout.row(v), round(x)
                rgb[max(0, y - half) : y + half + 1, max(x - layout.marker, round(points[0][0])) : x + layout.marker + 1] = colour  # what lies before the first x is the legend's
    for place, colour in enumerate(COLOURS[: len(series)]):
        y = layout.legend_row(place)
        rgb[y - 3 : y + 4, 12:44] = colour
    rgb[layout.bottom : layout.bottom + 2, layout.left : layout.right + 1] = 0
    rgb[layout.top : layout.bottom + 2, layout.left : layout.left + 2] = 0
    return rgb


def images(charts: DataFrame, layout: Layout = Layout()) -> DataFrame:  # noqa: B008 - frozen
    """chart_id, width, height, rgb, context."""

    def paint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), AT_ONCE):
                out = []
                for row in batch.iloc[a : a + AT_ONCE].itertuples():
                    values = [[None if v is None or v != v else float(v) for v in s] for s in (row.values if row.values is not None else [])]
                    out.append((row.chart_id, layout.width, layout.height, draw(layout, list(row.xs) if row.xs is not None else [], values).tobytes(), row.context))
                yield pd.DataFrame(out, columns=["chart_id", "width", "height", "rgb", "context"])

    # a chart is a short row and an image of much work: rows are dealt out before they are drawn
    tasks = int(charts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = charts.select("chart_id", "xs", F.transform("series", lambda s: s["values"]).alias("values"), "context").repartition(tasks, "chart_id")
    return rows.mapInPandas(paint, "chart_id string, width int, height int, rgb binary, context string")


def _token(line: Column, text: Column, x: Column, y: Column, width: int) -> Column:
    """A token of a given width around a point."""
    one = F.lit(1)
    return F.struct(
        one.alias("block_num"), one.alias("par_num"), line.cast("int").alias("line_num"), text.alias("text"), F.lit(95.0).alias("conf"), (x - width // 2).cast("int").alias("left"), (y - 6).cast("int").alias("top"), F.lit(width).alias("width"), F.lit(12).alias("height")
    )


def tokens(charts: DataFrame, layout: Layout = Layout(), left_out: Callable[[Column], Column] | None = None) -> DataFrame:  # noqa: B008 - frozen
    """The tokens of each chart's tick labels and legend, by their places. left_out: from the place of an x tick (from 0), whether
    its label isn't read."""
    span = layout.right - layout.left - 20
    first, last = F.array_min("xs"), F.array_max("xs")
    hidden = lambda i: F.coalesce(left_out(i), F.lit(False)) if left_out else F.lit(False)
    x_label = lambda x, i: F.when(~hidden(i), _token(F.lit(200), F.regexp_replace(x.cast("string"), r"\.0$", ""), F.rint(layout.left + 10 + span * (x - first) / (last - first)), F.lit(layout.bottom + 20), 20))
    y_label = F.transform(F.sequence(F.lit(0), F.lit(layout.y_top)), lambda v: _token(100 + v, v.cast("string"), F.lit(80), F.rint(layout.bottom - (layout.bottom - layout.top) * v / layout.y_top), 20))
    names = F.transform("series", lambda s, i: _token(300 + i, s["name"], F.lit(layout.left + 60), layout.bottom - 20 - 22 * i, 90))
    every = F.filter(F.concat(F.transform("xs", x_label), y_label, names), lambda t: t.isNotNull())
    return charts.select("chart_id", F.explode(every).alias("t")).select("chart_id", "t.*")
