"""Charts drawn, and read back from their pixels; axes by lines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import charts, digitize, lines, raster

LAYOUT = raster.Layout()
CHART = "chart_id string, xs array<double>, series array<struct<name: string, values: array<double>>>, context string"


def frame(spark, rows):
    return spark.createDataFrame(rows, CHART)


def boxes(spark, *pixels):
    rows = [(str(i), p.shape[1], p.shape[0], p.tobytes()) for i, p in enumerate(pixels)]
    found = lines.axis_pairs(lines.segments(spark.createDataFrame(rows, "chart_id string, width int, height int, rgb binary")))
    return {r.chart_id: (r.left, r.top, r.right, r.bottom) for r in found.collect()}


def test_axes_without_labels(spark):
    plain = raster.draw(LAYOUT, list(range(6)), [])
    crossed = raster.draw(LAYOUT, list(range(6)), [[4, 3, 2, 1, 0.5, 0.5], [1, 1, 1, 1, 1, 1]])
    noisy = crossed.copy()
    noisy[np.random.default_rng(1).random(noisy.shape[:2]) < 0.002] = 90
    broken = crossed.copy()
    broken[:, 200:218] = 255  # a gap in the x axis
    got = boxes(spark, plain, crossed, noisy, broken, np.full_like(plain, 255))
    drawn = (LAYOUT.left, LAYOUT.top, LAYOUT.right, LAYOUT.bottom)
    assert set(got) == {"0", "1", "2", "3"}
    # dots near an end may make a line longer by the gap that is bridged
    assert all(abs(a - b) <= (2 + lines.GAP_MOST if k == "2" else 2) for k in got for a, b in zip(got[k], drawn, strict=True))


def test_axes_need_a_corner(spark):
    apart = np.full((400, 520, 3), 255, np.uint8)
    apart[345:347, 300:500] = 0
    apart[60:200, 30:32] = 0
    tilted = np.full((400, 520, 3), 255, np.uint8)
    for x in range(100, 480):
        tilted[345 + (x - 100) // 10, x] = 0
    tilted[60:346, 100:102] = 0
    assert boxes(spark, apart, tilted) == {}


def test_segments_of_odd_images(spark):
    rows = [("short", 520, 400, b"\0" * 10), ("none", 520, 400, None), ("flat", 0, 0, b""), ("sizeless", None, 400, b"\0")]
    assert lines.segments(spark.createDataFrame(rows, "chart_id string, width int, height int, rgb binary")).count() == 0


def test_crossing_series_are_read(spark):
    """Natural curves that cross: at least nine in ten values come back within half a line's thickness, under their names. (Where
    curves cover each other, or turn sharply within the seven pixels that are looked at, the middle of a band lies elsewhere.)"""
    r = np.random.default_rng(3)
    xs = [float(x) for x in range(8)]
    rows, want = [], {}
    for k in range(12):
        curves = [np.clip(np.cumsum(r.normal(0, 0.25, 8)) + start, 0.3, 4.9).round(2).tolist() for start in r.permutation([1.2, 2.4, 3.6])]
        want[str(k)] = {f"series {'abc'[i]}": c for i, c in enumerate(curves)}
        rows.append((str(k), xs, [(name, c) for name, c in want[str(k)].items()], "Figure 1: score over time"))
    charts_ = frame(spark, rows)
    got = digitize.digitize(raster.images(charts_), raster.tokens(charts_)).collect()
    half_line = LAYOUT.thick / 2 * LAYOUT.y_top / (LAYOUT.bottom - LAYOUT.top)
    near = total = 0
    for c in got:
        assert [row.x for row in c.plot_rows] == xs
        for row in c.plot_rows:
            for name, v in zip(c.series_names, row["values"], strict=True):
                near += name in want[c.chart_id] and v is not None and abs(v - want[c.chart_id][name][int(row.x)]) <= half_line
    total = sum(len(c) for chart in want.values() for c in chart.values())
    assert len(got) == 12 and near / total >= 0.9, near / total


def test_gaps_and_empty_charts(spark):
    """Missing values stay missing; charts without values give no row."""
    charts_ = frame(spark, [("gap", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], [("series a", [1.0, 2.0, None, 3.0, 2.0, 1.0])], "Figure 1"), ("none", None, None, "Figure 2"), ("empty", [0.0, 1.0, 2.0, 3.0], [], "Figure 3")])
    got = {r.chart_id: r for r in digitize.digitize(raster.images(charts_), raster.tokens(charts_)).collect()}
    assert set(got) == {"gap"} and [row["values"][0] is None for row in got["gap"].plot_rows] == [False, False, True, False, False, False]


def test_unread_ticks_are_filled(spark):
    charts_ = frame(spark, [("c", [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], [("series a", [1.0, 2.0, 2.5, 3.0, 2.0, 1.0])], "Figure 1")])
    seen = raster.tokens(charts_, left_out=lambda i: i == 3)
    assert seen.count() == 5 + 6 + 1
    one = digitize.digitize(raster.images(charts_), seen).first()
    assert [row.x for row in one.plot_rows] == [0, 1, 2, 3, 4, 5] and one.plot_rows[3]["values"][0] == pytest.approx(3.0, abs=0.1)
    boxes_ = digitize.axis_boxes(raster.images(charts_), digitize.charts.tick_groups(seen.limit(0).select("chart_id", F.lit(0.0).alias("value"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1).alias("width"), F.lit(1).alias("height"))))
    assert boxes_.first().method == "lines"


def test_a_series_beside_the_x_axis_takes_nothing_of_it():
    """The lowest series runs a pixel above the axis for a while."""
    layout = raster.Layout()
    steps = [[0.1, 0.1, 0.2, 0.1, 0.1, 0.3], [1.2, 1.2, 1.1, 1.4, 1.2, 1.1], [2.1, 2.1, 2.4, 2.4, 2.8, 2.1], [3.1, 3.8, 3.2, 3.4, 3.2, 3.3], [4.3, 4.1, 4.3, 4.1, 4.3, 4.1]]
    found = lines.segments_of(raster.draw(layout, [float(x) for x in range(6)], steps))
    assert any(kind == "h" and abs(x1 - layout.left) <= 2 and abs(x2 - layout.right) <= 2 and abs(y1 - layout.bottom) <= 2 for kind, x1, y1, x2, _ in found)


def test_many_charts_are_labelled_by_the_batch(spark):
    none = "series_pos int, label_hint string, r double, g double, b double, samples array<double>, quality double"
    rows = [("a", 1, None, 255.0, 0.0, 0.0, [1.0, 2.0, None], 2.0), ("a", 2, "hint", None, None, None, [5.0, 6.0, 7.0], 1.0), ("a", 3, None, 250.0, 0.0, 0.0, [5.5, 6.5, 7.5], None), (None, 1, None, 0.0, 0.0, 255.0, [1.0], 1.0), ("lone", 4, None, 1.0, 1.0, 1.0, [3.0], 1.0)]
    series = spark.createDataFrame(rows, f"chart_id string, {none}")
    legend = spark.createDataFrame([("a", 1, "red", 255.0, 0.0, 0.0), (None, 1, "blue", 0.0, 0.0, 255.0), ("no series", 1, "x", 1.0, 1.0, 1.0)], "chart_id string, entry_pos int, text string, r double, g double, b double")
    kept = charts.distinct_series(series)
    assert kept.columns == series.columns
    assert {(r.chart_id, r.series_pos, r.quality) for r in kept.collect()} == {("a", 1, 2.0), ("a", 2, 1.0), (None, 1, 1.0), ("lone", 4, 1.0)}
    found = charts.assign_labels(kept, legend)
    assert {tuple(r) for r in found.collect()} == {("a", 1, "red"), ("a", 2, "hint"), (None, 1, "blue"), ("lone", 4, "Series 1")}
    assert "InPandas" not in found._jdf.queryExecution().toString()


def test_images_are_read_twice(spark):
    rows = [(str(i), [float(x) for x in range(6)], [{"name": f"{n} events", "values": [k + 0.1 + (x + i) % 5 / 10 for x in range(6)]} for k, n in enumerate(["click", "view"])], "Figure: events over time") for i in range(3)]
    charts_ = spark.createDataFrame(rows, "chart_id string, xs array<double>, series array<struct<name:string,values:array<double>>>, context string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    images = raster.images(charts_)
    read = digitize.digitize(images.mapInPandas(counted, images.schema), raster.tokens(charts_)).collect()
    assert {r.chart_id: r.series_names for r in read} == {str(i): ["view events", "click events"] for i in range(3)}
    assert seen.value == 2 * 3


def test_masks_of_many_colours_are_those_of_each_pixel():
    rgb = np.random.default_rng(5).integers(0, 256, (40, 50, 3)).astype(np.uint8)
    p = rgb.astype(float)
    for m in digitize.charts.colour_masks(rgb):
        if m["center_rgb"] is not None:
            near = (np.sqrt(((p - m["center_rgb"]) ** 2).sum(axis=2)) <= digitize.charts.NEAR_COLOUR) & digitize.charts._saturated(p, digitize.charts.SATURATION, digitize.charts.BRIGHT)
            assert (m["mask"] == digitize.charts.closed(near)).all()
