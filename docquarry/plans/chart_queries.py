"""Charts drawn from events and read back from their pixels, with the values in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import digitize, lines, raster
from ..session import stored
from .text_queries import table

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
#: A series moves in a band of its own, in so many steps of a tenth.
STEPS = 7
#: The bands begin so far above whole numbers, clear of the x axis.
FLOOR = 0.1
#: Place of the x tick whose label isn't read.
UNREAD = 3


def event_charts(spark, sf) -> DataFrame:
    """A chart for each user and month: a line for each event type, over six stretches of five days (the last one to the month's
    end), of its events there against the user's most in any stretch of any type."""
    e = table(spark, sf, "events").filter("ts IS NOT NULL").select("user_id", F.date_format("ts", "yyyy-MM").alias("month"), F.least(F.lit(5), F.floor((F.dayofmonth("ts") - 1) / 5)).cast("int").alias("x"), "event_type")
    cells = e.groupBy("user_id", "month", "x", "event_type").agg(F.count("*").alias("n"))
    of = cells.groupBy("user_id", "month").agg(F.max("n").alias("most"), F.map_from_entries(F.collect_list(F.struct(F.struct("event_type", "x").alias("cell"), F.col("n").alias("n")))).alias("m"))  # 30 cells at most
    level = lambda t, x: F.floor(STEPS * F.coalesce(F.try_element_at("m", F.struct(F.lit(t).alias("event_type"), F.lit(x).alias("x"))), F.lit(0)) / F.col("most")) / 10
    series = F.array(*(F.struct(F.lit(f"{t} events").alias("name"), F.array(*(i + FLOOR + level(t, x) for x in range(6))).alias("values")) for i, t in enumerate(EVENT_TYPES)))
    key = F.concat_ws("|", "user_id", "month")
    return of.select(key.alias("chart_id"), F.array(*(F.lit(float(x)) for x in range(6))).alias("xs"), series.alias("series"), F.lit("Figure: events over time").alias("context"))


def _key(chart_id: str = "chart_id"):
    part = F.split(chart_id, r"\|")
    return part[0].cast("long").alias("user_id"), part[1].alias("month")


def digitize_events(spark, sf) -> DataFrame:
    """Every chart drawn (without the label of one tick) and read back: the step of each event type at each stretch."""
    charts_ = stored(event_charts(spark, sf), "charts")
    images = raster.images(charts_)  # drawn anew for each use: a stored table's reader would hold 4,096 of them at once
    read = digitize.digitize(images, raster.tokens(charts_, left_out=lambda i: i == UNREAD))
    values = read.select("chart_id", "confidence", "series_names", F.explode("plot_rows").alias("r")).select("chart_id", "confidence", F.col("r.x").cast("int").alias("x"), F.explode(F.arrays_zip(F.col("series_names").alias("name"), F.col("r.values").alias("v"))).alias("p"))
    names = F.array(*(F.lit(f"{t} events") for t in EVENT_TYPES))
    band = F.array_position(names, F.col("p.name")) - 1
    return values.select(*_key(), "x", F.regexp_replace("p.name", " events$", "").alias("event_type"), F.rint(10 * (F.col("p.v") - band - FLOOR)).cast("int").alias("step"), F.round("confidence", 6).alias("confidence"))


DIGITIZED = f"""
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, least(5, (day(ts) - 1) // 5) AS x, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL),
     m AS (SELECT user_id, month, max(n) AS most FROM e GROUP BY ALL),
     c AS (SELECT m.*, x.x, t.event_type FROM m, (SELECT unnest(range(6)) AS x) x, (SELECT unnest({EVENT_TYPES}) AS event_type) t)
SELECT c.user_id, c.month, CAST(c.x AS INTEGER) AS x, c.event_type, CAST({STEPS} * coalesce(n, 0) // most AS INTEGER) AS step, 0.8::DOUBLE AS confidence
FROM c LEFT JOIN e ON e.user_id = c.user_id AND e.month = c.month AND e.x = c.x AND e.event_type = c.event_type
"""


def axis_lines(spark, sf) -> DataFrame:
    """The axes of every chart found by lines alone, without any label, and whether they lie within two pixels of those drawn."""
    layout = raster.Layout()
    found = lines.axis_pairs(lines.segments(raster.images(event_charts(spark, sf), layout)))
    near = [F.abs(F.col(side) - getattr(layout, side)) <= 2 for side in ("left", "top", "right", "bottom")]
    return found.select(*_key(), (near[0] & near[1] & near[2] & near[3]).alias("as_drawn"))


AXES = "SELECT DISTINCT user_id, strftime(ts, '%Y-%m') AS month, true AS as_drawn FROM events WHERE ts IS NOT NULL"

QUERIES = {"digitize_events": digitize_events, "axis_lines": axis_lines}
ORACLES = {"digitize_events": DIGITIZED, "axis_lines": AXES}
