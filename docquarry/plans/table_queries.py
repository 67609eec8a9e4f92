"""Queries of tables, geometry, OCR and charts, with oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import charts, ocr, records, tables
from ..sources import files as S
from . import fixtures
from .text_queries import literal, table

B = chr(92)


def header_tables(spark, sf):
    """Suppliers of each nation as a table, formatted."""
    named = S.table_from_rows(table(spark, sf, "supplier").withColumn("s_acctbal", F.format_string("%.2f", "s_acctbal")), ["s_nationkey"], ["s_suppkey"], ["s_suppkey", "s_name", "s_acctbal"])
    shaped = tables.formatted(named)
    return shaped.select("s_nationkey", "structure", F.md5("markdown").alias("markdown"), F.md5("embedding_text").alias("embedding"))


HEADER = """
SELECT s_nationkey, 'header_table' AS structure,
  md5('| s_suppkey | s_name | s_acctbal |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(printf('| %d | %s | %.2f |', s_suppkey, s_name, s_acctbal), chr(10) ORDER BY s_suppkey)) AS markdown,
  md5(string_agg(printf('s_suppkey: %d; s_name: %s; s_acctbal: %.2f', s_suppkey, s_name, s_acctbal), chr(10) ORDER BY s_suppkey)) AS embedding
FROM supplier GROUP BY s_nationkey
"""


def pair_tables(spark, sf):
    """Each part as a key-value block."""
    rows = [("Part Number:", F.col("p_partkey").cast("string")), ("Product name:", F.concat(F.lit("  "), F.col("p_name"), F.lit(" | x"))), ("Status", F.lit(""))]
    m = F.array(*(F.array(F.lit(k), v) for k, v in rows))
    shaped = tables.formatted(table(spark, sf, "part").select("p_partkey", m.alias("matrix")))
    return shaped.select("p_partkey", "structure", "markdown", "embedding_text")


PAIRS = f"""
SELECT p_partkey, 'key_value' AS structure,
  '| Field | Value |' || chr(10) || '| --- | --- |' || chr(10) || '| Part Number | ' || p_partkey || ' |' || chr(10) || '| Product name | ' || p_name || ' {B}| x |' || chr(10) || '| Status |  |' AS markdown,
  'Part Number: ' || p_partkey || chr(10) || 'Product name: ' || p_name || ' | x' || chr(10) || 'Status' AS embedding_text FROM part
"""


def structures(spark, sf):
    m = tables.formatted(fixtures.tables(spark))
    return m.select("table_id", "structure", tables.looks_like_data(F.col("matrix")).alias("data_first"), F.size("matrix").alias("n_rows"))


STRUCTURES = [("critical", "header_table", False, 3), ("parts", "header_table", False, 3), ("lots", "key_value", True, 3), ("colons", "key_value", False, 3), ("alpha", "header_table", True, 3), ("discontinuation", "header_table", True, 3), ("materials", "header_table", False, 4)]


def column_anchors(spark, sf):
    """Anchors of the prices of each brand and the anchor nearest to each part."""
    parts = table(spark, sf, "part")
    anchors = parts.groupBy("p_type").agg(tables.column_anchors(F.collect_list(F.floor("p_retailprice").cast("double")), 3).alias("a"))
    met = parts.join(anchors, "p_type").withColumn("i", tables.nearest_anchor(F.col("p_retailprice"), F.col("a")))
    return met.select("p_partkey", F.size("a").cast("long").alias("n_anchors"), F.round(F.get("a", F.col("i")), 4).alias("anchor"))


def nearest_join(spark, sf):
    anchors = F.array(*(F.lit(float(a)) for a in (900, 1000, 1250, 1700)))
    return table(spark, sf, "part").select("p_partkey", tables.nearest_anchor(F.col("p_retailprice"), anchors).alias("column_no"))


NEAREST = """
SELECT p_partkey, (list_position(d, list_min(d)) - 1)::INTEGER AS column_no
FROM (SELECT p_partkey, list_transform([900.0, 1000.0, 1250.0, 1700.0], lambda a: abs(p_retailprice - a::DOUBLE)) AS d FROM part)
"""


#: Pages of parts: rows to a page and to its first table, where columns, rows and the second table lie, and the words above.
PAGE_ROWS, FIRST_ROWS = 24, 12
COLUMNS = (50.0, 180.0, 320.0, 450.0)
TOP, LEADING, APART = 100.0, 14.0, 60.0
TITLES = ("Part", "Size", "Type", "Price")


def part_pages(spark, sf):
    """T01-T10 on pages laid out from parts: a document for each brand, two tables to a page, lines in the order of columns, a little
    out of line, some cells missing; words above the first table are its header on even pages and a section title on odd ones."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    rows = table(spark, sf, "part").withColumn("n", place).select(F.col("p_brand").alias("document_id"), F.floor(F.col("n") / PAGE_ROWS).cast("int").alias("page"), (F.col("n") % PAGE_ROWS).alias("i"), "p_partkey", "p_size", "p_type", "p_retailprice")
    shift = F.col("p_partkey") % 3
    top = TOP + LEADING * F.col("i") + F.when(F.col("i") >= FIRST_ROWS, APART).otherwise(0.0)
    texts = (F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.when((F.col("p_size") % 7 != 0) | F.col("i").isin(0, FIRST_ROWS), F.col("p_type")), F.format_string("%.2f", "p_retailprice"))
    cell = lambda k, t: F.struct((F.lit(100 * k) + F.col("i")).cast("int").alias("line_no"), t.alias("text"), (COLUMNS[k] + F.col("p_partkey") % 4).alias("x0"), (top + 0.9 * ((shift + k) % 3)).alias("y0"))
    lines = rows.select("document_id", "page", F.explode(F.array(*(cell(k, t) for k, t in enumerate(texts)))).alias("c")).select("document_id", "page", "c.*").filter("text IS NOT NULL")
    sized = lambda df: df.withColumns({"x1": F.col("x0") + 40.0, "y1": F.col("y0") + 10.0})
    prose = rows.select("document_id", "page").distinct()
    word = lambda k, t: F.struct(F.lit(k).alias("word_no"), t.alias("text"), F.lit(COLUMNS[k]).alias("x0"), F.lit(TOP - 16.0 + k % 2).alias("y0"))
    title = F.array(*(F.lit(t) for t in ("1.2", "Section", "of", "parts")))
    words = prose.select("document_id", "page", F.explode(F.array(*(word(k, F.when(F.col("page") % 2 == 0, F.lit(t)).otherwise(title[k])) for k, t in enumerate(TITLES)))).alias("w")).select("document_id", "page", "w.*")
    foot = prose.select("document_id", "page", F.lit(900).alias("line_no"), F.lit("a line below all tables").alias("text"), F.lit(61.0).alias("x0"), F.lit(700.0).alias("y0"))
    found = tables.detect(sized(lines.unionByName(foot)), sized(words))
    cells = F.array_join(F.transform("matrix", lambda r: F.array_join(r, "|")), ";")
    return found.select("document_id", "page", "table_index", "header_recovered", F.md5(cells).alias("cells"), F.round(F.get("bbox", F.lit(1)), 4).alias("top"))


PART_PAGES = f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part),
     r AS (SELECT p_brand AS document_id, CAST(n // {PAGE_ROWS} AS INTEGER) AS page, n % {PAGE_ROWS} AS i, p_partkey,
             p_partkey || '|' || p_size || '|' || CASE WHEN p_size % 7 <> 0 OR n % {PAGE_ROWS} IN (0, {FIRST_ROWS}) THEN p_type ELSE '' END || '|' || printf('%.2f', p_retailprice) AS cells,
             CASE WHEN p_size % 7 <> 0 OR n % {PAGE_ROWS} IN (0, {FIRST_ROWS}) THEN [0, 1, 2, 3] ELSE [0, 1, 3] END AS columns FROM n),
     t AS (SELECT document_id, page, CASE WHEN i < {FIRST_ROWS} THEN 1 ELSE 2 END AS k, string_agg(cells, ';' ORDER BY i) AS cells,
             min({TOP} + {LEADING} * i + CASE WHEN i >= {FIRST_ROWS} THEN {APART} ELSE 0 END + 0.9 * list_min(list_transform(columns, lambda c: (p_partkey % 3 + c) % 3))) AS top
           FROM r GROUP BY ALL HAVING count(*) >= 2)
SELECT document_id, page, CAST(k AS INTEGER) AS table_index, k = 1 AND page % 2 = 0 AS header_recovered,
  md5(CASE WHEN k = 1 AND page % 2 = 0 THEN '{"|".join(TITLES)};' ELSE '' END || cells) AS cells,
  round(CASE WHEN k = 1 AND page % 2 = 0 THEN {TOP - 16} ELSE top END, 4) AS top FROM t
"""


def header_band(spark, sf):
    """Events as words in bands above others of the same user: a range join in a page."""
    e = table(spark, sf, "events")
    boxes = e.filter("event_type = 'error'").select(F.col("event_id").alias("table_id"), F.lit("d").alias("document_id"), F.col("user_id").alias("page"), F.lit(0.0).alias("left"), F.lit(50.0).alias("right"), (F.col("value") + 30).alias("top"))
    words = e.filter("event_type = 'click'").select(F.lit("d").alias("document_id"), F.col("user_id").alias("page"), "event_type", F.col("value").alias("x0"), (F.col("value") + 1).alias("x1"), F.col("value").alias("y0"), (F.col("value") + 2).alias("y1"), F.col("event_type").alias("text"))
    met = tables.words_above(boxes, words)
    return met.groupBy("table_id").agg(F.count("*").alias("n"), F.round(F.sum("y0"), 4).alias("y"))


BAND = """
SELECT t.event_id AS table_id, count(*) AS n, round(sum(w.value), 4) AS y FROM events t JOIN events w ON t.user_id = w.user_id
WHERE t.event_type = 'error' AND w.event_type = 'click' AND w.value + 2 <= t.value + 30 AND w.value >= greatest(0, t.value + 30 - 25) AND w.value + 1 >= 0 AND w.value <= 50 GROUP BY t.event_id
"""


def gap_segments(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("s")).withColumn("e", F.col("s") + 60)
    return tables.segments(e, ["user_id"], "s", "e", 3600).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("s").alias("first"))


SEGMENTS = """
WITH e AS (SELECT user_id, floor(epoch(ts)) AS s FROM events),
     g AS (SELECT *, CASE WHEN s - (lag(s) OVER w + 60) > 3600 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s)),
     k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM g)
SELECT user_id, segment, count(*) AS n, min(s)::DOUBLE AS first FROM k GROUP BY ALL
"""


def _ocr(spark):
    rows = [("d", 1, *r) for r in fixtures.OCR]
    return spark.createDataFrame(rows, "document_id string, page int, block_num int, par_num int, line_num int, text string, conf double, left int, top int, width int, height int")


def ocr_lines(spark, sf):
    return ocr.lines(_ocr(spark)).select("line_no", "text", "x0", "y0", "x1", "y1", F.round("confidence", 4).alias("confidence"))


def ocr_table(spark, sf):
    found = ocr.table_matrix(ocr.lines(_ocr(spark)))
    return found.select("document_id", F.array_join(F.transform("matrix", lambda r: F.array_join(r, "|")), ";").alias("cells"))


def ocr_numbers(spark, sf):
    return ocr.numeric_tokens(_ocr(spark)).select("text", "value", "x", "y")


def ocr_pages(spark, sf):
    """Pages whose images take most of them, by document length."""
    pages = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"), (F.col("n_chars") * 10.0).alias("page_area"))
    images = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page"), F.lit(100.0).alias("width"), (F.col("doc_id") % 11 * 10.0).alias("height"))
    return ocr.pages_for_ocr(pages, images).select("document_id")


def _ticks(spark):
    return spark.createDataFrame(fixtures.TICKS, "chart_id string, axis string, pixel double, value double")


def axis_fit(spark, sf):
    fits = charts.fit_axes(_ticks(spark))
    return fits.select("chart_id", "axis", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), F.col("points").cast("long").alias("points"), F.round("rmse", 6).alias("rmse"))


def _weekly(spark, sf):
    """Mean value of each event type by day: ticks and pixels of a made-up axis."""
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v")).withColumn("x", F.datediff("day", F.lit("2024-01-01")).cast("double"))


def axis_fit_events(spark, sf):
    w = _weekly(spark, sf)
    ticks = w.select(F.col("event_type").alias("chart_id"), F.lit("x").alias("axis"), (F.col("x") * 7 + 30).alias("pixel"), F.col("x").alias("value"))
    return charts.fit_axes(ticks).select("chart_id", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.col("points").cast("long").alias("points"))


AXIS_EVENTS = """
WITH d AS (SELECT DISTINCT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::DOUBLE AS x FROM events)
SELECT event_type AS chart_id, round(regr_slope(x, x * 7 + 30), 6) AS slope, round(regr_intercept(x, x * 7 + 30), 5) AS intercept, count(*) AS points FROM d GROUP BY event_type
"""


def tick_fill(spark, sf):
    return charts.fill_ticks(charts.fit_axes(_ticks(spark))).select("chart_id", F.posexplode(F.arrays_zip("values", "pixels")).alias("i", "t")).select("chart_id", "i", F.round("t.values", 6).alias("value"), F.round("t.pixels", 4).alias("pixel"))


CALIBRATION = [
    ("good", [0.0, 2.0, 4.0, 6.0], [10.0, 20.0, 30.0, 40.0], [0.0, 8.0], 0.1, "Figure 1: scores over time", "accepted"),
    ("few", [0.0, 2.0, 4.0], [10.0, 20.0, 30.0], [0.0, 8.0], 0.1, "Figure", "too_few_x_ticks"),
    ("twice", [0.0, 2.0, 2.0, 6.0], [10.0, 20.0, 30.0, 40.0], [0.0, 8.0], 0.1, "Figure", "duplicate_x_ticks"),
    ("back", [0.0, 2.0, 4.0, 6.0], [10.0, 20.0, 15.0, 40.0], [0.0, 8.0], 0.1, "Figure", "non_monotonic_x_ticks"),
    ("prose", [15.0, 22.0, 2024.0, 2027.0], [10.0, 20.0, 30.0, 40.0], [0.0, 8.0], 0.1, "Figure", "irregular_tick_spacing"),
    ("flat", [0.0, 2.0, 4.0, 6.0], [10.0, 20.0, 30.0, 40.0], [8.0, 8.0], 0.1, "Figure", "invalid_y_range"),
    ("poor", [0.0, 2.0, 4.0, 6.0], [10.0, 20.0, 30.0, 40.0], [0.0, 8.0], 1.0, "Figure", "poor_y_calibration"),
    ("image", [0.0, 2.0, 4.0, 6.0], [10.0, 20.0, 30.0, 40.0], [0.0, 8.0], 0.1, "", "no_chart_context"),
]


def calibration_check(spark, sf):
    rows = spark.createDataFrame([r[:-1] for r in CALIBRATION], "chart_id string, v array<double>, p array<double>, y array<double>, rmse double, context string")
    return rows.select("chart_id", charts.calibration(F.col("v"), F.col("p"), F.col("y"), F.col("rmse"), F.col("context")).alias("reason"))


def _event_rows(spark, sf):
    """One chart of all event types by day."""
    w = _weekly(spark, sf)
    days = w.groupBy("x").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    names = w.select("event_type").distinct().agg(F.array_sort(F.collect_list("event_type")).alias("series_names"))
    rows = days.crossJoin(F.broadcast(names)).select("series_names", F.struct("x", F.transform("series_names", lambda n: F.try_element_at(F.col("m"), n)).alias("values"), F.lit(charts.NOTE).alias("uncertainty_note")).alias("r"))
    return rows.groupBy("series_names").agg(F.array_sort(F.collect_list("r"), lambda a, b: F.signum(a["x"] - b["x"]).cast("int")).alias("plot_rows"))


def plot_extreme(spark, sf):
    """The lowest and highest event type of every day of the table."""
    ask = lambda word: F.concat(F.lit(f"which is {word} at week "), F.col("day").cast("string"))
    both = _event_rows(spark, sf).select("*", F.explode("plot_rows.x").alias("x")).select("plot_rows", "series_names", F.col("x").cast("long").alias("day"))
    answer = lambda word: charts.plot_answer(ask(word), F.col("plot_rows"), F.col("series_names"))
    name = lambda c: F.regexp_extract(c["answer"], r", (.+?) has the", 1)
    return both.select("day", name(answer("lowest")).alias("lowest"), name(answer("highest")).alias("highest")).filter("lowest is not null")


EXTREME = """
WITH w AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS x, avg(value) AS v FROM events GROUP BY ALL)
SELECT x AS day, arg_min(event_type, v) AS lowest, arg_max(event_type, v) AS highest FROM w GROUP BY x
"""

PLOT_QUESTIONS = [
    ("Which treatment group has the lowest score at week 12?", "At Week 12, Luminara 50mg (n=225) has the lowest mean Neuropathy Symptom Score, approximately 1.8."),
    ("Highest score at week 6?", "At Week 6, Placebo (n=215) has the highest mean Neuropathy Symptom Score, approximately 7.8."),
    ("Score of placebo at week 4", "At Week 4, the mean Neuropathy Symptom Score for Placebo (n=215) is approximately 8."),
    ("Score with Luminara 25 mg at week 10", "At Week 10, the mean Neuropathy Symptom Score for Luminara 25mg (n=210) is approximately 4.1."),
    ("lowest at week 12.5", "At Week 12.5, Luminara 50mg (n=225) has the lowest mean Neuropathy Symptom Score, approximately 1.8."),
    ("lowest at week 13", None),
    ("lowest of all", None),
]


def plot_answers(spark, sf):
    asked = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(PLOT_QUESTIONS)], "id long, q string")
    chart = fixtures.chart_rows(spark).filter("chart_id = 'chart'")
    return asked.crossJoin(F.broadcast(chart)).select("id", charts.plot_answer(F.col("q"), F.col("plot_rows"), F.col("series_names"))["answer"].alias("answer"))


def baseline_repair(spark, sf):
    fixed = fixtures.chart_rows(spark).withColumn("plot_rows", charts.repair_baseline(F.col("plot_rows")))
    return fixed.select("chart_id", F.array_join(F.transform(F.get("plot_rows", F.lit(0))["values"], lambda v: F.format_string("%.1f", v)), "|").alias("first"), F.contains(F.get("plot_rows", F.lit(0))["uncertainty_note"], F.lit("inferred")).alias("inferred"), charts.rows_valid(F.col("plot_rows")).alias("valid"))


def plot_table(spark, sf):
    matrix, text = charts.plot_texts(F.col("plot_rows"), F.col("series_names"))
    return fixtures.chart_rows(spark).select("chart_id", F.array_join(F.get(matrix, F.lit(2)), "|").alias("second"), F.substring_index(text, "\n", 1).alias("line"))


def series_labels(spark, sf):
    series = spark.createDataFrame(
        [("c", 1, None, 250.0, 0.0, 0.0, [1.0, 2.0, 3.0], 2.0), ("c", 2, None, 0.0, 0.0, 250.0, [9.0, 8.0, 7.0], 1.9), ("c", 3, None, 240.0, 0.0, 0.0, [1.0, 3.0, 4.0], 1.5), ("c", 4, "Gray series", 128.0, 128.0, 128.0, [20.0, 21.0, 22.0], 1.2)],
        "chart_id string, series_pos int, label_hint string, r double, g double, b double, samples array<double>, quality double",
    )
    legend = spark.createDataFrame([("c", 1, "blue", 0.0, 10.0, 255.0), ("c", 2, "red", 255.0, 10.0, 0.0)], "chart_id string, entry_pos int, text string, r double, g double, b double")
    return charts.assign_labels(charts.distinct_series(series), legend)


def matrix_records(spark, sf):
    """Parts of each type as a matrix; its records by canonical field."""
    named = S.table_from_rows(table(spark, sf, "part").select("p_type", "p_partkey", F.col("p_name").alias("Description"), F.col("p_partkey").alias("Article Number")), ["p_type"], ["p_partkey"], ["Article Number", "Description"])
    each = named.select("p_type", F.posexplode(records.from_matrix(F.col("matrix"))).alias("i", "r"))
    return each.select("p_type", "i", records.value_of(F.col("r"), "part number").alias("part"), records.label_of(F.col("r")).alias("label"))


RECORDS = "SELECT p_type, (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1)::INTEGER AS i, p_partkey::VARCHAR AS part, p_name AS label FROM part"


def text_records(spark, sf):
    t = F.concat(F.lit("Lot: "), "p_partkey", F.lit("; Batch number: "), "p_size", F.lit("\nno field; Expiry: "), "p_brand", F.lit(" ;; empty: ;"))
    r = F.get(records.from_text(t), F.lit(0))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(r, lambda p: F.concat_ws("=", p["field"], p["value"])), "|").alias("record"))


QUERIES = {
    "header_markdown": header_tables,
    "kv_embedding_text": pair_tables,
    "table_structure_class": structures,
    "column_anchors": column_anchors,
    "nearest_column": nearest_join,
    "page_table_detection": part_pages,
    "header_range_join": header_band,
    "gap_segments": gap_segments,
    "ocr_lines": ocr_lines,
    "ocr_table": ocr_table,
    "ocr_numeric_tokens": ocr_numbers,
    "ocr_page_filter": ocr_pages,
    "axis_fit": axis_fit,
    "axis_fit_events": axis_fit_events,
    "tick_fill": tick_fill,
    "calibration_check": calibration_check,
    "plot_extreme": plot_extreme,
    "plot_answers": plot_answers,
    "baseline_repair": baseline_repair,
    "plot_table_text": plot_table,
    "series_assignment": series_labels,
    "records_from_matrix": matrix_records,
    "records_from_text": text_records,
}

ORACLES = {
    "header_markdown": HEADER,
    "kv_embedding_text": PAIRS,
    "table_structure_class": literal("table_id VARCHAR, structure VARCHAR, data_first BOOLEAN, n_rows INTEGER", STRUCTURES),
    "nearest_column": NEAREST,
    "page_table_detection": PART_PAGES,
    "header_range_join": BAND,
    "gap_segments": SEGMENTS,
    "ocr_lines": literal("line_no INTEGER, text VARCHAR, x0 INTEGER, y0 INTEGER, x1 INTEGER, y1 INTEGER, confidence DOUBLE", [(1, "Test Limit", 10, 10, 250, 22, 90.5), (2, "Burst ramp 0.90", 10, 30, 242, 43, 87.6667), (3, "Seal O.5", 11, 50, 231, 62, 77.5)]),
    "ocr_table": literal("document_id VARCHAR, cells VARCHAR", [("d", "Test|Limit;Burst ramp|0.90;Seal|O.5")]),
    "ocr_numeric_tokens": literal("text VARCHAR, value DOUBLE, x DOUBLE, y DOUBLE", [("0.90", 0.9, 222.0, 37.0), ("O.5", 0.5, 216.0, 56.0)]),
    "ocr_page_filter": "SELECT doc_id::VARCHAR AS document_id FROM documents WHERE doc_id % 7 = 0 OR length(trim(coalesce(text, ''))) = 0 OR (doc_id % 11) * 1000.0 / greatest(n_chars * 10.0, 1.0) >= 0.45",
    "axis_fit": literal("chart_id VARCHAR, axis VARCHAR, slope DOUBLE, intercept DOUBLE, points BIGINT, rmse DOUBLE", [("c", "x", 0.04, -4.0, 5, 0.0), ("c", "y", -0.025, 10.0, 5, 0.0)]),
    "axis_fit_events": AXIS_EVENTS,
    "tick_fill": literal("chart_id VARCHAR, i INTEGER, value DOUBLE, pixel DOUBLE", [("c", i, 2.0 * i, 100.0 + 50 * i) for i in range(6)]),
    "calibration_check": literal("chart_id VARCHAR, reason VARCHAR", [(r[0], r[-1]) for r in CALIBRATION]),
    "plot_extreme": EXTREME,
    "plot_answers": literal("id BIGINT, answer VARCHAR", [(i, a) for i, (_, a) in enumerate(PLOT_QUESTIONS)]),
    "baseline_repair": literal("chart_id VARCHAR, first VARCHAR, inferred BOOLEAN, valid BOOLEAN", [("chart", "8.5|8.5|8.5", False, True), ("hidden", "8.5|8.5|8.5", True, True)]),
    "plot_table_text": literal("chart_id VARCHAR, second VARCHAR, line VARCHAR", [("chart", f"2|8.2|7.5|7|{charts.NOTE}", "x=0, Placebo (n=215)=8.5, Luminara 25mg (n=210)=8.5, Luminara 50mg (n=225)=8.5 (approximate)"), ("hidden", f"2|8.2|7.5|7|{charts.NOTE}", "x=0, Placebo (n=215)=8.5, Luminara 25mg (n=210)=8.5, Luminara 50mg (n=225)=4 (approximate)")]),
    "series_assignment": literal("chart_id VARCHAR, series_pos INTEGER, label VARCHAR", [("c", 1, "red"), ("c", 2, "blue"), ("c", 4, "Gray series")]),
    "records_from_matrix": RECORDS,
    "records_from_text": "SELECT p_partkey, 'lot number=' || p_size || '|expiration date=' || p_brand AS record FROM part",
}

#: Typed-in cases, which tests run; the registered queries of these names work on given tables.
FIXTURES = ('table_structure_class', 'ocr_lines', 'ocr_table', 'ocr_numeric_tokens', 'axis_fit', 'tick_fill', 'calibration_check', 'baseline_repair', 'plot_table_text', 'plot_answers', 'series_assignment')
FIXTURE_QUERIES, FIXTURE_ORACLES = ({name: d.pop(name) for name in FIXTURES} for d in (QUERIES, ORACLES))
