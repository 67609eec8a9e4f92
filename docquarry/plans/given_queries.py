"""Small cases of the operators, laid out from the given tables: each part, user, turn or document fills one, and SQL says what must
come of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..operators import charts, corpus, evaluation, ingestion, ocr, routes, tables
from . import duck as D
from .source_queries import HEADS, _HEADS
from .text_queries import CHUNKS_CTE, table


def q(text: str) -> str:
    """A text as an SQL literal; line ends by chr(10)."""
    return "(" + " || chr(10) || ".join("'" + t.replace("'", "''") + "'" for t in text.split("\n")) + ")"


# -- texts ---------------------------------------------------------------------------------------------------------------


def doc_type_rules(spark, sf):
    """X14 over whole documents, with a telling first line on most and a telling name on some."""
    head = F.element_at(F.array(*(F.lit(h) for h in HEADS)), (F.col("doc_id") % len(HEADS) + 1).cast("int"))
    name = F.when(F.col("doc_id") % 17 == 0, F.lit("my coa.pdf")).otherwise(F.format_string("cocoa-%d.pdf", "doc_id"))
    return table(spark, sf, "documents").select("doc_id", X.doc_type(F.concat_ws("\n", head, F.lower("text")), name).alias("doc_type"))


DOC_TYPES = f"""
WITH t AS (SELECT doc_id, {D.collapse(f"lower(CASE WHEN doc_id % 17 = 0 THEN 'my coa.pdf' ELSE 'cocoa-' || doc_id || '.pdf' END || chr(10) || concat_ws(chr(10), {_HEADS}[doc_id % {len(HEADS)} + 1], text))")} AS whole FROM documents)
SELECT doc_id, {D.doc_type('whole')} AS doc_type FROM t
"""


def question_parts(spark, sf):
    """X16-X18 of questions about the words of every turn."""
    t = table(spark, sf, "conversations").withColumn("q", F.format_string("What is the lot no and expiry date of %s at x = %d", F.coalesce("text", F.lit("")), "turn"))
    fields = X.requested_fields(F.col("q"))
    return t.select("conv_id", "turn", F.array_join(fields, "|").alias("fields"), F.md5(F.array_join(X.entity_terms(F.col("q"), fields), "|")).alias("entities"), X.requested_x(F.col("q")).alias("x"))


_ASKED = "('What is the lot no and expiry date of ' || coalesce(text, '') || ' at x = ' || turn)"
_FIELDS = " || ".join(f"CASE WHEN {D.any_of('n', names)} THEN '|{field}' ELSE '' END" for field, names in config.QUESTION_FIELDS.items())
_X = ", ".join(f"TRY_CAST(nullif(regexp_extract({D.plot('raw')}, '{p}', 1), '') AS DOUBLE)" for p in (r"\bweek\s*(\d+(?:\.\d+)?)\b", r"\bat\s+(?:x\s*=\s*)?(\d+(?:\.\d+)?)\b", r"\bx\s*=\s*(\d+(?:\.\d+)?)\b"))
PARTS = f"""
WITH t AS (SELECT conv_id, turn, text, {_ASKED} AS raw, {D.rag(_ASKED)} AS n FROM conversations), f AS (SELECT *, substr({_FIELDS}, 2) AS fields FROM t)
SELECT conv_id, turn, fields, md5(array_to_string(list_filter({D.words('raw')}, lambda w: length(w) >= 3 AND NOT list_contains({D.values(config.ENTITY_IGNORED)}, w)
  AND NOT list_contains(string_split(replace(fields, '|', ' '), ' '), w)), '|')) AS entities,
  coalesce({_X}) AS x FROM f
"""


def refusal_stability(spark, sf):
    """Every turn as an answer, some of them refusals in other wordings; odd turns ought to be refused."""
    t = table(spark, sf, "conversations")
    said = F.when(F.col("turn") % 3 == 0, F.lit(config.NOT_FOUND)).when(F.col("turn") % 3 == 1, F.concat(F.lit("  the ANSWER was not\tfound in the processed documents. "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    rows = evaluation.refusal_stability(t.select("conv_id", "turn", said.alias("answer")), F.col("turn") % 2 == 1)
    return rows.select("conv_id", "turn", "refused", "stable_pass")


REFUSED = f"""
WITH r AS (SELECT conv_id, turn, turn % 3 < 2 OR contains({D.expected('text')}, {q(config.NOT_FOUND.lower())}) AS refused FROM conversations)
SELECT conv_id, turn, refused, refused = (turn % 2 = 1) AS stable_pass FROM r
"""

# -- tables and OCR ------------------------------------------------------------------------------------------------------


def table_structure_class(spark, sf):
    """A small table of each part, in four shapes."""
    p = table(spark, sf, "part")
    s = lambda c: F.col(c).cast("string")
    row = lambda *cells: F.array(*(c if not isinstance(c, str) else F.lit(c) for c in cells))
    shapes = (
        F.array(row("Part Number", "Description"), row(s("p_partkey"), s("p_name")), row(s("p_size"), s("p_type"))),
        F.array(row("Lot Number", s("p_partkey")), row("Product Article Number", s("p_size")), row("Date of Manufacture", "20240315")),
        F.array(row("Owner:", s("p_brand")), row("x", s("p_name")), row("z", "w")),
        F.array(row("Reason", "Placebo", "20 mg", "40 mg"), row(s("p_name"), "5.6%", F.concat(s("p_size"), F.lit("%")), "9.2%")),
    )
    m = tables.normalize_matrix(F.element_at(F.array(*shapes), (F.col("p_partkey") % 4 + 1).cast("int")))
    shaped = p.select("p_partkey", F.inline(F.array(F.struct(m.alias("m")))))
    return shaped.select("p_partkey", tables.structure(F.col("m")).alias("structure"), tables.looks_like_data(F.col("m")).alias("data_first"), F.size("m").alias("n_rows"))


STRUCTURES = """
SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 2) THEN 'key_value' ELSE 'header_table' END AS structure, p_partkey % 4 IN (1, 3) AS data_first, CASE WHEN p_partkey % 4 = 3 THEN 2 ELSE 3 END::INTEGER AS n_rows FROM part
"""

#: Lines of parts to a page, their height, and where sizes and prices stand.
PAGE_LINES, LINE, SIZE_AT, PRICE_AT = 20, 20, 500, 620


def _part_tokens(spark, sf):
    """OCR tokens of parts: name, size (its zeros read as O) and price on a line, beside a percentage and noise of low confidence."""
    p = table(spark, sf, "part").select((F.floor(F.col("p_partkey") / PAGE_LINES)).cast("int").alias("page"), (F.col("p_partkey") % PAGE_LINES).cast("int").alias("n"), "p_name", "p_size", "p_retailprice")
    token = lambda text, left, width, conf: F.struct(text.cast("string").alias("text"), left.cast("int").alias("left"), F.lit(width).alias("width"), F.lit(float(conf)).alias("conf"))
    words = F.transform(F.split("p_name", " "), lambda w, i: token(w, 10 + 60 * i, 50, 90))
    rest = F.array(token(F.translate(F.col("p_size").cast("string"), "0", "O"), F.lit(SIZE_AT), 30, 80), token(F.format_string("%.2f", "p_retailprice"), F.lit(PRICE_AT), 60, 70), token(F.lit("12%"), F.lit(700), 30, 30), token(F.lit("noise"), F.lit(740), 30, 10))
    return p.select(F.lit("d").alias("document_id"), "page", F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.col("n").alias("line_num"), (10 + LINE * F.col("n")).alias("top"), F.lit(12).alias("height"), F.explode(F.concat(words, rest)).alias("t")).select(
        "document_id", "page", "block_num", "par_num", "line_num", "t.text", "t.conf", "t.left", "top", "t.width", "height"
    )


_TOKEN_ROWS = f"""r AS (SELECT CAST(p_partkey // {PAGE_LINES} AS INTEGER) AS page, CAST(p_partkey % {PAGE_LINES} AS INTEGER) AS n, p_name, replace(p_size::VARCHAR, '0', 'O') AS size, p_size, printf('%.2f', p_retailprice) AS price,
  len(string_split(p_name, ' ')) AS words FROM part)"""


def ocr_lines(spark, sf):
    """The lines of every page of parts."""
    return ocr.lines(_part_tokens(spark, sf)).select("page", "line_no", "text", "x0", "y0", "x1", "y1", F.round("confidence", 4).alias("confidence"))


LINES = f"""
WITH {_TOKEN_ROWS}
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY n) AS INTEGER) AS line_no, p_name || ' ' || size || ' ' || price AS text, 10 AS x0, 10 + {LINE} * n AS y0, {PRICE_AT + 60} AS x1, 22 + {LINE} * n AS y1,
  round((90.0 * words + 150) / (words + 2), 4)::DOUBLE AS confidence FROM r
"""


def ocr_table(spark, sf):
    """The borderless table of every page of parts."""
    found = ocr.table_matrix(ocr.lines(_part_tokens(spark, sf)))
    return found.select("page", F.array_join(F.transform("matrix", lambda r: F.array_join(r, "|")), ";").alias("cells"))


OCR_TABLE = f"WITH {_TOKEN_ROWS} SELECT page, string_agg(p_name || '|' || size || '|' || price, ';' ORDER BY n) AS cells FROM r GROUP BY page HAVING count(*) >= 2"


def ocr_numeric_tokens(spark, sf):
    """Sizes and prices as numbers with their places."""
    return ocr.numeric_tokens(_part_tokens(spark, sf)).select("page", "text", "value", "x", "y")


OCR_NUMBERS = f"""
WITH {_TOKEN_ROWS}
SELECT page, size AS text, p_size::DOUBLE AS value, {SIZE_AT + 15}::DOUBLE AS x, (16 + {LINE} * n)::DOUBLE AS y FROM r
UNION ALL SELECT page, price, price::DOUBLE, {PRICE_AT + 30}::DOUBLE, (16 + {LINE} * n)::DOUBLE FROM r
"""

# -- charts --------------------------------------------------------------------------------------------------------------


def _hour_ticks(spark, sf):
    """Ticks of a chart for each event type: its days along x, its hours along y; no event in every fifth hour is read along z."""
    e = table(spark, sf, "events").filter("ts IS NOT NULL").select(F.col("event_type").alias("chart_id"), F.dayofmonth("ts").cast("double").alias("day"), F.hour("ts").cast("double").alias("hour"))
    x = e.select("chart_id", F.lit("x").alias("axis"), (30 + 7 * F.col("day")).alias("pixel"), F.col("day").alias("value"))
    return x.unionByName(e.select("chart_id", F.lit("y").alias("axis"), (400 - 4 * F.col("hour")).alias("pixel"), F.col("hour").alias("value"))).distinct()


def axis_fit(spark, sf):
    fits = charts.fit_axes(_hour_ticks(spark, sf))
    return fits.select("chart_id", "axis", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.col("points").cast("long").alias("points"), F.round("rmse", 6).alias("rmse"))


AXIS_FIT = """
WITH t AS (SELECT DISTINCT event_type AS chart_id, 'x' AS axis, 30.0 + 7 * day(ts) AS pixel, day(ts)::DOUBLE AS value FROM events UNION ALL SELECT DISTINCT event_type, 'y', 400.0 - 4 * hour(ts), hour(ts)::DOUBLE FROM events)
SELECT chart_id, axis, round(regr_slope(value, pixel::DOUBLE), 6) AS slope, round(regr_intercept(value, pixel::DOUBLE), 4) AS intercept, count(*) AS points, 0.0::DOUBLE AS rmse FROM t GROUP BY ALL
"""


def tick_fill(spark, sf):
    """The hours of each event type as x ticks, of which every fifth isn't read."""
    ticks = table(spark, sf, "events").select(F.col("event_type").alias("chart_id"), F.lit("x").alias("axis"), (30 + 9.0 * F.hour("ts")).alias("pixel"), F.hour("ts").cast("double").alias("value")).filter("value % 5 <> 3").distinct()
    filled = charts.fill_ticks(charts.fit_axes(ticks))
    return filled.select("chart_id", F.posexplode(F.arrays_zip("values", "pixels")).alias("i", "t")).select("chart_id", "i", F.round("t.values", 6).alias("value"), F.round("t.pixels", 4).alias("pixel"))


TICK_FILL = """
WITH h AS (SELECT DISTINCT event_type AS chart_id, hour(ts) AS h FROM events WHERE hour(ts) % 5 <> 3), r AS (SELECT chart_id, min(h) AS low, max(h) AS high FROM h GROUP BY ALL)
SELECT chart_id, i::INTEGER AS i, (low + i)::DOUBLE AS value, (30 + 9 * (low + i))::DOUBLE AS pixel FROM (SELECT *, unnest(range(high - low + 1)) AS i FROM r)
"""

#: Reasons of the calibration by a user's remainder.
REASONS = ("accepted", "too_few_x_ticks", "duplicate_x_ticks", "non_monotonic_x_ticks", "irregular_tick_spacing", "invalid_y_range", "poor_y_calibration", "no_chart_context")


def calibration_check(spark, sf):
    """A chart for each user, scaled by its number of events, with one of eight defects."""
    users = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"))
    k = (F.col("user_id") % len(REASONS)).cast("int")
    scaled = lambda *v: F.array(*(F.col("n") * x for x in v))
    values = F.when(k == 1, scaled(0.0, 2.0, 4.0)).when(k == 2, scaled(0.0, 2.0, 2.0, 6.0)).when(k == 4, scaled(15.0, 22.0, 2024.0, 2027.0)).otherwise(scaled(0.0, 2.0, 4.0, 6.0))
    pixels = F.when(k == 1, scaled(10.0, 20.0, 30.0)).when(k == 3, scaled(10.0, 20.0, 15.0, 40.0)).otherwise(scaled(10.0, 20.0, 30.0, 40.0))
    y = F.when(k == 5, scaled(8.0, 8.0)).otherwise(scaled(0.0, 8.0))
    rmse = F.col("n") * F.when(k == 6, 1.0).otherwise(0.1)
    return users.select("user_id", charts.calibration(values, pixels, y, rmse, F.when(k == 7, F.lit("prose")).otherwise(F.lit("Figure 1: scores over time"))).alias("reason"))


CALIBRATION = f"SELECT DISTINCT user_id, {D.values(REASONS)}[user_id % {len(REASONS)} + 1] AS reason FROM events"


def _three(spark, sf):
    """Three points of three series for each user; the last series begins hidden behind the others where the user's number is even."""
    u = table(spark, sf, "events").groupBy("user_id").agg((F.count("*") % 10 / 10.0).alias("b"))
    v = lambda *x: F.array(*(F.lit(float(y)) if not isinstance(y, str) else F.expr(y) for y in x))
    row = lambda x, values: F.struct(F.lit(float(x)).alias("x"), values.alias("values"), F.lit(charts.NOTE).alias("uncertainty_note"))
    rows = F.array(row(0, v("9D + b", "9D + b", "if(user_id % 2 = 0, 4D, 9D + b)")), row(2, v("8D", 7.5, 7.0)), row(4, v(7.5, 6.25, "5D + b")))
    return u.select("user_id", "b", rows.alias("plot_rows"), F.array(F.lit("Placebo"), F.lit("Dose 25"), F.lit("Dose 50")).alias("series_names"))


_THREE = "u AS (SELECT user_id, (count(*) % 10) / 10.0 AS b FROM events GROUP BY user_id)"


def baseline_repair(spark, sf):
    """C12, W11, F12."""
    fixed = _three(spark, sf).withColumn("plot_rows", charts.repair_baseline(F.col("plot_rows")))
    first = F.get("plot_rows", F.lit(0))
    return fixed.select("user_id", F.array_join(F.transform(first["values"], lambda v: F.format_string("%.1f", v)), "|").alias("first"), F.contains(first["uncertainty_note"], F.lit("inferred")).alias("inferred"), charts.rows_valid(F.col("plot_rows")).alias("valid"))


BASELINE = f"WITH {_THREE} SELECT user_id, printf('%.1f|%.1f|%.1f', 9 + b, 9 + b, 9 + b) AS first, user_id % 2 = 0 AS inferred, true AS valid FROM u"


def plot_table_text(spark, sf):
    """P13."""
    matrix, text = charts.plot_texts(F.col("plot_rows"), F.col("series_names"))
    return _three(spark, sf).select("user_id", F.array_join(F.get(matrix, F.lit(3)), "|").alias("last"), F.substring_index(text, "\n", -1).alias("line"))


PLOT_TABLE = f"""
WITH {_THREE}, t AS (SELECT user_id, regexp_replace(printf('%.1f', 5 + b), '[.]0$', '') AS v FROM u)
SELECT user_id, '4|7.5|6.25|' || v || '|' || {q(charts.NOTE)} AS last, 'x=4, Placebo=7.5, Dose 25=6.25, Dose 50=' || v || ' (approximate)' AS line FROM t
"""


def plot_answers(spark, sf):
    """Questions about each user's chart, at its points, near them and beyond."""
    asked = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(t).alias("q")) for i, t in enumerate(("Which has the lowest score at week 4?", "Highest score at week 2?", "Score of placebo at week 4", "lowest at week 4.5", "lowest at week 6", "lowest of all"))))
    rows = _three(spark, sf).select("user_id", "plot_rows", "series_names", F.explode(asked).alias("a"))
    return rows.select("user_id", "a.id", charts.plot_answer(F.col("a.q"), F.col("plot_rows"), F.col("series_names"))["answer"].alias("answer"))


PLOT_ANSWERS = f"""
WITH {_THREE}, l AS (SELECT user_id, CASE WHEN b <= 1.2 THEN 'Dose 50' END AS name, regexp_replace(printf('%.1f', 5 + b), '[.]0$', '') AS v FROM u), s AS (SELECT *, ' mean Neuropathy Symptom Score, approximately ' AS m FROM l)
SELECT user_id, id::INTEGER AS id, CASE id WHEN 0 THEN 'At Week 4, ' || name || ' has the lowest' || m || v || '.' WHEN 1 THEN 'At Week 2, Placebo has the highest' || m || '8.'
  WHEN 2 THEN 'At Week 4, the mean Neuropathy Symptom Score for Placebo is approximately 7.5.' WHEN 3 THEN 'At Week 4.5, ' || name || ' has the lowest' || m || v || '.' END AS answer
FROM s, (SELECT unnest(range(6)) AS id)
"""


def series_assignment(spark, sf):
    """Four series and a legend for each user, their colours and heights shifted by its number of events."""
    users = lambda: table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("chart_id")).agg((F.count("*") % 10).cast("double").alias("b"))
    s = lambda pos, hint, rgb, at, quality: F.struct(F.lit(pos).alias("series_pos"), F.lit(hint).cast("string").alias("label_hint"), *((F.lit(float(v)) + F.col("b")).alias(c) for c, v in zip("rgb", rgb, strict=True)), F.array(*(F.col("b") + float(v) for v in at)).alias("samples"), F.lit(quality).alias("quality"))
    series = users().select("chart_id", F.inline(F.array(s(1, None, (240, 0, 0), (1, 2, 3), 2.0), s(2, None, (0, 0, 240), (9, 8, 7), 1.9), s(3, None, (230, 0, 0), (1, 3, 4), 1.5), s(4, "Gray series", (128, 128, 128), (20, 21, 22), 1.2))))
    e = lambda pos, text, rgb: F.struct(F.lit(pos).alias("entry_pos"), F.lit(text).alias("text"), *(F.lit(float(v)).alias(c) for c, v in zip("rgb", rgb, strict=True)))
    legend = users().select("chart_id", F.inline(F.array(e(1, "blue", (0, 10, 255)), e(2, "red", (255, 10, 0)))))
    return charts.assign_labels(charts.distinct_series(series), legend)


SERIES = "SELECT DISTINCT user_id::VARCHAR AS chart_id, v.series_pos::INTEGER AS series_pos, v.label FROM events, (VALUES (1, 'red'), (2, 'blue'), (4, 'Gray series')) v(series_pos, label)"

# -- routes, sources and prompts -------------------------------------------------------------------------------------------

#: Kinds of questions that each part is asked, by number.
QUESTIONS = (
    "What was the observed result for the burst pressure test?",
    "What percentage of patients in the 40 mg group had any discontinuation?",
    "Which materials are used for the housing, the gaskets and the pump tubing?",
    "List the part number and operating temperature of the housing.",
    "What is the warranty period?",
    "   ",
    "Compare the operating temperature and materials of the AKTA ready flow kit products.",
    "What is the difference of Luminara doses in improvement and severe adverse event rate at week 12?",
    "Which pharmaceutical lactose uses calf rennet, and is it compliant?",
)


def _asked(spark, sf):
    """questions (question_id, question) about each part and the table that each is given as its hit."""
    # a part is a short row with nine tables to lay out: rows are dealt out first
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"), F.col("p_partkey").cast("string").alias("key")).repartition(tasks, "p_partkey")
    row = lambda *cells: F.array(*(F.lit(c) if isinstance(c, str) else c for c in cells))
    pressure = F.concat("size", F.lit(".24 MPa"))
    critical = F.array(row("Critical attribute", "Verification method", "Acceptance criterion", "Observed result"), row("Burst pressure", "Hydrostatic ramp", ">=0.90 MPa", pressure), row("Seal integrity", "Bubble test", "No leak", "No leak"))
    left = F.array(row("Reason", "Placebo", "20 mg", "40 mg"), row("Any discontinuation", "5.6%", "6.1%", F.concat("size", F.lit(".2%"))), row("Adverse event", "1.9%", "2.6%", "4.1%"))
    materials = F.array(row("Component", "Material", "Operating temperature", "Part number"), row("Housing", "Polypropylene (PP)", "+2°C to +40°C", F.concat(F.lit("100-"), "key")), row("Gasket", "EPDM", "", ""), row("Pump tubing", "Silicone", "", F.concat(F.lit("200-"), "key")))
    parts = F.array(row("Part Number", "Description"), row("29477427", "High Flow Kit F"), row("29184612", "High Flow Gradient C"))
    doses = F.array(row("Dose", "NSS reduction at week 12", "Severe adverse event rate", "Lot"), row("Luminara 25 mg", "4.7", "2.3%", F.col("key")), row("Luminara 50 mg", "6.7", "2.6%", F.col("key")))
    rennet = F.array(row("Product", "Calf rennet", "Lot"), row("Other lactose", "not used, except Lactohale® 300", F.col("key")), row("Lactohale® 300", "used", F.col("key")))
    given = (critical, left, materials, materials, parts, parts, materials, doses, rennet)
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("question"), m.alias("matrix")) for i, (t, m) in enumerate(zip(QUESTIONS, given, strict=True))))
    rows = p.select("p_partkey", "key", F.explode(each).alias("e")).select((F.col("p_partkey") * 10 + F.col("e.i")).alias("question_id"), "e.question", "key", "e.matrix")
    shaped = tables.formatted(rows)
    one = F.lit(1)
    hits = shaped.select(
        "question_id", one.alias("rank"), F.concat(F.lit("part-"), "key", F.lit(".pdf")).alias("file"), one.alias("page_start"), one.alias("page_end"), F.lit("table").alias("content_type"),
        F.col("structure").alias("table_structure_type"), F.col("matrix").alias("structured_data"), F.col("embedding_text").alias("text_for_embedding"), F.col("markdown").alias("text_for_llm"),
        F.lit(0.5).alias("semantic_score"), (F.col("question_id") % 7 / 10.0).alias("score"),
    )
    return rows.select("question_id", "question"), hits


def route_precedence(spark, sf):
    """The route of every question and its answer."""
    questions, hits = _asked(spark, sf)
    a = routes.answers(questions, hits)
    return a.select("question_id", "answer_status", "answer_route", F.when(F.col("answer_route") != "llm_generation", F.col("answer")).alias("answer"))


_TEMPERATURE = "The AKTA ready flow kits have an operating-temperature range of +2°C to +40°C. The retrieved product records identify "
_MATERIALS = " The available material information includes Housing: Polypropylene (PP); Gasket: EPDM; Pump tubing: Silicone."
ROUTED = f"""
SELECT p_partkey * 10 + i AS question_id,
  ['structured_answer', 'structured_answer', 'specialized_deterministic_answer', 'structured_answer', 'insufficient_evidence', 'empty_question', 'structured_comparison_answer', 'specialized_deterministic_answer', 'specialized_deterministic_answer'][i + 1] AS answer_status,
  ['deterministic_structured_single_field', 'deterministic_structured_single_field', 'deterministic_materials_multi_component', 'deterministic_structured_multi_field', 'evidence_gate', 'validation', 'deterministic_structured_comparison', 'deterministic_luminara_efficacy_safety_comparison', 'deterministic_calf_rennet_compliance'][i + 1] AS answer_route,
  CASE i WHEN 0 THEN p_size || '.24 MPa' WHEN 1 THEN p_size || '.2%' WHEN 2 THEN 'Housing: Polypropylene (PP)' || chr(10) || 'Gaskets: EPDM' || chr(10) || 'Pump tubing: Silicone'
    WHEN 3 THEN 'Housing — Part Number: 100-' || p_partkey || '; Operating Temperature: +2°C to +40°C' || chr(10) || 'Pump tubing — Part Number: 200-' || p_partkey
    WHEN 4 THEN {q(config.NOT_FOUND)} WHEN 5 THEN 'Please enter a question.'
    WHEN 7 THEN {q(routes.EFFICACY_SAFETY["answer"])} WHEN 8 THEN {q(routes.EXCEPTION + routes.EXCEPTION_COMPLIANCE)}
    ELSE {q(_TEMPERATURE)} || 'Housing (part number 100-' || p_partkey || ').' || {q(_MATERIALS)} END AS answer
FROM part, (SELECT unnest(range({len(QUESTIONS)})) AS i)
"""


def source_lines(spark, sf):
    """The source of every question about a part."""
    return corpus.source_lines(_asked(spark, sf)[1])


SOURCES = f"SELECT p_partkey * 10 + i AS question_id, '1. part-' || p_partkey || '.pdf | page 1 | table | score: ' || printf('%.4f', ((p_partkey * 10 + i) % 7) / 10.0) AS sources FROM part, (SELECT unnest(range({len(QUESTIONS)})) AS i)"


def prompt_text(spark, sf):
    """The whole prompt of every user turn, with the next two turns of its conversation as context (none for some)."""
    t = table(spark, sf, "conversations").filter("text IS NOT NULL").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    asked = t.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "conv_id", "turn", F.concat(F.when(F.col("turn") % 4 == 0, F.lit("List all values of ")).otherwise(F.lit("About ")), "text").alias("question"))
    near = t.select("conv_id", F.col("turn").alias("at"), F.col("text").alias("text_for_llm"))
    met = asked.join(near, "conv_id").filter(F.col("at").between(F.col("turn") + 1, F.col("turn") + 2) & (F.col("conv_id") % 5 != 0))
    hits = met.select("question_id", (F.col("at") - F.col("turn")).alias("rank"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("file"), F.col("at").alias("page_start"), F.lit("text").alias("content_type"), "text_for_llm")
    p = corpus.prompts(asked.select("question_id", "question"), hits)
    return p.select("question_id", F.md5("prompt").alias("prompt"), F.char_length("prompt").alias("n"))


_SEVERAL = f"regexp_matches(lower(question), {q('|'.join(f'(?:{p})' for p in config.MULTI_VALUE))})"
_HEAD = q("Answer the question using only the context.\n\nRules:\n")
PROMPTS = f"""
WITH t AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
     a AS (SELECT conv_id * 1000 + turn AS question_id, conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'List all values of ' ELSE 'About ' END || text AS question FROM t WHERE role = 'user'),
     c AS (SELECT question_id, string_agg('[CONTEXT ' || (t.turn - a.turn) || ']' || chr(10) || 'File: c' || a.conv_id || '.txt' || chr(10) || 'Page: ' || t.turn || chr(10) || 'Type: text' || chr(10) || trim(t.text, ' '), chr(10) || chr(10) ORDER BY t.turn) AS context
           FROM a JOIN t ON t.conv_id = a.conv_id AND t.turn BETWEEN a.turn + 1 AND a.turn + 2 WHERE a.conv_id % 5 <> 0 GROUP BY ALL),
     p AS (SELECT question_id, {_HEAD} || CASE WHEN context IS NULL THEN {q(chr(10).join((*corpus.NO_CONTEXT_RULES, corpus.ABSENT_RULE)))} ELSE {q(chr(10).join((*corpus.RULES, corpus.ABSENT_RULE)))}
           || CASE WHEN {_SEVERAL} THEN {q(chr(10) + corpus.SEVERAL_RULE)} ELSE '' END END || {q(chr(10) * 2 + 'Question:' + chr(10))} || question || {q(chr(10) * 2 + 'Context:' + chr(10))} || coalesce(context, '') || {q(chr(10) * 2 + 'Answer:')} AS prompt
           FROM a LEFT JOIN c USING (question_id))
SELECT question_id, md5(prompt) AS prompt, length(prompt)::INTEGER AS n FROM p
"""

def public_answers(spark, sf):
    """An answer about each part with its details, escaped."""
    p = table(spark, sf, "part")
    shown = corpus.public_answer(F.concat(F.lit("It is "), "p_name"), F.lit("High"), F.lit("<route> & 'more'"), F.format_string('1. "%s" | page %d', "p_brand", "p_size"))
    return p.select("p_partkey", F.md5(shown).alias("shown"))


PUBLIC = """
SELECT p_partkey, md5('It is ' || p_name || chr(10) || chr(10) || '<details><summary>Sources</summary>' || chr(10) || '<pre>Confidence: High' || chr(10) || 'Route: &lt;route&gt; &amp; &#x27;more&#x27;' || chr(10)
  || '1. &quot;' || p_brand || '&quot; | page ' || p_size || '</pre>' || chr(10) || '</details>') AS shown FROM part
"""


def ocr_page_text(spark, sf):
    """The text of every page of parts, and its confidence."""
    return ocr.page_text(ocr.lines(_part_tokens(spark, sf))).select("page", "text", F.round("confidence", 6).alias("confidence"))


PAGE_TEXT = f"""
WITH {_TOKEN_ROWS}
SELECT page, string_agg(p_name || ' ' || size || ' ' || price, chr(10) ORDER BY n) AS text, round(avg((90.0 * words + 150) / (words + 2)) / 100, 6)::DOUBLE AS confidence FROM r GROUP BY page
"""


def table_fallback(spark, sf):
    """Pages of parts where the first detector is given the even ones only; a second one's tables stand in on the others."""
    pages = ocr.table_matrix(ocr.lines(_part_tokens(spark, sf)))
    found = pages.filter("page % 2 = 0").select("document_id", "page", F.lit(1).alias("table_index"), F.lit("first").alias("detector"), F.size("matrix").alias("n"))
    second = pages.filter("page % 3 <> 0").select("document_id", "page", F.lit(1).alias("table_index"), F.lit("second").alias("detector"), F.size("matrix").alias("n"))
    return tables.with_fallback(found, second).select("page", "detector", "n")


FALLBACK = f"""
WITH {_TOKEN_ROWS}, p AS (SELECT page, count(*)::INTEGER AS n FROM r GROUP BY page HAVING count(*) >= 2)
SELECT page, CASE WHEN page % 2 = 0 THEN 'first' ELSE 'second' END AS detector, n FROM p WHERE page % 2 = 0 OR page % 3 <> 0
"""


def plot_report(spark, sf):
    """The report of each user's chart; every third one is too unsure."""
    items = _three(spark, sf).select(F.col("user_id").alias("item_seq"), "plot_rows", "series_names", F.when(F.col("user_id") % 3 == 0, 0.5).otherwise(0.8).alias("confidence"))
    valid = items.select("item_seq", charts.plot_valid(F.lit("Plot_Table"), F.col("plot_rows"), F.col("confidence")).alias("usable"))
    return evaluation.plot_report(items).join(valid, "item_seq").withColumnRenamed("item_seq", "user_id")


REPORT = "SELECT DISTINCT user_id, 3 AS rows, 3 AS series, true AS rows_valid, user_id % 3 <> 0 AS confident, user_id % 3 <> 0 AS usable FROM events"


def ingest_report(spark, sf):
    """Documents as text files and suppliers as CSV files become a corpus; the
    lines of its summary."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("input_pos"), F.format_string("/in/doc-%d.txt", "doc_id").alias("file_path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    rows = table(spark, sf, "supplier").groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 100).alias("block")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("r"))
    csv = F.concat_ws("\n", F.lit("key,name"), F.transform("r", lambda r: F.concat_ws(",", r["s_suppkey"].cast("string"), r["s_name"])))
    sheets = rows.select((1_000_000_000 + F.col("s_nationkey") * 1_000_000 + F.col("block")).cast("long").alias("input_pos"), F.format_string("/in/nation-%d-%d.csv", "s_nationkey", "block").alias("file_path"), csv.cast("binary").alias("content"))
    files = docs.unionByName(sheets).withColumn("size_bytes", F.octet_length("content").cast("long"))
    return corpus.registry_report(ingestion.build(files).documents).select("part", "document_id", "i", "line")


_LABELS = list(corpus.SUMMARY.items())
INGESTED = f"""
WITH {CHUNKS_CTE},
     u AS (SELECT doc_id, count(DISTINCT {D.retrieval('chunk')}) AS n FROM k GROUP BY doc_id),
     h AS (SELECT min(doc_id) AS pos, 'doc-' || min(doc_id) || '.txt' AS file, 'txt' AS kind, 'Text Document' AS type FROM documents GROUP BY sha256(coalesce(text, ''))
           UNION ALL SELECT 1000000000 + s_nationkey * 1000000 + s_suppkey // 100, 'nation-' || s_nationkey || '-' || (s_suppkey // 100) || '.csv', 'csv', 'Spreadsheet' FROM supplier GROUP BY ALL),
     d AS (SELECT printf('doc_%03d', row_number() OVER (ORDER BY pos)) AS document_id, h.*, 1 AS num_pages,
             CASE WHEN kind = 'txt' THEN coalesce(u.n, 0) ELSE 0 END AS text, CASE WHEN kind = 'csv' THEN 1 ELSE 0 END AS "table", 0 AS ocr_text, 0 AS ocr_table, 0 AS plot_table FROM h LEFT JOIN u ON u.doc_id = h.pos AND kind = 'txt'),
     t AS (SELECT count(*) AS n, {", ".join(f'sum("{c}")::BIGINT AS "{c}"' for c, _ in _LABELS)} FROM d),
     l AS (SELECT 1 AS part, document_id, ['- ' || file, '  - ID: ' || document_id, '  - Kind: ' || kind, '  - Type: ' || type, {", ".join(f"'  - {label}: ' || {chr(34)}{c}{chr(34)}" for c, label in _LABELS)}, ''] AS v FROM d
           UNION ALL SELECT 0, NULL, ['Documents processed: ' || n, ''] FROM t
           UNION ALL SELECT 2, NULL, ['Overall totals:', {", ".join(f"'- {label}: ' || {chr(34)}{c}{chr(34)}" for c, label in _LABELS)}, '- Scaling guidance: ' || CASE WHEN n < 100 THEN 'Single FAISS index with metadata filters is appropriate.'
             WHEN n < 1000 THEN 'Use persistent artifacts, batch embeddings, file fingerprints, and document-level centroid prefiltering.' ELSE 'Use hierarchical retrieval: document-level routing followed by chunk retrieval, plus a persistent vector database and background ingestion.' END] FROM t)
SELECT part::INTEGER AS part, document_id, unnest(range(len(v)))::INTEGER AS i, unnest(v) AS line FROM l
"""

QUERIES = {
    f.__name__: f
    for f in (doc_type_rules, question_parts, refusal_stability, table_structure_class, ocr_lines, ocr_table, ocr_numeric_tokens, axis_fit, tick_fill, calibration_check, baseline_repair, plot_table_text, plot_answers, series_assignment, route_precedence, source_lines, prompt_text, public_answers, ocr_page_text, table_fallback, plot_report, ingest_report)
}
ORACLES = {
    "doc_type_rules": DOC_TYPES, "question_parts": PARTS, "refusal_stability": REFUSED, "table_structure_class": STRUCTURES, "ocr_lines": LINES, "ocr_table": OCR_TABLE, "ocr_numeric_tokens": OCR_NUMBERS, "axis_fit": AXIS_FIT,
    "tick_fill": TICK_FILL, "calibration_check": CALIBRATION, "baseline_repair": BASELINE, "plot_table_text": PLOT_TABLE, "plot_answers": PLOT_ANSWERS, "series_assignment": SERIES, "route_precedence": ROUTED, "source_lines": SOURCES, "prompt_text": PROMPTS, "public_answers": PUBLIC, "ocr_page_text": PAGE_TEXT, "table_fallback": FALLBACK, "plot_report": REPORT, "ingest_report": INGESTED,
}
