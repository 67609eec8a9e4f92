"""Operators on whole tables that have a DuckDB equivalent: ticks and plot rows of events, records and answers from tables of
parts, terms of conversations, retrieval over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..operators import charts, records, retrieval, routes, tables, vector_index
from . import duck as D
from .answer_queries import TOPK_CTE
from .text_queries import table


# -- ticks and plot rows of events -------------------------------------------------------------------------------------


def contiguous_ticks(spark, sf):
    """The longest run of each user's events without a wide gap; a pixel is a minute."""
    ticks = table(spark, sf, "events").select("user_id", "event_id", (F.unix_seconds(F.col("ts").cast("timestamp")) / 60).alias("pixel"))
    return charts.contiguous(ticks, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.min("pixel"), 6).alias("first"), F.round(F.max("pixel"), 6).alias("last"))


TICKS = """
WITH e AS (SELECT user_id, floor(epoch(ts)) / 60 AS p FROM events),
     g AS (SELECT *, p - lag(p) OVER (PARTITION BY user_id ORDER BY p) AS gap FROM e),
     t AS (SELECT user_id, median(gap) FILTER (gap > 0) AS typical, count(*) AS n FROM g GROUP BY user_id),
     c AS (SELECT g.user_id, p, sum(CASE WHEN n >= 3 AND gap > 45 AND gap > 3 * typical THEN 1 ELSE 0 END) OVER (PARTITION BY g.user_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM g JOIN t USING (user_id)),
     r AS (SELECT user_id, run, count(*) AS n, min(p) AS first, max(p) AS last FROM c GROUP BY ALL)
SELECT user_id, n, round(first, 6) AS first, round(last, 6) AS last FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, run) = 1
"""


def _hours(spark, sf):
    """A chart for each user and day: the highest value of each event type by hour."""
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), F.hour("ts").cast("double").alias("x"), "event_type", "value")
    names = F.array(*(F.lit(n) for n in EVENT_TYPES))
    best = e.groupBy("user_id", "day", "x").agg(*(F.max(F.when(F.col("event_type") == n, F.col("value"))).alias(f"v{i}") for i, n in enumerate(EVENT_TYPES)))
    row = F.struct("x", F.array(*(F.col(f"v{i}") for i in range(len(EVENT_TYPES)))).alias("values"), F.lit(charts.NOTE).alias("uncertainty_note"))
    rows = best.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(row), lambda a, b: F.signum(a["x"] - b["x"]).cast("int")).alias("plot_rows"))
    return rows.withColumn("series_names", names)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
HOURS_CTE = """e AS (SELECT user_id, ts::DATE AS day, hour(ts)::DOUBLE AS x, event_type, max(value) AS v FROM events WHERE event_type IN ('click', 'error', 'purchase', 'signup', 'view') GROUP BY ALL)"""


def plot_rows_valid(spark, sf):
    """F12 for the chart of each user and day."""
    return _hours(spark, sf).select("user_id", F.col("day").cast("string").alias("day"), charts.rows_valid(F.col("plot_rows")).alias("valid"))


ROWS_VALID = f"""
WITH {HOURS_CTE}, s AS (SELECT user_id, day, event_type, count(*) AS n FROM e GROUP BY ALL),
     t AS (SELECT user_id, day, count(*) FILTER (n >= 2) AS two FROM s GROUP BY ALL), x AS (SELECT user_id, day, count(DISTINCT x) AS rows FROM e GROUP BY ALL)
SELECT user_id, day::VARCHAR AS day, rows >= 3 AND two >= 2 AS valid FROM t JOIN x USING (user_id, day)
"""


def plot_nearest_x(spark, sf):
    """The row nearest to every hour of the day, where one is near enough."""
    asked = _hours(spark, sf).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    near = charts.row_at(F.col("plot_rows"), F.col("hour").cast("double"))
    return asked.select("user_id", F.col("day").cast("string").alias("day"), "hour", near["x"].alias("x")).filter("x is not null")


NEAREST_X = f"""
WITH {HOURS_CTE}, u AS (SELECT DISTINCT user_id, day, x FROM e),
     s AS (SELECT user_id, day, coalesce(median(d), 1.0) AS step FROM (SELECT user_id, day, x - lag(x) OVER (PARTITION BY user_id, day ORDER BY x) AS d FROM u) GROUP BY ALL),
     n AS (SELECT u.user_id, u.day, h.hour, u.x, abs(u.x - h.hour) AS d, row_number() OVER (PARTITION BY u.user_id, u.day, h.hour ORDER BY abs(u.x - h.hour), u.x) AS r FROM u, (SELECT unnest(range(24))::INTEGER AS hour) h)
SELECT n.user_id, n.day::VARCHAR AS day, n.hour, n.x FROM n JOIN s USING (user_id, day) WHERE r = 1 AND d <= greatest(0.25, 0.3 * step)
"""


def plot_named(spark, sf):
    """The value of every event type at every hour of the table, asked for by name."""
    e = table(spark, sf, "events").select(F.hour("ts").cast("double").alias("x"), "event_type", "value")
    best = e.groupBy("x").agg(*(F.max(F.when(F.col("event_type") == n, F.col("value"))).alias(f"v{i}") for i, n in enumerate(EVENT_TYPES)))
    row = F.struct("x", F.array(*(F.col(f"v{i}") for i in range(len(EVENT_TYPES)))).alias("values"), F.lit(charts.NOTE).alias("uncertainty_note"))
    chart = best.agg(F.array_sort(F.collect_list(row), lambda a, b: F.signum(a["x"] - b["x"]).cast("int")).alias("plot_rows"))  # 24 rows at most
    names = F.array(*(F.lit(n) for n in EVENT_TYPES))
    asked = chart.withColumn("hour", F.explode("plot_rows.x")).withColumn("name", F.explode(names)).withColumn("q", F.format_string("what is the %s value at week %.0f", "name", "hour"))
    return asked.select("name", "hour", charts.plot_answer(F.col("q"), F.col("plot_rows"), names)["answer"].alias("answer")).filter("answer is not null")


PLOT_NAMED = """
WITH b AS (SELECT event_type AS name, hour(ts)::DOUBLE AS hour, max(value) AS v FROM events GROUP BY ALL)
SELECT name, hour, printf('At Week %d, the mean Neuropathy Symptom Score for %s is approximately %s.', hour::INTEGER, name,
  CASE WHEN abs(v) >= 100 THEN printf('%.1f', v) ELSE regexp_replace(regexp_replace(printf('%.2f', v), '0+$', ''), '[.]$', '') END) AS answer FROM b
"""

# -- tables of parts -----------------------------------------------------------------------------------------------------

ANCHORS = """
WITH p AS (SELECT p_type, list(floor(p_retailprice) ORDER BY floor(p_retailprice)) AS xs FROM part GROUP BY p_type),
c AS (SELECT p_type, list_reduce(list_transform(xs, lambda x: [{'s': x::DOUBLE, 'n': 1.0::DOUBLE}]),
  lambda a, e: CASE WHEN abs(e[1].s - a[-1].s / a[-1].n) <= 3 THEN list_concat(a[:-2], [{'s': a[-1].s + e[1].s, 'n': a[-1].n + 1}]) ELSE list_concat(a, e) END) AS k FROM p),
a AS (SELECT p_type, list_transform(k, lambda c: c.s / c.n) AS a FROM c),
d AS (SELECT p_partkey, a, list_transform(a, lambda x: abs(p_retailprice - x)) AS d FROM part JOIN a USING (p_type))
SELECT p_partkey, len(a) AS n_anchors, round(a[list_position(d, list_min(d))], 4) AS anchor FROM d
"""


def records_from_kv(spark, sf):
    """Each part as key-value rows with aliases and an empty value."""
    text = lambda c: F.col(c).cast("string")
    rows = [("Part No:", text("p_partkey")), ("Product name", F.concat(F.lit("  "), F.col("p_name"), F.lit(" ; "))), ("Batch number", text("p_size")), ("Article Number", F.concat(F.lit("A-"), text("p_partkey"))), ("Status", F.lit(" "))]
    matrix = F.array(*(F.array(F.lit(k), v) for k, v in rows), F.array(F.lit("alone")))
    record = F.get(records.from_pairs(matrix), F.lit(0))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(record, lambda p: F.concat_ws("=", p["field"], p["value"])), "|").alias("record"), records.label_of(record).alias("label"))


KV = "SELECT p_partkey, 'part number=A-' || p_partkey || '|product name=' || p_name || '|lot number=' || p_size AS record, p_name AS label FROM part"

#: Parts to a table of the answers below.
TABLE_ROWS = 20


def _asked(spark, sf, question, extra=()):
    """A question on every part, and as its hit the table that holds the part and its neighbours."""
    parts = table(spark, sf, "part").withColumn("table_no", F.floor(F.col("p_partkey") / TABLE_ROWS))
    head = F.array(*(F.lit(h) for h in ("Part Number", "Description", *(h for h, _ in extra))))
    cells = F.array(F.col("p_partkey").cast("string"), "p_name", *(c for _, c in extra))
    rows = parts.groupBy("table_no").agg(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("c")))).alias("rows"))
    shaped = tables.formatted(rows.select("table_no", F.concat(F.array(head), F.col("rows.c")).alias("matrix")))
    asked = parts.select(F.col("p_partkey").alias("question_id"), question.alias("question"), "table_no")
    hit = shaped.select(
        "table_no",
        F.lit(1).alias("rank"),
        F.lit("parts.pdf").alias("file"),
        F.lit(1).alias("page_start"),
        F.lit(1).alias("page_end"),
        F.lit("table").alias("content_type"),
        F.col("structure").alias("table_structure_type"),
        F.col("matrix").alias("structured_data"),
        F.col("embedding_text").alias("text_for_embedding"),
        F.col("markdown").alias("text_for_llm"),
        F.lit(0.5).alias("semantic_score"),
        F.lit(0.6).alias("score"),
    )
    return routes.answers(asked.drop("table_no"), asked.select("question_id", "table_no").join(hit.hint("merge"), "table_no").drop("table_no")).select("question_id", "answer_route", "answer")


def single_field_answer(spark, sf):
    """The part number of every part by its name, from a table of 20."""
    return _asked(spark, sf, F.concat(F.lit("What is the part number of "), F.col("p_name"), F.lit("?")))


def _terms(c: str, ignored) -> str:
    return f"list_filter({D.words(c)}, lambda t: length(t) >= 3 AND NOT list_contains({D.values(ignored)}, t))"


SINGLE = f"""
WITH q AS (SELECT p_partkey, p_partkey // {TABLE_ROWS} AS t, {_terms('p_name', config.ENTITY_IGNORED)} AS terms FROM part),
     r AS (SELECT p_partkey AS k, p_partkey // {TABLE_ROWS} AS t, 'part number ' || p_partkey || ' description ' || p_name AS words FROM part)
SELECT q.p_partkey AS question_id, 'deterministic_structured_single_field' AS answer_route, min(r.k)::VARCHAR AS answer
FROM q JOIN r USING (t) WHERE len(list_filter(terms, lambda x: NOT contains(r.words, x))) = 0 GROUP BY q.p_partkey
"""


def multi_field_answer(spark, sf):
    """Part number and observed result, a line for every row of the best record's table."""
    size = ("Observed result", F.concat(F.lit("size "), F.col("p_size").cast("string")))
    out = _asked(spark, sf, F.concat(F.lit("List the part number and the observed result of "), F.col("p_name"), F.lit(".")), [size])
    return out.select("question_id", "answer_route", F.md5("answer").alias("answer"))


MULTI = f"""
WITH q AS (SELECT p_partkey, p_partkey // {TABLE_ROWS} AS t, {_terms('p_name', config.ENTITY_IGNORED)} AS terms FROM part),
     r AS (SELECT p_partkey AS k, p_partkey // {TABLE_ROWS} AS t, 'part number ' || p_partkey || ' description ' || p_name || ' observed result size ' || p_size AS words,
             p_name || ' — Part Number: ' || p_partkey || '; Observed Result: size ' || p_size AS line FROM part),
     s AS (SELECT q.p_partkey, r.k, r.line, len(list_filter(list_append(terms, 'list'), lambda x: contains(r.words, x))) AS n FROM q JOIN r USING (t))
SELECT p_partkey AS question_id, 'deterministic_structured_multi_field' AS answer_route, md5(string_agg(line, chr(10) ORDER BY n DESC, k)) AS answer FROM s GROUP BY p_partkey
"""


def header_validity(spark, sf):
    """whether words of each part can be the header of a table whose first row is given."""
    name = F.when(F.col("p_size") <= 10, F.format_string("%d. %s", "p_size", "p_name")).when(F.col("p_size") <= 15, F.concat(F.lit("Table 3 "), "p_name")).when(F.col("p_size") <= 20, F.lit("  ")).otherwise(F.col("p_name"))
    last = F.when(F.col("p_size") >= 45, F.concat("p_type", F.lit("."))).otherwise(F.col("p_type"))
    given = F.array(F.array(F.lit("red ring"), F.lit("Brand#1"), F.lit("ECONOMY")))
    return table(spark, sf, "part").select("p_partkey", tables.valid_header(F.array(name, "p_brand", last), given).alias("valid"))


VALIDITY = """
SELECT p_partkey, p_size > 15 AND p_size < 45 AND NOT (p_size > 20 AND p_name = 'red ring' AND p_brand = 'Brand#1' AND p_type = 'ECONOMY') AS valid FROM part
"""

# -- terms of conversations ----------------------------------------------------------------------------------------------


def entity_terms(spark, sf):
    """X16-X18 of every turn, asked for with fields and a position."""
    t = table(spark, sf, "conversations").withColumn("q", F.format_string("Which lot number and materials at week %d.5: %s", "turn", F.coalesce("text", F.lit(""))))
    fields = X.requested_fields(F.col("q"))
    return t.select("conv_id", "turn", F.array_join(fields, ",").alias("fields"), F.md5(F.array_join(X.entity_terms(F.col("q"), fields), " ")).alias("terms"), X.requested_x(F.col("q")).alias("x"))


_Q = "('Which lot number and materials at week ' || turn || '.5: ' || coalesce(text, ''))"
_FIELD = " || ".join(f"CASE WHEN {D.any_of('q', names)} THEN ',{field}' ELSE '' END" for field, names in config.QUESTION_FIELDS.items())
ENTITY = f"""
WITH t AS (SELECT conv_id, turn, {_Q} AS raw, {D.rag(_Q)} AS q FROM conversations), f AS (SELECT *, substr({_FIELD}, 2) AS fields FROM t)
SELECT conv_id, turn, fields, md5(array_to_string(list_filter({D.words('raw')}, lambda w: length(w) >= 3 AND NOT list_contains({D.values(config.ENTITY_IGNORED)}, w)
  AND NOT list_contains(string_split(replace(fields, ',', ' '), ' '), w)), ' ')) AS terms, turn + 0.5 AS x FROM f
"""

# -- retrieval -----------------------------------------------------------------------------------------------------------


def _parts_as_items(spark, sf):
    """Vectors with the texts of parts: many items of a file and page share a text."""
    e = table(spark, sf, "embeddings")
    text = F.concat("p_name", F.lit(" "), F.md5("p_name"))
    items = e.join(table(spark, sf, "part"), F.col("vec_id") == F.col("p_partkey")).select(
        F.col("vec_id").alias("item_seq"),
        F.format_string("f%d.pdf", "label").alias("file"),
        F.lit("Text Document").alias("doc_type"),
        F.lit(1).alias("page_start"),
        F.when(F.col("label") % 2 == 0, "table").otherwise("text").alias("content_type"),
        F.when(F.col("label") % 3 == 0, "key_value").otherwise("header_table").alias("table_structure_type"),
        text.alias("text_for_embedding"),
    )
    return e, items


def _part_questions(spark, sf, e):
    word = F.when(F.col("vec_id") % 40 == 0, "status").otherwise("batch")
    q = e.filter("vec_id % 20 = 0").join(table(spark, sf, "part"), F.col("vec_id") == F.col("p_partkey"))
    return q.select(
        F.col("vec_id").alias("question_id"),
        F.concat(F.lit("which "), word, F.lit(" of the "), F.col("p_name")).alias("question"),
        "embedding",
        F.when(F.col("vec_id") % 60 == 0, F.format_string("f%d.pdf", "label")).otherwise(F.lit(config.ALL_DOCUMENTS)).alias("document_filter"),
        F.when(F.col("vec_id") % 100 == 0, F.array(F.lit("table"))).otherwise(X.lit_array(config.CONTENT_TYPES)).alias("content_type_filter"),
    )


def hybrid_filtered(spark, sf):
    """W01, F01, V04, W03, J09, V06, V07 on given vectors: every 20th vector with a question, top 5."""
    e, items = _parts_as_items(spark, sf)
    hits = retrieval.hybrid(_part_questions(spark, sf, e), items, e.select(F.col("vec_id").alias("item_seq"), "embedding"), 5)
    return hits.select("question_id", "rank", "item_seq", F.round("score", 6).alias("score"))


_PARTS_CTE = f"""i AS (SELECT vec_id, label, p_name || ' ' || md5(p_name) AS text, 'f' || label || '.pdf' AS file, CASE WHEN label % 2 = 0 THEN 'table' ELSE 'text' END AS kind, label % 3 = 0 AS pairs FROM embeddings JOIN part ON vec_id = p_partkey),
a AS (SELECT vec_id AS question_id, {D.tokens("'which ' || CASE WHEN vec_id % 40 = 0 THEN 'status' ELSE 'batch' END || ' of the ' || p_name")} AS k, CASE WHEN vec_id % 60 = 0 THEN 'f' || label || '.pdf' END AS wanted, vec_id % 100 = 0 AS tables_only
  FROM embeddings JOIN part ON vec_id = p_partkey WHERE vec_id % 20 = 0)"""

HYBRID = f"""
WITH {TOPK_CTE}, {_PARTS_CTE},
p AS (SELECT *, list_distinct(k) AS d, list_concat(list_transform(range(1, greatest(len(k), 1)), lambda i: array_to_string(k[i : i + 1], ' ')), list_transform(range(1, greatest(len(k) - 1, 1)), lambda i: array_to_string(k[i : i + 2], ' '))) AS phrases FROM a),
m AS (SELECT k.question_id, i.vec_id AS item_seq, k.score AS semantic, i.*, p.d, p.phrases, p.k AS asked, {D.tokens('i.text')} AS own FROM k JOIN i ON i.vec_id = k.item_seq JOIN p ON p.question_id = k.question_id
  WHERE k.rank <= 30 AND (wanted IS NULL OR wanted = i.file) AND (NOT tables_only OR kind = 'table')),
r AS (SELECT question_id, item_seq, file, text, semantic, semantic + CASE WHEN len(d) > 0 THEN 0.16 * len(list_filter(d, lambda x: list_contains(own, x))) / len(d) ELSE 0 END
  + CASE WHEN len(list_filter(phrases, lambda x: contains(text, x))) > 0 THEN 0.12 ELSE 0 END + CASE WHEN list_has_any(asked, {D.values(config.TABLE_INTENT)}) AND kind = 'table' THEN 0.05 ELSE 0 END
  + CASE WHEN list_has_any(asked, {D.values(config.KEY_VALUE_INTENT)}) AND pairs THEN 0.03 ELSE 0 END AS score FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, semantic DESC, item_seq) AS position FROM r),
u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY question_id, file, text ORDER BY position) = 1)
SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY position))::INTEGER AS rank, item_seq, round(score, 6) AS score FROM u QUALIFY rank <= 5
"""


def semantic_filtered(spark, sf):
    """The filter first, then the exact top 3."""
    e, items = _parts_as_items(spark, sf)
    found = retrieval.semantic(_part_questions(spark, sf, e), items, e.select(F.col("vec_id").alias("item_seq"), "embedding"), F.col("content_type") == "table", 3)
    return found.select("question_id", "item_seq", "rank", F.round("semantic_score", 6).alias("score"))


SEMANTIC = f"""
WITH {_PARTS_CTE}, s AS (SELECT q.vec_id AS question_id, v.vec_id AS item_seq, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings v JOIN i ON i.vec_id = v.vec_id WHERE q.vec_id % 20 = 0 AND q.vec_id IN (SELECT question_id FROM a) AND i.kind = 'table')
SELECT question_id, item_seq, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_seq))::INTEGER AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 3
"""


def plot_retrieval(spark, sf):
    """Vectors with texts as plots, by vector and shared words, within the document asked for."""
    e, items = _parts_as_items(spark, sf)
    plots = items.join(e.select(F.col("vec_id").alias("item_seq"), "embedding"), "item_seq").select("item_seq", "file", F.col("text_for_embedding").alias("search_text"), "embedding")
    hits = retrieval.plot_hits(_part_questions(spark, sf, e), plots, 2)
    return hits.select("question_id", "item_seq", "rank", F.round("semantic_score", 6).alias("semantic_score"), F.round("score", 6).alias("score"))


PLOT_HITS = f"""
WITH {_PARTS_CTE}, w AS (SELECT question_id, wanted, q.embedding::DOUBLE[] AS v, list_distinct(list_filter(string_split('which ' || CASE WHEN question_id % 40 = 0 THEN 'status' ELSE 'batch' END || ' of the ' || p_name, ' '), lambda t: length(t) >= 3)) AS words
  FROM a JOIN embeddings q ON q.vec_id = question_id JOIN part ON p_partkey = question_id),
s AS (SELECT question_id, i.vec_id AS item_seq, list_dot_product(v, e.embedding::DOUBLE[]) AS semantic, len(list_filter(words, lambda t: list_contains(string_split(i.text, ' '), t))) / len(words) AS shared
  FROM w, i JOIN embeddings e ON e.vec_id = i.vec_id WHERE wanted IS NULL OR wanted = i.file)
SELECT question_id, item_seq, (row_number() OVER (PARTITION BY question_id ORDER BY semantic + 0.12 * shared + 0.08 DESC, item_seq))::INTEGER AS rank, round(semantic, 6) AS semantic_score, round(semantic + 0.12 * shared + 0.08, 6) AS score FROM s QUALIFY rank <= 2
"""

def index_topk(spark, sf):
    """V02, W01 by a stored index of cells: every 20th vector's 20 best items, exact."""
    e = table(spark, sf, "embeddings")
    index = vector_index.build(e.select(F.col("vec_id").alias("item_seq"), "embedding"))
    found, _ = vector_index.search(e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("question_id"), "embedding"), index, 20)
    return found.select("question_id", "item_seq", "rank", F.round("semantic_score", 6).alias("score"))


INDEX_TOPK = f"WITH {TOPK_CTE} SELECT question_id, item_seq, rank, round(score, 6) AS score FROM k WHERE rank <= 20"


QUERIES = {
    "index_topk": index_topk,
    "contiguous_ticks": contiguous_ticks,
    "plot_rows_valid": plot_rows_valid,
    "plot_nearest_x": plot_nearest_x,
    "plot_named": plot_named,
    "records_from_kv": records_from_kv,
    "single_field_answer": single_field_answer,
    "multi_field_answer": multi_field_answer,
    "header_validity": header_validity,
    "entity_terms": entity_terms,
    "hybrid_filtered": hybrid_filtered,
    "semantic_filtered": semantic_filtered,
    "plot_retrieval": plot_retrieval,
}

ORACLES = {
    "index_topk": INDEX_TOPK,
    "column_anchors": ANCHORS,
    "contiguous_ticks": TICKS,
    "plot_rows_valid": ROWS_VALID,
    "plot_nearest_x": NEAREST_X,
    "plot_named": PLOT_NAMED,
    "records_from_kv": KV,
    "single_field_answer": SINGLE,
    "multi_field_answer": MULTI,
    "header_validity": VALIDITY,
    "entity_terms": ENTITY,
    "hybrid_filtered": HYBRID,
    "semantic_filtered": SEMANTIC,
    "plot_retrieval": PLOT_HITS,
}
