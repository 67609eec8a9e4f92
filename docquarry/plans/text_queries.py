"""Queries of the text kernel and of the corpus, with oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..operators import corpus as C
from ..operators.providers import Embedder
from ..session import shared_folder, stored
from ..sources import files as S
from . import duck as D


#: Tables of texts, whose rows cost more to work on than to move.
TEXTS = ("documents", "conversations")


def table(spark, sf, name):
    """A table; one of texts that has fewer splits than there are cores is dealt to all cores (large tables have more splits)."""
    found = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name in TEXTS and found.rdd.getNumPartitions() < cores else found


def registry_dedup(spark, sf):
    docs = table(spark, sf, "documents")
    files = docs.select(F.col("doc_id").alias("input_pos"), F.format_string("/in/doc-%d.txt", "doc_id").alias("file_path"), F.octet_length(X.text(F.col("text"))).cast("long").alias("size_bytes"), S.content_hash(X.text(F.col("text"))).alias("file_hash"))
    return S.registry(S.validate(files)).select("document_id", "file", "doc_type", "file_kind", "file_hash", "file_size_bytes")


REGISTRY = """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS file_hash, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
     k AS (SELECT file_hash, min(doc_id) AS doc_id, any_value(n) AS n FROM h GROUP BY file_hash)
SELECT printf('doc_%03d', row_number() OVER (ORDER BY doc_id)) AS document_id, 'doc-' || doc_id || '.txt' AS file,
       'Text Document' AS doc_type, 'txt' AS file_kind, file_hash, n AS file_size_bytes FROM k
"""


def normalized(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(X.normalize_retrieval(t)).alias("retrieval"), F.md5(X.normalize_rag(t)).alias("rag"), F.md5(X.normalize_plot(t)).alias("plot"), F.md5(X.clean_display(t)).alias("display"))


def chunks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("i", "chunk")).select("doc_id", (F.col("i") + 1).alias("chunk_index"), F.md5("chunk").alias("chunk_md5"))


CHUNKS_CTE = f"""
s AS (SELECT doc_id, source, {D.strip("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT doc_id, source, t, unnest(CASE WHEN length(t) <= 1000 THEN [0] ELSE range(0, length(t), 850) END) AS pos FROM s),
c AS (SELECT doc_id, source, pos, {D.strip("substring(t, pos + 1, 1000)")} AS chunk FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_index FROM c WHERE chunk <> '')
"""


def chunk_frame(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "source", F.posexplode(X.chunks(F.col("text"))).alias("i", "chunk")).withColumn("chunk_index", F.col("i") + 1)


def chunk_counts(spark, sf):
    n = F.size(X.chunks(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", n.cast("long").alias("n_chunks")).filter("n_chunks > 0")


def signature_dedup(spark, sf):
    items = chunk_frame(spark, sf).select("doc_id", "chunk_index", F.col("source").alias("document_id"), F.lit(1).alias("page_start"), F.lit("text").alias("content_type"), F.col("chunk").alias("text_for_embedding"))
    return C.dedup_items(items, ["doc_id", "chunk_index"], columns=["doc_id", "chunk_index", "document_id"])


def token_counts(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(X.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


def identifiers(spark, sf):
    found = X.identifiers(F.concat_ws(" ", "p_name", F.concat(F.lit("lot AB-"), "p_partkey", F.lit("x")), F.concat(F.col("p_size"), F.lit(" mg")), F.format_string("%08d", "p_partkey"), F.concat(F.col("p_size"), F.lit(" %"))))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(found), "|").alias("identifiers"))


IDENTIFIERS = """
SELECT p_partkey, array_to_string(list_sort(list_distinct([printf('%08d', p_partkey), p_size || ' %', p_size || ' mg', 'ab-' || p_partkey || 'x'])), '|') AS identifiers FROM part
"""


def query_phrases(spark, sf):
    users = table(spark, sf, "conversations").filter("role = 'user'")
    return users.select("conv_id", "turn", F.md5(F.array_join(F.array_sort(X.phrases(F.col("text"))), "|")).alias("phrases"), F.size(X.phrases(F.col("text"))).cast("long").alias("n"))


PHRASES = f"""
WITH t AS (SELECT conv_id, turn, {D.tokens("text")} AS k FROM conversations WHERE role = 'user'),
     p AS (SELECT conv_id, turn, list_distinct(list_concat(
        list_transform(range(1, greatest(len(k), 1)), lambda i: array_to_string(k[i : i + 1], ' ')),
        list_transform(range(1, greatest(len(k) - 1, 1)), lambda i: array_to_string(k[i : i + 2], ' ')))) AS p FROM t)
SELECT conv_id, turn, md5(array_to_string(list_sort(p), '|')) AS phrases, len(p)::BIGINT AS n FROM p
"""

DOC_TYPES = [
    ("coa.pdf", "CERTIFICATE OF ANALYSIS for lot 7", "Certificate of Analysis"),
    ("a.pdf", "the COA of this lot", "Certificate of Analysis"),
    ("cocoa.pdf", "cocoa powder", "Unknown"),
    ("safety.pdf", "SAFETY DATA SHEET", "Safety Data Sheet"),
    ("x.pdf", "Phase 3 clinical trial of a drug", "Clinical Trial Report"),
    ("x.pdf", "a clinical trial with methodology and efficacy", "Clinical Trial Report"),
    ("x.pdf", "Physical properties and operating pressure", "Specification"),
    ("x.pdf", "physical properties only", "Unknown"),
    ("specification.pdf", "component material", "Specification"),
    ("x.pdf", "quality agreement statement", "Quality Agreement"),
    ("x.pdf", "To whom it may concern", "Declaration / Statement"),
    ("x.pdf", "BSE/TSE statement", "Regulatory / Supporting Documentation"),
]


def doc_types(spark, sf):
    rows = spark.createDataFrame([(i, f, s) for i, (f, s, _) in enumerate(DOC_TYPES)], "id long, file string, sample string")
    return rows.select("id", X.doc_type(F.col("sample"), F.col("file")).alias("doc_type"))


def literal(columns: str, rows: list[tuple]) -> str:
    """An oracle of typed-in rows. columns: "name type, ..."."""
    show = lambda v: "NULL" if v is None else ("TRUE" if v else "FALSE") if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    picks = ", ".join(f"{n}::{k} AS {n}" for n, k in zip(names, kinds, strict=True))
    return f"SELECT {picks} FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) AS v({', '.join(names)})"


def intent_flags(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.prefers_tables(t).alias("tables"), X.prefers_key_values(t).alias("pairs"), X.is_plot_question(t).alias("plot"), X.needs_general_route(t).alias("general"), X.is_comparison(t).alias("comparison"))


INTENTS = f"""
SELECT conv_id, turn, list_has_any({D.tokens("text")}, {D.values(config.TABLE_INTENT)}) AS tables, list_has_any({D.tokens("text")}, {D.values(config.KEY_VALUE_INTENT)}) AS pairs,
  {D.plot("text")} <> '' AND ({D.any_of(D.plot("text"), config.PLOT_TERMS)} OR regexp_matches({D.plot("text")}, '\\b(?:week|day|month|year|time)\\s*\\d+(?:\\.\\d+)?\\b')) AS plot,
  ({D.any_of(D.plot("text"), config.COMPARISON_TERMS)} AND {D.any_of(D.plot("text"), config.SAFETY_TERMS)}) OR {D.any_of(D.plot("text"), config.DESIGN_TERMS)} AS general,
  {D.any_of("lower(text)", config.ANY_COMPARISON)} AS comparison FROM conversations
"""


def focus_evidence(spark, sf):
    """Each user turn's focus terms against the next turn of the conversation."""
    from ..operators import routes

    t = table(spark, sf, "conversations")
    asked = t.filter("role = 'user'").select("conv_id", "turn", "text")
    replies = t.select("conv_id", (F.col("turn") - 1).alias("turn"), X.normalize_rag(F.col("text")).alias("evidence"))
    check = routes.evidence_check(F.col("text"), F.col("evidence"))
    e = asked.join(replies, ["conv_id", "turn"], "left").select("conv_id", "turn", check.alias("c"))
    return e.select("conv_id", "turn", F.col("c.has_evidence").alias("has_evidence"), F.array_join("c.focus_terms", " ").alias("focus"), F.array_join("c.matched_terms", " ").alias("matched"), F.round("c.match_ratio", 6).alias("match_ratio"))


FOCUS = f"""
WITH a AS (SELECT conv_id, turn, {D.focus("text")} AS f FROM conversations WHERE role = 'user'),
     b AS (SELECT a.conv_id, a.turn, {D.ordered_distinct("a.f")} AS f, coalesce({D.rag("r.text")}, '') AS e
           FROM a LEFT JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.turn + 1),
     m AS (SELECT *, list_filter(f, lambda t: contains(e, t)) AS hit FROM b)
SELECT conv_id, turn, len(f) = 0 OR len(hit) > 0 AS has_evidence, coalesce(array_to_string(f, ' '), '') AS focus, coalesce(array_to_string(hit, ' '), '') AS matched,
       round(CASE WHEN len(f) = 0 THEN 1.0::DOUBLE ELSE len(hit)::DOUBLE / len(f) END, 6) AS match_ratio FROM m
"""

QUESTION_ROWS = [
    (1, "What is the lot no and expiry date of kit 18-B?", "lot number|expiration date", "kit", None),
    (2, "NSS at week 12 for 40mg?", "40 mg", "nss|week|40mg", 12.0),
    (3, "Value at x = 3.5", "", "value", 3.5),
    (4, "Article numbers and max pressure of the pump", "part number|operating pressure", "article|pump", None),
    (5, "", "", "", None),
]


def question_parts(spark, sf):
    rows = spark.createDataFrame([(i, q) for i, q, *_ in QUESTION_ROWS], "id long, q string")
    fields = X.requested_fields(F.col("q"))
    return rows.select("id", F.array_join(fields, "|").alias("fields"), F.array_join(X.entity_terms(F.col("q"), fields), "|").alias("entities"), X.requested_x(F.col("q")).alias("x"))


def coverage(spark, sf):
    """Documents as items by language, covered by source."""
    docs = table(spark, sf, "documents")
    kind = F.when(F.col("lang") == "en", "text").when(F.col("lang") == "fr", "table").when(F.col("lang") == "de", "ocr_text").otherwise("ocr_table")
    items = docs.select(F.col("source").alias("document_id"), kind.alias("content_type"))
    known = docs.select(F.col("source").alias("document_id")).distinct()
    return C.coverage(known, items)


COVERAGE = """
SELECT source AS document_id, count(*) FILTER (lang = 'en') AS text, count(*) FILTER (lang = 'fr') AS "table", count(*) FILTER (lang = 'de') AS ocr_text,
       count(*) FILTER (lang NOT IN ('en', 'fr', 'de')) AS ocr_table, 0::BIGINT AS plot_table, count(*) AS total FROM documents GROUP BY source
"""


def registry_totals(spark, sf):
    return C.registry_totals(coverage(spark, sf))


def processing_status(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("content_type"))
    return C.processing_status(docs)


def filter_choices(spark, sf):
    return C.filter_choices(table(spark, sf, "documents"), "source", config.ALL_DOCUMENTS)


def chat_export(spark, sf):
    return C.chat_markdown(table(spark, sf, "conversations")).select("conv_id", F.md5("markdown").alias("markdown_md5"))


CHAT = """
SELECT conv_id, md5(string_agg('## ' || upper(substr(role, 1, 1)) || substr(role, 2) || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS markdown_md5
FROM conversations GROUP BY conv_id
"""


def unique_values(spark, sf):
    grouped = table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("v"))
    shown = X.unique_values(F.transform("v", lambda v: F.concat(F.lit(" "), F.initcap(v["p_name"]), F.lit("; "))))
    return grouped.select("p_brand", F.array_join(shown, "|").alias("names"))


UNIQUE = """
WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS k FROM part GROUP BY ALL),
     w AS (SELECT p_brand, k, list_transform(string_split(p_name, ' '), lambda x: upper(substr(x, 1, 1)) || substr(x, 2)) AS n FROM f)
SELECT p_brand, string_agg(array_to_string(n, ' '), '|' ORDER BY k) AS names FROM w GROUP BY p_brand
"""


def persist_roundtrip(spark, sf):
    """The chunk corpus saved with the vectors of its chunks, a later version saved beside it, and the first one loaded again."""
    chunks_ = chunk_frame(spark, sf).select(F.format_string("%d-%d", "doc_id", "chunk_index").alias("source_id"), F.col("source").alias("document_id"), F.col("chunk").alias("text_for_embedding"))
    chunks_ = stored(chunks_, "chunks")
    vectors = chunks_.select("source_id", "document_id", Embedder().column(F.col("text_for_embedding")).alias("embedding"))
    where = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    first = C.save_corpus(where, chunks_, chunks_.select("document_id").distinct(), vectors)
    C.save_corpus(where, chunks_.limit(0), chunks_.select("document_id").limit(0), vectors.limit(0))
    loaded = C.load_corpus(spark, where, first)
    return loaded["items"].groupBy("document_id").agg(F.count("*").alias("items"), F.sum(F.char_length("text_for_embedding")).alias("chars"))


QUERIES = {
    "registry_dedup": registry_dedup,
    "normalized_texts": normalized,
    "chunk_overlap": chunks,
    "chunk_parent_counts": chunk_counts,
    "signature_dedup": signature_dedup,
    "token_counts": token_counts,
    "identifiers": identifiers,
    "query_phrases": query_phrases,
    "doc_type_rules": doc_types,
    "intent_flags": intent_flags,
    "focus_evidence": focus_evidence,
    "question_parts": question_parts,
    "content_coverage": coverage,
    "registry_totals": registry_totals,
    "processing_status": processing_status,
    "filter_choices": filter_choices,
    "chat_export": chat_export,
    "unique_values": unique_values,
    "persist_roundtrip": persist_roundtrip,
}

ORACLES = {
    "registry_dedup": REGISTRY,
    "normalized_texts": f"SELECT doc_id, md5({D.retrieval('text')}) AS retrieval, md5({D.rag('text')}) AS rag, md5({D.plot('text')}) AS plot, md5({D.display('text')}) AS display FROM documents",
    "chunk_overlap": f"WITH {CHUNKS_CTE} SELECT doc_id, chunk_index::INTEGER AS chunk_index, md5(chunk) AS chunk_md5 FROM k",
    "chunk_parent_counts": f"WITH {CHUNKS_CTE} SELECT doc_id, count(*) AS n_chunks FROM k GROUP BY doc_id",
    "signature_dedup": f"""WITH {CHUNKS_CTE}, g AS (SELECT doc_id, chunk_index::INTEGER AS chunk_index, source AS document_id,
        row_number() OVER (PARTITION BY source, sha1({D.retrieval('chunk')}) ORDER BY doc_id, chunk_index) AS r FROM k) SELECT doc_id, chunk_index, document_id FROM g WHERE r = 1""",
    "token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({D.tokens('text')}) AS token FROM documents) GROUP BY token",
    "identifiers": IDENTIFIERS,
    "query_phrases": PHRASES,
    "doc_type_rules": literal("id BIGINT, doc_type VARCHAR", [(i, t) for i, (_, _, t) in enumerate(DOC_TYPES)]),
    "intent_flags": INTENTS,
    "focus_evidence": FOCUS,
    "question_parts": literal("id BIGINT, fields VARCHAR, entities VARCHAR, x DOUBLE", [(i, f, e, x) for i, _, f, e, x in QUESTION_ROWS]),
    "content_coverage": COVERAGE,
    "registry_totals": f'SELECT count(*) AS documents, sum(text)::BIGINT AS text, sum("table")::BIGINT AS "table", sum(ocr_text)::BIGINT AS ocr_text, sum(ocr_table)::BIGINT AS ocr_table, sum(plot_table)::BIGINT AS plot_table, sum(total)::BIGINT AS total FROM ({COVERAGE})',
    "processing_status": "SELECT 0 AS part, lang || ': ' || count(*) AS line FROM documents GROUP BY lang",
    "filter_choices": f"SELECT '{config.ALL_DOCUMENTS}' AS choice UNION ALL SELECT DISTINCT source FROM documents WHERE source IS NOT NULL",
    "chat_export": CHAT,
    "unique_values": UNIQUE,
    "persist_roundtrip": f"WITH {CHUNKS_CTE} SELECT source AS document_id, count(*) AS items, sum(length(chunk))::BIGINT AS chars FROM k GROUP BY source",
}

#: Typed-in cases, which tests run; the registered queries of these names work on given tables.
FIXTURES = ('doc_type_rules', 'question_parts')
FIXTURE_QUERIES, FIXTURE_ORACLES = ({name: d.pop(name) for name in FIXTURES} for d in (QUERIES, ORACLES))
