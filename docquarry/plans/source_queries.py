"""Sources, evaluation runs and the streaming registry on given tables, with oracles."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..operators import evaluation
from ..session import shared_folder, stored
from ..sources import files as S
from ..streaming import ingest
from . import duck as D
from .text_queries import table

#: What a document's first page begins with, by doc_id; its third page, which is beyond the sample, always says another type.
HEADS = (
    "CERTIFICATE OF ANALYSIS for lot 7",
    "Safety  Data\tSheet",
    "Phase III clinical trial",
    "Clinical trial: methodology and efficacy",
    "Specifications. Operating temperature: 4",
    "Physical properties; operating pressure",
    "Certificate of quality",
    "To whom it may concern",
    "Internal SDS, revised",
    "Compliance statement",
    "Supplier qualification record",
    "Quality agreement",
    "",
)


def typed_registry(spark, sf):
    """Documents as PDF files of three pages (every ninth one cannot be read), with types from the first two pages
    and their numbers of pages."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    head = F.element_at(F.array(*(F.lit(h) for h in HEADS)), (F.col("doc_id") % len(HEADS) + 1).cast("int"))
    files = docs.select(F.col("doc_id").alias("input_pos"), F.format_string("/in/file-%d.pdf", "doc_id").alias("file_path"), F.octet_length("text").cast("long").alias("size_bytes"), S.content_hash(F.concat(F.format_string("%d ", F.col("doc_id") % len(HEADS)), "text")).alias("file_hash"))
    known = stored(S.registry(S.validate(files)), "registry")
    texts = F.array(F.concat(head, F.lit(" "), F.substring("text", 1, 500)), F.substring("text", 501, 500), F.lit("Safety Data Sheet"))
    read = docs.filter("doc_id % 9 <> 0").withColumn("head", head).select("doc_id", F.posexplode(texts).alias("i", "text"))
    pages = read.join(known.select("document_id", F.col("input_pos").alias("doc_id")), "doc_id").select("document_id", (F.col("i") + 1).alias("page"), "text")
    typed = S.unit_counts(S.typed(known, S.page_sample(pages)), pages.select("document_id"))
    return typed.select("document_id", "file", "doc_type", "num_pages")


_HEADS = "[" + ", ".join("'" + h.replace("\t", "' || chr(9) || '") + "'" for h in HEADS) + "]"
TYPED = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % {len(HEADS)} AS k FROM documents),
     f AS (SELECT k, text, min(doc_id) AS doc_id FROM d GROUP BY ALL),
     s AS (SELECT *, doc_id % 9 <> 0 AS readable, CASE WHEN doc_id % 9 <> 0 THEN {_HEADS}[k + 1] || ' ' || substring(text, 1, 500) || chr(10) || substring(text, 501, 500) ELSE '' END AS sample FROM f),
     t AS (SELECT *, {D.collapse("lower('file-' || doc_id || '.pdf' || chr(10) || sample)")} AS whole FROM s)
SELECT printf('doc_%03d', row_number() OVER (ORDER BY doc_id)) AS document_id, 'file-' || doc_id || '.pdf' AS file,
  {D.doc_type('whole')} AS doc_type, CASE WHEN readable THEN 3 ELSE 0 END::INTEGER AS num_pages FROM t
"""


def csv_tables(spark, sf):
    """The suppliers of each nation in blocks of a hundred keys as a CSV file (balances with trailing zeros, keys with gaps,
    words for missing values, repeated headers) and the cells read from it."""
    s = table(spark, sf, "supplier")
    gap = F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey").cast("string")).otherwise("")
    row = F.concat_ws(",", F.col("s_suppkey").cast("string"), F.concat(F.lit('"'), "s_name", F.lit(', Ltd"')), F.format_string("%.2f", "s_acctbal"), gap, F.when(F.col("s_suppkey") % 5 == 0, "NA").otherwise("known"), F.when(F.col("s_acctbal") > 0, "True").otherwise("False"))
    lines = s.groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 100).alias("block")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))).alias("l"))
    content = F.concat_ws("\n", F.lit("key,name,balance,gap,name,positive"), F.transform("l", lambda x: x["row"]))
    read = S.read_csv_content(lines.select(F.concat_ws("-", "s_nationkey", "block").alias("document_id"), content.cast("binary").alias("content")))
    return read.select("document_id", F.array_join(F.transform("matrix", lambda r: F.array_join(r, "|")), ";").alias("cells"))


CSV = """
WITH r AS (SELECT s_nationkey || '-' || (s_suppkey // 100) AS document_id, * FROM supplier),
     g AS (SELECT document_id, bool_and(s_suppkey % 3 <> 0) AS whole, bool_and(s_suppkey % 3 = 0) AS none FROM r GROUP BY ALL)
SELECT document_id, 'key|name|balance|gap|name.1|positive;' || string_agg(s_suppkey || '|' || s_name || ', Ltd|' || CAST(round(s_acctbal, 2) AS DOUBLE) || '|'
    || CASE WHEN none THEN '' WHEN s_suppkey % 3 = 0 THEN '' WHEN whole THEN s_suppkey::VARCHAR ELSE s_suppkey || '.0' END || '|'
    || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'known' END || '|' || CASE WHEN s_acctbal > 0 THEN 'True' ELSE 'False' END, ';' ORDER BY s_suppkey) AS cells
FROM r JOIN g USING (document_id) GROUP BY document_id
"""


_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_LINKS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
#: The parts of a workbook but for its sheet: styles are plain, a built-in date, a date and time of its own, and a decimal.
_PARTS = {
    "xl/workbook.xml": f'<workbook {_MAIN} {_LINKS}><sheets><sheet name="orders" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {_MAIN}>" + "".join(f"<si><t>{t}</t></si>" for t in ("F", "O", "P", "order", "status", "total", "date", "moment", "customer", "large")) + "</sst>",
    "xl/styles.xml": f'<styleSheet {_MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="#,##0.00 &quot;days&quot;"/></numFmts>'
    '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>',
}


def workbooks(sheets):
    """document_id and content of XLSX files with one sheet. sheets: document_id, xml."""

    @F.pandas_udf("binary")
    def packed(xml: pd.Series) -> pd.Series:
        def one(sheet: str) -> bytes:
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in (_PARTS | {"xl/worksheets/sheet1.xml": sheet}).items():
                    z.writestr(name, text)
            return raw.getvalue()

        return xml.map(one)

    return sheets.select("document_id", packed("xml").alias("content"))


def xlsx_tables(spark, sf):
    """The orders of ten customers at a time as an XLSX file (dates by style, decimals, shared strings, booleans, missing cells)
    and the cells read from it."""
    o = table(spark, sf, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1899-12-30")))
    cell = lambda column, at, value, kind="", style=0: F.concat(F.lit(f'<c r="{column}'), at, F.lit(f'" s="{style}"{kind}><v>'), value.cast("string"), F.lit("</v></c>"))
    rows = o.groupBy(F.floor(F.col("o_custkey") / 10).cast("string").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey", F.array_position(F.array(F.lit("F"), F.lit("O"), F.lit("P")), F.col("o_orderstatus")).alias("status"), F.format_string("%.2f", "o_totalprice").alias("total"), "o_totalprice", day.alias("day")))).alias("o"))
    head = F.lit('<row r="1">' + "".join(f'<c r="{c}1" t="s"><v>{i}</v></c>' for i, c in enumerate("ABCDEFG", 3)) + "</row>")
    body = lambda x, i: F.concat(
        F.lit("<row>"),
        cell("A", i + 2, x["o_orderkey"]),
        cell("B", i + 2, x["status"] - 1, ' t="s"'),
        cell("C", i + 2, x["total"], style=3),
        cell("D", i + 2, x["day"], style=1),
        cell("E", i + 2, F.concat(x["day"].cast("string"), F.lit(".5")), style=2),
        F.when(x["o_custkey"] % 10 != 3, cell("F", i + 2, x["o_custkey"])).otherwise(F.lit("")),
        cell("G", i + 2, (x["o_totalprice"] > 100_000).cast("int"), ' t="b"'),
        F.lit("</row>"),
    )
    xml = F.concat(F.lit(f"<worksheet {_MAIN}><sheetData>"), head, F.array_join(F.transform("o", body), ""), F.lit("</sheetData></worksheet>"))
    read = S.read_xlsx(workbooks(rows.select("document_id", xml.alias("xml"))))
    return read.select("document_id", "sheet_name", F.md5(F.array_join(F.transform("matrix", lambda r: F.array_join(r, "|")), ";")).alias("cells"), F.size("matrix").alias("n"))


XLSX = """
WITH r AS (SELECT (o_custkey // 10)::VARCHAR AS document_id, * FROM orders),
     g AS (SELECT document_id, bool_or(o_custkey % 10 = 3) AS gaps, bool_and(round(o_totalprice, 2) = floor(round(o_totalprice, 2))) AS whole FROM r GROUP BY ALL)
SELECT document_id, 'orders' AS sheet_name, (count(*) + 1)::INTEGER AS n, md5('order|status|total|date|moment|customer|large;' || string_agg(
    o_orderkey || '|' || o_orderstatus || '|' || CASE WHEN whole THEN printf('%.0f', o_totalprice) ELSE CAST(CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS VARCHAR) END || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || strftime(o_orderdate, '%Y-%m-%d') || ' 12:00:00|'
    || CASE WHEN o_custkey % 10 = 3 THEN '' WHEN gaps THEN o_custkey || '.0' ELSE o_custkey::VARCHAR END || '|' || CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'False' END, ';' ORDER BY o_orderkey)) AS cells
FROM r JOIN g USING (document_id) GROUP BY document_id
"""


def eval_run(spark, sf):
    """The user turns of all conversations as cases, the next turn as the answer; a turn that is alone in its conversation's
    first place of each hundred fails in its route, and must not take others with it."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    cases = t.filter("role = 'user'").groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id")).agg(F.min("text").alias("question"))
    none = F.lit(None).cast("string")
    cases = stored(cases.withColumns({"required_terms": F.array(), "forbidden_terms": F.array(F.lit("the")), "expect_not_found": F.lit(False), "expected_file": none, "expected_page": F.lit(None).cast("int"), "expected_content_type": none}), "cases")
    said = stored(t.filter("role = 'assistant'").groupBy((F.col("conv_id") * 1000 + F.col("turn") - 1).alias("question_id")).agg(F.min("text").alias("said")), "said")
    least = cases.agg(F.min("question_id")).first()[0]

    def route(here):
        planted = F.when(F.col("question_id").isin(least, least + 2), F.raise_error(F.concat(F.lit("planted failure of case "), F.col("question_id").cast("string")))).otherwise(F.lit("copied"))
        own = said.join(here.select("question_id"), "question_id", "left_semi")  # all of it is read, but only a block's answers are dealt out
        answers = here.select("question_id").join(own, "question_id", "left").select("question_id", F.coalesce("said", F.lit("")).alias("answer"), planted.cast("string").alias("answer_route"), F.lit("answered").alias("answer_status"))
        return answers, evaluation.hits_of_none(spark)

    rows = evaluation.run(cases, route, block=max(256, cases.count() // 8))
    return rows.select("question_id", "passed", "answer_route", F.regexp_replace("error", "^[A-Za-z]*: ", "").alias("error"), (F.col("seconds") > 0).alias("timed"))


EVAL_RUN = f"""
WITH c AS (SELECT DISTINCT conv_id * 1000 + turn AS question_id FROM conversations WHERE role = 'user'),
     a AS (SELECT conv_id * 1000 + turn - 1 AS question_id, min(text) AS said FROM conversations WHERE role = 'assistant' GROUP BY ALL),
     m AS (SELECT min(question_id) AS least FROM c)
SELECT question_id, CASE WHEN question_id IN (least, least + 2) THEN false ELSE NOT contains({D.expected('said')}, 'the') AND NOT contains({D.expected('said')}, 'the answer was not found in the processed documents.') END AS passed,
  CASE WHEN question_id IN (least, least + 2) THEN 'error' ELSE 'copied' END AS answer_route,
  CASE WHEN question_id IN (least, least + 2) THEN 'planted failure of case ' || question_id ELSE '' END AS error, true AS timed
FROM c LEFT JOIN a USING (question_id), m
"""


def registry_stream(spark, sf):
    """The registry of documents that come in three parts, each by a start of its own of one streaming query."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("input_pos"), F.format_string("/in/doc-%d.txt", "doc_id").alias("file_path"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"), S.content_hash(F.coalesce("text", F.lit(""))).alias("file_hash"))
    docs = stored(docs, "arriving")
    third = docs.agg(F.max("input_pos")).first()[0]
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for part in range(3 if third is not None else 0):
        docs.filter(F.floor(F.col("input_pos") * 3 / (third + 1)) == part).write.mode("append").parquet(f"{where}/in")
        files = spark.readStream.schema(docs.schema).parquet(f"{where}/in")
        ingest.registry_query(files, f"{where}/registry", f"{where}/checkpoint").awaitTermination()
    if third is None:
        return spark.createDataFrame([], "document_id string, file_path string, file_hash string")
    return spark.read.schema(ingest.REGISTERED).parquet(f"{where}/registry").select(F.format_string("doc_%03d", "number").alias("document_id"), "file_path", "file_hash")


STREAMED = """
WITH k AS (SELECT sha256(coalesce(text, '')) AS file_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1)
SELECT printf('doc_%03d', row_number() OVER (ORDER BY doc_id)) AS document_id, '/in/doc-' || doc_id || '.txt' AS file_path, file_hash FROM k
"""

QUERIES = {"typed_registry": typed_registry, "csv_tables": csv_tables, "xlsx_tables": xlsx_tables, "eval_run": eval_run, "registry_stream": registry_stream}
ORACLES = {"typed_registry": TYPED, "csv_tables": CSV, "xlsx_tables": XLSX, "eval_run": EVAL_RUN, "registry_stream": STREAMED}
