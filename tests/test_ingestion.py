"""Files and decoded frames to a corpus, and questions to answers."""

import pytest

from docquarry.operators import corpus, ingestion
from docquarry.operators.providers import OcrProvider
from docquarry.plans import fixtures
from docquarry.session import installed_version
from docquarry.sources import files
from test_operators import _zip


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("files")
    (where / "a.txt").write_text("The burst pressure test was passed at 1.24 MPa.\n" * 40)
    (where / "b.docx").write_bytes(b"broken")
    cell = '<c t="inlineStr"><is><t>{}</t></is></c>'
    rows = "".join("<row>" + "".join(cell.format(c) for c in r) + "</row>" for r in fixtures.TABLES["critical"])
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    (where / "c.xlsx").write_bytes(
        bytes(_zip({"xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": f"<worksheet {s}><sheetData>{rows.replace('>=', '&gt;=')}</sheetData></worksheet>"}))
    )
    (where / "d.csv").write_text('Part,Weight\n"A, long",2\n\nB\n')
    (where / "e.xlsx").write_bytes(b"broken too")
    (where / "f.csv").write_text("a,b\n1,2\n3,4,5\n")
    (where / "g.png").write_bytes(b"image")
    plots = fixtures.chart_rows(spark).selectExpr("'doc_001' AS document_id", "3 AS page", "plot_rows", "series_names")
    return ingestion.build(files.read_files(spark, str(where)), ingestion.Decoded(plots=plots))


def test_corpus(built):
    counts = {r.file: (r.doc_type, r["text"], r["table"], r["plot_table"]) for r in built.documents.collect()}
    assert counts["c.xlsx"] == ("Spreadsheet", 0, 1, 0) and counts["b.docx"][1:] == (0, 0, 0) and counts["a.txt"][1] == 3 and counts["a.txt"][3] == 2  # two plots on one page
    assert counts["d.csv"] == ("Spreadsheet", 0, 1, 0)
    assert {r.document_id: r.warning.split(":")[0] for r in built.warnings.collect()} == {"doc_002": "docx", "doc_005": "xlsx", "doc_006": "csv", "doc_007": "image"}
    report = [r.line for r in corpus.registry_report(built.documents).orderBy("part", "document_id", "i").collect()]
    assert report[:4] == ["Documents processed: 7", "", "- a.txt", "  - ID: doc_001"] and "- Digital tables: 2" in report and report[-1].startswith("- Scaling guidance: Single")


def test_image_files_and_persistence(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g.png").write_bytes(b"image")
    frame = files.read_files(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError, match="No searchable content"):
        ingestion.build(frame)
    token = "SELECT document_id, page, 1 AS block_num, 1 AS par_num, 1 AS line_num, word AS text, '95' AS conf, 10 + 60 * i AS left, 10 AS top, 50 AS width, 12 AS height FROM {t} LATERAL VIEW posexplode(array('scanned', 'words', 'found')) w AS i, word"
    provider = OcrProvider("fake", lambda images: spark.sql(token, t=images))
    built = ingestion.build(frame, ocr_provider=provider, persist_to=str(tmp_path / "out"))
    assert [(r.content_type, r.text_for_llm) for r in built.items.collect()] == [("ocr_text", "scanned words found")]
    again = corpus.load_corpus(spark, built.persisted_to)
    assert again["items"].count() == 1 and again["registry"].first().file == "g.png"


def test_all_files_are_covered(built):
    assert built.items.count() == built.items.select("item_seq").distinct().count()


def test_answers(spark, built):
    asked = spark.createDataFrame([(1, "What was the observed result for the burst pressure test?"), (2, "Which group has the lowest score at week 12?"), (3, "")], "question_id long, question string")
    got = {r.question_id: r for r in ingestion.ask(asked, built, 5).collect()}
    assert (got[1].answer, got[1].answer_route) == ("1.24 MPa", "deterministic_structured_single_field")
    assert got[2].answer_route == "deterministic_plot_lowest" and got[3].answer_status == "empty_question"


def test_versions():
    assert installed_version("pyspark")[0].isdigit() and installed_version("no-such-package") == "not installed"
