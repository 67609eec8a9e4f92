"""What files hold, dense numbers, versions of a corpus, evaluation runs and the registry of a stream."""

import io
from datetime import datetime, time

import pytest
from pyspark.sql import functions as F

from docquarry.operators import corpus, evaluation, ingestion, numbering, versions
from docquarry.sources import files
from docquarry.streaming import ingest
from test_operators import _zip

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_csv_columns_print_as_their_types():
    raw = b'n,gap,x,name,name,flag,,code\n1,1,2.50,"A, long",NA,True,u,007\n2,,3,B,n/a,False,,8\n'
    assert files.csv_cells(raw) == [
        ["n", "gap", "x", "name", "name.1", "flag", "Unnamed: 6", "code"],
        ["1", "1.0", "2.5", "A, long", "", "True", "u", "7"],
        ["2", "", "3.0", "B", "", "False", "", "8"],
    ]
    assert files.csv_cells(b"a\n1e16\n12345678.0\n")[1:] == [["1e+16"], ["12345678.0"]]
    assert files.csv_cells(b"\xef\xbb\xbfa,b\n\n1,2\n") == [["a", "b"], ["1", "2"]]
    for broken in (b"", b"a,b\n1,2,3\n4,5,6,7\n"):
        with pytest.raises(Exception):  # noqa: B017 - any error becomes a warning of the document
            files.csv_cells(broken)


def workbook(rows, styles="", shared="", properties=""):
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN}>{properties}<sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="/xl/worksheets/s.xml"/></Relationships>',
        "xl/worksheets/s.xml": f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>",
    }
    if styles:
        parts["xl/styles.xml"] = f"<styleSheet {MAIN}>{styles}</styleSheet>"
    if shared:
        parts["xl/sharedStrings.xml"] = f"<sst {MAIN}>{shared}</sst>"
    return bytes(_zip(parts))


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="[$-409]d\\-mmm\\-yy"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="20"/></cellXfs>'


def test_xlsx_cells():
    text = lambda t, r: f'<c r="{r}" t="inlineStr"><is><t>{t}</t></is></c>'
    head = "".join(text(t, f"{c}1") for c, t in zip("ABCDEFG", ("id", "day", "own", "days", "at", "ok", "word"), strict=True))
    one = '<c r="A2"><v>1</v></c><c r="B2" s="1"><v>45292</v></c><c r="C2" s="2"><v>45292.25</v></c><c r="D2" s="3"><v>2.5</v></c><c r="E2" s="4"><v>0.75</v></c><c r="F2" t="b"><v>1</v></c><c r="G2" t="s"><v>0</v></c>'
    two = '<c r="A4"><v>2.0</v></c><c r="B4" s="1"><v>45293</v></c><c r="C4" s="2"><v>45294</v></c><c r="D4" t="e"><v>#N/A</v></c><c r="G4" t="str"><v>x</v></c>'
    raw = workbook(f'<row r="1">{head}</row><row r="2">{one}</row><row r="4">{two}</row><row r="9"/>', STYLES, "<si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>")
    (name, cells), = files.xlsx_sheets(raw)
    assert name == "S" and cells == [
        ["id", "day", "own", "days", "at", "ok", "word"],
        ["1.0", "2024-01-01 00:00:00", "2024-01-01 06:00:00", "2.5", "18:00:00", "1.0", "rich"],  # numbers and booleans beside gaps are floats
        ["", "", "", "", "", "", ""],
        ["2.0", "2024-01-02 00:00:00", "2024-01-03 00:00:00", "", "", "", "x"],
    ]
    dates = workbook('<row><c r="A1" t="inlineStr"><is><t>d</t></is></c></row><row><c r="A2" s="1"><v>1</v></c></row>', STYLES, properties='<workbookPr date1904="1"/>')
    assert files.xlsx_sheets(dates) == [("S", [["d"], ["1904-01-02"]])] and files.xlsx_sheets(workbook("")) == [("S", [])]


def test_number_formats():
    dated = {"yyyy-mm-dd": True, "h:mm AM/PM": True, "[h]:mm:ss": True, "0.00": False, '0 "days"': False, "[Red]0": False, "General": False, "#,##0;[Red]-d": False, "\\d0": False, "mmm": True}
    assert {f: files.is_date_format(f) for f in dated} == dated
    assert files.serial_date(45292.5, files.EPOCH) == datetime(2024, 1, 1, 12) and files.serial_date(0.25, files.EPOCH) == time(6)


def test_types_and_pages_come_from_what_files_hold(spark, tmp_path):
    said = lambda t: bytes(_zip({"word/document.xml": f"<w:document {WORD}><w:body><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:body></w:document>"}))
    (tmp_path / "a.docx").write_bytes(said("CERTIFICATE OF ANALYSIS for lot 7"))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.xlsx").write_bytes(workbook('<row><c r="A1" t="inlineStr"><is><t>safety data sheet</t></is></c></row><row><c r="A2"><v>1</v></c></row>'))
    (tmp_path / "d.xlsx").write_bytes(b"broken, too")
    (tmp_path / "e.pdf").write_bytes(b"pdf one")
    (tmp_path / "f.pdf").write_bytes(b"pdf two")
    (tmp_path / "g.txt").write_text("Safety data sheet")
    known = files.registry(files.validate(files.read_files(spark, str(tmp_path))))
    ids = {r.file: r.document_id for r in known.collect()}
    pages = spark.createDataFrame([(ids["e.pdf"], p, t) for p, t in ((1, "nothing"), (2, "safety  data\nsheet"), (3, "certificate of quality"))], "document_id string, page int, text string")
    built = ingestion.build(files.read_files(spark, str(tmp_path)), ingestion.Decoded(pages=pages))
    got = {r.file: (r.doc_type, r.num_pages) for r in built.documents.collect()}
    assert got == {"a.docx": ("Certificate of Analysis", 1), "b.docx": ("Unknown", 1), "c.xlsx": ("Spreadsheet", 1), "d.xlsx": ("Spreadsheet", 0), "e.pdf": ("Safety Data Sheet", 3), "f.pdf": ("Unknown", 0), "g.txt": ("Text Document", 1)}
    seq = [r.item_seq for r in built.items.orderBy("branch", "document_id", "page_start", "ordinal", "chunk_index").collect()]
    assert seq == list(range(1, len(seq) + 1))
    report = [r.line for r in corpus.registry_report(built.documents).collect()]
    assert "- Pages/sheets: 7" in report and "  - Pages/sheets: 3" in report


def test_dense_numbers(spark):
    frame = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)] + [(None, "n"), (None, "m"), (5, "y")], "k int, v string").repartition(7)
    got = [(r.number, r.k) for r in numbering.numbered(frame, ["k", "v"]).orderBy("number").collect()]
    assert [n for n, _ in got] == list(range(1, 1004)) and [k for _, k in got] == [None, None, *sorted([*range(1000), 5])]
    assert numbering.numbered(frame.limit(0), ["k"]).count() == 0
    plan = numbering.numbered(frame, ["k"], start=10)
    assert plan.agg(F.min("number"), F.max("number")).first()[:] == (10, 1012)


def frames(spark, n):
    items = spark.createDataFrame([(i, "ab"[i % 2], "d1") for i in range(n)], "item_seq int, content_type string, document_id string")
    return items, items.select("document_id").distinct(), items.select("item_seq", "document_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))


def test_versions_of_a_corpus(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "c")
    with pytest.raises(FileNotFoundError):
        corpus.load_corpus(spark, where)
    assert corpus.save_corpus(where, *frames(spark, 3), by_type=True) == 1
    publish = versions._publish
    monkeypatch.setattr(versions, "_publish", lambda *a: (_ for _ in ()).throw(OSError("the writer died")))
    with pytest.raises(OSError):
        corpus.save_corpus(where, *frames(spark, 5))  # all tables are written, but nobody sees them
    assert corpus.load_corpus(spark, where)["items"].count() == 3
    monkeypatch.setattr(versions, "_publish", publish)
    assert corpus.save_corpus(where, *frames(spark, 4)) == 2
    assert [corpus.load_corpus(spark, where, v)["items"].count() for v in (None, 1, 2)] == [4, 3, 4]
    assert corpus.load_corpus(spark, where)["centroids"].count() == 1
    with pytest.raises(Exception, match="(?i)exist"):  # another writer was first
        versions._publish(spark, where, 2, {"version": 2, "folder": "x", "tables": {}})
    items, documents, vectors = frames(spark, 4)
    corpus.save_corpus(where, items.limit(1), documents, vectors)
    with pytest.raises(RuntimeError, match="misaligned"):
        corpus.load_corpus(spark, where)


def test_damage_is_noticed(spark, tmp_path):
    import shutil

    where = str(tmp_path / "c")
    corpus.save_corpus(where, *frames(spark, 6))
    folder = tmp_path / "c" / "versions" / versions.manifest(spark, where)["folder"] / "items"
    shutil.copy(next(folder.glob("part-*.parquet")), folder / "part-99999-copied.parquet")
    with pytest.raises(RuntimeError, match="differs"):
        corpus.load_corpus(spark, where)


CASE = "question_id long, question string, required_terms array<string>, forbidden_terms array<string>, expect_not_found boolean, expected_file string, expected_page int, expected_content_type string"


@pytest.mark.parametrize("block", [1, 4, 100])
def test_failing_cases_stay_alone(spark, block):
    cases = spark.createDataFrame([(i, f"q{i}", ["yes"], None, False, None, None, None) for i in range(12)] + [(3, "again", ["yes"], None, False, None, None, None)], CASE)

    def route(here):
        ids = [r.question_id for r in here.collect()]
        if 7 in ids:
            raise ValueError("seven is not answered\nsecond line")
        return here.select("question_id", F.lit("yes").alias("answer"), F.when(F.col("question_id") == 5, F.raise_error(F.lit("five"))).otherwise("r").cast("string").alias("answer_route"), F.lit("ok").alias("answer_status")).distinct(), evaluation.hits_of_none(spark)

    rows = {r.question_id: r for r in evaluation.run(cases, route, block).collect()}
    assert set(rows) == set(range(12))
    assert rows[7].error == "ValueError: seven is not answered" and rows[7].answer == "ERROR: seven is not answered" and rows[7].answer_route == "error" and not rows[7].passed
    assert rows[5].error.endswith(": five") and not rows[5].answer_passed
    assert all(rows[i].passed and rows[i].error == "" and rows[i].seconds > 0 for i in range(12) if i not in (5, 7))
    m = evaluation.metrics(evaluation.run(cases, route, block), "seconds").first()
    assert m.average_response_time_seconds > 0 and m.median_response_time_seconds > 0
    assert evaluation.run(cases.limit(0), route, block).count() == 0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    where = str(tmp_path / "registry")
    schema = "input_pos long, file_path string, size_bytes long, file_hash string"
    first = spark.createDataFrame([(2, "b", 1, "B"), (1, "a", 1, "A"), (3, "a2", 1, "A")], schema)
    second = spark.createDataFrame([(0, "late", 1, "B"), (9, "n", 1, "N"), (8, "m", 1, "M")], schema)
    for batch, rows in ((0, first), (1, second), (1, second)):
        ingest.register_batch(spark, rows, batch, where)
    got = {r.file_hash: (r.file_path, r.number) for r in spark.read.parquet(where).collect()}
    assert got == {"A": ("a", 1), "B": ("b", 2), "M": ("m", 3), "N": ("n", 4)}




def test_large_sheets_are_read_in_pieces_with_odd_rows(spark):
    cell = '<c r="{}{}"><v>{}</v></c>'
    body = "".join(f'<row r="{i}">' + cell.format("A", i, i) + cell.format("AB", i, i / 2) + "</row>" for i in range(2, 4000) if i % 100)
    sheet = f'<worksheet xmlns="{files.S[1:-1]}"><cols><col min="1"/></cols><sheetData>{body}<row r="4000"/></sheetData><mergeCells/></worksheet>'
    rows = list(files._sheet_rows(io.BytesIO(sheet.encode())))
    assert [r.get("r") for r in rows] == [str(i) for i in range(2, 4000) if i % 100] + ["4000"]
    cells = files.xlsx_rows(io.BytesIO(sheet.encode()), [], [], files.EPOCH)
    assert len(cells) == 3999 and {len(r) for r in cells} == {28} and cells[99] == [""] * 28
    assert cells[3998][0] == 3999 and cells[3998][27] == 1999.5 and cells[0] == [""] * 28


def test_a_failing_block_is_read_once_for_its_halves(spark, monkeypatch):
    from docquarry.session import stored

    whole, kept = [], []
    monkeypatch.setattr(evaluation, "stored", lambda df, name: (kept.append(name), stored(df, name))[1])
    none = F.lit(None).cast("string")
    cases = spark.range(64).select(F.col("id").alias("question_id"), F.lit("q").alias("question"), F.array().cast("array<string>").alias("required_terms"), F.array().cast("array<string>").alias("forbidden_terms"), F.lit(False).alias("expect_not_found"), none.alias("expected_file"), none.cast("int").alias("expected_page"), none.alias("expected_content_type"))

    def route(here):
        whole.append("Range" in here._jdf.queryExecution().optimizedPlan().toString())
        bad = F.when(F.col("question_id") == 7, F.raise_error(F.lit("no"))).otherwise(F.lit("r"))
        return here.select("question_id", F.lit("a").alias("answer"), bad.cast("string").alias("answer_route"), F.lit("answered").alias("answer_status")), evaluation.hits_of_none(spark)

    rows = {r.question_id: (r.passed, r.error) for r in evaluation.run(cases, route, block=64).collect()}
    assert rows == {i: (True, "") if i != 7 else (False, rows[7][1]) for i in range(64)} and "no" in rows[7][1]
    assert sum(whole) == 1 and kept.count("block") >= 1


def test_typed_registry_equals_its_sql_on_odd_texts(spark, duck, tmp_path):
    from conftest import rows_of
    from docquarry.plans import catalogue, source_queries

    ends = ["xñsdsñy", "sdsñ", "coá", "́coa", "𝔸sds", "٣coa", "ªcoa", "sds_", "xsds", "a sds.", "DECLARATİON", "declaratıon", "quality　agreement"]
    cut = ["é" * 496 + " sds" + "ñ" * 500, "ñ" * 997 + "sds" + "xx", "😀" * 250 + "sds" + "😀" * 247]  # words begin or end where pages do
    ids = [i for i in range(12, 10000, 13) if i % 9]  # their first pages begin with nothing
    frame = spark.createDataFrame(list(zip(ids, [*ends, *cut, None, "", ends[0]], strict=False)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = source_queries.typed_registry(spark, str(tmp_path)).toPandas()
    assert rows_of(got) == rows_of(con.execute(catalogue.oracle_sql()["typed_registry"]).df())
    assert set(got["doc_type"]) >= {"Safety Data Sheet", "Certificate of Analysis", "Declaration / Statement", "Unknown"}
