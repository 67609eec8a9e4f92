"""Operators on small frames: sources, dedup, tables, retrieval, persistence, streaming."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry import config
from docquarry.operators import charts, corpus, digitize, ocr, providers, retrieval, tables
from docquarry.sources import files
from docquarry.streaming import ingest


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one \xff two")
    (tmp_path / "b.txt").write_bytes(b"one \xff two")
    (tmp_path / "c.csv").write_text("h1,h2\n1,\n2,x\n")
    got = files.read_files(spark, str(tmp_path))
    reg = files.registry(files.validate(got)).orderBy("document_id").collect()
    assert [(r.document_id, r.file, r.doc_type) for r in reg] == [("doc_001", "a.txt", "Text Document"), ("doc_002", "c.csv", "Spreadsheet")]
    assert got.filter("file_path like '%a.txt'").select(files.decode_text(F.col("content"))).first()[0] == "one  two"
    assert files.read_csv_content(got.filter("file_path like '%c.csv'").selectExpr("'d' AS document_id", "content")).first().matrix == [["h1", "h2"], ["1", ""], ["2", "x"]]


def test_rejects(spark):
    bad = spark.createDataFrame([("/x/a.exe", 5), ("/x/a.pdf", config.MAX_FILE_BYTES + 1), ("/x/ok.pdf", 1)], "file_path string, size_bytes long")
    assert [r.reject_reason is None for r in files.validate(bad, strict=False).collect()] == [False, False, True]
    for at, reason in ((0, "Unsupported"), (1, "larger than 100 MB")):
        one = spark.createDataFrame([bad.collect()[at]], bad.schema)
        with pytest.raises(Exception, match=reason):
            files.validate(one).collect()


def test_ticks_outside_the_plot_box_go(spark):
    fits = spark.createDataFrame([("a", "x", 0.1, 0.0, 5, 0.0, [0.0, 40.0, 80.0, 120.0, 160.0], [0.0, 4.0, 8.0, 12.0, 16.0])], "chart_id string, axis string, slope double, intercept double, points int, rmse double, tick_pixels array<double>, tick_values array<double>")
    boxes = spark.createDataFrame([("a", 30.0, 110.0)], "chart_id string, left double, right double")
    assert charts.fill_ticks(fits, boxes).first().asDict() == {"chart_id": "a", "values": [4.0, 8.0, 12.0], "pixels": [40.0, 80.0, 120.0]}
    assert charts.fill_ticks(fits, boxes.withColumn("right", F.lit(50.0))).count() == 0


def _zip(parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(raw.getvalue())


def test_docx_and_xlsx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = "<w:tc><w:p><w:r><w:t>{}</w:t></w:r></w:p></w:tc>"
    row = "<w:tr>" + cell.format("a") + cell.format("b") + "</w:tr>"
    docx = _zip({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl>{row}{row}</w:tbl></w:body></w:document>"})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    xlsx = _zip(
        {
            "xl/workbook.xml": f'<workbook {s}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si></sst>",
            "xl/worksheets/s.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="B2"><v>7</v></c></row></sheetData></worksheet>',
        }
    )
    d = files.read_docx(spark.createDataFrame([("d1", docx), ("d2", bytearray(b"broken"))], "document_id string, content binary")).orderBy("document_id").collect()
    assert (d[0].text, d[0].tables, d[0].error) == ("Hello", [[["a", "b"], ["a", "b"]]], None) and d[1].error
    x = files.read_xlsx(spark.createDataFrame([("x", xlsx)], "document_id string, content binary")).first()
    assert (x.page, x.sheet_name, x.matrix) == (1, "S", [["name", "Unnamed: 1", "5"], ["", "7", ""]])


def test_dedup_is_idempotent(spark):
    rows = [(1, "d", 1, "text", "A b"), (2, "d", 1, "text", "a  B"), (3, "d", 2, "text", "a b"), (4, "d", 1, "table", "a b"), (5, None, None, "text", None), (6, None, None, "text", None)]
    items = spark.createDataFrame(rows, "item_seq int, document_id string, page_start int, content_type string, text_for_embedding string")
    once = corpus.dedup_items(items, ["item_seq"])
    assert sorted(r.item_seq for r in once.collect()) == [1, 3, 4, 5]
    assert corpus.dedup_items(once, ["item_seq"]).count() == 4
    assert sorted(r.item_seq for r in corpus.dedup_items(items, ["item_seq"], cross_type=True).collect()) == [1, 3, 5]


def test_matrix_shapes(spark):
    m = spark.createDataFrame([([["  a  ", "b\n\n"], [None, "  c"], ["", " "]],), ([],), (None,)], "matrix array<array<string>>")
    got = [r[0] for r in m.select(tables.normalize_matrix(F.col("matrix"))).collect()]
    assert got[:2] == [[["a", "b"], ["", "c"]], []]


def test_candidates_match_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_seq long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:7])], "question_id long, embedding array<double>")
    got = {(r.question_id, r["rank"]): r.item_seq for r in retrieval.candidates(q, frame, 5, 5).collect()}
    for i in range(7):
        order = np.argsort(-(x @ x[i]), kind="stable")[:5]
        assert [got[i, k + 1] for k in range(5)] == order.tolist()


def test_near_copies_are_dropped(spark):
    text = "the operating pressure of the pump is five bar at most in all modes"
    rows = [(1, 1, 1, "f", 1, text), (1, 2, 2, "f", 1, text + "."), (1, 3, 3, "f", 2, text), (1, 4, 4, "f", 1, "something else")]
    ranked = spark.createDataFrame(rows, "question_id long, item_seq long, position int, file string, page_start int, text_for_embedding string")
    assert [r.item_seq for r in retrieval.greedy_distinct(ranked, 2).orderBy("rank").collect()] == [1, 3]


def test_anchors(spark):
    xs = spark.createDataFrame([([10.0, 12.0, 30.0, 11.0, 39.0],), ([],)], "xs array<double>")
    assert [r[0] for r in xs.select(tables.column_anchors(F.col("xs"))).collect()] == [[11.0, 34.5], []]
    assert xs.select(ocr.pair_anchors(F.array(F.lit(0.0), F.lit(30.0), F.lit(100.0)))).first()[0] == [15.0, 100.0]


def test_sampling_follows_the_curve():
    mask = np.zeros((60, 100), bool)
    for x in range(100):
        mask[10 + x // 4, x] = True
    mask[55, :20] = True  # a legend swatch
    got = charts.sample_series(mask, [5.0, 50.0, 90.0], radius=1)
    assert got == pytest.approx([11, 22, 32], abs=1)


def test_colour_masks():
    rgb = np.full((40, 40, 3), 255, np.uint8)
    rgb[5, :] = (200, 10, 10)
    rgb[15, :] = (10, 10, 200)
    assert sorted(int(m["mask"].sum()) for m in charts.colour_masks(rgb)) == [40, 40]


def test_embedder_is_deterministic():
    a = providers.hashed_features(["Hello world", "", "hello WORLD"])
    assert np.allclose(a[0], a[2]) and not a[1].any() and np.isclose((a[0] ** 2).sum(), 1)


def test_generator_choice():
    local, hosted = providers.Generator("local"), providers.Generator("hosted")
    assert providers.choose({"local": local, "hosted": hosted}, None, ("hosted",)).name == "hosted"
    with pytest.raises(ValueError):
        providers.choose({"local": local}, "other")


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 1200), (2, "x" * 1200), (3, "y")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = ingest.chunked(ingest.new_documents(spark, str(tmp_path / "in"), "doc_id long, text string")).writeStream.format("memory").queryName("chunks_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.table("chunks_out").groupBy("file_hash").count().count() == 2
    finally:
        q.stop()


def _drawn():
    """A chart of 500 x 400: x ticks 0, 2, .. 10 at 120 + 60 i, y = 10 at pixel 60 and 0 at 340, two coloured lines and a legend."""
    rgb = np.full((400, 500, 3), 255, np.uint8)
    at = lambda v: round(340 - 28 * v)
    lines = {(200, 30, 30): [9, 8, 7, 6, 5, 4], (30, 30, 200): [9, 6, 4.5, 3, 2, 1.5]}
    for colour, values in lines.items():
        for x in range(120, 421):
            y = at(np.interp(x, [120 + 60 * i for i in range(6)], values))
            rgb[y - 1 : y + 2, x] = colour
    token = lambda n, text, x, y, w=20: ("c", 1, 1, n, text, 95.0, x - w // 2, y - 6, w, 12)
    tokens = [token(50, str(2 * i), 120 + 60 * i, 360) for i in range(6) if i != 3]  # one tick is missing
    tokens += [token(10 + i, str(v), 60, at(v)) for i, v in enumerate((10, 8, 6, 4, 2, 0))]
    for n, (y, colour, text) in enumerate([(300, (30, 30, 200), "Treated"), (320, (200, 30, 30), "Placebo")]):
        rgb[y - 2 : y + 3, 70:100] = colour
        tokens += [token(70 + n, text, 170, y, 60)]
    return rgb, tokens


def test_digitize(spark):
    rgb, tokens = _drawn()
    image = "chart_id string, width int, height int, rgb binary, context string"
    kind = "chart_id string, block_num int, par_num int, line_num int, text string, conf double, left int, top int, width int, height int"
    rows = [("c", 500, 400, rgb.tobytes(), "Figure 1: score over time"), ("prose", 500, 400, rgb.tobytes(), ""), ("blank", 500, 400, bytes([255]) * 600_000, "Figure 2: chart")]
    seen = tokens + [("prose", *t[1:]) for t in tokens]
    got = digitize.digitize(spark.createDataFrame(rows, image), spark.createDataFrame(seen, kind)).collect()
    assert [r.chart_id for r in got] == ["c"]
    chart = got[0]
    assert chart.series_names == ["Placebo", "Treated"]
    assert [r.x for r in chart.plot_rows] == [0, 2, 4, 6, 8, 10]
    want = [[9, 9], [8, 6], [7, 4.5], [6, 3], [5, 2], [4, 1.5]]
    assert np.abs(np.array([r["values"] for r in chart.plot_rows], float) - want).max() < 0.2
    assert chart.confidence == pytest.approx(min(0.9, 0.4 + 0.04 * 5 + 0.2))


def test_closing_fills_small_holes():
    mask = np.zeros((9, 9), bool)
    mask[2:7, 2:7] = True
    mask[4, 4] = False
    assert charts.closed(mask).sum() == 25 and charts.closed(np.ones((3, 3), bool)).all()


def test_centroids_of_odd_vectors_and_many_keys(spark, monkeypatch):
    monkeypatch.setattr(corpus, "PARTIAL_KEYS", 2)
    rows = [("a", [1.0, 2.0]), ("a", [3.0, None]), ("a", None), ("b", [0.0, 0.0]), (None, [3.0, 4.0]), ("c", []), ("d", [5.0, 12.0, 0.0]), ("a", [2.0, 4.0]), ("e", [None, 2.0])]
    got = {r.document_id: r.centroid for r in corpus.centroids(spark.createDataFrame(rows, "document_id string, embedding array<float>").repartition(3)).collect()}
    size = (2**2 + 3**2) ** 0.5
    assert set(got) == {"a", "b", None, "d", "e"}
    assert got["a"] == pytest.approx([2 / size, 3 / size]) and got["b"] == [0, 0] and got[None] == pytest.approx([0.6, 0.8])
    assert got["d"] == pytest.approx([5 / 13, 12 / 13, 0]) and got["e"][0] is None


def test_a_saved_corpus_works_out_its_vectors_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embed(text):
        seen.add(1)
        return [float(len(text)), 1.0]

    items = spark.createDataFrame([("s1", "d1", "ab"), ("s2", "d1", "abcd"), ("s3", "d2", "x")], "source_id string, document_id string, text string")
    corpus.save_corpus(f"file://{tmp_path}/c", items, items.select("document_id").distinct(), items.select("source_id", "document_id", embed("text").alias("embedding")))
    assert seen.value == 3
    assert corpus.load_corpus(spark, f"file://{tmp_path}/c")["centroids"].count() == 2


def test_dedup_of_short_columns_reads_the_items_once_and_keeps_one_of_equal_rows(spark):
    rows = [(1, 1, "d", "Some text"), (1, 1, "d", "some  text"), (2, 1, "d", "SOME TEXT"), (3, 1, None, "x"), (4, 1, None, "X"), (5, 1, "e", "x")]
    items = spark.createDataFrame(rows, "doc_id long, chunk_index int, document_id string, text_for_embedding string").withColumns({"page_start": F.lit(1), "content_type": F.lit("text")})
    got = corpus.dedup_items(items, ["doc_id", "chunk_index"], columns=["doc_id", "document_id"])
    assert sorted((r.doc_id, r.document_id) for r in got.collect()) == [(1, "d"), (3, None), (5, "e")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_strip_takes_what_the_pattern_takes(spark):
    from docquarry.functions import text as X

    every = "".join(chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000)
    rows = [(c + "a" + c,) for c in every] + [(f" {c}\t",) for c in every] + [("",), (None,)]
    seen = spark.createDataFrame(rows, "t string").select(X.strip(F.col("t")).alias("a"), F.regexp_replace("t", f"^{X.SPACE}+|{X.SPACE}+$", "").alias("b"))
    assert seen.filter("NOT (a <=> b)").count() == 0
