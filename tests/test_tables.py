"""Tables found by folds in Spark against a plain walk through each page."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import tables
from docquarry.plans import fixtures

GEOMETRY = "document_id string, page int, {0} int, text string, x0 double, y0 double, x1 double, y1 double"
S = tables.SETTINGS


def clean(t):
    return " ".join((t or "").split())


def deal(cells, anchors):
    out = [[] for _ in anchors]
    for x, t in cells:
        out[min(range(len(anchors)), key=lambda i: (abs(x - anchors[i]), i))].append(clean(t))
    return [" ".join(t for t in c if t) for c in out]


def box(cells):
    return [min(c[2] for c in cells), min(c[3] for c in cells), max(c[4] for c in cells), max(c[5] for c in cells)]


def plain(lines, words):
    """(matrix, box, candidates) of the tables of one page; lines and words are (number, text, x0, y0, x1, y1)."""
    rows = {}
    for c in sorted(lines):
        if clean(c[1]):
            rows.setdefault(next((y for y in rows if abs(c[3] - y) < S.y_tolerance), c[3]), []).append(c)
    wide = [sorted(r, key=lambda c: c[2]) for r in rows.values() if len(r) > 1]
    starts = [c[2] for r in wide for c in r]
    groups = []
    for r in sorted((r for r in wide if any(sum(abs(x - c[2]) <= S.x_tolerance for x in starts) > 1 for c in r)), key=lambda r: r[0][3]):
        if groups and r[0][3] - groups[-1][-1][0][5] <= S.gap:
            groups[-1].append(r)
        else:
            groups.append([r])
    found = []
    for g in groups:
        means = []
        for x in sorted(c[2] for r in g for c in r):
            if means and abs(x - means[-1][0] / means[-1][1]) <= S.x_tolerance:
                means[-1] = (means[-1][0] + x, means[-1][1] + 1)
            else:
                means.append((x, 1))
        anchors = [s / n for s, n in means]
        matrix = [m for r in g if any(m := deal([(c[2], c[1]) for c in r], anchors))]
        if len(g) < S.min_rows or len(matrix) < S.min_rows or len(anchors) < S.min_columns:
            continue
        around = box([c for r in g for c in r])
        left, top, right, _ = around
        heads = []
        for w in sorted(words, key=lambda w: (w[3], w[2], w[0])):
            if clean(w[1]) and w[5] <= top and w[3] >= max(0, top - S.header_gap) and w[4] >= left and w[2] <= right:
                home = next((h for h in heads if abs(w[3] - sum(x[3] for x in h) / len(h)) <= S.header_y_tolerance), None)
                if home is None:
                    heads.append([w])
                else:
                    home.append(w)
        candidates = []
        for h in sorted(heads, key=lambda h: -min(w[3] for w in h)):
            h.sort(key=lambda w: w[2])
            if 0 <= top - max(w[5] for w in h) <= S.header_gap:
                candidates.append((deal([(w[2], w[1]) for w in h], anchors), box(h)))
        found.append((matrix, around, candidates))
    return found


def random_page(r, k):
    """Rows and columns out of line, ties in place, blanks, lines on their own, words above in one to three rows."""
    text = lambda: r.choice(["a", "b  c", " 12 ", "+", "", None, "Lot"])
    lines, words, y = [], [], 40.0
    for _ in range(r.randint(0, 3)):
        y += r.choice([15, 21, 26, 60])
        for _ in range(r.randint(1, 5)):
            for x in (50, 120, 190, 260):
                if r.random() < 0.8:
                    lines.append((text(), x + r.choice([0, 0, 4, 11]), y + r.choice([0, 0, 1, 2.5, 3]), 30, 10))
            y += r.choice([12, 14, 30])
    for _ in range(r.randint(0, 12)):
        words.append((text(), r.choice([50, 60, 120, 195, 400]), r.choice([30, 31, 33.5, 36, 60, 61, 80, 100]), 20, 8))
    number = lambda rows: [(i, t, float(x), float(y), float(x + w), float(y + h)) for i, (t, x, y, w, h) in enumerate(rows)]
    r.shuffle(lines)
    return k, number(lines), number(words)


def test_pages_against_a_plain_walk(spark):
    r = random.Random(4)
    pages = [random_page(r, k) for k in range(60)]
    lines = spark.createDataFrame([("d", k, *c) for k, ls, _ in pages for c in ls], GEOMETRY.format("line_no"))
    words = spark.createDataFrame([("d", k, *c) for k, _, ws in pages for c in ws], GEOMETRY.format("word_no"))
    found = tables.page_tables(lines)
    above = tables.header_candidates(found, words)
    got = {}
    for row in found.join(above, ["document_id", "page", "table_index"], "left").orderBy("page", "table_index").collect():
        got.setdefault(row.page, []).append((row.matrix, pytest.approx(row.bbox), [(c.header, list(c.bbox)) for c in row.candidates or []]))
    want = {k: t for k, ls, ws in pages if (t := plain(ls, ws))}
    assert want.keys() == got.keys() and sum(map(len, want.values())) > 40 and any(c for t in want.values() for *_, c in t)
    for k in want:
        assert want[k] == got[k], k


def test_header_is_recovered(spark):
    found = tables.detect(spark.createDataFrame(fixtures.LINES, GEOMETRY.format("line_no")), spark.createDataFrame(fixtures.WORDS, GEOMETRY.format("word_no"))).collect()
    assert [(r.table_index, r.header_recovered, r.matrix, r.bbox[1]) for r in found] == [(1, True, [["", "Milk", "Calf rennet*"], ["Lactose A", "+", "-"], ["Lactose B", "+", "-"]], 104.0)]


def test_detection_stays_in_the_jvm(spark):
    lines = spark.createDataFrame(fixtures.LINES, GEOMETRY.format("line_no"))
    plan = tables.detect(lines, lines.withColumnRenamed("line_no", "word_no"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_places_that_are_null_and_empty_pages(spark):
    lines = spark.createDataFrame([("d", 1, 1, "a", None, 1.0, 2.0, 2.0), ("d", 2, 1, "  ", 1.0, 1.0, 2.0, 2.0)], GEOMETRY.format("line_no"))
    assert tables.detect(lines, lines.withColumnRenamed("line_no", "word_no").filter(F.lit(False))).count() == 0


def test_borderless_tables_settle_their_steps(spark):
    """Filters on a page's anchors and matrix don't carry their expressions into those of every cell."""
    from docquarry.operators import ocr

    kind = "document_id string, page int, block_num int, par_num int, line_num int, text string, conf double, left int, top int, width int, height int"
    found = ocr.table_matrix(ocr.lines(spark.createDataFrame([("d", 1, 1, 1, i, t, 90.0, x, 20 * i, 30, 12) for i in range(3) for t, x in (("a", 10), (f"b{i}", 200))], kind)))
    assert [r.matrix for r in found.collect()] == [[["a", "b0"], ["a", "b1"], ["a", "b2"]]]
    assert len(found._jdf.queryExecution().optimizedPlan().toString().split("aggregate(")) <= 4


def test_pages_are_folded_once_and_in_all_tasks(spark):
    lines = spark.createDataFrame([("d", 1, i, f"t{i}", 50.0 + 100 * (i % 3), 10.0 * (i // 3), 90.0 + 100 * (i % 3), 10.0 * (i // 3) + 8) for i in range(9)], "document_id string, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double")
    found = tables.page_tables(lines.repartition("document_id"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2 and plan.count("array_position(") == 1  # rows and columns; a cell's row
    assert "RepartitionByExpression [document_id#" in plan and ", page#" in plan.split("RepartitionByExpression [document_id#")[1].split("]")[0]
    assert [(r.table_index, r.matrix) for r in found.collect()] == [(1, [[f"t{3 * i + k}" for k in range(3)] for i in range(3)])]
