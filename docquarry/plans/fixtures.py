"""Small typed-in tables, charts and questions that exercise the operators. The chart and its series, several of the tables
and the first four questions are public test fixtures' rows, so that results can be held against known ones; the rest is invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MATRIX = "array<array<string>>"

TABLES = {
    "critical": [["Critical attribute", "Verification method", "Acceptance criterion", "Observed result"], ["Burst pressure", "Hydrostatic ramp", ">=0.90 MPa", "1.24 MPa"], ["Seal integrity", "Bubble test", "No leak", "No leak"]],
    "parts": [["Part Number", "Description"], ["29477427", "High Flow Kit F"], ["29184612", "High Flow Gradient C"]],
    "lots": [["Lot Number", "18356721"], ["Product Article Number", "28 9301 82"], ["Date of Manufacture", "20240315"]],
    "colons": [["Owner:", "QA"], ["x", "y"], ["z", "w"]],
    "alpha": [["Comparison", "Contrast", "Alpha"], ["Week 12 NSI change", "40 mg vs placebo", "0.025"], ["Week 12 NSI change", "20 mg vs placebo", "0.025"]],
    "discontinuation": [["Reason", "Placebo", "20 mg", "40 mg"], ["Any discontinuation", "5.6%", "6.1%", "9.2%"], ["Adverse event", "1.9%", "2.6%", "4.1%"]],
    "materials": [["Component", "Material", "Operating temperature", "Part number"], ["Housing", "Polypropylene (PP)", "+2°C to +40°C", "100-1"], ["Gasket", "EPDM", "", ""], ["Pump tubing", "Silicone", "", "100-3"]],
}

CHART = [(0, [8.5, 8.5, 8.5]), (2, [8.2, 7.5, 7.0]), (4, [8.0, 6.2, 5.4]), (6, [7.8, 5.4, 4.1]), (8, [7.7, 4.8, 3.0]), (10, [7.5, 4.1, 2.2]), (12, [7.4, 3.8, 1.8])]
SERIES = ["Placebo (n=215)", "Luminara 25mg (n=210)", "Luminara 50mg (n=225)"]

QUESTIONS = [
    (1, "What was the observed result for the burst pressure test?"),
    (2, "Which treatment group has the lowest mean Neuropathy Symptom Score at week 12?"),
    (3, "What is the alpha allocation for the Week 12 NSI change, 40 mg vs placebo?"),
    (4, "What percentage of patients in the 40 mg group had any discontinuation?"),
    (5, "Which materials are used for the housing, the gaskets and the pump tubing?"),
    (6, "List the part number and operating temperature of the housing."),
    (7, "What is the warranty period?"),
    (8, "   "),
    (9, "Compare the operating temperature and materials of the AKTA ready flow kit products."),
]


def tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, m) for k, m in TABLES.items()], f"table_id string, matrix {MATRIX}")


def chart_rows(spark: SparkSession) -> DataFrame:
    note = "Approximate; digitized from rendered plot pixels"
    rows = [(float(x), v, note) for x, v in CHART]
    hidden = [(float(x), [8.5, 8.5, 4.0] if x == 0 else v, note) for x, v in CHART]
    kind = "array<struct<x:double,values:array<double>,uncertainty_note:string>>"
    return spark.createDataFrame([("chart", rows, SERIES), ("hidden", hidden, SERIES)], f"chart_id string, plot_rows {kind}, series_names array<string>")


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "question_id long, question string")


#: Which table each question is given as its hit.
HITS = {1: "critical", 2: "alpha", 3: "alpha", 4: "discontinuation", 5: "materials", 6: "materials", 7: "parts", 8: "parts", 9: "materials"}


def hits(spark: SparkSession) -> DataFrame:
    """Hits as retrieval gives them: the table of HITS, formatted."""
    from pyspark.sql import functions as F

    from ..operators import tables as T

    shaped = T.formatted(tables(spark))
    given = spark.createDataFrame(list(HITS.items()), "question_id long, table_id string")
    return given.join(shaped, "table_id").select(
        "question_id",
        F.lit(1).alias("rank"),
        F.concat("table_id", F.lit(".pdf")).alias("file"),
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


#: Lines and words of a page with a three-column table whose header is above the lines found.
LINES = [("d", 1, i, t, x, y, x + 40.0, y + 10.0) for i, (t, x, y) in enumerate([("Lactose A", 50.0, 120.0), ("+", 150.0, 121.0), ("-", 250.0, 120.0), ("Lactose B", 50.0, 140.0), ("+", 151.0, 140.0), ("-", 250.0, 141.0), ("a single line", 50.0, 300.0)])]
WORDS = [("d", 1, i, t, x, 104.0, x + 30.0, 112.0) for i, (t, x) in enumerate([("Milk", 150.0), ("Calf", 250.0), ("rennet*", 262.0)])]
OCR = [
    # block, par, line, text, conf, left, top, width, height
    (1, 1, 1, "Test", 90.0, 10, 10, 40, 12), (1, 1, 1, "Limit", 91.0, 200, 10, 50, 12), (1, 1, 2, "Burst", 88.0, 10, 30, 45, 12), (1, 1, 2, "ramp", 80.0, 60, 30, 40, 12),
    (1, 1, 2, "0.90", 95.0, 202, 31, 40, 12), (1, 1, 3, "Seal", 85.0, 11, 50, 40, 12), (1, 1, 3, "none", 20.0, 100, 50, 40, 12), (1, 1, 3, "O.5", 70.0, 201, 50, 30, 12),
]
#: Ticks of a chart: x ticks at 100 + 50 i for weeks 0, 2, ...; y ticks at 400 - 40 v.
TICKS = [("c", "x", 100.0 + 50 * i, 2.0 * i) for i in (0, 1, 2, 4, 5)] + [("c", "y", 400.0 - 40 * v, float(v)) for v in (0, 2, 4, 6, 8)] + [("c", "x", 900.0, 2027.0)]
