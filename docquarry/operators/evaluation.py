"""Evaluation of answers and sources against test cases."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..session import stored
from .charts import rows_valid


def answer_passes(answer: Column, required: Column, forbidden: Column, expect_not_found: Column) -> Column:
    """All required terms, no forbidden one, and the not-found message exactly where it is expected."""
    none = F.array().cast("array<string>")

    def passes(said: Column) -> Column:
        has = lambda t: F.contains(said, X.normalize_expected(t))
        refused = F.contains(said, X.normalize_expected(F.lit(config.NOT_FOUND)))
        return F.forall(F.coalesce(required, none), has) & ~F.exists(F.coalesce(forbidden, none), has) & (refused == F.coalesce(expect_not_found, F.lit(False)))

    return X.let(X.normalize_expected(answer), passes)


def source_matches(expected_file: Column, expected_page: Column, expected_type: Column) -> Column:
    """Whether a hit (file, page_start, page_end, content_type) is what a case expects; a null expectation fits all."""
    file_ok = F.contains(X.normalize_expected(F.col("file")), X.normalize_expected(expected_file))
    page_ok = (F.col("page_start") <= expected_page) & (expected_page <= F.coalesce("page_end", "page_start"))
    type_ok = X.normalize_expected(F.col("content_type")) == X.normalize_expected(expected_type)
    return (expected_file.isNull() | F.coalesce(file_ok, F.lit(False))) & (expected_page.isNull() | F.coalesce(page_ok, F.lit(False))) & (expected_type.isNull() | F.coalesce(type_ok, F.lit(False)))


def source_checks(cases: DataFrame, hits: DataFrame, top_k: int = 3) -> DataFrame:
    """question_id, source_passed, matching_ranks, rank_1_match, top_k_match."""
    considered = hits.filter(F.col("rank") <= max(1, top_k)).select("question_id", "rank", "file", "page_start", "page_end", "content_type")
    expects = F.col("expected_file").isNotNull() | F.col("expected_page").isNotNull() | F.col("expected_content_type").isNotNull()
    good = F.when(source_matches(F.col("expected_file"), F.col("expected_page"), F.col("expected_content_type")), F.col("rank"))
    met = cases.join(considered, "question_id", "left").groupBy("question_id").agg(F.array_sort(F.collect_list(good)).alias("matching_ranks"), F.max(expects).alias("expects"))
    found = F.size("matching_ranks") > 0
    return met.select("question_id", (found | ~F.col("expects")).alias("source_passed"), "matching_ranks", F.coalesce(F.get("matching_ranks", F.lit(0)) == 1, F.lit(False)).alias("rank_1_match"), found.alias("top_k_match"))


def evaluate(cases: DataFrame, answers: DataFrame, hits: DataFrame, top_k: int = 2) -> DataFrame:
    """A row per case. A case without an answer (its route failed) counts as failed with the route "error"."""
    sources = source_checks(cases, hits, max(3, top_k))
    joined = cases.join(answers.drop("question"), "question_id", "left").join(sources, "question_id", "left")
    ok = answer_passes(F.col("answer"), F.col("required_terms"), F.col("forbidden_terms"), F.col("expect_not_found"))
    checked = joined.withColumn("answer_passed", F.col("answer").isNotNull() & ok)
    return checked.withColumn("passed", F.col("answer_passed") & F.col("source_passed")).withColumn("answer_route", F.coalesce("answer_route", F.lit("error")))


def run(cases: DataFrame, route: Callable[[DataFrame], tuple[DataFrame, DataFrame]], block: int = 256, top_k: int = 2) -> DataFrame:
    """evaluate() with `error` (empty if there is none) and `seconds` (of the block, shared by its cases). route(cases) gives
    answers and hits; cases go through it in blocks by a hash of question_id. A block that fails is halved until the case is
    alone that fails: it gets a row with its message, and the others are answered."""
    results, width = [], max(1, -(-cases.count() // block))
    waiting = [(cases, width, i) for i in range(width)]
    while waiting:
        among, width, i = waiting.pop()
        here = among.filter(F.pmod(F.xxhash64("question_id"), F.lit(width)) == i)
        started = time.perf_counter()
        try:
            answers, hits = (stored(df, name) for df, name in zip(route(here), ("answers", "hits"), strict=True))
            error = ""
        except Exception as failure:  # noqa: BLE001 - whatever a route raises is a case's result
            several = here.select("question_id").distinct().limit(2).count() > 1
            if several and width < MOST_BLOCKS:
                here = stored(here, "block")  # its halves read it, not all cases
                waiting += [(here, 2 * width, i), (here, 2 * width, i + width)]
                continue
            error = f"{type(failure).__name__}: {_message(failure)}"
            answers = stored(here.select("question_id", F.lit(f"ERROR: {_message(failure)}").alias("answer"), F.lit("error").alias("answer_route"), F.lit("error").alias("answer_status")), "answers")
            hits = hits_of_none(cases.sparkSession)
        n = here.count()
        if n:
            seconds = (time.perf_counter() - started) / n
            rows = evaluate(here, answers, hits, top_k).withColumns({"error": F.lit(error), "seconds": F.lit(round(seconds, 6))})
            results.append(rows.withColumn("passed", F.col("passed") & (F.col("error") == "")).withColumn("answer_passed", F.col("answer_passed") & (F.col("error") == "")))
    if not results:
        none = evaluate(cases, cases.select("question_id", *(F.lit("").alias(c) for c in ("answer", "answer_route", "answer_status"))), hits_of_none(cases.sparkSession), top_k)
        return none.withColumns({"error": F.lit(""), "seconds": F.lit(0.0)})
    return stored(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results), "evaluated")


#: Blocks into which halving may divide the cases; equal question_ids stay together.
MOST_BLOCKS = 1 << 40


def hits_of_none(spark) -> DataFrame:
    kinds = {"question_id": "long", "rank": "int", "file": "string", "page_start": "int", "page_end": "int", "content_type": "string"}
    return spark.range(0, 0, 1, 1).select(*(F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()))


def _message(failure: Exception) -> str:
    """The first line of what went wrong; of an error inside Spark the text of raise_error, if that was it."""
    said = re.search(r"\[USER_RAISED_EXCEPTION\] (.*?)(?: SQLSTATE|$)", str(failure), re.M)
    return said[1].strip() if said else (str(failure).strip().splitlines() or [""])[0]


def metrics(rows: DataFrame, seconds: str | None = None) -> DataFrame:
    """Counts and shares, and mean and median seconds if rows have them."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    timed = [F.avg(seconds).alias("average_response_time_seconds"), F.median(seconds).alias("median_response_time_seconds")] if seconds else []
    return rows.agg(F.count("*").alias("tests"), share("passed").alias("overall_pass_rate"), share("answer_passed").alias("answer_accuracy"), share("source_passed").alias("source_accuracy"), share("rank_1_match").alias("rank_1_source_accuracy"), share("top_k_match").alias("top_k_source_recall"), *timed)


def refusal_stability(answers: DataFrame, expected_not_found: Column) -> DataFrame:
    """Whether each wording is refused as expected."""
    refused = F.contains(X.normalize_expected(F.col("answer")), X.normalize_expected(F.lit(config.NOT_FOUND)))
    return answers.withColumn("refused", refused).withColumn("stable_pass", F.col("refused") == expected_not_found)


def plot_report(plots: DataFrame) -> DataFrame:
    """Rows, series and validity of plot items."""
    return plots.select("item_seq", F.size("plot_rows").alias("rows"), F.size("series_names").alias("series"), rows_valid(F.col("plot_rows")).alias("rows_valid"), (F.coalesce("confidence", F.lit(0.0)) >= 0.70).alias("confident"))
