"""Answers: what their plan broadcasts and shuffles, questions with several hits and without any."""

import pytest

from conftest import SF
from docquarry.operators import routes
from docquarry.plans import catalogue

HITS = "question_id long, rank int, file string, page_start int, content_type string, table_structure_type string, structured_data array<array<string>>, text_for_embedding string, text_for_llm string, semantic_score double, score double"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_hits_are_shuffled_once_and_never_broadcast(spark):
    hits = spark.createDataFrame([(1, 1, "a", 1, "text", None, None, "x", "x", 0.5, 0.5)], HITS)
    plan = plan_of(routes.answers(spark.createDataFrame([(1, "Which x?")], "question_id long, question string"), hits))
    assert "Broadcast" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # questions and hits


def test_several_hits_are_taken_in_rank_order(spark):
    table = [["Description", "Part number"], ["Big ring", "P-1"], ["Small ring", "P-2"]]
    other = [["Description", "Part number"], ["Small ring", "Q-2"]]
    rows = [
        (1, 2, "b.pdf", 2, "table", "header_table", other, "Small ring Q-2", "", 0.9, 0.3),
        (1, 1, "a.pdf", 1, "table", "header_table", table, "Big ring P-1; Small ring P-2", "", 0.2, 0.4),
        (2, 1, "c.pdf", 3, "text", None, None, None, "Nothing of it.", 0.7, 0.7),
        (2, 3, "d.pdf", None, None, None, None, "", None, 0.1, 0.1),
        (4, 2, "e.pdf", 1, "text", None, None, "gaskets here", "gaskets here", 0.6, 0.6),
    ]
    asked = [(1, "What is the part number of the small ring?"), (2, "Which gaskets are there?"), (3, "Which gaskets are there?"), (4, "Which gaskets are there?"), (5, " ")]
    got = {r.question_id: r for r in routes.answers(spark.createDataFrame(asked, "question_id long, question string"), spark.createDataFrame(rows, HITS)).collect()}
    assert len(got) == 5
    # both small rings have the same terms; the better vector score decides
    assert (got[1].answer, got[1].answer_route, got[1].top_score, got[1].chunks_used) == ("Q-2", "deterministic_structured_single_field", 0.2, 2)
    assert got[1].sources == "1. a.pdf | page 1 | table | score: 0.4000\n2. b.pdf | page 2 | table | score: 0.3000" and got[1].rag_prompt == ""
    assert (got[2].answer_status, got[2].chunks_used, got[2].evidence_check.missing_terms) == ("insufficient_evidence", 2, ["gaskets", "there"])
    assert got[2].sources == "1. c.pdf | page 3 | text | score: 0.7000\n3. d.pdf | page Unknown | unknown | score: 0.1000"
    assert (got[3].answer_status, got[3].sources, got[3].top_score, got[3].confidence) == ("no_retrieval_results", "No sources retrieved.", 0.0, "Low")
    assert (got[4].answer_status, got[4].top_score) == ("generated", 0.0)  # no hit has rank 1
    assert "[CONTEXT 2]\nFile: e.pdf\nPage: 1\nType: text\ngaskets here" in got[4].rag_prompt
    assert got[5].answer_status == "empty_question"


@pytest.mark.parametrize("name", ["single_field_answer", "multi_field_answer"])
def test_tables_of_parts_are_never_broadcast(spark, name):
    assert "Broadcast" not in plan_of(catalogue.queries()[name](spark, SF))


def test_parts_are_dealt_out_before_their_tables_are_laid_out(spark):
    plan = plan_of(catalogue.queries()["route_precedence"](spark, SF))
    assert plan.count("REPARTITION_BY_NUM") == 2  # for questions and for hits
