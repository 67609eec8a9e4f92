"""Exact top lists by a stored index and by scanning, with odd vectors; near copies on both sides of the threshold."""

import time

import numpy as np
import pytest

from docquarry.operators import retrieval, vector_index
from docquarry.session import stored

VECTORS = "item_seq long, embedding array<float>"


def clustered(n, seed=0, size=16, groups=40):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, size)) * 4
    x = middle[r.integers(0, groups, n)] + r.normal(size=(n, size)) * 0.3
    x[: n // 3] = middle[0] + r.normal(size=(n // 3, size)) * 0.01  # a third of all in one place
    x[5] = x[6] = x[7]
    return x.astype(np.float32)


def best(x, ids, q, k):
    scores = x.astype(float) @ q.astype(float)
    order = np.lexsort((ids, -scores))[:k]
    return [(int(ids[i]), round(float(scores[i]), 5)) for i in order]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 100)
    monkeypatch.setattr(vector_index, "QUESTIONS", 7)


def test_index_is_exact_and_prunes(spark, small_blocks):
    x = clustered(3000)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    index = vector_index.build(frame)
    asked = list(range(0, 3000, 60))
    found, visited = vector_index.search(spark.createDataFrame([(i, x[i].tolist()) for i in asked], VECTORS.replace("item_seq", "question_id")), index, 20)
    got = {}
    for r in found.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.item_seq, round(r.semantic_score, 5)))
    assert got == {i: best(x, np.arange(3000), x[i], 20) for i in asked}
    read = visited.selectExpr("sum(points)").first()[0] / (len(asked) * 3000)
    assert read < 0.5, read  # a question in the crowded place reads all of it, the others little
    assert index.blocks.selectExpr("max(size(ids))").first()[0] < 3 * 100 and index.n == 3000


def odd(x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(900, None), (901, []), (902, [1.0] * 3), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16)]


@pytest.mark.parametrize("way", ["index", "scan"])
def test_odd_vectors(spark, way):
    x = clustered(50)
    items = spark.createDataFrame(odd(x), VECTORS)
    questions = spark.createDataFrame([(1, x[1].tolist()), (2, None), (3, [1.0]), (4, [float("nan")] * 16), (5, (-x[1]).tolist())], VECTORS.replace("item_seq", "question_id"))
    found = vector_index.search(questions, vector_index.build(items), 60)[0] if way == "index" else retrieval.candidates(questions, items, 60, 60)
    got = {}
    for r in found.collect():
        got.setdefault(r.question_id, []).append((r.item_seq, round(r.semantic_score, 5)))
    assert got.keys() == {1, 5} and all(len(v) == 50 for v in got.values()) and sorted(got[1]) == sorted(best(x, np.arange(50), x[1], 60))


def test_empty_index(spark):
    none = spark.createDataFrame([], VECTORS)
    assert vector_index.build(none) is None and vector_index.build(spark.createDataFrame([(1, None), (2, [float("nan")])], VECTORS)) is None
    assert vector_index.search(none.withColumnRenamed("item_seq", "question_id"), None, 5)[0].count() == 0


def test_near_copies_on_both_sides_of_the_threshold(spark):
    """Copies with more and more changes, transposed blocks, other places and blanks, against the matcher on every pair."""
    from collections import Counter
    from difflib import SequenceMatcher

    r = np.random.default_rng(2)
    words = [f"w{'abcdefgh'[i % 8]}{i}" for i in range(60)]
    texts = []
    for q in range(6):
        base = [words[i] for i in r.integers(0, 60, 40)]
        texts.append([" ".join(base)])
        for changes in (0, 1, 2, 3, 4, 5, 8, 20):
            other = list(base)
            for at in r.integers(0, 40, changes):
                other[at] = words[r.integers(0, 60)]
            texts[q].append(" ".join(other))
        texts[q] += [" ".join(base[20:] + base[:20]), " ".join(base[:25]), "", "  ", "zzz " * 40, " ".join(base)]
    rows = [(q, i + 1, "f" if i % 7 else "g", i % 2 if i < 4 else 1, t) for q, own in enumerate(texts) for i, t in enumerate(own)]
    ranked = spark.createDataFrame(rows, "question_id long, position int, file string, page_start int, text_for_embedding string")
    ratios, want = [], set()
    for q in range(6):
        kept = []
        for _, i, f, p, t in (x for x in rows if x[0] == q):
            t = " ".join(t.split())
            alike = [SequenceMatcher(None, t, k[2]).ratio() for k in kept if k[:2] == (f, p) and t and k[2]]
            ratios += alike
            if not any(x >= 0.92 for x in alike):
                kept.append((f, p, t))
                want.add((q, i))
    got = retrieval.greedy_distinct(ranked.withColumn("place", ranked["position"]), 100).collect()
    assert {(x.question_id, x.place) for x in got} == want
    assert any(0.85 < x < 0.92 for x in ratios) and any(0.92 <= x < 1 for x in ratios)
    states = Counter(s for row in retrieval.gathered_hits(ranked).collect() for own in row.states for s in own)
    bound = states[retrieval.EQUAL] + states[retrieval.BY_LENGTH] + states[retrieval.BY_LETTERS]
    assert bound and states[retrieval.UNDECIDED] and states[retrieval.BY_LENGTH] and states[retrieval.BY_LETTERS]


def test_groups_of_questions_meet_parts_of_items(spark, monkeypatch):
    """Many cells, small blocks: the same as brute force; nothing of it passes through the driver."""
    for name, value in (("QUESTION_GROUP", 40), ("BLOCK", 16), ("PAIRS", 3000), ("PAIRS_OF_GROUPS", 3000)):
        monkeypatch.setattr(retrieval, name, value)
    monkeypatch.setattr("pyspark.sql.DataFrame.toPandas", lambda self: pytest.fail("rows on the driver"))
    x = clustered(700).round(1)  # with ties
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    questions = items.filter("item_seq % 7 = 0").withColumnRenamed("item_seq", "question_id")
    found = retrieval.candidates(questions, items, 9, 9)
    assert found.groupBy("question_id", "item_seq").count().filter("count > 1").isEmpty()
    got = {}
    for r in found.orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.item_seq)
    exact = lambda i: [k for k, _ in best(x, np.arange(700), x[i], 9)]
    scores = lambda i, ks: np.round(x[ks].astype(float) @ x[i].astype(float), 6).tolist()
    assert got.keys() == set(range(0, 700, 7)) and all(scores(i, got[i]) == scores(i, exact(i)) for i in got)


def test_single_precision_only_decides_which_products_are_worked_out(spark):
    rng = np.random.default_rng(1)
    for scale, copies in ((1.0, 0), (1.0, 400), (1e20, 0), (1e-20, 0), (None, 400)):
        q, x = rng.normal(size=(30, 16)), rng.normal(size=(700, 16))
        x[100 : 100 + copies] = x[3]
        x *= 10.0 ** rng.integers(-30, 30, size=(700, 1)) if scale is None else scale
        x[600:650] = x[600] * (1 + 1e-13 * rng.integers(0, 5, size=(50, 1)))  # single precision can't tell these apart
        x[7], q[5], q[4], x[9] = np.nan, np.nan, 0, 0
        ids = rng.permutation(700).astype(np.int64)
        best = retrieval._Best(np.arange(30), q, None, 20)
        for at in range(0, 700, 128):
            best.meet(retrieval._Items(ids[at : at + 128], x[at : at + 128], 20))
        got = [(r["q"], r["i"], r["s"]) for r in best.batch(["q", "i", "s"]).to_pylist()]
        want = []
        for k in range(30):
            s = np.einsum("ij,ij->i", np.repeat(q[k : k + 1], 700, axis=0), x)
            ok = np.isfinite(s)
            want += [(k, int(ids[ok][o]), float(s[ok][o])) for o in np.lexsort((ids[ok], -s[ok]))[:20]]
        assert got == want


def test_items_are_stored_once_and_no_copy_of_them_is_shuffled(spark, monkeypatch):
    """Many groups of questions: what is shuffled are the questions, once each, and every part's best."""
    for name, value in (("QUESTION_GROUP", 20), ("BLOCK", 16)):
        monkeypatch.setattr(retrieval, name, value)
    x = clustered(300).round(1)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS)
    questions = items.filter("item_seq % 3 = 0").withColumnRenamed("item_seq", "question_id")
    found = retrieval.top_items(questions, items, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange hashpartitioning") == 1, plan
    got = {}
    for r in found.collect():
        got.setdefault(r.question_id, []).append((-r.score, r.item_seq))
    assert got.keys() == set(range(0, 300, 3))
    want = lambda q: sorted((x.astype(float) @ x[q].astype(float)).tolist(), reverse=True)[:5]
    assert all(np.allclose([-s for s, _ in sorted(got[q])[:5]], want(q)) for q in got)


def test_blocks_hold_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    rows = spark.range(0, 100, 1, 3).selectExpr("id", "if(id % 5 = 0, null, array(float(id), float(1))) AS embedding", "concat('w', id) AS file")
    packed = retrieval.blocks(rows, "item").collect()
    read = [r for b in packed for r in retrieval.pa.ipc.open_stream(b.item_rows).read_all().to_pylist()]
    assert len({b.item for b in packed}) == len(packed) and sorted(r["id"] for r in read) == list(range(100))
    assert all(r["embedding"] == (None if r["id"] % 5 == 0 else [float(r["id"]), 1.0]) and r["file"] == f"w{r['id']}" for r in read)


def test_shuffle_files_behind_a_stored_table_go(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size())) if f.startswith("shuffle_")}
    before = files()
    frame = spark.range(1000).repartition(3)
    read = stored(frame, "kept")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and read.count() == 1000
