"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF, rows_of
from docquarry.llm import bpe, common, covertree, graph, htmltext, media, ngramjoin, packing, recompress, sharding, toxicity, warc
from docquarry.llm.queries import oracle_sql, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash long, extra date"
LONG = " ".join(f"long{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, clashing extra columns."""
    base = " ".join(f"base{i}" for i in range(120))
    texts = [
        (0, "a b c"), (1, None), (2, ""), (3, "   \t\n"), (4, LONG), (5, LONG + " tail"), (6, base), (7, base), (8, base.replace("base60", "BASE60")), (9, base.replace("base60", "other")),
        (10, f"start {PASSAGE} end"), (11, f"x {PASSAGE} y z"), (12, PASSAGE), (None, PASSAGE), (13, "same " * 40), (14, "same " * 30), (15, "a b c"), (15, "a b c"), (16, "one"), (16, "two words"),
        (17, "é ü ß 漢字 😀"), (18, "A B C"), (19, "<|endoftext|> x"),
    ]
    return spark.createDataFrame([(i, t, None, None if k % 5 == 0 else f"s{k % 3}", 1, 2, date(2024, 1, 1)) for k, (i, t) in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracles(spark, duck, name):
    assert rows_of(queries()[name](spark, SF).toPandas()) == rows_of(duck.execute(oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, name, tmp_path):
    for t in ("documents", "labels", "pages", "embeddings", "sales", "sale_lines", "clicks"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries()[name](spark, str(tmp_path)).count() == 0


# -- op9, op1 ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    import tiktoken

    found = {base64.b64decode(a): int(x) for a, x in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=found, special_tokens={})


def test_bpe_round_trip(docs, local, ranks):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids := ranks.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in local)
    assert got == want


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aab \n\t'sé漢字😀0123.-­ THEthe ing"), max_size=60))
def test_bpe_matches_library(ranks, text):
    b = bpe.vocabulary(P.path("byte_bpe_50k.tiktoken"))
    ids = b.encode(text)
    assert ids == ranks.encode_ordinary(text) and b.decode(ids) == text.encode() and b.offsets(ids)[-1] == len(text.encode())


def test_bpe_frames(spark, docs):
    full = bpe.encode_frame(docs, P.path("byte_bpe_50k.tiktoken"))
    back = bpe.decode_frame(full, P.path("byte_bpe_50k.tiktoken"))
    assert Counter(r.text for r in back.collect()) == Counter(r.text or "" for r in docs.collect())


def json_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [np.array(t.encode(x, add_special_tokens=False).ids, "<u4") for x in texts]


def test_packing_ids_are_those_of_the_json_vocabulary(local, spark):
    texts = [t or "" for _, t in local] + [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for a, b in zip(packing.byte_bpe_ids(texts), json_ids(texts), strict=True):
        assert a.tolist() == b.tolist()


def test_packing(spark, docs, local):
    rows = packing.pack(docs, length=64, window_sequences=4).collect()
    got = Counter()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        got[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length
    want = Counter(tuple([*ids.tolist(), 0]) for ids in json_ids([t or "" for _, t in local]))
    made = Counter()
    for (_, n), pieces in by_doc.items():
        pieces.sort(key=lambda r: (r.start, r.sequence_id))
        copies = Counter(r.start for r in pieces)[0]
        ids = [x for r in pieces[::1] for x in np.frombuffer(r.ids, "<u4").tolist()] if copies == 1 else None
        if ids is not None:
            assert len(ids) == n
            made[tuple(ids)] += 1
    assert sum(made.values()) >= len(local) - 4 and not made - want
    total = sum(got.values())
    sizes = [got[k] for k in sorted(got)]
    full = total // 64
    assert sizes[:full] == [64] * full and all(s & (s - 1) == 0 for s in sizes[full:]) and total == sum(len(i) for i in want.elements())
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n


def test_pack_digest_against_the_json_vocabulary(spark):
    """The registered query's columns, recomputed from every document's ids."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = frame.collect()
    ids = {r.doc_id: np.append(x, 0).astype("<u4") for r, x in zip(rows, json_ids([r.text or "" for r in rows]), strict=True)}
    pieces, at, by_sequence = packing.pack_digest(frame).collect(), Counter(), defaultdict(list)
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert (r.doc_tokens, r.start, r.ids_crc32) == (len(own), at[r.doc_id], zlib.crc32(own[r.start : r.start + r.length].tobytes()))
        at[r.doc_id] += r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert at == Counter({d: len(x) for d, x in ids.items()})
    for found in by_sequence.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))]
    lengths = [sum(n for _, n in by_sequence[k]) for k in sorted(by_sequence)]
    full = sum(lengths) // 1024
    assert lengths[:full] == [1024] * full and all(n & (n - 1) == 0 for n in lengths[full:])


def test_mixture_holds_in_every_window(spark):
    texts = spark.createDataFrame([(i, f"w{i} " * (50 if i % 4 else 150), "abcd"[i % 4]) for i in range(400)], "doc_id long, text string, source string").repartition(7)
    rows = packing.pack(texts, length=128, window_sequences=8).groupBy("window", "queue").agg(F.sum("length").alias("n")).collect()
    total, each = sum(r.n for r in rows), Counter()
    for r in rows:
        each[r.queue] += r.n
    last = max(r.window for r in rows)
    for r in rows:
        if r.window < last:
            assert abs(r.n - 1024 * each[r.queue] / total) <= 1


@given(st.lists(st.tuples(st.integers(1, 5000), st.integers(1, 50)), min_size=1, max_size=6), st.integers(1, 700))
@settings(max_examples=100, deadline=None)
def test_weighted_rounds_fill_the_stream(queues, window):
    totals, weights = [n for n, _ in queues], [x for _, x in queues]
    rounds = packing.Rounds(totals, window, weights)
    seen = np.zeros(sum(totals), int)
    for s, n in enumerate(totals):
        at = 0
        for w, first, place, size in rounds.stretches(s, 0, n):
            assert first == at and rounds.sent(s, w) <= first and first + size <= rounds.sent(s, w + 1)
            at += size
            seen[place : place + size] += 1
        assert at == n
    assert (seen == 1).all()


def test_targets_are_dealt_until_a_source_is_dry(spark):
    texts = spark.createDataFrame([(i, f"w{i} " * 50, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string").repartition(7)
    pieces = packing.pack(texts, length=128, window_sequences=8, targets={"a": 0.5, "b": 0.375, "c": 0.125}).cache()
    total = Counter({r.queue: r.n for r in pieces.groupBy("queue").agg(F.sum("length").alias("n")).collect()})
    each = defaultdict(Counter)
    for r in pieces.groupBy("window", "queue").agg(F.sum("length").alias("n")).collect():
        each[r.window][r.queue] = r.n
    dry = int(total["a"] / 512)
    assert dry > 5 and max(each) > dry
    for w in range(dry):
        assert all(abs(each[w][q] - n) <= 1 for q, n in (("a", 512), ("b", 384), ("c", 128)))
    assert each[dry + 1]["a"] == 0 and abs(each[dry + 1]["b"] - 768) <= 1 and abs(each[dry + 1]["c"] - 256) <= 1
    assert sum(total.values()) == sum(sum(x.values()) for x in each.values()) == packing.token_queues(texts, packing.byte_bpe_ids).agg(F.sum("n")).first()[0]
    with pytest.raises(ValueError):
        packing.pack(texts, targets={"a": 1, "b": 1, "c": 0})


def test_many_sources_keep_their_queues(spark, monkeypatch):
    monkeypatch.setattr(packing, "SPAN", 3)
    docs = [(i, f"w{i} " * (1 + i % 40), "hot" if i % 3 == 0 else f"s{i % 29}") for i in range(300)] + [(300, None, None), (301, "", "é"), (302, "x", "😀")]
    texts = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5, "doc_id").cache()
    want, got = ([tuple(r) for r in packing.pack(texts, length=16, window_sequences=4, max_queues=q).collect()] for q in (4096, 7))
    assert len({r[6] for r in got}) == 33 and Counter(got) == Counter(want)


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=6), st.integers(1, 700))
@settings(max_examples=100, deadline=None)
def test_rounds_fill_the_stream(totals, window):
    rounds = packing.Rounds(totals, window)
    seen = np.zeros(sum(totals), int)
    for s, n in enumerate(totals):
        at = 0
        for _, first, place, size in rounds.stretches(s, 0, n):
            assert first == at
            at += size
            seen[place : place + size] += 1
    assert (seen == 1).all()


# -- op2 ---------------------------------------------------------------------------------------------------------------

SPLIT = re.compile(r"[^\x20\x09-\x0D]+").findall


def brute_windows(rows, window=13):
    """rows: (doc_id, text); a null id is larger than any other."""
    key = lambda d: float("inf") if d is None else d
    least = {}
    words = [SPLIT(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(least.get(g, float("inf")), key(d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < key(d):
                gone[i : i + window] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_substring_dedup(docs, local):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompress.substring_digest(docs).collect())
    assert got == brute_windows(local)


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup_random(spark, seed):
    rng = random.Random(seed)
    pool = [[rng.choice("ab" if seed == 0 else "abcdefgh") for _ in range(rng.randint(13, 40 if seed < 2 else 400))] for _ in range(12)]
    pool += [["x"] * 200, ["p", "q"] * 60]
    rows = []
    for d in rng.sample(range(1000), 60):
        words = []
        for _ in range(rng.randint(0, 5)):
            whole = rng.choice(pool)
            a = rng.randint(0, len(whole) // 2) if rng.random() < 0.5 else 0
            words += whole[a : rng.randint(a, len(whole)) if rng.random() < 0.3 else None] if rng.random() < 0.6 else [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        rows.append((d, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = recompress.substring_dedup(frame, slice_words=400, fan=16 if seed % 2 else 3)  # 3: names are dealt in two steps
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()) == brute_windows(rows)


def test_shared_symbols_stand_for_equal_words():
    rng = np.random.default_rng(0)
    passage = [f"w{x}" for x in rng.integers(0, 50, 3000)] + ["run"] * 300 + ["a", "b"] * 100
    words, found = [], []
    for head in ("left side", "some other beginning"):
        w = [*head.split(), *passage, *(f"{head[0]}{x}" for x in range(40))]
        raw = " ".join(w).encode()
        h, base = recompress.word_names(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        first = recompress._first(base)
        found.append({(int(a), int(b), int(n)): int(at) for a, b, n, at in zip(*recompress.high_symbols(h, recompress.near_symbols(h, first)), strict=True)})
        words.append(w)
    shared = found[0].keys() & found[1].keys()
    for key in shared:
        (x, y), n = (f[key] for f in found), key[2]
        assert words[0][x : x + n] == words[1][y : y + n] and n >= recompress.WINDOW
    assert sum(n for _, _, n in shared) > 2000


def test_without_repeats_keeps_columns(docs):
    out = recompress.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


# -- op10 --------------------------------------------------------------------------------------------------------------


def brute_components(rows, n=4, percent=85):
    sets = []
    for _, t in rows:
        w = SPLIT((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows))


def test_ngram_join(docs, local):
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.ngram_digest(docs).collect()) == brute_components(local)


@pytest.mark.parametrize(("n", "percent", "hot"), [(4, 85, 64), (5, 80, 64), (5, 80, 6)])
def test_ngram_join_random(spark, n, percent, hot, monkeypatch):
    monkeypatch.setattr(ngramjoin, "HOT_LIST", hot)
    monkeypatch.setattr(ngramjoin, "BLOCK", 16 if hot == 6 else 256)
    rng = random.Random(n)
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 80))] for _ in range(12)]
    rows = []
    for d in range(240):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
        if rng.random() < 0.3:
            words += PASSAGE.split()
        rows.append((d, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.ngram_join(frame, n, percent).collect()) == brute_components(rows, n, percent)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 102), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


# -- op8 ---------------------------------------------------------------------------------------------------------------


def brute_vectors(rows, cosine=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n = len(rows)
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                links[i, j] = a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            label[i] = min([label[i], *(label[j] for j in np.flatnonzero(links[i]))])
    least = defaultdict(list)
    for i, (v, _) in enumerate(rows):
        least[label[i]].append(v)
    return Counter((v, int(links[i].sum()), m := min([x for x in least[label[i]] if x is not None], default=v), v is not None and v == m) for i, (v, _) in enumerate(rows))


@pytest.mark.parametrize("block", [8, 1500])
def test_cover_tree(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * [0.02, 0.2, 0.6][i % 3]).astype("float32").tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(20)] + [(300, [2 * x for x in rows[0][1]])]
    rows += [(400, None), (401, []), (402, [0.0] * 5), (403, [float("nan")] * 5), (404, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (405, [None, 1.0, 1.0, 1.0, 1.0]), (406, [1.0, 2.0]), (407, [1.0, 2.0]), (None, rows[0][1]), (0, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(frame, block=block).collect())
    assert got == brute_vectors(rows)


def test_dual_traversal_finds_every_link():
    rng = np.random.default_rng(5)
    x = covertree.unit(np.repeat(rng.normal(size=(40, 6)), 6, axis=0) + rng.normal(size=(240, 6)) * 0.25)
    ids, ones = np.arange(240), np.ones(240, int)
    a, b = covertree.CoverTree(x[:120], ids[:120], ones[:120]), covertree.CoverTree(x[120:], ids[120:], ones[120:])
    n1, n2, _ = covertree.dual(a, b, False)
    hit = a.points @ b.points.T >= 0.9
    assert (n1 == hit.sum(1)).all() and (n2 == hit.sum(0)).all()
    m1, m2, _ = covertree.dual(a, a, True)
    own = a.points @ a.points.T >= 0.9
    assert (m1 + m2 == own.sum(1) - 1).all()


# -- op3 ---------------------------------------------------------------------------------------------------------------


def test_warc(spark):
    big = "".join(f"<p>{i} é</p>" for i in range(9000))
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://c", big), (6, "http://c", big), (None, "n", "x"), (7, "w", "WARC/1.1\r\n\r\nfoo\r\n\r\n"), (8, "t", "0\r\n\r\n")]
    pages = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    path = common.new_path(spark, "test-warc")
    warc.write_archives(pages, path, segment_bytes=4096)
    assert warc.read_records(spark, path).filter("part is not null").count() > 10
    got = {r.page_id: r for r in warc.read_pages(spark, path).collect()}
    assert len(got) == len(rows) and all(r.verified for r in got.values())
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert got[i].record_type == "revisit" or bytes(got[i].payload) == raw
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 2, None: 2, 3: 4, 5: 6}


def test_revisits_refer_to_records_that_exist(spark):
    rows = [(1, "a", "same"), (2, "b", "same"), (2, "b", "same"), (3, "c", "other"), (3, "c", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = common.new_path(spark, "test-warc")
    warc.write_archives(pages, path)
    found = [r for r in warc.read_records(spark, path).collect()]
    ids = [r.page.record_id for r in found]
    assert len(set(ids)) == len(rows) and [r.page.refers_to in ids for r in found if r.page.record_type == "revisit"] == [True]
    assert all(r.verified for r in warc.read_pages(spark, path).collect())
    # an archive without the response
    lone = common.new_path(spark, "test-warc")
    sha1 = warc.base32_sha1(b"same")
    [revisit] = warc.page_records(1, "0-0", "a", b"same", 2, False, 4096)
    [wrong] = warc.page_records(4, "0-1", "a", b"else", 5, False, 4096)
    [response] = warc.page_records(5, "0-2", "a", b"some", None, True, 4096)
    response = response.replace(warc.base32_sha1(b"some").encode(), warc.base32_sha1(b"else").encode())
    spark.createDataFrame([(x.decode(),) for x in (revisit, wrong, response)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(lone)
    got = {r.page_id: (r.record_type, r.verified) for r in warc.read_pages(spark, lone).collect()}
    assert got == {1: ("revisit", False), 4: ("revisit", False), 5: ("response", False)} and sha1


def test_lost_segment_is_noticed(spark):
    rows = [("o", "response", None, "sha1:X", None, 1, None, bytearray(b"ab")), ("o", "continuation", None, None, None, 3, 6, bytearray(b"ef"))]
    assert not warc.reassemble(spark.createDataFrame(rows, warc.RECORD)).first().whole


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked(body, size):
    assert warc.dechunk(warc.chunked(body, size)) == body
    assert warc.dechunk(warc.chunked(body, size)[:-5]) is None


# -- op5 ---------------------------------------------------------------------------------------------------------------


def test_media(docs, local):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_digest(docs).collect())
    pad = lambda b: b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
    raw = [(i, (t or "").encode()) for i, t in local]
    assert got == Counter((i, len(b), len(pad(b)), hashlib.sha256(pad(b)).hexdigest(), zlib.crc32(pad(b)[-32:])) for i, b in raw)


def test_media_digests(docs):
    import io
    import wave

    stored = {(r.doc_id, r.n_bytes, hashlib.sha256(bytes(r.media)).hexdigest()): bytes(r.media) for r in media.media_table(docs).collect()}
    got = media.media_digest(docs).collect()
    assert len({(r.doc_id, r.n_bytes, r.media_sha256) for r in got}) == len(stored)
    for r in got:
        raw = stored[r.doc_id, r.n_bytes, r.media_sha256]
        w = wave.open(io.BytesIO(raw))
        assert r.media_bytes == len(raw) and w.getsampwidth() == 1 and w.getnframes() * w.getnchannels() == r.payload_bytes
        assert hashlib.sha256(w.readframes(w.getnframes())).hexdigest() == r.payload_sha256
        assert r.feature.split(";")[1] == str(len(raw)) and r.feature.endswith("embedded=0")


def test_sniffing():
    import gzip
    import struct

    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IEND", b"")
    gz = gzip.compress(b"hello" * 100)
    wav = media.wav(b"BM RIFF P5 " + png + b"xx" + gz + b"GIF89a")
    assert media.sniff(wav) == [("audio/wav", 0, len(wav)), ("image/png", 44 + 11, len(png)), ("application/gzip", 44 + 11 + len(png) + 2, len(gz))]
    assert media.sniff(png[:-3]) == [] and media.sniff(b"") == []
    assert media.sniff(b"P5\n2 2\n255\nabcd") == [("image/x-portable-graymap", 0, 15)]


def test_pdfs_are_carved_whole():
    def section(before, body, prev=""):
        at = len(before) + len(body)
        return before + body + b"xref\n0 1\n0000000000 65535 f\ntrailer\n<< /Size 1 %s>>\nstartxref\n%d\n%%%%EOF" % (prev.encode(), at)

    one = section(b"%PDF-1.7\n", b"1 0 obj\n<< >>\nendobj\n")
    updated = section(one + b"\n", b"2 0 obj\n<< >>\nendobj\n", f"/Prev {one.rindex(b'xref', 0, -20)} ")
    twice = section(updated + b"\r\n", b"3 0 obj\n<< /Length 9 >>\nendobj\n")
    head, rest = b"%PDF-1.4\n1 0 obj\n<< /Linearized 1 /L ", b" /N 1 >>\nendobj\nxref\n0 1\nstartxref\n0\n%%EOF\n2 0 obj\n<< >>\nendobj\nxref\n0 1\nstartxref\n60\n%%EOF\n"
    linear = head + b"%d" % (len(head) + len(rest) + 3) + rest
    assert len(linear) == len(head) + len(rest) + 3
    wrong = head + b"999999" + rest
    for pdf in (one, updated, twice, linear, section(linear, b"9 0 obj\n<< >>\nendobj\n")):
        assert media.sniff(pdf) == [("application/pdf", 0, len(pdf))]
        assert media.sniff(b"text " + pdf + b" and " + pdf) == [("application/pdf", 5, len(pdf)), ("application/pdf", 10 + len(pdf), len(pdf))]
    assert media.sniff(wrong) == [("application/pdf", 0, len(wrong) - 1)]
    assert media.sniff(b"x" + one + updated) == [("application/pdf", 1, len(one)), ("application/pdf", 1 + len(one), len(updated))]


def test_declared_types_are_corrected(spark):
    frame = spark.createDataFrame([(1, bytearray(media.wav(b"abcd")), "image/png"), (2, bytearray(b"nothing"), "image/png"), (3, None, None)], "doc_id long, media binary, declared string")
    assert sorted((r.doc_id, r.type, r.valid, r.length) for r in media.sniff_frame(frame).collect()) == [(1, "audio/wav", True, 48), (2, "image/png", False, 0), (3, None, False, 0)]


# -- op6 ---------------------------------------------------------------------------------------------------------------


def test_sharding(spark, docs, local):
    rows = sharding.shard_digest(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in local)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("range_bytes", [500, 5000, 4 << 20])
def test_shards_are_even(spark, range_bytes):
    rng = random.Random(2)
    frame = spark.createDataFrame([(i, "hot text " * 5 if i % 3 == 0 else "x" * rng.randrange(300)) for i in range(2000)], "doc_id long, text string").repartition(5)
    out = sharding.shard(frame, range_bytes=range_bytes).collect()
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r["size"]
    assert len(out) == 2000 and max(sizes.values()) - min(sizes.values()) <= 2 * 301
    order = [(r.shard, r.slot) for r in sorted(out, key=lambda r: (r.key, r.doc_id))]
    assert order == sorted(order)


# -- op7 ---------------------------------------------------------------------------------------------------------------

PAGE = (
    '<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home {0}</a></li></ul></nav><!-- ad -->'
    '<div class="cookie-notice">We use cookies {0}</div><article><h1>Title {0} &amp; more</h1><p>First <b>bold<br>line {0}<p>Second&nbsp; &lt;x&gt;  {0}</p><p>Share this page</p>'
    '<form><p>Your mail</p></form><aside>see also</aside><section id="comments"><p>Nice {0}</p></section></article><div class="sidebar"><p>side {0}</p></div><footer>&copy; {0}</footer></body></html>'
)


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(8)] + [(100, "http://h.example/x", None), (101, None, ""), (102, "http://one.example", "<p>alone <i>in</i>line<div>next</div> tail"), (102, "http://one.example", "<p>alone <i>in</i>line<div>next</div> tail")]
    out = {r.page_id: r for r in htmltext.main_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(3)).collect()}
    for i in range(8):
        assert out[i].text == f"Title {i} & more\n\nFirst bold line {i}\n\nSecond <x> {i}"
        assert out[i].n_chars == len(out[i].text)
    assert out[100].text == out[101].text == "" and out[102].text == "alone inline\n\nnext\n\ntail"


def test_copies_of_a_page_are_not_template(spark):
    frame = spark.createDataFrame([(i, f"http://h.example/{i}", PAGE.format(0)) for i in range(30)], "page_id long, url string, html string")
    assert {r.text.count("\n\n") for r in htmltext.main_text(frame).collect()} == {3}


def test_copies_of_an_article_are_one_page(spark):
    long = [" ".join(f"w{j}x{k}" for k in range(20)) for j in range(6)]
    page = lambda i, paragraphs: f'<nav><a href="/{i}">menu {i}</a></nav><div class="ad">advert {i}</div><article><h1>Title</h1>' + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</article><footer>foot {i}</footer>"
    near = lambda i: [*long[: i % 6], f"edited {i} " * 5, *long[i % 6 + 1 :]]
    same = [(i, f"http://same.example/{i}", page(i, long)) for i in range(8)] + [(8 + i, f"http://same.example/{8 + i}", page(i, [f"other {i} " * 20])) for i in range(4)]
    edited = [(100 + i, f"http://near.example/{i}", page(i, near(i))) for i in range(12)]
    # different articles beside the copies: the notice they share still is template
    mixed = [(200 + i, f"http://mixed.example/{i}", page(i, [*long, "Share this page"])) for i in range(9)] + [(250 + i, f"http://mixed.example/{50 + i}", page(i, [f"own {i} " * 20, "Share this page"])) for i in range(6)]
    out = {r.page_id: r.text for r in htmltext.main_text(spark.createDataFrame(same + edited + mixed, "page_id long, url string, html string").repartition(5)).collect()}
    for i in range(8):
        assert all(p in out[i] for p in long)
    for i in range(12):
        assert all(p.strip() in out[100 + i] for p in near(i))
    for i in range(9):
        assert out[200 + i] == "\n\n".join(long)
    for i in range(6):
        assert out[250 + i] == f"own {i} " * 19 + f"own {i}"


@pytest.mark.parametrize("pages", [2, 3, 4])
def test_notices_on_small_hosts(spark, pages):
    frame = spark.createDataFrame([(i, f"http://h.example/{i}", f"<article><p>{f'own {i} ' * 20}</p><p>Share this page</p>{'<p>in two</p>' if i < 2 else ''}</article>") for i in range(pages)], "page_id long, url string, html string")
    out = {r.page_id: r for r in htmltext.extract(frame).collect()}
    assert all(("Share" in r.text) == (pages == 2) and ("in two" in r.text) == (i < 2) for i, r in out.items())
    assert all(r.text.startswith(f"own {i} own") for i, r in out.items())


def test_tree_matching():
    a = ["#root", [["div", [["p", []], ["b", []]]], ["p", []]]]
    b = ["#root", [["div", [["b", []]]], ["nav", []], ["p", []]]]
    assert htmltext.match(a, b, {}) == 4
    places = {}
    htmltext.align(a, b, {}, places)
    assert places[id(a[1][1])] == 4 and id(a[1][0][1][0]) not in places
    assert htmltext.nested(htmltext.flat(b)) == b


@pytest.mark.parametrize("rows", [3, 400])
def test_wide_pages_are_matched_like_narrow_ones(rows):
    shape = lambda page: htmltext.skeleton(htmltext.Builder(page).root)
    body = "<h2>a</h2><p>b</p>" * rows
    found = htmltext.blocks(f"<h3>new</h3>{body}", shape(f"{body}<h3>end</h3>"))
    assert [t for place, t, _, _ in found if place.startswith("?")] == ["new"]


def test_wide_matching_is_exact(monkeypatch):
    import random

    rng = random.Random(1)
    node = lambda: [rng.choice("abc"), [[k, []] for k in rng.choices("xy", k=rng.randint(0, 3))]]
    p, q = ([node() for _ in range(n)] for n in (560, 540))
    worth = {}  # of pairs of two-level trees: one and the longest common run of kinds
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i, x in enumerate(p, 1):
        for j, y in enumerate(q, 1):
            key = x[0], "".join(c[0] for c in x[1]), y[0], "".join(c[0] for c in y[1])
            if x[0] == y[0] and key not in worth:
                a, b = key[1], key[3]
                t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
                for k, u in enumerate(a, 1):
                    for m, v in enumerate(b, 1):
                        t[k][m] = max(t[k - 1][m], t[k][m - 1], t[k - 1][m - 1] + (u == v))
                worth[key] = 1 + t[-1][-1]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (worth[key] if x[0] == y[0] else 0))
    left, right, places = ["r", p], ["r", q], {}
    htmltext.align(left, right, {}, places)
    assert htmltext.match(left, right, {}) == len(places) == 1 + best[-1][-1]
    monkeypatch.setattr(htmltext, "REMEMBERED", 3)  # what is worked out again comes out alike
    again = {}
    htmltext.align(left, right, {}, again)
    assert again == places


def test_hostile_markup_is_read_in_linear_time():
    import time

    pages = ["<div>", "<span>", "<a ", '<a " ', "<p>a<b>", "<h2>t</h2><p>x</p>", "<ul><li>x", "<!--", "<", "</b>", "<td>", '<p class="ad-x">y']
    for part in pages:
        page = part * 5000 + "x"
        start = time.process_time()
        reference = htmltext.nested(htmltext.flat(htmltext.skeleton(htmltext.Builder(page).root)))
        htmltext.blocks(page, reference)
        assert time.process_time() - start < 5, part
    assert [t for _, t, _, _ in htmltext.blocks("<div>" * 5000 + "x", None)] == ["x"]


def test_names_alone_drop_no_text():
    long = "a sentence of the article that goes on for a while and has no link at all. " * 3
    page = f'<article><p>{long}</p><div class="related-work"><p>{long}</p></div><div class="related-posts"><a href="x">one</a></div><div class="related-x"><a href="x">{long}</a></div><ul class="comment-list"><li>{long}</li></ul><div class="article-header-body"><p>end</p></div></article>'
    assert [t for _, t, kept, _ in htmltext.blocks(page, None) if kept] == [long.strip(), long.strip(), "end"]


def test_names_that_mislead():
    """Reader comments go whatever else their names say; sections with telling names stay if they hold prose."""
    long = "a sentence of the article that goes on for a while and has no link at all. " * 3
    kept = lambda page: [t for _, t, k, _ in htmltext.blocks(page, None) if k]
    for name in ("comment-body", "comment-content", "comments", "reader-comment", "comment-author-text", "commentlist", "disqus_thread"):
        assert kept(f'<div><p>{long}</p></div><div class="{name}"><p>{long}</p></div>') == [long.strip()], name
        assert kept(f'<article><p>{long}</p><div class="x {name}"><p>Nice!</p></div></article>') == [long.strip()], name
    for part in (
        '<section id="notices"><p>Mind the step.</p></section>', '<p class="alert">Mind the step.</p>', '<section id="recommendations"><h2>Recommendations</h2><p>Mind the step.</p></section>',
        '<section id="discussion"><h2>Discussion</h2><p>Mind the step.</p></section>', f'<div class="search"><p>{long}</p></div>', '<div class="related-work"><p>Mind the step.</p></div>',
    ):
        assert kept(f"<article><p>{long}</p>{part}</article>")[-1] == (long.strip() if long in part else "Mind the step."), part
    assert kept(f'<article class="post comments-open"><p>{long}</p></article>') == [long.strip()]
    assert kept("<article><p>where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == ["where x=2 holds"]
    assert kept(f'<article><p>{long}</p><ul class="related"><li><a href="x">One more.</a></li></ul><div class="notices"><p>Menu</p></div></article>') == [long.strip()]


def test_pages_against_a_plain_parser(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.now, self.off, self.inside = [], [], [], False

        def flush(self):
            if t := " ".join("".join(self.now).split()):
                self.out.append(t)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in htmltext.BLOCK:
                self.flush()
            if tag == "br":
                self.now.append(" ")
            if tag == "article":
                self.inside = True
            if tag in htmltext.DROPPED or ("class", "ad") in attrs:
                self.off.append(tag)

        def handle_endtag(self, tag):
            if tag in htmltext.BLOCK:
                self.flush()
            if self.off and self.off[-1] == tag:
                self.off.pop()
            if tag == "article":
                self.inside = False

        def handle_data(self, data):
            if self.inside and not self.off:
                self.now.append(data)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = {r.page_id: r.text for r in htmltext.main_text(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html or "")
        plain.flush()
        assert out[r.page_id] == "\n\n".join(plain.out), r.page_id


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "<br>", "<table>", "<tr>", "<td>", "</table>", "<article>", "</article>", "<ul>", "<li>", "<script>", "</script>", "x", " y ", "&amp;", "<", "<!--", "-->", '<a href="', ">"]), max_size=30))
def test_any_markup_parses(parts):
    htmltext.blocks("".join(parts), None)


# -- op4 ---------------------------------------------------------------------------------------------------------------


def test_scores_against_brute_force(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(model.index) > 5 and len(model.thresholds) == 3
    for r in toxicity.grade(frame, model).collect():
        counts = Counter()
        for word in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            counts.update({word, *("^" + word[:n] for n in (4, 5, 6) if len(word) > n)})
        score = sum(model.weights[model.index[f]] * np.log(1 + n) for f, n in counts.items() if f in model.index)
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        each = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        assert abs(r.severity - sum(k * p for k, p in enumerate(each))) < 1e-9 and abs(r.p_toxic - above[0]) < 1e-9
        assert r.rejected == (above[0] >= 0.5) and abs(each[r.grade] - max(each)) < 1e-9


def test_ordinal_regression_recovers_an_order():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        x = {0: float(rng.integers(0, 4)), 1: float(rng.normal())}
        rows.append((x, int(np.clip(x[0] + rng.normal() * 0.2, 0, 3).round())))
    model = toxicity.fit(rows, {"a": 0, "b": 1})
    assert model.weights[0] > 5 * abs(model.weights[1]) and (np.diff(model.thresholds) > 0).all()


def test_held_out_toxicity(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.filter("doc_id % 5 <> 0"))
    held = toxicity.grade(docs, model).join(labels.filter("doc_id % 5 = 0"), "doc_id").collect()
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.rejected for r in toxic) >= 0.5 * len(toxic) and sum(r.rejected for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r.severity <= 3 for r in held)


def test_toxicity_edge_cases(spark, docs):
    none = toxicity.train(docs, spark.createDataFrame([(0, None), (None, 1), (999, 1)], "doc_id long, toxic int"))
    out = toxicity.grade(docs, none)
    assert out.count() == docs.count() and out.filter("rejected or severity > 0").count() == 0
    clash = toxicity.grade(docs.withColumn("severity", F.lit("x")), none)
    assert dict(clash.dtypes)["severity"] == "double" and clash.columns.count("severity") == 1


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = common.store(stage(spark, docs, SF), name)
        assert docs.columns == source.columns
        after = {r.doc_id: r for r in docs.collect()}
        if name == "near_duplicates":
            groups = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
            assert set(after) == {component for _, _, component in groups}
        if name == "substring_dedup":
            sums = {d: (n - gone) for d, n, gone, _ in brute_windows([(r.doc_id, r.text) for r in before])}
            assert {d: len(SPLIT(r.text)) for d, r in after.items()} == sums
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_edge_cases(spark, docs, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.store(stage(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() > 0


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    clash = "copies severity grade p_toxic rejected hash root row n queue window at verified __d".split()
    docs = source.select("*", *(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in clash)).repartition(3)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.store(stage(spark, now, SF), name)
        assert now.schema == docs.schema or now.columns == docs.columns
        for r in now.collect():
            assert all(r[c] == f"{c} {r.doc_id}" for c in clash)
    assert 0 < now.count() <= 150
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).select("doc_id").distinct().count() == now.count()


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_document_of_each_group_stays(spark):
    import corpus_pipeline

    base = [f"base{i}" for i in range(120)]
    near = lambda tag, at: " ".join([tag, *base[:at], "edited", *base[at + 1 :]])
    rows = [(1, near("one", 5)), (1, near("one", 50)), (1, near("one", 50)), (2, near("one", 90)), (3, ""), (4, " "), (4, "")]
    rows += [(None, " ".join(f"null{i}" if i != at else "edited" for i in range(120))) for at in (5, 50, 90)]
    rows += [(i, " ".join(f"late{k}" if k != at else "edited" for k in range(120))) for i, at in ((None, 5), (9, 50), (8, 90))]
    docs = spark.createDataFrame([(i, t, None, "s", 1, 2, date(2024, 1, 1)) for i, t in rows], DOCS).repartition(3)
    got = corpus_pipeline.no_near_duplicates(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text.split()[0] if r.text.split() else r.text) for r in got), key=repr) == sorted([(1, "one"), (3, ""), (4, " "), (4, ""), (None, "null0"), (8, "late0")], key=repr)
