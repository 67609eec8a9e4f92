"""Point-in-time features, token files and spelling variants against brute force, with their edge cases."""

import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from docquarry.llm import pointintime, tokenfile, variants

DAY0 = datetime(2024, 1, 1)


@pytest.fixture
def torn(spark):
    """Many small ranges and batches, so that clients, items and moments are cut anywhere."""
    settings_ = {"spark.sql.execution.arrow.maxRecordsPerBatch": "5", "spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings_}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


# -- op11 --------------------------------------------------------------------------------------------------------------

SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, extra string"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, cents long"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, id long"


def shop(seed: int):
    """Skewed, tied, late, repeated and broken rows."""
    r = random.Random(seed)
    at = lambda: None if r.random() < 0.05 else DAY0 + timedelta(hours=r.choice([0, 0, 24, 48, r.randint(0, 24 * 20)]), microseconds=r.choice([0, 0, r.randint(0, 10**9)]))
    late = lambda t: None if t is None or r.random() < 0.05 else t + timedelta(hours=r.choice([0, 0, 1, 47, 24 * 15]))
    client = lambda: r.choice([7, 7, 7, 1, 2, None])
    money = lambda: r.choice([None, 1.005, 0.125, -3.5, float("nan"), float("inf"), r.random() * 100])
    sales, lines, clicks = [], [], []
    for i in range(60):
        t = at()
        sales.append((None if i == 3 else i if i != 9 else 8, client(), "done", money(), t, late(t), 1, "x"))
    for _ in range(150):
        lines.append((r.choice([7, 7, None, *range(60)]), 1, r.choice([5, 5, 6, 7, None]), 1, 1, money(), 0.0, None, at(), 4))
    for i in range(120):
        t = at()
        clicks.append((r.choice([i, None, 5]), t, late(t), client(), r.choice(["purchase", "view", None]), money(), None, 1))
    return sales, lines + lines[:5], clicks + clicks[:30]


def brute_features(sales, lines, clicks):
    cents = lambda x: 0 if x is None or x != x or abs(x) == float("inf") else int(np.floor(100 * x + 0.5))
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    delay, out = timedelta(minutes=240), []
    same = lambda c: tuple("nan" if x != x else x for x in c)
    clicks = list({same(c): c for c in clicks}.values())
    for sale, client, _, _, sold, *_ in sales:
        if sale is None or client is None or sold is None:
            continue
        t = sold + timedelta(seconds=zlib.crc32(str(sale).encode()) % 259200)
        label = any(s[1] == client and s[4] is not None and t < s[4] <= t + timedelta(days=7) for s in sales)
        for d in (2, 14):
            inside = lambda at, arrived: at is not None and arrived is not None and t - timedelta(days=d) < at <= t and arrived + delay <= t  # noqa: B023, E731
            c = [x for x in clicks if x[3] == client and inside(x[1], x[2])]
            s = [x for x in sales if x[1] == client and inside(x[4], x[5])]
            ln = [x for y in s for x in lines if y[0] is not None and x[0] == y[0] and x[8] is not None and x[8] <= t]
            last = max(c, key=lambda x: (x[1], -1 if x[0] is None else x[0]))[0] if c else None
            out.append((sale, d, us(t), label, len(c), sum(x[4] == "purchase" for x in c), sum(cents(x[5]) for x in c), last, len(s), sum(cents(x[3]) for x in s), len(ln), len({x[2] for x in ln if x[2] is not None}), sum(cents(x[5]) for x in ln)))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_point_in_time(torn, seed):
    sales, lines, clicks = shop(seed)
    frames = [torn.createDataFrame(x, schema).repartition(3) for x, schema in ((sales, SALES), (lines, LINES), (clicks, CLICKS))]
    got = pointintime.feature_table(*frames)
    names = "sale_id d t_us label n_clicks n_purchases click_cents last_click_id n_sales sale_cents n_lines n_items line_cents".split()
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == brute_features(sales, lines, clicks)


def test_point_in_time_other_parameters(torn):
    """Other windows, one question a day and no lines or clicks."""
    sales, lines, clicks = shop(3)
    frames = [torn.createDataFrame(x, schema) for x, schema in ((sales, SALES), ([], LINES), ([], CLICKS))]
    ask = F.col("sold_at").cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY")
    got = pointintime.feature_table(*frames, days=(0.5, 1, 30), delay_minutes=0, horizon_days=1, ask=ask)
    known = [s for s in sales if None not in (s[0], s[1], s[4])]
    by = {d: 0 for d in (0.5, 1.0, 30.0)}
    for r in got.collect():
        by[r.d] += r.n_sales
        assert r.n_lines == r.n_clicks == 0 and r.last_click_id is None
    for d in by:
        want = 0
        for s in known:
            t = s[4] + timedelta(days=1)
            want += sum(x[1] == s[1] and None not in (x[4], x[5]) and t - timedelta(days=d) < x[4] <= t and x[5] <= t for x in sales)
        assert by[d] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=40), st.integers(1, 7))
def test_running_max(rows, _):
    rows.sort(key=lambda x: x[0])
    runs, values = np.array([x for x, _ in rows], np.int64), np.array([v for _, v in rows], np.int64)
    want = [max(v for r, v in rows[: i + 1] if r == rows[i][0]) for i in range(len(rows))]
    assert not rows or pointintime.running_max(values, runs).tolist() == want


# -- op12 --------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**64 - 1)), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    raw = tokenfile.EliasFano.encode(np.array(values, np.uint64))
    coded = tokenfile.EliasFano(raw)
    assert coded.all().tolist() == values and [coded[i] for i in range(len(values))] == values
    if values:
        spread = max(values[-1] - values[0], 1)
        assert 8 * len(raw) <= len(values) * (3 + max(0, np.log2(spread / len(values)))) + 32 * (len(values) // tokenfile.SAMPLE + 1) + 8 * 32


TEXTS = [(5, "Don't  stop,  it's 2024 ÉCOLE"), (5, "again"), (None, "unnamed one"), (-3, "<|endoftext|> x<|startoftext|>y"), (2**62, None), (7, ""), (6, "tab\tand\nnew line Σίσυφος ΣΑΣ é ́x 漢字 😀"), (8, "w" * 300 + " " + "long " * 4000), (9, " a "), (10, "a " * 5)]


def test_token_files(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(tokenfile, "PIECE_CHARS", 100)  # long texts in pieces
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in TEXTS], "doc_id long, text string, at long, content string").repartition(3)
    path = f"file://{tmp_path}/files"
    tokenfile.write_token_files(docs, path, P.path("word_bpe_49k.json"), 2, shard_ids=12)
    want = Counter((i, *library.encode(t or "", add_special_tokens=False).ids, 2) for i, t in TEXTS)
    shards = [tokenfile.TokenShard(f.read_bytes()) for f in tmp_path.glob("files/part-*") if f.stat().st_size]
    assert len(shards) > 3
    got, order = Counter(), []
    for s in sorted(shards, key=lambda s: (s.range, s.shard)):
        for k in range(s.n):
            got[s.doc_id(k), *s.document(k).tolist()] += 1
            order.append(s.doc_id(k))
            assert s.doc_id(k) is None or s.doc_id(s.find(s.doc_id(k))) == s.doc_id(k)
        assert s.find(123456) is None
    assert got == want and order == sorted(order, key=lambda x: (x is not None, x or 0))
    start, rows = 0, sorted(tokenfile.document_digests(spark, path).collect(), key=lambda r: r.start)
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter({(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())): n for (i, *ids), n in want.items()})


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("abSTdm'rel l9,.\"<|>_-\t\x1c\x0b\x85\u00a0éÉΣσ\u0301漢İı"), max_size=40), max_size=4))
def test_stretches_give_the_ids_of_the_library(word_bpe, texts):
    texts += ["It's 12 o'CLOCK, they'll say: 'twas", "<|endoftext|>a<|ENDOFTEXT|>", "x'S''s"]
    enc = tokenfile.encoder(P.path("word_bpe_49k.json"))
    got = [np.frombuffer(p, enc.dtype).tolist() for p in enc.encode(texts)]
    assert got == [word_bpe.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_of_the_whole_table(spark):
    from tokenizers import Tokenizer

    library, start = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_file_round_trip(docs).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[r.doc_id] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_damaged_token_file():
    raw = bytearray(tokenfile.TokenShard.encode(0, 0, [1, 2], [b"\1\0\2\0", b"\2\0"], 2))
    assert tokenfile.TokenShard(bytes(raw)).document(1).tolist() == [2]
    raw[-1] ^= 1
    for broken in (bytes(raw), bytes(raw[:-1]), b"x" + bytes(raw[1:])):
        with pytest.raises(ValueError):
            tokenfile.TokenShard(broken)


# -- op13 --------------------------------------------------------------------------------------------------------------


def brute_words(docs, least=7, every=31):
    import re

    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, factor=10):
    words, out, form = brute_words(docs), [], {}
    beside = defaultdict(list)
    for a in words:
        beside[a] = [b for b in words if near(a, b)]
        best = min(beside[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= factor * words[a] else None
    for a, n in words.items():
        root = a
        while form[root] is not None:
            root = form[root]
        out.append((a, form[a], root, n, len(beside[a]), None if form[a] is None else words[form[a]]))
    return Counter(out)


def variant_docs(seed):
    """Few letters, so that words are crowded; chains of forms; repeats, ties, nulls, very long runs, other scripts."""
    r = random.Random(seed)
    made = ["".join(r.choice("abé") for _ in range(r.choice([7, 7, 8, 8, 9]))) for _ in range(400)]
    chain = ["kingdom " * 1200, "kingdoms " * 110, "kingdomss " * 9, "kingdomsss kingdomsss"]
    docs = [(k, " ".join(made[k : k + 40] * r.choice([1, 2]))) for k in range(0, 400, 10)]
    docs += [(1000 + k, t) for k, t in enumerate(chain)] + [(None, "Straße ÉTUDIANT étudiant etudiant"), (None, "étudiant ×étudiant÷Étudiant Étudiant"), (1, None), (2, ""), (3, "漢字students漢students studentsΩstudent"), (4, ("z" * 900 + " ") * 3 + "z" * 899 + " " + "z" * 899)]
    return docs + docs[:3]


@pytest.mark.parametrize("crowd", [2, 48])
def test_spelling_variants(torn, monkeypatch, crowd):
    monkeypatch.setattr(variants, "CROWD", crowd)
    monkeypatch.setattr(variants, "SHARD_OWNERS", 100)
    docs = variant_docs(crowd)
    frame = torn.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n long").repartition(3)
    got = Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(frame).collect())
    want = brute_variants(docs)
    assert got == want and any(f is not None for _, f, *_ in want) and ("kingdomsss", "kingdomss", "kingdom", 2) not in {w[:4] for w in want if w[1] is None}


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=2, max_size=9), st.text("abé", min_size=2, max_size=9))
def test_one_edit_in_exactly_one_leaf(a, b):
    """The open parts of the leaves share out the places, so a near pair is verified once, whatever the split."""

    def leaves(i, j):
        if j - i <= 1:
            return [(i, j)]
        return leaves(i, (i + j) // 2) + leaves((i + j) // 2, j)

    hits = sum(variants.one_edit(a, b, i, j) for i, j in leaves(0, len(a)))
    assert hits == near(a, b)


def test_counts_flush(monkeypatch):
    """Counts taken in many parts add up to the same."""
    docs, total = variant_docs(5), Counter()
    counts = variants.Counts(7, 31)
    for i, t in docs:
        if t is not None:
            counts.add(i, t)
        if len(counts.known) > 20:
            for w, n in zip(*counts.take(), strict=True):
                total[w] += n
    for w, n in zip(*counts.take(), strict=True):
        total[w] += n
    assert {w: n for w, n in total.items() if n >= 2} == brute_words(docs)
