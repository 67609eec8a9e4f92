"""Spelling variants: words at an edit distance of one, by Aho-Corasick automata over their halves.

Words are counted per task from Arrow batches and summed. If two words differ by one inserted, deleted or replaced code
point, one of the two halves of each stands unchanged in the other: the first one at its beginning, the second one at
its end, shifted by the difference of the lengths. Every word's two halves (owners) go to automaton shards, and every word goes,
to be scanned, to the shards where a half that it may hold would be: the halves of a length L lie at L // 2, and a near
word is of length L - 1, L or L + 1, so six places are to be looked up. A shard is chosen by a hash of the segment and its
place, and there are as many shards as the owners need (SHARD_OWNERS); within one, an Aho-Corasick automaton over its
segments runs over each word sent there; a hit counts if its offset and the lengths agree, and the pair is then verified.

A half that many words share (a common prefix, say) would bring all pairs of them together. Where a segment has more than
CROWD owners, the part that is left open is halved in turn, and its owners and scanned words are dealt by the segment
together with one half of that part; so it goes on until a group is small or one code point is left open, where its size
is bounded by the alphabet. A pair is reported by one group only: that whose open part holds the place where the words
first differ.

Each word's form is then the near word of largest n; roots follow forms by doubling the distance in each join. A form's n is at
least `factor` times as large, so there are few rounds.

Defined results: a null or empty text has no words; a null doc_id writes as nothing before the colon; rows that are
repeated count again; very long runs are words like others; ties go to the smallest word in code-point order; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, store, tidied
from .duckbytes import CRC_TABLE, byte_list, crc32

#: Owners of segments to a shard, and owners that a segment may have before its open part is halved.
SHARD_OWNERS, CROWD = 40_000, 48
#: Distinct words that a task holds before it hands its counts on.
HELD_WORDS = 300_000
#: Latin-1 bytes: A-Z lower-cased, letters (a-z and U+00C0 to U+00FF) kept, all others a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters, lower-cased, as Latin-1 bytes (a byte a code point); what lies beyond U+00FF separates."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


class _Known(dict):
    """Run -> number, given in the order in which runs come."""

    def __missing__(self, run: bytes) -> int:
        n = self[run] = len(self)
        return n


class Counts:
    """Counts of words. The CRC-32 of '<doc_id>:<run>' is put together from the CRC of the run, which is kept with it, and
    that of the prefix moved on by the run's length: moving by n bytes is crc32(zeros, c) ^ crc32(zeros, 0)."""

    def __init__(self, least: int, every: int):
        self.least, self.every, self.words = least, every, {}
        self.clear()

    def clear(self) -> None:
        self.known, self.n, self.crc, self.size = _Known(), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def add(self, doc_id: int | None, text: str) -> None:
        long = [r for r in runs(text) if len(r) >= self.least]
        if not long:
            return
        before = len(self.known)
        ids = np.fromiter(map(self.known.__getitem__, long), np.int64, len(long))
        if len(self.known) > before:
            new = list(self.known)[before:] if before == 0 else [r for r in dict.fromkeys(long) if self.known[r] >= before]
            if len(self.known) > len(self.n):
                grow = max(len(self.known), 2 * len(self.n))
                self.n, self.crc, self.size = (np.append(x, np.zeros(grow - len(x), x.dtype)) for x in (self.n, self.crc, self.size))
            self.crc[before : len(self.known)] = [zlib.crc32(r if r.isascii() else r.decode("latin-1").encode()) for r in new]
            self.size[before : len(self.known)] = [len(r) if r.isascii() else len(r.decode("latin-1").encode()) for r in new]
        prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        sizes = self.size[ids]
        lengths, which = np.unique(sizes, return_inverse=True)
        moved = np.array([zlib.crc32(bytes(n), prefix) ^ zlib.crc32(bytes(n)) for n in lengths.tolist()], np.uint32)
        h = self.crc[ids] ^ moved[which]
        hit = h % self.every == 0
        np.add.at(self.n, ids[~hit], 1)
        for i in np.flatnonzero(hit).tolist():
            at = int(h[i]) % len(long[i])
            word = long[i][:at] + long[i][at + 1 :]
            if len(word) >= self.least:
                self.words[word] = self.words.get(word, 0) + 1

    def take(self) -> tuple[list[str], list[int]]:
        """All counts so far, and none afterwards."""
        n = self.n.tolist()
        found = [(r, n[i]) for r, i in self.known.items() if n[i]] + list(self.words.items())
        self.words = {}
        self.clear()
        return [r.decode("latin-1") for r, _ in found], [x for _, x in found]


def word_counts(documents: DataFrame, least: int = 7, occurrences: int = 2, every: int = 31) -> DataFrame:
    """Stored table (word, n) of the words of at least `least` code points that occur at least `occurrences` times, where a
    run whose hash with its document is divisible by `every` has lost a code point."""
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(least, every)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.add(doc_id, text.as_py())
            if len(counts.known) + len(counts.words) > HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in counts.take()], schema=out)
        words, n = counts.take()
        for a in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 50_000]), pa.array(n[a : a + 50_000])], schema=out)

    parts = documents.filter("text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(run), "word string, n long")
    return store(parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences), "words")


# -- segments ----------------------------------------------------------------------------------------------------------


def _open_half(i: Column, j: Column) -> Column:
    return F.floor((i + j) / 2).cast("int")


def _with_key(rows: DataFrame) -> DataFrame:
    """The group of a row: length of the owner, open part, and what stands before and after it in the word. d is the word's
    length less the owner's."""
    size = F.char_length("word")
    after = F.col("j") + F.col("d")
    return rows.withColumn("key", F.concat_ws(" ", "size", "i", "j", F.expr("left(word, i)"), F.substring("word", after + 1, F.greatest(size - after, F.lit(0)))))


def segments(words: DataFrame) -> DataFrame:
    """Owner rows (d null counts as 0) and rows to be scanned: word, owner (boolean), size (the owner's length), d, i, j (open
    part of the owner), key; crowded groups are split (see the module). Words need two code points at least."""
    size = F.char_length("word").cast("int")
    roles = F.array(*(F.struct(F.lit(owner).alias("owner"), F.lit(d).alias("d")) for owner, d in ((True, 0), (False, -1), (False, 0), (False, 1))))
    rows = words.select("word", F.explode(roles).alias("r")).select("word", "r.owner", "r.d", (size - F.col("r.d")).alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    parts = F.array(F.struct(half.alias("i"), F.col("size").alias("j")), F.struct(F.lit(0).alias("i"), half.alias("j")))
    rows = rows.select("word", "owner", "d", "size", F.explode(parts).alias("p")).select("word", "owner", "d", "size", "p.i", "p.j")
    settled, spare = None, []
    while True:
        found = store(_with_key(rows).withColumn("group", F.xxhash64("key")).drop("key"), "segments")
        spare.append(found)
        crowds = store(found.filter("owner").groupBy("group").agg(F.count("*").alias("c"), F.max(F.col("j") - F.col("i")).alias("open")).filter(F.col("c") > 0), "groups")
        spare.append(crowds)
        joined = found.join(crowds, "group")  # rows without an owner to meet end here
        crowded = (F.col("c") > CROWD) & (F.col("open") > 1)
        kept = joined.filter(~crowded).select("word", "owner", "d", "size", "i", "j", "group")
        settled = kept if settled is None else settled.unionByName(kept)
        if not crowds.filter(crowded).limit(1).count():
            return settled, spare
        middle = _open_half(F.col("i"), F.col("j"))
        halves = F.array(F.struct(F.col("i"), middle.alias("j")), F.struct(middle.alias("i"), F.col("j")))
        rows = joined.filter(crowded).select("word", "owner", "d", "size", F.explode(halves).alias("p")).select("word", "owner", "d", "size", "p.i", "p.j")


def first_difference(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def one_edit(owner: str, word: str, i: int, j: int) -> bool:
    """Whether the words differ by exactly one code point, inserted, deleted or replaced, at a place of the owner's open part
    [i, j) (or at its end, if that is the owner's end). The place is the first one at which they differ."""
    at = i + first_difference(owner[i:], word[i:])
    if not (at < j or at == j == len(owner)) or owner[:i] != word[:i]:
        return False
    d = len(word) - len(owner)
    return owner[at + (d <= 0) :] == word[at + (d >= 0) :] and owner != word


def near_pairs(rows: DataFrame, shards: int) -> DataFrame:
    """(word, near) of each scanned word and each owner near to it, from the automata of `shards` shards."""
    out = pa.schema([("word", pa.string()), ("near", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        shard, owners, automaton = None, {}, None
        for batch in batches:
            found = []
            for s, owner, group, word, d, size, i, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    shard, owners, automaton = s, {}, None
                if owner:  # owners come first in their shard
                    ahead = i >= size - j  # the longer of the two unchanged parts is the segment
                    owners.setdefault(word[:i] if ahead else word[j:], {}).setdefault((group, size, i, j, ahead), []).append(word)
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for segment, places in owners.items():
                        automaton.add_word(segment, (len(segment), places))
                    automaton.make_automaton()
                for end, (n, places) in automaton.iter(word):
                    for ahead in (True, False):
                        # offsets that agree: at the beginning, or shifted by the difference of the lengths up to the end
                        if (end + 1 == n == i) if ahead else (end + 1 == len(word) and n == size - j and end + 1 - n == j + d):
                            found.extend((word, u) for u in places.get((group, size, i, j, ahead), ()) if one_edit(u, word, i, j))
                if len(found) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)], schema=out)
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)], schema=out)

    dealt = rows.select(F.pmod("group", F.lit(shards)).cast("int").alias("shard"), "owner", "group", "word", "d", "size", "i", "j")
    return dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("owner")).mapInArrow(tidied(run), "word string, near string")


def roots(forms: DataFrame) -> DataFrame:
    """Stored table (word, root) of the words that have a form; forms: word, form, without cycles."""
    now = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = store(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        if not joined.filter("moved").limit(1).count():
            return joined
        now = joined.drop("moved")
        now.stored_at = joined.stored_at


def spelling_variants(documents: DataFrame, least: int = 7, occurrences: int = 2, every: int = 31, factor: int = 10) -> DataFrame:
    """op13: word, form, root, n, n_near, form_n of every word of the documents."""
    words = word_counts(documents, least, occurrences, every)
    owners = 2 * words.count()
    rows, spare = segments(words)
    pairs = store(near_pairs(rows, max(1, -(-owners // SHARD_OWNERS))), "near")
    discard(*spare)
    beside = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = beside.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("b"))
    of = words.join(best, "word", "left").withColumn("near_n", -F.col("b.less"))
    takes = F.col("near_n") >= factor * F.col("n")
    of = store(of.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("b.form")).alias("form"), F.when(takes, F.col("near_n")).alias("form_n")), "forms")
    last = roots(of.filter("form IS NOT NULL")).select("word", "root")
    return of.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_RUN = "[A-Za-zÀ-ÿ]+"

ORACLE = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUN}')) AS r FROM documents) GROUP BY ALL HAVING length(run) >= 7),
hashed AS (SELECT run, n, {crc32(byte_list("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM runs, {CRC_TABLE}),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
less AS (SELECT word, n, p, left(word, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -near_n, 'form': near}}) AS b FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * w.n THEN b.form END AS form, CASE WHEN -b.less >= 10 * w.n THEN -b.less END AS form_n
  FROM words w LEFT JOIN best ON w.word = best.word),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.root WHERE f.form IS NOT NULL)
SELECT f.word, form, w.root, n, n_near, form_n FROM forms f
JOIN (SELECT walk.word, walk.root FROM walk JOIN forms f2 ON f2.word = walk.root WHERE f2.form IS NULL) w(word, root) ON w.word = f.word
"""
