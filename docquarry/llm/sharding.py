"""Range sharding by sampled splitters, in DataFrame operations only.

Rows are ordered by (md5 of the text, doc_id), which keeps equal texts together. A size-weighted sample of the keys
gives quantile boundaries; rows are dealt to the ranges between them, ranges that came out too full are sampled
and cut again, and each range's bytes are summed. A row's place in the whole order is its range's base plus its
place in the range, so shards follow from exact byte positions and differ by one row's size at most; the sample
only decides how evenly the work is spread. A group of equal texts larger than a range is cut by doc_id.

Defined results: a null text has size 1 and the CRC of the empty text; a null doc_id sorts first; repeated rows are
told apart by an internal row number; an empty table gives no rows. Other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import duckbytes
from .common import store

SHARDS = 8
#: Bytes a range aims at, keys drawn for each range, and the most ranges one round of splitters makes.
RANGE_BYTES, DRAWN, MAX_SPLITTERS = 4 << 20, 24, 4095


def _below(splitters: list[tuple], at: Column) -> Column:
    """How many splitters are at or below the key: first among every 64th, then in the stretch between."""
    if not splitters:
        return F.lit(0)
    step = 64
    value = lambda s: F.struct(F.lit(s[0]).alias("key"), F.lit(s[1]).cast("long").alias("doc_id"), F.lit(s[2]).cast("long").alias("row"))
    coarse = F.array(*(value(s) for s in splitters[step - 1 :: step])) if len(splitters) >= step else None
    groups = F.array(*(F.array(*(value(s) for s in splitters[i : i + step])) for i in range(0, len(splitters), step)))
    block = F.size(F.filter(coarse, lambda s: s <= at)) if coarse is not None else F.lit(0)
    within = F.coalesce(F.size(F.filter(F.get(groups, block), lambda s: s <= at)), F.lit(0))
    return F.least(block * step + F.greatest(within, F.lit(0)), F.lit(len(splitters)))


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[tuple]:
    """Quantile boundaries of a size-weighted sample of about DRAWN keys a range (bounded by MAX_SPLITTERS)."""
    ranges = min(ranges, MAX_SPLITTERS + 1)
    if ranges < 2:
        return []
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(DRAWN * ranges / max(total, 1)))
    drawn = F.pmod(F.xxhash64(F.lit("splitter"), "key", "doc_id", "row"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < chance
    # rows larger than the step of the sample stand for several draws
    weight = F.greatest(F.lit(1.0), F.col("size") * F.lit(DRAWN * ranges / max(total, 1)))
    found = sorted((r[0], -1 if r[1] is None else r[1], r[2], r[3]) for r in rows.filter(drawn).select("key", "doc_id", "row", weight).collect())
    step, seen, out = sum(r[3] for r in found) / ranges, 0.0, []
    for r in found:
        if seen >= step * (len(out) + 1) and len(out) < ranges - 1:
            out.append((r[0], r[1], r[2]))
        seen += r[3]
    return sorted(set(out))


def shard(documents: DataFrame, shards: int = SHARDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, key, size, text_crc32, shard, slot (gapless from 0 in a shard), range."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.md5(text.cast("binary")).alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = store(keyed, "keys")  # narrow: the texts are read once
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return rows.select("doc_id", "key", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("range"))
    at = F.struct("key", F.coalesce(F.col("doc_id"), F.lit(-1)).alias("doc_id"), "row")
    # the sample's step shrinks with the table, as ranges of about range_bytes are wanted, but 64 at least
    ranges = max(64, -(-total // range_bytes))
    dealt = rows.withColumn("range", _below(_splitters(rows, total, ranges), at).cast("long"))
    target = -(-total // min(ranges, MAX_SPLITTERS + 1))
    for _ in range(3):  # subdivide overfull ranges
        full = [r[0] for r in dealt.groupBy("range").agg(F.sum("size").alias("b")).filter(F.col("b") > 2 * max(target, 2 * range_bytes)).limit(MAX_SPLITTERS).collect()]
        if not full:
            break
        inside = dealt.filter(F.col("range").isin(full))
        size = inside.agg(F.sum("size")).first()[0]
        more = _splitters(inside, size, -(-size // range_bytes))
        dealt = dealt.withColumn("range", F.col("range") * (MAX_SPLITTERS + 2) + F.when(F.col("range").isin(full), _below(more, at)).otherwise(0))
    order = ("key", F.asc_nulls_first("doc_id"), "row")
    inside = Window.partitionBy("range").orderBy(*order)
    placed = store(dealt.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0))), "placed")
    ranges_ = placed.groupBy("range").agg(F.sum("size").alias("bytes"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges_.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
    # the shard by the middle of the row's bytes, in doubles: positions times shards may pass 2^63
    middle = F.col("base") + F.col("before") + (F.col("size") - 1) / 2
    of = F.least(F.floor(middle / F.lit(total / shards)), F.lit(shards - 1)).cast("int")
    sharded = placed.join(base, "range").withColumn("shard", of)
    counts = sharded.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = sharded.withColumn("slot", F.row_number().over(Window.partitionBy("range", "shard").orderBy(*order)) - 1)
    return numbered.join(slots, ["range", "shard"]).select("doc_id", "key", "size", "text_crc32", "shard", (F.col("slot") + F.col("first")).cast("long").alias("slot"), "range")


def shard_digest(documents: DataFrame) -> DataFrame:
    """op6: the law is `bytes` (sizes near equal)."""
    return shard(documents).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = f"""
WITH t AS (SELECT doc_id, md5(coalesce(text, '')) AS key, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT *, octet_length(b) + 1 AS size FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY key, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM s),
d AS (SELECT *, least(floor((before + (size - 1) / 2) / (total / {SHARDS})), {SHARDS - 1})::INTEGER AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, {duckbytes.crc32(duckbytes.byte_list("b"))} AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d, {duckbytes.CRC_TABLE}
"""
