"""Point-in-time feature table: what was known of a client at the moment each of its sales is asked about.

An event counts in a window of d days at a moment t from its start (the latest of its own time, its arrival plus the
delay and, for a line, its shipping) until its own time plus d days. So a count at t is the number of starts up to t
less the number of expiries up to t, and sums go the same way. Starts, expiries and questions become rows ordered by
(client, time); Spark cuts that order into ranges of equal size, so a client of any weight falls into as many chunks as
it needs. A task walks through its range in Arrow batches: starts and expiries are sorted arrays with prefix sums, a
question finds its place in both by searchsorted and subtracts, and totals are carried from batch to batch. Each range
also leaves the totals of its first and its last client; their sums over earlier ranges of the same client are the base
totals that are added to the answers of the client with which a range begins. The last click is a running maximum of
(ts, click_id) over the starts, carried alike: if the latest one has expired, all have.

Different items: the intervals of a client's item are unioned first, by the same walk over (client, item, start) with
the greatest end so far as what is carried; an interval that begins at or after it opens a new stretch. The stretches
don't overlap, so they count like other events.

Nothing is gathered by client, item or sale; what goes to a single task is an Arrow batch, and of each range two edge
rows, which are summed by client.

Defined results: a sale without client_id or sold_at is neither asked about nor counted, one without sale_id has no t and
isn't asked about, but counts; null arrival, ts or shipping never counts; clicks equal in all their columns count once, sales
and lines as often as they stand; amounts that are null, NaN or infinite count as 0 cents; a null click_id comes before
all others; ties in time are all in; a missing item counts as a line but not as an item; empty tables give no rows or
counts of 0; other columns are ignored (but keep clicks apart).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, tidied
from .duckbytes import CRC_TABLE, byte_list, crc32

DAY = 86_400_000_000
NONE = np.iinfo(np.int64).min
#: Kinds of rows: code = family * FAMILY + END (an expiry) + OPEN << window (opens an item's stretch) + 1 << window.
FAMILY, END, OPEN = 1 << 20, 1 << 19, 1 << 8
CLICK, PURCHASE, SALE, LINE, ITEM, LABEL, QUESTION = range(7)
#: Per window: name, families, whether cents are summed.
MEASURES = (
    ("n_clicks", (CLICK, PURCHASE), False),
    ("n_purchases", (PURCHASE,), False),
    ("click_cents", (CLICK, PURCHASE), True),
    ("n_sales", (SALE,), False),
    ("sale_cents", (SALE,), True),
    ("n_lines", (LINE,), False),
    ("line_cents", (LINE,), True),
    ("n_items", (ITEM,), False),
)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _time(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz")


def _days(n: float) -> Column:
    return F.expr(f"INTERVAL '{round(n * 86400)}' SECOND")


def _cents(name: str) -> Column:
    x = F.col(name).cast("double")
    usual = F.abs(x) < 9e16  # neither NaN nor more cents than a long holds
    return F.when(usual, F.floor(100 * x + 0.5)).otherwise(0).cast("long")


def ask_after_crc(seconds: int = 259_200) -> Column:
    """The contract's moment: sold_at plus (crc32 of the decimal sale_id modulo 259200) seconds."""
    return _time("sold_at") + (F.crc32(F.col("sale_id").cast("string").cast("binary")) % seconds) * F.expr("INTERVAL '1' SECOND")


# -- the union of an item's intervals ----------------------------------------------------------------------------------


def _numbers(column: pa.Array) -> np.ndarray:
    """An Arrow column of longs, times or booleans as numbers; null is NONE (False)."""
    if pa.types.is_boolean(column.type):
        return column.fill_null(False).to_numpy(zero_copy_only=False)
    return column.cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False)


def _array(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Numbers as an Arrow column; NONE is null."""
    if pa.types.is_boolean(kind):
        return pa.array(values, kind)
    return pa.array(values, pa.int64(), mask=values == NONE).cast(kind)


def running_max(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The greatest value so far of the same run; runs are ascending whole numbers."""
    levels, rank = np.unique(values, return_inverse=True)
    base = runs * len(levels)
    return levels[np.maximum.accumulate(base + rank) - base]


class ItemRuns:
    """Walks through one range of intervals ordered by (client, item, start)."""

    keys = ("client", "has_item", "item")

    def __init__(self, spans: Sequence[int]):
        self.spans, self.held, self.key, self.first, self.edges = spans, None, None, None, []
        self.best = [NONE] * len(spans)

    def walk(self, rows: dict[str, np.ndarray] | None) -> dict[str, np.ndarray] | None:
        """The rows but the last, which waits for the next call, with for each window the greatest end before the row in
        its run (prev) and, on a run's last row, the run's greatest end (close). None ends the range."""
        over = rows is None
        rows = self.held if over else rows if self.held is None else {c: np.concatenate([self.held[c], rows[c]]) for c in rows}
        if rows is None:
            return None
        n = len(rows["client"]) - (not over)
        self.held = None if over else {c: x[n:] for c, x in rows.items()}
        if not n:
            return None
        if self.first is None:
            self.first = tuple(rows[c][0] for c in self.keys)
        differs = np.zeros(len(rows["client"]), bool)
        for c in self.keys:
            differs[1:] |= rows[c][1:] != rows[c][:-1]
        differs[0] = self.key != tuple(rows[c][0] for c in self.keys)
        last = np.append(differs[1:], over)[:n]
        rows = {c: x[:n] for c, x in rows.items()}
        new, in_first = differs[:n], np.logical_and.reduce([rows[c] == k for c, k in zip(self.keys, self.first, strict=True)])
        runs = np.append(0, np.cumsum(new))
        out = rows | {"first": in_first}
        ends = []
        for k, span in enumerate(self.spans):
            end = rows["sold"] + span
            known = running_max(np.append(self.best[k], np.where(rows["has_item"] & (rows["start"] < end), end, NONE)), runs)
            out[f"prev{k}"] = np.where(new, NONE, known[:-1])
            out[f"close{k}"] = np.where(last & ~in_first, known[1:], NONE)
            ends.append(known[1:])
        self.key, self.best = tuple(rows[c][-1] for c in self.keys), [x[-1] for x in ends]
        if over:  # the last run may go on in the next range
            for k in range(len(self.spans)):
                out[f"close{k}"][-1] = NONE
        for i in np.flatnonzero(last & in_first).tolist() + [n - 1] * (over and self.key != self.first):
            self.edges.append((*(rows[c][i] for c in self.keys), bool(in_first[i]), [x[i] for x in ends]))
        return out


def item_stretches(lines: DataFrame, days: Sequence[float]) -> DataFrame:
    """Stored table of the lines (client, item, start, sold, cents, id) in ranges of (client, item, start), with what
    ItemRuns finds and, as rows with edge, what a range knows of its first and its last run."""
    times = [f"{name}{k}" for name in ("prev", "close") for k in range(len(days))]
    given = ["client", "has_item", "item", "start", "sold", "cents", "id"]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in lines.select(given).schema), T.StructField("first", T.BooleanType()), *(T.StructField(c, T.TimestampNTZType()) for c in times), T.StructField("edge", T.BooleanType()), T.StructField("chunk", T.LongType())])
    out, spans = _arrow(schema), [round(d * DAY) for d in days]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, runs = TaskContext.get().partitionId(), ItemRuns(spans)

        def made(rows: dict[str, np.ndarray], edge: bool) -> pa.RecordBatch:
            n = len(rows["client"])
            rows = rows | {"edge": np.full(n, edge), "chunk": np.full(n, chunk)}
            return pa.RecordBatch.from_arrays([_array(rows[f.name], f.type) if f.name in rows else pa.nulls(n, f.type) for f in out], schema=out)

        for batch in chain(batches, [None]):
            if batch is None or batch.num_rows:
                rows = runs.walk(None if batch is None else {c: _numbers(batch.column(c)) for c in given})
                if rows is not None:
                    yield made(rows, False)
        if runs.edges:
            client, has, item, first, ends = zip(*runs.edges, strict=True)
            yield made({"client": np.array(client), "has_item": np.array(has), "item": np.array(item), "first": np.array(first)} | {f"close{k}": np.array(e) for k, e in enumerate(zip(*ends, strict=True))}, True)

    order = ["client", "has_item", "item", "start", "id"]
    return store(lines.select(given).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(run), schema), "stretches")


# -- starts, expiries and questions ------------------------------------------------------------------------------------

POINT = ["client", "time", "code", "id", "n", "cents", "ts"]


def _points(df: DataFrame, *points: tuple[Column, Column, Column]) -> DataFrame:
    """Rows of df's client, id, n, cents and ts for each (condition, time, code) that holds."""
    made = F.array(*(F.when(when, F.struct(time.alias("time"), code.cast("int").alias("code"))) for when, time, code in points))
    return df.select("client", "id", "n", "cents", "ts", F.explode(made).alias("p")).filter("p IS NOT NULL").select("client", "p.time", "p.code", "id", "n", "cents", "ts")


def _interval(df: DataFrame, family: Column, at: str, days: Sequence[float]) -> DataFrame:
    """Starts and expiries of df's events, which count from `start` to `at` plus the days."""
    live = [F.col("start") < F.col(at) + _days(d) for d in days]
    bits = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(live)), F.lit(0))
    return _points(df, (bits > 0, F.col("start"), family * FAMILY + bits), *((x, F.col(at) + _days(days[k]), family * FAMILY + END + (1 << k)) for k, x in enumerate(live)))


def _line_points(lines: DataFrame, days: Sequence[float]) -> DataFrame:
    """Starts of lines, with the items' stretches that they open, and expiries of lines and stretches, summed by moment."""
    windows = range(len(days))
    found = item_stretches(lines, days)
    edges = found.filter("edge AND has_item")
    earlier = Window.partitionBy("client", "item").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select("chunk", "first", *(F.max(f"close{k}").over(earlier).alias(f"carried{k}") for k in windows)).filter("first")
    rows = found.filter("NOT edge").join(carried, ["chunk", "first"], "left")
    rows = rows.withColumns({f"prev{k}": F.greatest(f"prev{k}", f"carried{k}") for k in windows} | {f"live{k}": F.col("start") < F.col("sold") + _days(d) for k, d in enumerate(days)})
    rows = rows.withColumns({f"opens{k}": F.col("has_item") & F.col(f"live{k}") & (F.col(f"prev{k}").isNull() | (F.col("start") >= F.col(f"prev{k}"))) for k in windows})
    rows = rows.withColumns({"n": F.lit(1).cast("long"), "ts": F.lit(None).cast("timestamp_ntz")})
    bits = sum((F.when(F.col(f"live{k}"), 1 << k).otherwise(0) + F.when(F.col(f"opens{k}"), OPEN << k).otherwise(0) for k in windows), F.lit(0))
    starts = rows.select("client", F.col("start").alias("time"), (LINE * FAMILY + bits).cast("int").alias("code"), "id", "n", "cents", "ts")
    line_end, item_end = ([F.lit(family * FAMILY + END + (1 << k)) for k in windows] for family in (LINE, ITEM))
    closes = [(F.col(f"close{k}").isNotNull(), F.col(f"close{k}"), item_end[k]) for k in windows]
    ends = _points(
        rows,
        *((F.col(f"live{k}"), F.col("sold") + _days(d), line_end[k]) for k, d in enumerate(days)),
        *((F.col(f"opens{k}") & F.col(f"prev{k}").isNotNull(), F.col(f"prev{k}"), item_end[k]) for k in windows),
        *closes,
    )
    whole = edges.groupBy("client", "item").agg(*(F.max(f"close{k}").alias(f"close{k}") for k in windows))  # runs that touch a range's edge
    whole = whole.withColumns({"id": F.lit(None).cast("long"), "n": F.lit(1).cast("long"), "cents": F.lit(0).cast("long"), "ts": F.lit(None).cast("timestamp_ntz")})
    ends = ends.unionByName(_points(whole, *closes)).groupBy("client", "time", "code").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))
    return starts.unionByName(ends.withColumns({"id": F.lit(None).cast("long"), "ts": F.lit(None).cast("timestamp_ntz")}).select(POINT))


def points(sales: DataFrame, lines: DataFrame, clicks: DataFrame, days: Sequence[float], delay_minutes: int, horizon_days: float, ask: Column) -> DataFrame:
    """All starts, expiries and questions: client, time, code, id, n, cents, ts."""
    delay, none = F.expr(f"INTERVAL '{delay_minutes}' MINUTE"), F.lit(None).cast("timestamp_ntz").alias("ts")
    one, is_purchase = F.lit(1).cast("long").alias("n"), F.col("kind").eqNullSafe("purchase")
    sold = sales.filter("client_id IS NOT NULL AND sold_at IS NOT NULL").select(
        F.col("client_id").cast("long").alias("client"), F.col("sale_id").cast("long").alias("id"), one, _cents("total").alias("cents"), none, _time("sold_at").alias("sold"), (_time("arrived_at") + delay).alias("known"), ask.alias("asked")
    )
    known = sold.filter("known IS NOT NULL").withColumn("start", F.greatest("sold", "known"))
    ahead = _points(sold, (F.lit(True), F.col("sold") - _days(horizon_days), F.lit(LABEL * FAMILY + 1)), (F.lit(True), F.col("sold"), F.lit(LABEL * FAMILY + END + 1)), (F.col("asked").isNotNull(), F.col("asked"), F.lit(QUESTION * FAMILY)))
    line = lines.withColumn("id", F.monotonically_increasing_id()).filter("sale_id IS NOT NULL AND shipped_at IS NOT NULL")
    line = line.select(F.col("sale_id").cast("long").alias("sale"), F.col("item_id").cast("long").alias("item"), _cents("amount").alias("cents"), _time("shipped_at").alias("shipped"), "id")
    line = line.join(known.select(F.col("id").alias("sale"), "client", "sold", "start"), "sale")
    line = line.select("client", F.col("item").isNotNull().alias("has_item"), F.coalesce("item", F.lit(0)).alias("item"), F.greatest("start", "shipped").alias("start"), "sold", "cents", "id")
    line = line.filter(" OR ".join(f"start < sold + INTERVAL '{round(d * 86400)}' SECOND" for d in days))
    seen = clicks.distinct().filter("client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL")
    seen = seen.select(F.col("client_id").cast("long").alias("client"), F.col("click_id").cast("long").alias("id"), one, _cents("value").alias("cents"), _time("ts").alias("ts"), F.greatest(_time("ts"), _time("arrived_at") + delay).alias("start"), F.when(is_purchase, PURCHASE).otherwise(CLICK).alias("family"))
    parts = [_interval(seen, F.col("family"), "ts", days), _interval(known, F.lit(SALE), "sold", days), ahead, _line_points(line, days)]
    out = parts[0].select(POINT)
    for part in parts[1:]:
        out = out.unionByName(part.select(POINT))
    return out


class ClientRuns:
    """Walks through one range of points ordered by (client, time, code) and answers its questions."""

    def __init__(self, windows: int):
        self.windows, self.client, self.first, self.edges = windows, None, None, []
        self.names = [f"{name}{k}" for k in range(windows) for name, _, _ in MEASURES] + ["ahead"]
        self.totals, self.last = np.zeros(len(self.names), np.int64), (NONE, NONE)

    def walk(self, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Answers to a batch's questions."""
        client, time, code = rows["client"], rows["time"], rows["code"]
        if self.first is None:
            self.first = self.client = client[0]
        if client[0] != self.client:  # the client before ended with its batch
            if self.client == self.first:
                self.leave(self.totals, self.last)
            self.client, self.totals, self.last = client[0], np.zeros_like(self.totals), (NONE, NONE)
        change = client[1:] != client[:-1]
        moment = np.append(0, np.cumsum((time[1:] != time[:-1]) | change))  # dense names of (client, time), ascending
        run = np.append(0, np.cumsum(change))  # 0: the client that goes on from the batch before
        heads = np.append(0, np.flatnonzero(change) + 1)
        family, end = code // FAMILY, code & END > 0
        asked = np.flatnonzero(family == QUESTION)
        to, since = moment[asked], moment[heads][run[asked]]
        goes_on, tail = run[asked] == 0, moment[heads[-1]]
        second = moment[heads[1]] if len(heads) > 1 else moment[-1] + 1

        def gathered(mask: np.ndarray, values: np.ndarray) -> tuple:
            """Sums up to the questions, over the last client and over the first one."""
            at, total = moment[mask], np.append(0, np.cumsum(values[mask]))
            low, high = np.searchsorted(at, since), np.searchsorted(at, to, "right")
            return total[high] - total[low], total[-1] - total[np.searchsorted(at, tail)], total[np.searchsorted(at, second)]

        sums = []
        for k in range(self.windows):
            here = code & (1 << k) > 0
            for _, families, cents in MEASURES:
                mask, values = np.isin(family, families) & here, rows["cents"] if cents else rows["n"]
                starts = (family == LINE) & ~end & (code & (OPEN << k) > 0) if families == (ITEM,) else mask & ~end
                sums.append([a - b for a, b in zip(gathered(starts, values), gathered(mask & end, values), strict=True)])
        sums.append([a - b for a, b in zip(gathered((family == LABEL) & ~end, rows["n"]), gathered((family == LABEL) & end, rows["n"]), strict=True)])
        at_questions, of_tail, of_head = zip(*sums, strict=True)

        # the latest click that has started, in the order of (ts, click_id)
        clicks = np.flatnonzero((family <= PURCHASE) & ~end)
        order = np.lexsort((rows["id"][clicks], rows["ts"][clicks]))
        rank = np.empty(len(clicks), np.int64)
        rank[order] = np.arange(len(clicks))
        latest = clicks[order[running_max(rank, run[clicks])]] if len(clicks) else clicks
        at = moment[clicks]

        def click(low: np.ndarray, high: np.ndarray, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ts, ids = np.full(len(high), NONE), np.full(len(high), NONE)
            there = high > low
            ts[there], ids[there] = rows["ts"][latest[high[there] - 1]], rows["id"][latest[high[there] - 1]]
            later = carried & ((self.last[0] > ts) | ((self.last[0] == ts) & (self.last[1] > ids)))
            return np.where(later, self.last[0], ts), np.where(later, self.last[1], ids)

        def one_click(low: int, high: int, carried: bool) -> tuple[int, int]:
            return tuple(int(x[0]) for x in click(np.array([low]), np.array([high]), np.array([carried])))

        ts, ids = click(np.searchsorted(at, since), np.searchsorted(at, to, "right"), goes_on)
        out = {"sale": rows["id"][asked], "client": client[asked], "t": time[asked], "first": client[asked] == self.first, "last_ts": ts, "last_id": ids}
        out |= {name: x + np.where(goes_on, base, 0) for name, x, base in zip(self.names, at_questions, self.totals, strict=True)}
        if len(heads) > 1:
            if self.client == self.first:
                self.leave(self.totals + np.array(of_head), one_click(0, int(np.searchsorted(clicks, heads[1])), True))
            self.totals, self.last = np.array(of_tail), one_click(int(np.searchsorted(clicks, heads[-1])), len(clicks), False)
        else:
            self.totals, self.last = self.totals + np.array(of_tail), one_click(0, len(clicks), True)
        self.client = client[-1]
        return out

    def leave(self, totals: np.ndarray, last: tuple[int, int]) -> None:
        self.edges.append((self.client, totals, last))

    def close(self) -> None:
        if self.first is not None:
            self.leave(self.totals, self.last)


def answers(rows: DataFrame, windows: int) -> DataFrame:
    """Stored table: an answer for each question, from its own range alone, and the ranges' edge rows."""
    names = ClientRuns(windows).names
    long = lambda *cs: [T.StructField(c, T.LongType()) for c in cs]
    schema = T.StructType([*long("chunk"), T.StructField("edge", T.BooleanType()), T.StructField("first", T.BooleanType()), *long("client", "sale", "t", "last_ts", "last_id", *names)])
    out = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, runs = TaskContext.get().partitionId(), ClientRuns(windows)

        def made(found: dict[str, np.ndarray], edge: bool) -> pa.RecordBatch:
            n = len(found["client"])
            found = found | {"chunk": np.full(n, chunk), "edge": np.full(n, edge)}
            return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(n, f.type) for f in out], schema=out)

        for batch in batches:
            if batch.num_rows:
                found = runs.walk({c: _numbers(batch.column(c)) for c in POINT})
                if len(found["client"]):
                    yield made(found, False)
        runs.close()
        if runs.edges:
            client, totals, last = zip(*runs.edges, strict=True)
            edge = {"client": np.array(client), "first": np.array(client) == runs.first, "last_ts": np.array([x for x, _ in last]), "last_id": np.array([x for _, x in last])}
            yield made(edge | {name: np.array([x[i] for x in totals]) for i, name in enumerate(names)}, True)

    order = ["client", "time", "code", "id"]
    return store(rows.select(POINT).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(run), schema), "answers")


def feature_table(sales: DataFrame, lines: DataFrame, clicks: DataFrame, days: Sequence[float] = (2, 14), delay_minutes: int = 240, horizon_days: float = 7, ask: Column | None = None) -> DataFrame:
    """A row for each sale and window: sale_id, d, t_us, label, counts and sums (see the module)."""
    ask = ask_after_crc() if ask is None else ask
    found = answers(points(sales, lines, clicks, days, delay_minutes, horizon_days, ask), len(days))
    names = ClientRuns(len(days)).names
    earlier = Window.partitionBy("client").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = found.filter("edge").select("chunk", "first", *(F.sum(c).over(earlier).alias(f"base_{c}") for c in names), F.max(F.struct("last_ts", "last_id")).over(earlier).alias("base_last")).filter("first")
    rows = found.filter("NOT edge").join(before, ["chunk", "first"], "left")
    last = F.greatest(F.struct("last_ts", "last_id"), F.col("base_last"))
    rows = rows.select("sale", "t", last.alias("last"), *((F.col(c) + F.coalesce(f"base_{c}", F.lit(0))).alias(c) for c in names))
    windows = []
    for k, d in enumerate(days):
        live = (F.col("last.last_ts") > F.col("t") - round(d * DAY)) & (F.col("last.last_id") != int(NONE))
        counts = {name: F.col(f"{name}{k}") for name, _, _ in MEASURES}
        windows.append(F.struct(F.lit(d).cast("int" if float(d).is_integer() else "double").alias("d"), *(c.alias(name) for name, c in counts.items()), F.when(live, F.col("last.last_id")).alias("last_click_id")))
    rows = rows.select(F.col("sale").alias("sale_id"), F.col("t").alias("t_us"), (F.col("ahead") > 0).alias("label"), F.explode(F.array(*windows)).alias("w"))
    return rows.select("sale_id", "w.d", "t_us", "label", *(f"w.{c}" for c in ("n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")))


_CENTS = "coalesce(CAST(floor(100 * {} + 0.5) AS BIGINT), 0)"

ORACLE = f"""
WITH q AS (
  SELECT row_number() OVER () AS r, sale_id, client_id, sold_at + to_seconds({crc32(byte_list("CAST(CAST(sale_id AS VARCHAR) AS BLOB)"))} % 259200) AS t
  FROM sales, {CRC_TABLE} WHERE client_id IS NOT NULL AND sold_at IS NOT NULL AND sale_id IS NOT NULL),
w AS (SELECT q.*, d, t - to_days(d) AS since FROM q, (VALUES (2), (14)) v(d)),
known AS (SELECT sale_id, client_id, sold_at, arrived_at + INTERVAL 240 MINUTE AS known_at, {_CENTS.format("total")} AS cents FROM sales),
seen AS (SELECT client_id, ts, click_id, kind, arrived_at + INTERVAL 240 MINUTE AS known_at, {_CENTS.format("value")} AS cents FROM (SELECT DISTINCT * FROM clicks)),
c AS (
  SELECT r, d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(cents) AS click_cents, max({{'ts': ts, 'id': click_id}}).id AS last_click_id
  FROM w JOIN seen s ON s.client_id = w.client_id AND ts <= t AND ts > since AND known_at <= t GROUP BY r, d),
s AS (SELECT r, d, count(*) AS n_sales, sum(cents) AS sale_cents FROM w JOIN known k ON k.client_id = w.client_id AND sold_at <= t AND sold_at > since AND known_at <= t GROUP BY r, d),
l AS (
  SELECT r, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum({_CENTS.format("amount")}) AS line_cents
  FROM w JOIN known k ON k.client_id = w.client_id AND sold_at <= t AND sold_at > since AND known_at <= t
  JOIN sale_lines x ON x.sale_id = k.sale_id AND shipped_at <= t GROUP BY r, d),
a AS (SELECT DISTINCT r FROM q JOIN known k ON k.client_id = q.client_id AND sold_at > t AND sold_at <= t + INTERVAL 7 DAY)
SELECT sale_id, CAST(d AS INTEGER) AS d, epoch_us(t) AS t_us, a.r IS NOT NULL AS label,
  coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, last_click_id,
  coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM w LEFT JOIN c USING (r, d) LEFT JOIN s USING (r, d) LEFT JOIN l USING (r, d) LEFT JOIN a USING (r)
"""
