"""Cohort retention kept up to date by signed deltas.

A client's start is its earliest known purchase; the start's 3-day run is its cohort and every
3 days from the start on are a period.  A state is materialised as three tables: the starts,
the parts (one row for each client and period with a known row) and the cells (parts summed
by segment, cohort and period).  ``advance`` takes a state to the next one from the rows that
came late:

* clients whose start a late purchase makes or moves are shifted: their parts are retracted
  from the cells and computed anew, from all their rows, under the new cohort;
* the late rows of the others add increments: cents always, the client only in a period in
  which it had no row.

So of the rows of the old state only those of shifted clients are read again.

A client may hold a third of all rows: such clients are dealt over parts before they meet
their start (``spread_join``) and summed in each task before they meet again.

Defined cases: rows equal in all columns of clicks count once; rows without ts or client_id
are dropped; a row without arrived_at is known in the last state alone, one without click_id
is not late; a value that is null or no finite number gives 0 cents; a client without
purchases, or with rows only before its start, gives no rows; a client missing from clients,
or without a city, has the segment '' and, listed with several cities, the least; an empty
table of clicks gives no rows; columns beyond those named are not read, so their names cannot
clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import heavy_keys, load, scratch, spread_join, staged

DAY = 86_400_000_000
RUN = 3 * DAY
CUTOFF = datetime(2024, 3, 1)
COLUMNS = ("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props")
CELL = ("segment", "cohort", "period")


@dataclass
class State:
    starts: DataFrame  # client_id, segment, start
    parts: DataFrame  # client_id, segment, cohort, period, cents
    cells: DataFrame  # segment, cohort, period, users, users_crc32, cents


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp as its clock reads, whatever the session's zone."""
    return F.expr(f"CAST(CAST(CAST(CAST({name} AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000000 AS BIGINT)")


def _run(x: Column) -> Column:
    """The 3-day run of a number of microseconds, rounded down in whole numbers."""
    return ((x - F.pmod(x, F.lit(RUN))) / F.lit(RUN)).cast("bigint")


def narrow(clicks: DataFrame) -> DataFrame:
    """client_id, at, bought, cents, arrives and deal (a hash of the row, to deal rows by) of distinct usable rows."""
    rows = clicks.select(*COLUMNS).filter("ts IS NOT NULL AND client_id IS NOT NULL").distinct()
    h = F.crc32(F.col("click_id").cast("string"))
    late = F.when(h % 3 == 0, h % 100).otherwise(0) * F.lit(DAY)
    cents = F.floor(F.col("value") * 100 + 0.5)
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return rows.select(
        F.col("client_id").cast("bigint").alias("client_id"), micros("ts").alias("at"), F.col("kind").eqNullSafe("purchase").alias("bought"),
        F.when(finite, cents).otherwise(0).cast("bigint").alias("cents"), (micros("arrived_at") + late).alias("arrives"), F.xxhash64(*COLUMNS).alias("deal"),
    )


def segments(clients: DataFrame) -> DataFrame:
    return clients.filter("client_id IS NOT NULL").groupBy(F.col("client_id").cast("bigint").alias("client_id")).agg(F.min("city").alias("segment"))


def earliest(rows: DataFrame) -> DataFrame:
    return rows.filter("bought").groupBy("client_id").agg(F.min("at").alias("start"))


def placed(starts: DataFrame, named: DataFrame) -> DataFrame:
    return starts.hint("merge").join(named.hint("merge"), "client_id", "left").withColumn("segment", F.coalesce("segment", F.lit("")))


def contributions(rows: DataFrame, starts: DataFrame, heavy: DataFrame) -> DataFrame:
    """One row for each client and period: client_id, segment, cohort, period, cents."""
    met = spread_join(rows, starts, "client_id", "deal", heavy).filter("at >= start")
    period, cohort = _run(F.col("at") - F.col("start")), _run(F.col("start"))
    return met.groupBy("client_id", "segment", cohort.alias("cohort"), period.alias("period")).agg(F.sum("cents").alias("cents"))


def summed(parts: DataFrame) -> DataFrame:
    """Cells of signed parts: each has ``users`` (the client's -1, 0 or 1) and signed cents."""
    crc = F.crc32(F.col("client_id").cast("string")) * F.col("users")
    return parts.groupBy(*CELL).agg(F.sum("users").alias("users"), F.sum(crc).alias("users_crc32"), F.sum("cents").alias("cents"), F.sum("moved").alias("moved"))


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def first_state(known: DataFrame, named: DataFrame, heavy: DataFrame) -> State:
    starts = staged(placed(earliest(known), named), "starts")
    parts = staged(contributions(known, starts, heavy), "parts")
    return State(starts, parts, staged(summed(parts.withColumns({"users": _long(1), "moved": _long(0)})).drop("moved"), "cells"))


def advance(state: State, known: DataFrame, late: DataFrame, named: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cells of the next state (with ``moved``), and ``moved`` of the cells of ``state``."""
    old = state.starts.select("client_id", F.col("start").alias("old"))
    newest = earliest(late).hint("merge").join(old.hint("merge"), "client_id", "left").filter("old IS NULL OR start < old")
    shifted = staged(placed(newest, named).withColumn("moved", (F.col("old").isNotNull() & (_run(F.col("old")) != _run(F.col("start")))).cast("bigint")), "shifted")
    flags = shifted.select("client_id", "moved")

    retract = state.parts.hint("merge").join(flags.hint("merge"), "client_id").withColumns({"users": _long(-1), "cents": -F.col("cents")})
    again = known.unionByName(late)
    anew = contributions(again, shifted.select("client_id", "segment", "start"), heavy).hint("merge").join(flags.hint("merge"), "client_id").withColumn("users", _long(1))
    rest = state.starts.hint("merge").join(flags.hint("merge"), "client_id", "left_anti")
    more = contributions(late, rest, heavy).alias("n")
    had = state.parts.select("client_id", "period", F.lit(True).alias("had"))
    more = more.hint("merge").join(had.hint("merge"), ["client_id", "period"], "left").withColumns({"users": F.when(F.col("had"), _long(0)).otherwise(_long(1)), "moved": _long(0)})

    names = ["client_id", *CELL, "users", "cents", "moved"]
    delta = staged(retract.select(*names).unionByName(anew.select(*names)).unionByName(more.select(*names)), "delta")
    gone = delta.filter("users < 0")
    # what is retracted leaves the new state, so its moved clients are those of the old one
    changes = summed(delta.withColumn("moved", F.when(F.col("users") < 0, 0).otherwise(F.col("moved"))))
    both = state.cells.withColumn("moved", _long(0)).unionByName(changes)
    cells = both.groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in ("users", "users_crc32", "cents", "moved"))).filter("users > 0")
    return cells, gone.groupBy(*CELL).agg(F.sum("moved").alias("moved"))


def retention(clicks: DataFrame, clients: DataFrame, cutoff: datetime = CUTOFF) -> DataFrame:
    """The cells of state 0 (rows that arrive before ``cutoff``) and of state 1 (all rows), maintained from it."""
    rows = staged(narrow(clicks), "rows")
    limit = (cutoff - datetime(1970, 1, 1)).days * DAY + (cutoff - datetime(cutoff.year, cutoff.month, cutoff.day)).seconds * 1_000_000
    early = F.coalesce(F.col("arrives") < limit, F.lit(False))
    known, late = rows.filter(early), rows.filter(~early)
    heavy, named = staged(heavy_keys(rows, "client_id"), "heavy"), staged(segments(clients), "segments")
    state = first_state(known, named, heavy)
    cells, moved = advance(state, known, late, named, heavy)
    first = state.cells.withColumn("moved", _long(0)).unionByName(moved.withColumns({"users": _long(0), "users_crc32": _long(0), "cents": _long(0)}))
    first = first.groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in ("users", "users_crc32", "cents", "moved")))
    columns = ["state", *CELL, "users", "users_crc32", "moved", "cents"]
    return first.withColumn("state", F.lit(0)).select(*columns).unionByName(cells.withColumn("state", F.lit(1)).select(*columns))


def op11_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users, their checksum, moved users and cents of every cell of both states."""
    with scratch() as result:
        return result(retention(load(spark, sf_dir, "clicks"), load(spark, sf_dir, "clients")))


def _nibbles() -> list[int]:
    """Remainders of crc32 for four bits, from its polynomial."""
    out = []
    for n in range(16):
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def _crc32(text: str) -> str:
    """SQL of the crc32 of a short ASCII text, four bits at a time."""
    half = lambda a, b: f"xor({_nibbles()}[1 + (xor({a}, {b}) & 15)], {a} >> 4)"
    codes = f"list_transform(range(1, len({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: {half(half('a', 'b'), '(b >> 4)')}), 4294967295)"


ORACLE_OP11 = f"""
WITH r AS (
  SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
h AS (SELECT *, {_crc32("CAST(click_id AS VARCHAR)")} AS h FROM r),
k AS (
  SELECT client_id, epoch_us(ts) AS us, kind = 'purchase' AS bought, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents,
         coalesce(epoch_us(arrived_at) + CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END * {DAY} < epoch_us(TIMESTAMP '2024-03-01'), FALSE) AS early FROM h),
s AS (SELECT unnest([0, 1]) AS state),
v AS (SELECT s.state, k.* FROM k JOIN s ON early OR s.state = 1),
b AS (SELECT state, client_id, min(us) AS began FROM v WHERE bought GROUP BY ALL),
c AS (
  SELECT b.*, CAST(floor(b.began / {RUN}) AS BIGINT) AS cohort, o.began IS NOT NULL AND floor(o.began / {RUN}) <> floor(b.began / {RUN}) AS moved
  FROM b LEFT JOIN b AS o ON o.client_id = b.client_id AND o.state <> b.state),
g AS (SELECT client_id, min(city) AS city FROM clients GROUP BY ALL),
p AS (
  SELECT state, coalesce(g.city, '') AS segment, cohort, (us - began) // {RUN} AS period, client_id, bool_or(moved) AS moved, sum(cents) AS cents
  FROM v JOIN c USING (state, client_id) LEFT JOIN g USING (client_id) WHERE us >= began GROUP BY ALL)
SELECT CAST(state AS INTEGER) AS state, segment, cohort, CAST(period AS BIGINT) AS period, count(*) AS users,
       CAST(sum({_crc32("CAST(client_id AS VARCHAR)")}) AS BIGINT) AS users_crc32, CAST(sum(CAST(moved AS INTEGER)) AS BIGINT) AS moved, CAST(sum(cents) AS BIGINT) AS cents
FROM p GROUP BY 1, 2, 3, 4
"""
