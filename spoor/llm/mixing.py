"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, served again in a new order when
it has been served whole, up to ``most`` times.  A document's virtual finish time is the words
its source has sent with it, divided by the source's target: at time 1 every queue has sent
its target.  All documents are range-sorted by that time, and the order is cut at the total
budget; the document a queue is sending when its target is reached gives only the words up
to it, so a long document does not throw its source off.

Targets share the budget by weight.  None is above ``most`` times its source's size; what is
above is shared again by weight among the others.  The level of a weight unit rises round by
round (sums of a table with one row for each source) until no further source is full.

Cumulative words and places in the mix are prefix sums over range-sorted rows (``running``),
so a source of any size lies in many tasks.

Defined cases: a null or wordless text has size 0 and takes 0; a null source is a source, the
last one; rows with equal ids are documents of their own, and equal rows may change places;
null ids are shuffled like others; a source without words has target 0, as has everything in
an empty table (no rows); a very long text counts whole; columns other than id, text and source
are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import heavy_keys, load, map_batches, numbered, running, scratch, spread_join, staged
from spoor.llm.words import blocks, bounds

#: Weights of the sources in the order of their names, over and over.
WEIGHTS = (1, 2, 3)
#: Most times a source is served.
MOST = 3
SEED = 13


def n_words(column: pa.Array) -> np.ndarray:
    """The number of words of each text."""
    return np.concatenate([np.diff(bounds(data, offsets)[2]) for _, _, data, offsets in blocks(column)] or [np.zeros(0, np.int64)])


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row, id, source, size, t (a hash of the text) and deal, written once so that a row's number stays."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), text.alias("text"), F.xxhash64(text).alias("t"))
    kind = own.schema["id"].dataType.simpleString()
    out = map_batches(own, f"id {kind}, source string, t bigint, size bigint", lambda b: {"id": b.column(0), "source": b.column(1), "t": b.column(3), "size": n_words(b.column(2))})
    return staged(out.withColumns({"row": F.monotonically_increasing_id(), "deal": F.xxhash64("id", "t")}), "sized")


def targets(sources: DataFrame, budget: int, most: int = MOST) -> DataFrame:
    """``sources`` (source_size, weight) with each one's share of ``budget``, at most ``most`` times its size."""
    size, weight = F.col("source_size"), F.col("weight")
    full, level = F.lit(False), None
    while True:
        rest = sources.agg(F.sum(F.when(full, size * most).otherwise(0)).alias("sent"), F.sum(F.when(full, 0).otherwise(weight)).alias("units"), F.count(F.when(full, 1)).alias("full")).first()
        sent, units = rest.sent or 0, rest.units or 0
        if not units or level == (sent, units):
            return sources.withColumn("target", F.when(full, size * most).otherwise(F.lit(max(budget - sent, 0)) * weight / max(units, 1)).cast("double"))
        level = (sent, units)
        full = full | (size * most / weight < F.lit((budget - sent) / units))


def _shuffled(pass_: Column) -> Column:
    return F.xxhash64(F.lit(SEED), pass_, "id", "t")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, order): every row with size, source_size and target, and the mix: row, pass, words and the place ``at`` of its first word."""
    rows = sized(docs, id_col, text_col, source_col)
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.asc_nulls_last("source"))
    ranked, _ = numbered(per_source, "s", "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")).cast("bigint")
    ranked = staged(ranked.withColumn("weight", weight), "ranked")
    budget = int((rows.agg(F.sum("size")).first()[0] or 0) * share)
    goals = targets(ranked, budget, most)
    # a null cannot be joined; the marked text is none that a source can have
    key = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    keyed = rows.withColumn("_key", key)
    heavy = staged(heavy_keys(keyed, "_key"), "heavy")
    known = staged(spread_join(keyed, goals.withColumn("_key", key).select("_key", "s", "source_size", "target"), "_key", "deal", heavy).drop("_key", "deal"), "known")

    passes = F.ceil(F.col("target") / F.col("source_size")).cast("int")
    entries = known.filter("size > 0 AND target > 0").select("row", "id", "t", "s", "size", "target", F.explode(F.sequence(F.lit(0), passes - 1)).alias("pass"))
    queue = running(entries.withColumn("key", _shuffled(F.col("pass"))), "s", ["pass", "key", "id", "t", "row"], "size", "sent", "queue")
    words = F.least(F.col("size"), F.floor("target") - F.col("sent"))
    served = queue.withColumn("words", words).filter("words > 0").select("row", "s", "pass", "words", "sent", ((F.col("sent") + F.col("words")) / F.col("target")).alias("finish"), F.lit(0).cast("bigint").alias("all"))
    order = running(served, "all", ["finish", "s", "sent"], "words", "at", "mix")
    cut = F.least(F.col("words"), F.lit(budget) - F.col("at"))
    return known, order.withColumn("words", cut).filter("words > 0").select("row", "pass", "words", "at")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, its source's size and target, and the words taken of every document."""
    with scratch() as result:
        rows, order = mix(load(spark, sf_dir, "documents"))
        taken = order.groupBy("row").agg(F.sum("words").alias("taken"))
        out = rows.hint("merge").join(taken.hint("merge"), "row", "left")
        return result(out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")))
