"""Branch (path-condition) trees from assertion chains, without building trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def next_assertion(records: DataFrame, trace: str, order: Sequence[str], is_assertion: Column) -> DataFrame:
    """WIN-2: for each record the place of the next assertion after it (null if there is none)."""
    w = W.partitionBy(trace).orderBy(*order)
    placed = records.withColumn("rn", F.row_number().over(w))
    after = w.rowsBetween(1, W.unboundedFollowing)
    return placed.withColumn("next_at", F.min(F.when(is_assertion, F.col("rn"))).over(after))


def chains(assertions: DataFrame, entry: str, trace: str, order: Sequence[str], condition: Column) -> DataFrame:
    """(entry, trace, chain): the ordered conditions with truth of each trace, every one of them."""
    cells = F.sort_array(F.collect_list(F.struct(*order, condition.alias("c"))))
    return assertions.groupBy(entry, trace).agg(F.transform(cells, lambda x: x["c"]).alias("chain"))


def prefixes(chained: DataFrame, entry: str) -> DataFrame:
    """BR-1: the distinct prefixes of an entry point's chains; those followed by an assertion are inner nodes."""
    sizes = F.sequence(F.lit(0), F.size("chain"))
    rows = chained.select(entry, "chain", F.explode(sizes).alias("depth"))
    prefix = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.slice("chain", 1, F.greatest("depth", F.lit(1))), ">"))
    split = F.when(F.col("depth") < F.size("chain"), F.regexp_replace(F.element_at("chain", F.least(F.col("depth") + 1, F.size("chain"))), "=[TF]$", ""))
    return rows.select(entry, "depth", prefix.alias("prefix"), split.alias("split")).groupBy(entry, "depth", "prefix").agg(F.max("split").alias("split"))


def metrics(chained: DataFrame, entry: str) -> DataFrame:
    """BR-2, AGG-21: height, size, terminals and internals by their closed forms.

    I distinct prefixes are followed by an assertion and D is the longest chain: internals I,
    terminals I + 1, size 2 I + 2, height D + 2.
    """
    inner = prefixes(chained, entry).groupBy(entry).agg(F.count("split").alias("internals"))
    depth = chained.groupBy(entry).agg(F.max(F.size("chain")).cast("bigint").alias("d"))
    return inner.join(depth, entry).select(
        entry, (F.col("d") + 2).alias("height"), (2 * F.col("internals") + 2).alias("size"), (F.col("internals") + 1).alias("terminals"), "internals"
    )


def path_conditions(chained: DataFrame, entry: str, entries: DataFrame | None = None) -> DataFrame:
    """BR-2: distinct sets of (condition, truth) over all leaves of an entry point's tree, empty sides among them.

    Each inner node has a side for true and one for false; a side that is no inner node is a
    leaf.  0 where nothing is asserted, also for ``entries`` without any chain.
    """
    rows = chained.select(entry, "chain", F.explode(F.sequence(F.lit(0), F.size("chain"))).alias("depth")).filter(F.col("depth") < F.size("chain"))
    split = F.regexp_replace(F.element_at("chain", F.col("depth") + 1), "=[TF]$", "")
    inner = rows.select(entry, F.slice("chain", 1, F.col("depth")).alias("path"), split.alias("split")).groupBy(entry, "path").agg(F.max("split").alias("split"))
    side = lambda truth: F.concat("path", F.array(F.concat("split", F.lit(truth))))
    sides = inner.select(entry, F.explode(F.array(side("=T"), side("=F"))).alias("path"))
    leaves = sides.join(inner.select(entry, "path"), [entry, "path"], "left_anti")
    counted = leaves.select(entry, F.array_sort(F.array_distinct("path")).alias("s")).distinct().groupBy(entry).agg(F.count("*").alias("conditions"))
    every = (chained if entries is None else entries).select(entry).distinct()
    return every.join(counted, entry, "left").withColumn("conditions", F.coalesce("conditions", F.lit(0)))
