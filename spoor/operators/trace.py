"""Operators over ordered record logs: shares, trigrams, probes and look-ups.

Every function takes column names, so any table with a trace key, an order and a kind is a
trace.  Windows are partitioned by trace: a trace is one program run, bounded by what wrote
it, and traces are dealt out over the cluster by their key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def of_kinds(records: DataFrame, *kinds: str, kind: str = "kind") -> DataFrame:
    """PRJ-1: records of the kinds given."""
    return records.filter(F.col(kind).isin(*kinds))


def without_kinds(records: DataFrame, *kinds: str, kind: str = "kind") -> DataFrame:
    """PRJ-2: records but for the kinds given (default statics are not counted)."""
    return records.filter(~F.col(kind).isin(*kinds))


def library_calls(records: DataFrame, declaring: str = "class_sig", prefix: str = "java/") -> DataFrame:
    """PRJ-3: calls whose declaring class is in the library."""
    return records.filter(F.col(declaring).startswith(prefix))


def share(rows: DataFrame, group: Sequence[str], key: str, cnt: str = "cnt", perc: str = "perc") -> DataFrame:
    """AGG-1: how often each key occurs in its group, and its share of the group."""
    counted = rows.groupBy(*group, key).agg(F.count("*").alias(cnt))
    return counted.withColumn(perc, F.col(cnt) / F.sum(cnt).over(W.partitionBy(*group)))


def trigrams(records: DataFrame, trace: str, order: Sequence[str], code: str, separator: str = ">") -> DataFrame:
    """WIN-1: (trace, code) of each run of three records; the last run of a trace is left out, as in the original loop."""
    w = W.partitionBy(trace).orderBy(*order)
    run = F.concat_ws(separator, F.col(code), F.lead(code, 1).over(w), F.lead(code, 2).over(w))
    placed = records.select(trace, run.alias("code"), F.row_number().over(w).alias("rn"), F.count("*").over(W.partitionBy(trace)).alias("n"))
    return placed.filter("rn <= n - 3").select(trace, "code")


def trigram_share(records: DataFrame, trace: str, order: Sequence[str], code: str) -> DataFrame:
    """AGG-2: share of each trigram in its trace."""
    return share(trigrams(records, trace, order, code), [trace], "code")


def call_shares(calls: DataFrame, trace: str, kind: str, qualified: str, unqualified: str) -> DataFrame:
    """AGG-3: counts by (kind), (kind, qualified) and (kind, unqualified) in one pass, as shares of the kind and of all calls."""
    sets = calls.groupingSets([[trace, kind], [trace, kind, qualified], [trace, kind, unqualified]], trace, kind, qualified, unqualified).agg(
        F.count("*").alias("cnt"), F.grouping_id().alias("gid")
    )
    level = F.when(F.col("gid") == 3, "kind").when(F.col("gid") == 1, "qualified").otherwise("unqualified")
    rows = sets.select(trace, kind, level.alias("level"), F.coalesce(qualified, unqualified, F.lit("")).alias("key"), "cnt")
    of_kind = F.sum(F.when(F.col("level") == "kind", F.col("cnt")))
    return rows.withColumns(
        {"perc_kind": F.col("cnt") / of_kind.over(W.partitionBy(trace, kind)), "perc_total": F.col("cnt") / of_kind.over(W.partitionBy(trace))}
    )


def conditional_shares(rows: DataFrame, group: Sequence[str], **conditions: Column) -> DataFrame:
    """AGG-4: share of the group's rows that meet each condition."""
    return rows.groupBy(*group).agg(F.count("*").alias("size"), *[(F.count_if(c) / F.count("*")).alias(f"{n}_perc") for n, c in conditions.items()])


def probes(records: DataFrame, trace: str, order: Sequence[str], kind: str) -> DataFrame:
    """WIN-5: first and last record of each trace: one aggregation, no sort."""
    at = F.struct(*order)
    return records.groupBy(trace).agg(F.min_by(kind, at).alias("first_kind"), F.max_by(kind, at).alias("last_kind"), F.count("*").alias("n"))


def dereference(records: DataFrame, heap: DataFrame, ref: str, heap_id: str) -> DataFrame:
    """JN-1: records with the heap object they refer to; a null reference (id 0 or none) is an error record, not a row."""
    return records.filter(F.col(ref).isNotNull()).join(heap, F.col(ref) == F.col(heap_id))


def user_heap(heap: DataFrame, defaults: DataFrame, heap_id: str, ref: str) -> DataFrame:
    """JN-13: heap objects that no default static refers to."""
    return heap.join(defaults.select(F.col(ref).alias("_ref")), F.col(heap_id) == F.col("_ref"), "left_anti")


def harvested(records: DataFrame, trace: str, receiver: str, order: str, is_loop: Column, is_add: Column) -> DataFrame:
    """JN-16: for each loop over a receiver, the number of earlier calls that added to it: a running count, not a self-join."""
    w = W.partitionBy(trace, receiver).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return records.withColumn("adds", F.count_if(is_add).over(w)).filter(is_loop)
