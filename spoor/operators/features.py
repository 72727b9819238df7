"""Long-format features: zero-filled aggregation, statistics, naming and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.operators.rounds import Rounds


def aggregate_features(features: DataFrame, members: DataFrame, group: str, member: str, name: str = "name", value: str = "value") -> DataFrame:
    """AGG-7/8/9: per group and feature avg, min, max, median, population variance and deviation over all members.

    A member without the feature counts as 0.0.  Mean and variance merge those of the members that have
    it with those of the zeros.  The median is selected by running counts over the distinct values, zeros
    among them, which are range-sorted: no list of values, and a large group lies in many tasks.
    """
    sizes = members.groupBy(group).agg(F.countDistinct(member).alias("n"))
    rows = features.join(members, member).select(group, F.col(name).alias("name"), F.col(value).cast("double").alias("v"))
    present = rows.groupBy(group, "name").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("k"))
    rounds = Rounds(features.sparkSession, "stats")
    both = rounds.keep(present.join(sizes, group), "present")
    zeros = both.filter("k < n").select(group, "name", F.lit(0.0).alias("v"), (F.col("n") - F.col("k")).alias("c"))
    values = rows.groupBy(group, "name", "v").agg(F.count("*").alias("c")).unionByName(zeros).groupBy(group, "name", "v").agg(F.sum("c").alias("c"))
    placed = before(values, [group, "name"], "v", "c", rounds).join(both.select(group, "name", "n"), [group, "name"])
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1  # places of the middle, from 1
    holds = lambda place: (F.col("before") < place) & (place <= F.col("before") + F.col("c"))
    middle = placed.filter(holds(low) | holds(high)).groupBy(group, "name").agg(((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("median"))
    k, n, mean = F.col("k"), F.col("n"), F.col("mean")
    var = (F.col("var") * k + mean * mean * k * (n - k) / n) / n
    absent = k < n
    return both.join(middle, [group, "name"]).select(
        group, F.col("name").alias(name), (mean * k / n).alias("avg"), F.when(absent, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("min"),
        F.when(absent, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("max"), "median", var.alias("variance"), F.sqrt(var).alias("stddev"),
    )


def before(rows: DataFrame, keys: list[str], order: str, weight: str, rounds: Rounds) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the rows of their keys that come before in ``order``, in column ``before``.

    Rows are range-sorted and summed within each part; what a part has to add is summed over a table of
    one row for each part and key.
    """
    parts = rounds.keep(rows.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()), "parts")
    own = W.partitionBy("_part", *keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inner = parts.withColumn("_own", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    past = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = parts.groupBy("_part", *keys).agg(F.sum(weight).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(past), F.lit(0))).drop("_sum")
    return inner.join(base, ["_part", *keys]).withColumn("before", F.col("_own") + F.col("_base")).drop("_part", "_own", "_base")


def zero_filled_average(features: DataFrame, members: DataFrame, group: str, member: str, name: str = "name", value: str = "value") -> DataFrame:
    """SNK-6, AGG-7 (the part that is emitted): sum over the members that have the feature, divided by the number of all members."""
    sizes = members.groupBy(group).agg(F.countDistinct(member).alias("n"))
    sums = features.join(members, member).groupBy(group, name).agg(F.sum(value).alias("s"))
    return sums.join(sizes, group).select(group, name, (F.col("s") / F.col("n")).alias("avg"))


def weighted_features(features: DataFrame, weights: DataFrame, key: str, value: str = "value", weight: str = "weight") -> DataFrame:
    """JN-15, Q-11: features scaled by their model's weight, 1 where none is known."""
    return features.join(weights, key, "left").withColumn(value, F.col(value) * F.coalesce(F.col(weight), F.lit(1))).drop(weight)


def feature_names(*sets: DataFrame, name: str = "name") -> DataFrame:
    """SET-6: the union of the names of several feature tables."""
    out = sets[0].select(name)
    for s in sets[1:]:
        out = out.union(s.select(name))
    return out.distinct()


def indexed_names(features: DataFrame, name: str = "name") -> DataFrame:
    """Attribute numbers from 1 in name order.

    Ranks come from a range-sorted table: row counts of its parts, then places within them.
    """
    names = features.select(name).distinct()
    from spoor.operators.graph import _spill

    # written with its partitions' numbers: both readers below see the same ones
    parts = _spill(names.repartitionByRange(name).select(name, F.spark_partition_id().alias("part")), "names")
    inner = parts.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy(name)))
    sizes = inner.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("before"))
    return inner.join(before, "part").select(name, (F.col("before") + F.col("at")).cast("bigint").alias("idx"))


def arff_rows(features: DataFrame, set_id: str = "set_id", name: str = "name", value: str = "value", separator: str = "-") -> DataFrame:
    """SNK-4: one sparse row of text for each set; the class is what precedes the separator in the id."""
    indexed = indexed_names(features, name)
    n = indexed.agg(F.max("idx").alias("n"))
    rows = features.join(indexed, name).groupBy(set_id).agg(F.sort_array(F.collect_list(F.struct("idx", F.col(value).alias("v")))).alias("cells"))
    body = F.array_join(F.transform("cells", lambda c: F.concat_ws(" ", c["idx"].cast("string"), F.format_string("%.4f", c["v"]))), ",")
    cls = F.split(F.col(set_id).cast("string"), separator)[0]
    return rows.crossJoin(F.broadcast(n)).select(
        set_id, F.concat(F.lit("{0 "), F.col(set_id).cast("string"), F.lit(","), body, F.lit(","), (F.col("n") + 1).cast("string"), F.lit(" "), cls, F.lit("}")).alias("row")
    )
