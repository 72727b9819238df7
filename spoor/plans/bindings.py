"""Bindings of the driver's tables to traces, graphs, heaps and scores.

The tables hold no program traces; each binding keeps an operator's semantics and swaps the payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: trace = user, order = (ts, event), kind = event type, entry point = user modulo 10."""
    return load(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), "value",
        (F.col("user_id") % 10).alias("entry"), F.get_json_object("props", "$.k").cast("int").alias("ref"),
    )


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: one graph; regions are entry points, nations objects, customers and suppliers method calls, orders values, parts operators."""
    pick = lambda t, k, p, kind, label: load(spark, sf_dir, t).select(
        F.lit("g").alias("graph_id"), F.concat(F.lit(p), F.col(k).cast("string")).alias("node_id"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label")
    )
    return (
        pick("region", "r_regionkey", "r", "ENTRYPOINT", "r_name")
        .unionByName(pick("nation", "n_nationkey", "n", "OBJECT", "n_name"))
        .unionByName(pick("customer", "c_custkey", "c", "METHODCALL", "c_mktsegment"))
        .unionByName(pick("supplier", "s_suppkey", "s", "METHODCALL", "s_nationkey"))
        .unionByName(pick("orders", "o_orderkey", "o", "VALUE", "o_orderstatus"))
        .unionByName(pick("part", "p_partkey", "p", "OPERATOR", "p_brand"))
    )


def graph_edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """B2: region-nation SUPPLIES, nation-customer and nation-supplier SCOPE, customer-order SUPPLIES, order-part PARAMETER, part-supplier TRANSFORMATION.

    Unless ``once`` an edge may be told several times.
    """

    def pick(t: str, a: str, pa: str, b: str, pb: str, kind: str) -> DataFrame:
        # each table gives edges of a kind and letters of its own, so equal ones are told by their keys
        keys = load(spark, sf_dir, t).select(a, b)
        return (keys.distinct() if once else keys).select(
            F.lit("g").alias("graph_id"), F.concat(F.lit(pa), F.col(a).cast("string")).alias("src"), F.concat(F.lit(pb), F.col(b).cast("string")).alias("dst"), F.lit(kind).alias("kind")
        )

    return (
        pick("nation", "n_regionkey", "r", "n_nationkey", "n", "SUPPLIES")
        .unionByName(pick("customer", "c_nationkey", "n", "c_custkey", "c", "SCOPE"))
        .unionByName(pick("supplier", "s_nationkey", "n", "s_suppkey", "s", "SCOPE"))
        .unionByName(pick("orders", "o_custkey", "c", "o_orderkey", "o", "SUPPLIES"))
        .unionByName(pick("lineitem", "l_orderkey", "o", "l_partkey", "p", "PARAMETER"))
        .unionByName(pick("lineitem", "l_partkey", "p", "l_suppkey", "s", "TRANSFORMATION"))
    )


def supply_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """B2 as many graphs: one for each nation with its suppliers, for pairwise work."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("graph_id"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("node_id"), F.lit("ENTRYPOINT").alias("kind"), F.lit("n").alias("label"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("graph_id"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("node_id"), F.lit("OPERATOR").alias("kind"), (F.floor("s_acctbal") % 4).cast("string").alias("label"))
    edges = s.select("graph_id", F.concat(F.lit("n"), F.col("graph_id")).alias("src"), F.col("node_id").alias("dst"), F.lit("TRANSFORMATION").alias("kind"))
    return n.unionByName(s), edges


def nation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: entity = nation, feature = market segment, value = number of customers."""
    return load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("entity"), F.col("c_mktsegment").alias("name")).agg(F.count("*").cast("double").alias("value"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5: tool = line status, level = line number, score = discount + tax, hit = returned."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("tool"), F.col("l_linenumber").alias("level"), F.concat_ws("_", "l_suppkey", "l_orderkey").alias("lhs"), F.concat_ws("_", "l_partkey", "l_linenumber").alias("rhs"),
        (F.col("l_discount") + F.col("l_tax")).alias("score"), (F.col("l_returnflag") == "R").alias("hit"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    )
