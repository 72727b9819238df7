"""Queries of scalar functions, set operations and single steps of graph comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from spoor.functions import arith, codes
from spoor.operators import features, graph, scores
from spoor.plans import bindings as b
from spoor.plans.registry import _SHARES, _kind_features, _r, query
from spoor.sources import sinks


@query("""SELECT c_mktsegment || '-' || c_custkey AS variant, n_name AS root_name FROM customer JOIN nation ON 'P' || c_nationkey = 'P' || n_nationkey""")
def variant_prefix_join(spark, d):
    """JN-12, FN-35: customers are variants of their nation: ids P<nation>-<customer>."""
    v = b.load(spark, d, "customer").select(F.concat(F.lit("P"), F.col("c_nationkey").cast("string"), F.lit("-"), F.col("c_custkey").cast("string")).alias("id"), F.concat_ws("-", "c_mktsegment", "c_custkey").alias("variant"))
    roots = b.load(spark, d, "nation").select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("root"), F.col("n_name").alias("root_name"))
    return scores.by_prefix(v, roots, "id", "root").select("variant", "root_name")


@query("""SELECT l_suppkey AS set_id, l_returnflag AS name, round(sum(l_discount) / max(n), 6) AS avg FROM lineitem JOIN (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) USING (l_suppkey) GROUP BY 1, 2""")
def legacy_prefix_average(spark, d):
    """AGG-23, SNK-6: members are ids <supplier>-<order>; their prefix is the group."""
    rows = b.load(spark, d, "lineitem").select(F.concat_ws("-", "l_suppkey", "l_orderkey").alias("member"), F.col("l_returnflag").alias("name"), F.col("l_discount").alias("value"))
    members = rows.select("member", F.regexp_replace("member", "-[^-]*$", "").cast("bigint").alias("set_id")).distinct()
    return features.zero_filled_average(rows, members, "set_id", "member").withColumns(_r("avg"))


@query("""WITH f AS (SELECT user_id, event_type AS name, count(*) AS c FROM events GROUP BY 1, 2)
SELECT user_id AS set_id, concat_ws(',', user_id, coalesce(max(CASE WHEN name = 'click' THEN c END)::VARCHAR, '0'), coalesce(max(CASE WHEN name = 'error' THEN c END)::VARCHAR, '?'), coalesce(max(CASE WHEN name = 'view' THEN c END)::VARCHAR, '')) AS row FROM f GROUP BY 1""")
def dense_rows(spark, d):
    """SNK-5: dense lines with a default for each feature."""
    f = b.traces(spark, d).groupBy(F.col("trace").alias("set_id"), F.col("kind").alias("name")).agg(F.count("*").alias("value"))
    return sinks.dense_rows(f, {"click": "0", "error": "?", "view": ""})


@query("""SELECT o_orderkey, NOT a AS n, a AND b AS an, a OR b AS o, a <> b AS x, o_orderstatus || o_custkey AS joined FROM (SELECT *, o_orderstatus = 'F' AS a, o_totalprice > 200000 AS b FROM orders)""")
def boolean_operators(spark, d):
    """FN-9, FN-10, FN-11."""
    ops = arith.logic(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000)
    return b.load(spark, d, "orders").select("o_orderkey", ops["NOT"].alias("n"), ops["AND"].alias("an"), ops["OR"].alias("o"), ops["XOR"].alias("x"), arith.concat(F.col("o_orderstatus"), F.col("o_custkey")).alias("joined"))


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS parsed, CAST(trunc(p_retailprice * 1.0) AS INT) AS narrowed, '0' AS dflt FROM part""")
def literals_and_casts(spark, d):
    """FN-12, FN-13, FN-15: literals with a suffix, narrowing, default values."""
    text = F.concat(F.col("p_size").cast("string"), F.lit("L"))
    return b.load(spark, d, "part").select("p_partkey", arith.literal(text, F.lit("J")).alias("parsed"), arith.java_cast(F.col("p_retailprice"), "I").alias("narrowed"), arith.default_value(F.lit("I")).alias("dflt"))


@query("""WITH e AS (SELECT DISTINCT p_partkey % 50 AS node_id, 'a' || p_partkey % 50 AS label FROM part WHERE p_size < 25 UNION SELECT DISTINCT p_partkey % 50, 'a' || p_partkey % 50 FROM part WHERE p_size >= 20)
SELECT 'g' AS graph_id, node_id, label FROM e""")
def subgraph_union(spark, d):
    """SET-2: two overlapping subgraphs, each node once."""
    part = lambda cond: b.load(spark, d, "part").filter(cond).select(F.lit("g").alias("graph_id"), (F.col("p_partkey") % 50).alias("node_id"), F.concat(F.lit("a"), (F.col("p_partkey") % 50).cast("string")).alias("label"))
    return graph.graph_union(part("p_size < 25"), part("p_size >= 20"))


@query("""WITH t AS (SELECT o_orderkey, list_sort(list(DISTINCT l_returnflag)) AS ts, count(DISTINCT l_returnflag) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT a.o_orderkey AS l, b.o_orderkey AS r, a.n > 0 AND a.n = b.n AND list_has_all(a.ts, b.ts) AS matches FROM t a JOIN t b ON a.o_orderkey + 1 = b.o_orderkey""")
def composition_matches(spark, d):
    """FN-22, SET-4: consecutive orders by the return flags that their lines own."""
    t = b.load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("ts"))
    return t.select(F.col("l_orderkey").alias("l"), F.col("ts").alias("lt")).join(t.select(F.col("l_orderkey").alias("r"), F.col("ts").alias("rt")), F.col("l") + 1 == F.col("r")).select("l", "r", codes.composition_match(F.col("lt"), F.col("rt")).alias("matches"))


_SIDES = """
e AS (SELECT s_nationkey AS node, s_suppkey AS other, CASE s_suppkey % 3 WHEN 0 THEN 'PARAMETER' WHEN 1 THEN 'SCOPE' ELSE 'SUPPLIES' END AS kind, s_suppkey % 2 = 0 AS way FROM supplier)"""


def _side(spark, d):
    kind = F.when(F.col("s_suppkey") % 3 == 0, "PARAMETER").when(F.col("s_suppkey") % 3 == 1, "SCOPE").otherwise("SUPPLIES")
    return b.load(spark, d, "supplier").select(F.col("s_nationkey").alias("node"), F.col("s_suppkey").alias("other"), kind.alias("kind"), (F.col("s_suppkey") % 2 == 0).alias("way"))


@query(f"""WITH {_SIDES}, p AS (SELECT n_nationkey AS l, (n_nationkey + 1) % 25 AS r FROM nation)
SELECT DISTINCT a.other AS lo, b.other AS ro FROM p JOIN e a ON a.node = l JOIN e b ON b.node = r AND a.way = b.way
WHERE a.other NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) AND b.other NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000) AND (a.kind = b.kind OR (a.kind IN ('PARAMETER', 'SCOPE') AND b.kind IN ('PARAMETER', 'SCOPE')))""")
def frontier_expansion(spark, d):
    """JN-3, JN-4, FN-20: each nation is mapped to the next one; some suppliers are mapped already."""
    e = _side(spark, d)
    pairs = b.load(spark, d, "nation").select(F.col("n_nationkey").alias("l"), ((F.col("n_nationkey") + 1) % 25).alias("r"))
    mapped = lambda cond: b.load(spark, d, "supplier").filter(cond).select("s_suppkey")
    return scores.expansion(pairs, e, e, mapped("s_acctbal < 2000"), mapped("s_acctbal > 8000"))


@query("""SELECT a.s_suppkey AS l, b.s_suppkey AS r FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey % 2 = b.s_suppkey % 2 WHERE a.s_acctbal < 5000 AND b.s_acctbal >= 5000""")
def residual_candidates(spark, d):
    """JN-5: unmapped suppliers of two graphs that match by kind and label."""
    n = b.load(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("kind"), (F.col("s_suppkey") % 2).alias("label"), "s_acctbal")
    return scores.residual(n.filter("s_acctbal < 5000"), n.filter("s_acctbal >= 5000"))


@query("""SELECT user_id % 10 AS entry, count(DISTINCT user_id) AS trace_count, CAST(sum(count(DISTINCT user_id)) OVER () AS BIGINT) AS total_traces FROM events GROUP BY 1""")
def trace_counters(spark, d):
    """AGG-22, SRT-1: traces of each entry point and in all."""
    from pyspark.sql import Window as W

    return b.traces(spark, d).groupBy("entry").agg(F.countDistinct("trace").alias("trace_count")).withColumn("total_traces", F.sum("trace_count").over(W.partitionBy()))


@query(f"""WITH {_SHARES}
SELECT user_id AS trace, name, round(value, 6) AS value FROM f WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)""")
def unfinished_work(spark, d):
    """SNK-11: what is left when some keys are finished."""
    f, _ = _kind_features(spark, d)
    done = b.traces(spark, d).filter("kind = 'error' and value > 100").select("trace")
    return sinks.unfinished(f, done, "trace").select("trace", "name", F.round("value", 6).alias("value"))
