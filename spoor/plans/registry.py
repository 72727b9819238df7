"""Every registered query of the behaviour operators with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions import arith, codes
from spoor.operators import branch, features, graph, leaders, scores, similarity, trace
from spoor.plans import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _r(*names: str, digits: int = 6) -> dict:
    """Rounded copies of floating columns: their last digits depend on the order of summation."""
    return {n: F.round(F.col(n), digits) for n in names}


# traces (B1) ------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT user_id, event_type a, lead(event_type, 1) OVER w b, lead(event_type, 2) OVER w c, row_number() OVER w rn, count(*) OVER (PARTITION BY user_id) n
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     g AS (SELECT user_id, a || '>' || b || '>' || c AS code, count(*) AS cnt FROM r WHERE rn <= n - 3 GROUP BY 1, 2)
SELECT user_id AS trace, code, cnt, round(cnt / sum(cnt) OVER (PARTITION BY user_id), 6) AS perc FROM g""")
def trace_trigram_share(spark, d):
    """WIN-1, AGG-2 on B1."""
    return trace.trigram_share(b.traces(spark, d), "trace", ["ts", "seq"], "kind").withColumns(_r("perc"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Trigram shares beside the number of records and the last kind of each trace."""
    return trace_trigram_share(spark, d).join(trace.probes(b.traces(spark, d), "trace", ["ts", "seq"], "kind"), "trace")


@query("""
WITH g AS (SELECT user_id, event_type, count(*) cnt FROM events WHERE event_type <> 'signup' GROUP BY ALL)
SELECT user_id AS trace, event_type AS kind, cnt, round(cnt / sum(cnt) OVER (PARTITION BY user_id), 6) AS perc FROM g""")
def trace_kind_share(spark, d):
    """AGG-1, PRJ-2 on B1; signups stand for default statics."""
    return trace.share(trace.without_kinds(b.traces(spark, d), "signup"), ["trace"], "kind").withColumns(_r("perc"))


@query("""
WITH c AS (SELECT user_id AS trace, event_type AS kind, event_type || '.' || (value > 20)::VARCHAR AS q, (value > 20)::VARCHAR AS u FROM events WHERE event_type IN ('click', 'view')),
     g AS (SELECT trace, kind, q, u, grouping_id(kind, q, u) gid, count(*) cnt FROM c GROUP BY GROUPING SETS ((trace, kind), (trace, kind, q), (trace, kind, u))),
     r AS (SELECT trace, kind, CASE gid WHEN 3 THEN 'kind' WHEN 1 THEN 'qualified' ELSE 'unqualified' END AS level, coalesce(q, u, '') AS key, cnt FROM g)
SELECT *, round(cnt / sum(CASE WHEN level = 'kind' THEN cnt END) OVER (PARTITION BY trace, kind), 6) AS perc_kind,
       round(cnt / sum(CASE WHEN level = 'kind' THEN cnt END) OVER (PARTITION BY trace), 6) AS perc_total FROM r""")
def trace_call_share_grouping_sets(spark, d):
    """AGG-3 on B1: clicks are instance calls, views static ones."""
    calls = trace.of_kinds(b.traces(spark, d), "click", "view").withColumn("u", (F.col("value") > 20).cast("string")).withColumn("q", F.concat_ws(".", "kind", "u"))
    return trace.call_shares(calls, "trace", "kind", "q", "u").withColumns(_r("perc_kind", "perc_total"))


@query("""
SELECT CASE event_type WHEN 'signup' THEN 'EM' WHEN 'click' THEN 'Im' || CAST(floor(value / 100) AS BIGINT) WHEN 'view' THEN 'Sm' || CAST(floor(value / 100) AS BIGINT)
       WHEN 'error' THEN 'A' WHEN 'purchase' THEN 'Op' END AS code, count(*) AS cnt FROM events GROUP BY 1""")
def record_code_projection(spark, d):
    """PRJ-1, PRJ-4 on B1: event types stand for record kinds."""
    names = {"signup": "EntryMethod", "click": "InstanceLibraryMethodCall", "view": "StaticLibraryMethodCall", "error": "Assertion", "purchase": "ObjectFieldPut"}
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("kind")]
    return b.traces(spark, d).select(codes.record_code(kind, F.floor(F.col("value") / 100).cast("string")).alias("code")).groupBy("code").agg(F.count("*").alias("cnt"))


_SHARES = "f AS (SELECT user_id, event_type || CAST(least(floor(value / 15), 9) AS INT) AS name, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS value FROM events GROUP BY 1, 2)"


def _kind_features(spark, d) -> tuple[DataFrame, DataFrame]:
    t = b.traces(spark, d)
    name = F.concat("kind", F.least(F.floor(F.col("value") / 15), F.lit(9)).cast("int").cast("string"))  # rare enough for some to be absent
    f = trace.share(t.withColumn("kind", name), ["trace"], "kind").select("trace", F.col("kind").alias("name"), F.col("perc").alias("value"))
    return f, t.select("trace", "entry").distinct()


@query(f"""
WITH {_SHARES}, m AS (SELECT DISTINCT user_id, user_id % 10 AS entry FROM events), n AS (SELECT entry, count(*) n FROM m GROUP BY 1)
SELECT entry, name, round(sum(value) / any_value(n), 6) AS avg FROM f JOIN m USING (user_id) JOIN n USING (entry) GROUP BY entry, name""")
def trace_feature_avg_zero_fill(spark, d):
    """AGG-7, SNK-6 on B1: mean over all traces of an entry point, absent features as 0."""
    f, m = _kind_features(spark, d)
    return features.zero_filled_average(f, m, "entry", "trace").withColumns(_r("avg"))


@query(f"""
WITH {_SHARES}, m AS (SELECT DISTINCT user_id, user_id % 10 AS entry FROM events), k AS (SELECT DISTINCT entry, name FROM f JOIN m USING (user_id)),
     x AS (SELECT k.entry, k.name, coalesce(value, 0) AS value FROM k JOIN m USING (entry) LEFT JOIN f ON f.user_id = m.user_id AND f.name = k.name)
SELECT entry, name, round(avg(value), 6) AS avg, round(min(value), 6) AS min, round(max(value), 6) AS max, round(median(value), 6) AS median,
       round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS stddev FROM x GROUP BY entry, name""")
def trace_feature_stats(spark, d):
    """AGG-7/8/9 on B1: all statistics over the zero-filled matrix."""
    f, m = _kind_features(spark, d)
    return features.aggregate_features(f, m, "entry", "trace").withColumns(_r("avg", "min", "max", "median", "variance", "stddev"))


@query(f"""
WITH {_SHARES} SELECT f.user_id AS trace, name, round(value * coalesce(w, 1), 6) AS value FROM f LEFT JOIN (SELECT DISTINCT user_id, 3 AS w FROM events WHERE value > 150) g USING (user_id)""")
def weighted_features(spark, d):
    """JN-15 on B1: traces with a very large value weigh 3, the others 1."""
    f, _ = _kind_features(spark, d)
    weights = b.traces(spark, d).filter("value > 150").select("trace", F.lit(3).alias("weight")).distinct()
    return features.weighted_features(f, weights, "trace").select("trace", "name", F.round("value", 6).alias("value"))


@query("""
SELECT user_id AS trace, arg_min(event_type, (ts, event_id)) AS first_kind, arg_max(event_type, (ts, event_id)) AS last_kind, count(*) AS n FROM events GROUP BY 1""")
def record_probes(spark, d):
    """WIN-5 on B1."""
    return trace.probes(b.traces(spark, d), "trace", ["ts", "seq"], "kind")


@query("""
SELECT event_type AS kind, p_type AS type_sig, count(*) AS cnt FROM events JOIN part ON CAST(json_extract(props, '$.k') AS INT) = p_partkey GROUP BY ALL""")
def dereference(spark, d):
    """JN-1: records of B1 joined to heap objects (parts) by reference."""
    heap = b.load(spark, d, "part")
    return trace.dereference(b.traces(spark, d), heap, "ref", "p_partkey").groupBy("kind", F.col("p_type").alias("type_sig")).agg(F.count("*").alias("cnt"))


@query("""
WITH x AS (SELECT user_id, event_id, event_type, count(CASE WHEN event_type = 'click' THEN 1 END) OVER (PARTITION BY user_id, CAST(json_extract(props, '$.k') AS INT) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS adds FROM events)
SELECT user_id AS trace, event_id AS seq, adds FROM x WHERE event_type = 'purchase'""")
def add_call_harvest(spark, d):
    """JN-16 on B1: clicks are adds, purchases loops, the reference is the receiver."""
    t = b.traces(spark, d)
    return trace.harvested(t, "trace", "ref", "seq", F.col("kind") == "purchase", F.col("kind") == "click").select("trace", "seq", "adds")


@query("""
SELECT o_custkey AS trace, count(*) AS size, round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*), 6) AS concrete_perc,
       round(count(CASE WHEN o_orderstatus = 'O' THEN 1 END) / count(*), 6) AS symbolic_perc, round(count(CASE WHEN o_totalprice > 200000 THEN 1 END) / count(*), 6) AS array_perc FROM orders GROUP BY 1""")
def heap_kind_share(spark, d):
    """AGG-4 on B6: heap = a customer's orders."""
    heap = b.load(spark, d, "orders").withColumnRenamed("o_custkey", "trace")
    out = trace.conditional_shares(heap, ["trace"], concrete=F.col("o_orderstatus") == "F", symbolic=F.col("o_orderstatus") == "O", array=F.col("o_totalprice") > 200000)
    return out.withColumns(_r("concrete_perc", "symbolic_perc", "array_perc"))


@query("""
WITH g AS (SELECT p_brand AS graph_id, CASE WHEN p_type LIKE '%ECONOMY%' THEN p_type ELSE '_ReferenceType_' END AS type_sig, count(*) cnt FROM part GROUP BY ALL)
SELECT *, round(cnt / sum(cnt) OVER (PARTITION BY graph_id), 6) AS perc FROM g""")
def heap_type_share(spark, d):
    """AGG-5, PRJ-5 on B6: types are generalised unless they are of the library (economy)."""
    p = b.load(spark, d, "part").select(F.col("p_brand").alias("graph_id"), F.when(F.col("p_type").contains("ECONOMY"), F.col("p_type")).otherwise("_ReferenceType_").alias("type_sig"))
    return trace.share(p, ["graph_id"], "type_sig").withColumns(_r("perc"))


@query("""SELECT p_type AS type_sig, count(*) AS cnt FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) GROUP BY 1""")
def user_heap(spark, d):
    """JN-13 on B6: parts that no large line refers to."""
    lines = b.load(spark, d, "lineitem").filter("l_quantity > 48")
    return trace.user_heap(b.load(spark, d, "part"), lines, "p_partkey", "l_partkey").groupBy(F.col("p_type").alias("type_sig")).agg(F.count("*").alias("cnt"))


@query("""
SELECT family, key, count(*) AS cnt FROM (
  SELECT 'kind' AS family, event_type AS key FROM events UNION ALL SELECT 'hour', CAST(hour(ts) AS VARCHAR) FROM events UNION ALL SELECT 'bucket', CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) FROM events)
GROUP BY ALL""")
def legacy_counts(spark, d):
    """AGG-19/20 on B1: one template of counts over several families in one pass."""
    cells = F.array(
        F.struct(F.lit("kind").alias("family"), F.col("kind").alias("key")), F.struct(F.lit("hour").alias("family"), F.hour("ts").cast("string").alias("key")),
        F.struct(F.lit("bucket").alias("family"), F.floor(F.col("value") / 50).cast("string").alias("key")),
    )
    return b.traces(spark, d).select(F.inline(cells)).groupBy("family", "key").agg(F.count("*").alias("cnt"))


# branch trees (B3) ------------------------------------------------------------------------


@query("""
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rn FROM events)
SELECT user_id AS trace, event_id AS seq, rn, coalesce(min(CASE WHEN event_type = 'error' THEN rn END) OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS next_at FROM r""")
def next_assertion_index(spark, d):
    """WIN-2 on B3: errors are assertions; 0 where none follows."""
    out = branch.next_assertion(b.traces(spark, d), "trace", ["ts", "seq"], F.col("kind") == "error")
    return out.select("trace", "seq", F.col("rn").cast("bigint").alias("rn"), F.coalesce(F.col("next_at").cast("bigint"), F.lit(0)).alias("next_at"))


_CHAINS = """
a AS (SELECT user_id % 10 AS entry, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i,
             'c' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) || '=' || CASE WHEN value > 20 THEN 'T' ELSE 'F' END AS c FROM events WHERE event_type = 'error'),
ch AS (SELECT entry, user_id, list(c ORDER BY i) AS chain FROM a GROUP BY 1, 2),
px AS (SELECT entry, depth, array_to_string(chain[1:depth], '>') AS prefix, max(CASE WHEN depth < len(chain) THEN 'c' || (depth + 1) END) AS split
       FROM (SELECT entry, chain, unnest(range(0, len(chain) + 1)) AS depth FROM ch) GROUP BY 1, 2, 3)"""


def _chains(spark, d) -> DataFrame:
    """Errors are assertions, the n-th one tests condition n, large values are true."""
    a = trace.of_kinds(b.traces(spark, d), "error")
    raw = branch.chains(a, "entry", "trace", ["ts", "seq"], F.when(F.col("value") > 20, "T").otherwise("F"))
    return raw.withColumn("chain", F.transform("chain", lambda x, i: F.concat(F.lit("c"), (i + 1).cast("string"), F.lit("="), x)))


@query(f"WITH {_CHAINS} SELECT entry, CAST(depth AS INT) AS depth, prefix, split FROM px")
def branch_prefixes(spark, d):
    """BR-1 on B3."""
    return branch.prefixes(_chains(spark, d), "entry")


@query(f"""WITH {_CHAINS}, i AS (SELECT entry, count(split) AS internals FROM px GROUP BY 1), dd AS (SELECT entry, max(len(chain)) AS d FROM ch GROUP BY 1)
SELECT entry, CAST(d + 2 AS BIGINT) AS height, 2 * internals + 2 AS size, internals + 1 AS terminals, internals FROM i JOIN dd USING (entry)""")
def branch_metrics(spark, d):
    """BR-2, AGG-21 on B3."""
    return branch.metrics(_chains(spark, d), "entry")


@query(f"""WITH {_CHAINS}, nd AS (SELECT DISTINCT entry, chain[1:i] AS path, i FROM (SELECT entry, chain, unnest(range(0, len(chain))) AS i FROM ch)),
kid AS (SELECT entry, list_append(path, 'c' || (i + 1) || t) AS path FROM nd, (VALUES ('=T'), ('=F')) v(t)),
n AS (SELECT entry, count(DISTINCT array_to_string(list_sort(path), '|')) AS conditions FROM kid WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.entry = kid.entry AND nd.path = kid.path) GROUP BY 1)
SELECT entry, coalesce(conditions, 0) AS conditions FROM (SELECT DISTINCT user_id % 10 AS entry FROM events) LEFT JOIN n USING (entry)""")
def path_conditions(spark, d):
    """BR-2: distinct sets of conditions over all leaves on B3."""
    return branch.path_conditions(_chains(spark, d), "entry", b.traces(spark, d).select("entry"))


# graphs (B2) ------------------------------------------------------------------------------

_NODES = """
nodes AS (SELECT 'r' || r_regionkey AS id, 'ENTRYPOINT' AS kind, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'OBJECT', n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'METHODCALL', c_mktsegment FROM customer UNION ALL SELECT 's' || s_suppkey, 'METHODCALL', CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'o' || o_orderkey, 'VALUE', o_orderstatus FROM orders UNION ALL SELECT 'p' || p_partkey, 'OPERATOR', p_brand FROM part)"""
_EDGES = """
edges AS (SELECT DISTINCT * FROM (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'SUPPLIES' AS kind FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'SCOPE' FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'SCOPE' FROM supplier
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'SUPPLIES' FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'PARAMETER' FROM lineitem
  UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'TRANSFORMATION' FROM lineitem))"""


@query(f"WITH {_NODES} SELECT 'g' AS graph_id, id AS node_id, kind, label FROM nodes")
def graph_nodes(spark, d):
    """GR-1, §1.3: node rows of B2."""
    return b.graph_nodes(spark, d)


@query(f"WITH {_EDGES} SELECT 'g' AS graph_id, src, dst, kind FROM edges")
def graph_edges(spark, d):
    """GR-1: edge rows of B2, one for each pair and kind."""
    return b.graph_edges(spark, d)


def _share_sql(table: str, kinds: tuple[str, ...], prefix: str) -> str:
    counts = ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS k{i}" for i, k in enumerate(kinds))
    rows = [f"SELECT 'g' AS graph_id, '{prefix}_{k}_PERC' AS name, round(CASE WHEN n = 0 THEN 0 ELSE k{i} / n END, 6) AS value FROM c" for i, k in enumerate(kinds)]
    rows += [
        f"SELECT 'g', '{prefix}_RATIO_{x}_{y}', round(CASE WHEN k{j} = 0 THEN 0 ELSE k{i} / k{j} END, 6) FROM c" for i, x in enumerate(kinds) for j, y in enumerate(kinds) if i != j
    ]
    return f"c AS (SELECT count(*) AS n, {counts} FROM {table}) " + " UNION ALL ".join(rows)


@query(f"WITH {_NODES}, {_share_sql('nodes', graph.NODE_KINDS, 'NODE')}")
def graph_node_shares(spark, d):
    """AGG-6 on B2: node shares and all ratios."""
    return graph.kind_shares(b.graph_nodes(spark, d), graph.NODE_KINDS, "NODE").withColumns(_r("value"))


@query(f"WITH {_EDGES}, {_share_sql('edges', graph.EDGE_KINDS, 'EDGE')}")
def graph_edge_shares(spark, d):
    """AGG-6 on B2: edge shares and ratios; the kind that does not occur gives ratios of 0, not infinity."""
    return graph.kind_shares(b.graph_edges(spark, d), graph.EDGE_KINDS, "EDGE").withColumns(_r("value"))


@query(f"WITH {_NODES}, {_EDGES} SELECT kind, count(*) AS cnt FROM nodes WHERE id IN (SELECT src FROM edges UNION SELECT dst FROM edges) GROUP BY 1")
def connected_nodes(spark, d):
    """PRJ-11 on B2: nodes with an edge, by kind."""
    return graph.connected(b.graph_nodes(spark, d), b.graph_edges(spark, d)).groupBy("kind").agg(F.count("*").alias("cnt"))


@query(f"""WITH {_NODES}, {_EDGES}, seeds AS (SELECT id, kind FROM nodes WHERE kind IN ('ENTRYPOINT', 'METHODCALL', 'OPERATOR')),
w AS (SELECT src AS id, dst AS o, kind FROM edges UNION ALL SELECT dst, src, kind FROM edges),
s AS (SELECT seeds.id, seeds.kind || '_' || coalesce(string_agg(n.kind || ':' || w.kind, ',' ORDER BY n.kind || ':' || w.kind), '') AS signature
      FROM seeds LEFT JOIN w ON w.id = seeds.id LEFT JOIN nodes n ON n.id = w.o GROUP BY seeds.id, seeds.kind),
g AS (SELECT signature, count(*) AS cnt FROM s GROUP BY 1)
SELECT 'g' AS graph_id, signature, cnt, round(cnt / sum(cnt) OVER (), 6) AS perc FROM g""")
def neighbourhood_signature_share(spark, d):
    """AGG-10, GR-7, SRT-5 on B2."""
    n = b.graph_nodes(spark, d)
    seeds = n.filter("kind in ('ENTRYPOINT', 'METHODCALL', 'OPERATOR')")
    return graph.signatures(n, b.graph_edges(spark, d), seeds).withColumns(_r("perc"))


_TAINT = f"""{_NODES}, {_EDGES},
cls AS (SELECT id, CASE WHEN kind IN ('VALUE', 'OBJECT') THEN 'DATA' ELSE kind END AS cls FROM nodes),
moves AS (SELECT e.src, e.dst, e.kind, 'out' AS way FROM edges e JOIN cls ON cls.id = e.src
            WHERE (cls = 'DATA') OR (cls = 'OPERATOR' AND kind = 'TRANSFORMATION') OR (cls = 'METHODCALL' AND kind IN ('SUPPLIES', 'SCOPE'))
          UNION ALL SELECT e.dst, e.src, e.kind, 'in' FROM edges e JOIN cls ON cls.id = e.dst WHERE cls = 'DATA' AND kind IN ('AGGREGATION', 'SCOPE')),
seen AS (SELECT id FROM nodes WHERE kind = 'OBJECT' AND label IN ('NATION_0', 'NATION_1') UNION SELECT m.dst FROM moves m JOIN seen ON m.src = seen.id)"""


#: Taint that does not follow parameters leaves parts and their suppliers alone.
_CAREFUL = tuple(r for r in graph.TAINT_RULES if r[1] != "PARAMETER")


def _tainted(spark, d, rules: tuple = graph.TAINT_RULES, numbers: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    n, e = b.graph_nodes(spark, d), b.graph_edges(spark, d, once=not numbers)
    if numbers:
        n, e = graph.numbered(n, e)
    moves = graph._spill(graph.steps(spark, n, e, rules).select("graph_id", "src", "dst", "kind"), "moves")
    seeds = n.filter("kind = 'OBJECT' and label in ('NATION_0', 'NATION_1')")
    return n, e, moves, graph.reach(moves, seeds, written=True)


@query(f"WITH RECURSIVE {_TAINT} SELECT 'g' AS graph_id, id AS node_id FROM seen")
def taint_reachability(spark, d):
    """GR-3 on B2."""
    return _tainted(spark, d)[3]


@query(f"WITH RECURSIVE {_TAINT} SELECT DISTINCT 'g' AS graph_id, src, dst, kind FROM moves WHERE src IN (SELECT id FROM seen)")
def taint_transitions(spark, d):
    """GR-3, GR-4 on B2."""
    _, _, moves, seen = _tainted(spark, d)
    return graph.transitions(moves, seen)


def _concerns(spark, d) -> DataFrame:
    n, e, _, seen = _tainted(spark, d, _CAREFUL)
    return graph.weak_components(*graph.untainted(n, e, seen))


@query(None)
def secondary_concern_components(spark, d):
    """GR-5, SET-3 on B2: components of what taint leaves (checked against brute force in the tests)."""
    return _concerns(spark, d)


@query(None)
def concern_boundary_restore(spark, d):
    """GR-5 on B2: how many nodes each component has with its re-attached neighbours."""
    n, e, _, seen = _tainted(spark, d, _CAREFUL, numbers=True)
    return graph.boundary_sizes(n, e, seen)


@query("""
WITH l AS (SELECT c_custkey AS l, c_nationkey AS key, count(o_orderkey) AS ld FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
     r AS (SELECT s_suppkey AS r, s_nationkey AS key, count(l_orderkey) AS rd FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)
SELECT l, r, key, round(CASE WHEN ld = 0 OR rd = 0 THEN 1 ELSE 1 - ld / greatest(ld, rd) END, 6) AS cost FROM l JOIN r USING (key)""")
def initial_candidate_cost(spark, d):
    """JN-2, Q-1, Q-2: two graphs of calls (customers and suppliers, keyed by nation), degrees from their orders and lines."""
    t = lambda n: b.load(spark, d, n)
    l = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("key")).agg(F.count("o_orderkey").alias("degree"))
    r = t("supplier").join(t("lineitem"), F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("key")).agg(F.count("l_orderkey").alias("degree"))
    return graph.initial_candidates(l, r, digits=6)


# scores (B4, B5) --------------------------------------------------------------------------

_PAIRS = """
f AS (SELECT c_nationkey AS e, c_mktsegment AS k, CAST(count(*) AS DOUBLE) AS v FROM customer GROUP BY 1, 2), t AS (SELECT e, sum(v) AS t FROM f GROUP BY 1),
s AS (SELECT a.e AS lhs, b.e AS rhs, sum(least(a.v, b.v)) AS c FROM f a JOIN f b ON a.k = b.k AND a.e < b.e GROUP BY 1, 2),
p AS (SELECT lhs, rhs, c / (l.t + r.t - c) AS score FROM s JOIN t l ON l.e = lhs JOIN t r ON r.e = rhs)"""


def _pairs(spark, d) -> DataFrame:
    return scores.overlap_scores(b.nation_features(spark, d), "entity", "name", "value")


@query(f"WITH {_PAIRS} SELECT lhs, rhs, round(score, 6) AS score FROM p")
def pair_scores_triangular(spark, d):
    """JN-6 on B4."""
    return _pairs(spark, d).withColumns(_r("score"))


@query(f"WITH {_PAIRS} SELECT CASE WHEN lhs = 7 THEN rhs ELSE lhs END AS program, round(max(score), 6) AS similarity FROM p WHERE lhs = 7 OR rhs = 7 GROUP BY 1")
def plaintiff_scores(spark, d):
    """JN-7, SIM-8 on B4: nation 7 against all."""
    return scores.plaintiff(_pairs(spark, d), 7).withColumns(_r("similarity"))


@query(f"""WITH {_PAIRS}, g AS (SELECT n_nationkey AS id, n_regionkey AS grp FROM nation), q AS (SELECT * FROM p WHERE score > 0.7),
x AS (SELECT a.grp AS lg, b.grp AS rg, coalesce(q.score, 1.0) AS s FROM g a CROSS JOIN g b LEFT JOIN q ON q.lhs = least(a.id, b.id) AND q.rhs = greatest(a.id, b.id))
SELECT lg, rg, round(avg(s), 6) AS avg_score FROM x GROUP BY 1, 2""")
def group_average_matrix(spark, d):
    """AGG-11 on B4: regions are groups; pairs below 0.7 are taken as missing."""
    groups = b.load(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("grp"))
    return scores.group_average(_pairs(spark, d).filter("score > 0.7"), groups).withColumns(_r("avg_score"))


@query(f"WITH {_PAIRS}, m AS (SELECT lhs, rhs, score FROM p UNION ALL SELECT rhs, lhs, score / 2 FROM p) SELECT least(lhs, rhs) AS lhs, greatest(lhs, rhs) AS rhs, round(max(score), 6) AS score FROM m GROUP BY 1, 2")
def pair_dedupe_max(spark, d):
    """AGG-12, SET-1 on B4: both directions of every pair."""
    p = _pairs(spark, d)
    both = p.unionByName(p.select(F.col("rhs").alias("lhs"), F.col("lhs").alias("rhs"), (F.col("score") / 2).alias("score")))
    return scores.dedupe_pairs(both).withColumns(_r("score"))


@query(f"WITH {_PAIRS} SELECT lhs, rhs, round(score, 6) AS score FROM p WHERE NOT EXISTS (SELECT 1 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE least(a.n_nationkey, b.n_nationkey) = lhs AND greatest(a.n_nationkey, b.n_nationkey) = rhs)")
def suspicious_anti_join(spark, d):
    """JN-9 on B4: nations of one region are known suspicious."""
    n = b.load(spark, d, "nation")
    bad = n.select(F.col("n_nationkey").alias("lhs"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("rhs"), "n_regionkey"), "n_regionkey").filter("lhs > rhs")
    return scores.without_pairs(_pairs(spark, d), bad).withColumns(_r("score"))


@query("""SELECT l_linestatus AS tool, count(*) AS cnt FROM lineitem WHERE CAST(l_suppkey AS VARCHAR) <> CAST(l_partkey AS VARCHAR) GROUP BY 1""")
def same_base_exclusion(spark, d):
    """JN-10, FN-35 on B5."""
    return scores.other_base(b.evaluated(spark, d)).groupBy("tool").agg(F.count("*").alias("cnt"))


@query("""SELECT l_linestatus AS tool, count(*) AS cnt, round(avg(l_discount + l_tax), 6) AS avg, round(min(l_discount + l_tax), 6) AS min, round(max(l_discount + l_tax), 6) AS max FROM lineitem WHERE l_discount + l_tax <> 0 GROUP BY 1""")
def usable_score_stats(spark, d):
    """PRJ-12, AGG-13 on B5."""
    return scores.usable(b.evaluated(spark, d)).groupBy("tool").agg(F.count("*").alias("cnt"), *[F.round(f("score"), 6).alias(n) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])


@query(f"WITH {_PAIRS}, x AS (SELECT *, row_number() OVER (PARTITION BY lhs ORDER BY score DESC, rhs) AS rn FROM p) SELECT lhs, rhs, round(score, 6) AS score FROM x WHERE rn = 1")
def best_match_lr(spark, d):
    """WIN-6, SIM-6 on B4, left to right."""
    return scores.best_matches(_pairs(spark, d), "lhs", "rhs").withColumns(_r("score"))


@query(f"WITH {_PAIRS}, x AS (SELECT *, row_number() OVER (PARTITION BY rhs ORDER BY score DESC, lhs) AS rn FROM p WHERE score <= 0.9) SELECT rhs, lhs, round(score, 6) AS score FROM x WHERE rn = 1")
def best_match_rl(spark, d):
    """WIN-6, SIM-6 on B4, right to left, with a validator: near-identical pairs do not count."""
    return scores.best_matches(_pairs(spark, d), "rhs", "lhs", F.col("score") <= 0.9).withColumns(_r("score"))


_TOPK = """
x AS (SELECT l_linestatus AS tool, l_linenumber AS level, l_returnflag = 'R' AS hit, row_number() OVER (PARTITION BY l_linestatus, l_linenumber ORDER BY l_discount + l_tax DESC, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem),
k AS (SELECT tool, level, count(CASE WHEN hit THEN 1 END) AS tp, (level * 5 - count(CASE WHEN hit THEN 1 END)) * 2 AS errors FROM x WHERE rn <= level * 5 GROUP BY tool, level)"""
_TIES = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _topk(spark, d) -> DataFrame:
    rows = b.evaluated(spark, d).withColumn("lv", F.col("level"))
    return scores.topk_errors(rows, ["tool", "lv"], "level", _TIES, "hit").drop("lv")


@query(f"WITH {_TOPK} SELECT tool, level, tp, errors FROM k")
def topk_errors(spark, d):
    """SRT-2, SRT-3 on B5."""
    return _topk(spark, d)


@query(f"WITH {_TOPK} SELECT tool, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(errors) AS BIGINT) AS errors, round(CASE WHEN sum(tp) + sum(errors) * 0.5 = 0 THEN 0 ELSE sum(tp) / (sum(tp) + sum(errors) * 0.5) END, 6) AS f_score FROM k GROUP BY 1")
def topk_fscore(spark, d):
    """SRT-3, AGG-17 on B5."""
    return scores.pooled_f(_topk(spark, d), "tool").withColumns(_r("f_score"))


@query(f"WITH {_TOPK} SELECT coalesce(tool, 'all') AS tool, coalesce(level, 0) AS level, CAST(sum(errors) AS BIGINT) AS errors FROM k GROUP BY ROLLUP (tool, level)")
def error_rollup(spark, d):
    """AGG-16 on B5: totals at every level."""
    out = scores.error_rollup(_topk(spark, d), "tool", "level")
    return out.select(F.coalesce("tool", F.lit("all")).alias("tool"), F.coalesce("level", F.lit(0)).alias("level"), "errors")


_SWEEP = """
x AS (SELECT l_suppkey % 20 AS grp, l_discount + l_tax AS score, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, CAST(l_returnflag = 'R' AS INT) AS hit FROM lineitem),
y AS (SELECT *, row_number() OVER w AS rn, sum(hit) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(hit) OVER (PARTITION BY grp) AS p FROM x
      WINDOW w AS (PARTITION BY grp ORDER BY score DESC, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
z AS (SELECT grp, CAST(rn AS BIGINT) AS rn, CAST(tp AS BIGINT) AS tp, CAST(rn - tp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, CAST(rn - tp + p - tp AS BIGINT) AS errors FROM y)"""


def _sweep(spark, d) -> DataFrame:
    rows = b.evaluated(spark, d).withColumn("grp", F.col("l_suppkey") % 20)
    return scores.sweep(rows, ["grp"], "hit", _TIES).select("grp", F.col("rn").cast("bigint").alias("rn"), "tp", "fp", "fn", "errors")


@query(f"WITH {_SWEEP} SELECT * FROM z")
def threshold_sweep(spark, d):
    """WIN-3 on B5: confusion counts at every cut."""
    return _sweep(spark, d)


@query(f"""WITH {_SWEEP}, u AS (SELECT *, errors > lag(errors) OVER (PARTITION BY grp ORDER BY rn) AS up FROM z), c AS (SELECT grp, coalesce(min(CASE WHEN up THEN rn - 1 END), max(rn)) AS rn FROM u GROUP BY 1)
SELECT z.* FROM z JOIN c USING (grp, rn)""")
def threshold_sweep_first_min(spark, d):
    """WIN-4 on B5."""
    return scores.first_minimum(_sweep(spark, d), ["grp"])


@query("""WITH m AS (SELECT l_linestatus AS tool, l_linenumber AS level, l_suppkey, avg(l_discount) AS m FROM lineitem GROUP BY ALL) SELECT tool, level, round(avg(m), 6) AS avg_of_avgs FROM m GROUP BY 1, 2""")
def avg_of_avgs_by_level(spark, d):
    """AGG-14 on B5: mean per base (supplier), then per tool and level."""
    rows = b.load(spark, d, "lineitem").select(F.col("l_linestatus").alias("tool"), F.col("l_linenumber").alias("level"), "l_suppkey", "l_discount")
    return scores.average_of_averages(rows, ["tool", "level"], "l_suppkey", "l_discount").withColumns(_r("avg_of_avgs"))


@query("""WITH g AS (SELECT s_suppkey, s_acctbal / 10000 AS base_score FROM supplier) SELECT l_suppkey AS base, l_orderkey, l_linenumber, round(greatest(base_score - l_discount * 10, 0) * 100, 6) AS drop_perc FROM lineitem JOIN g ON s_suppkey = l_suppkey""")
def score_drop_clamped(spark, d):
    """AGG-15, JN-11 on B5: suppliers are bases, their lines variants."""
    bases = b.load(spark, d, "supplier").select(F.col("s_suppkey").alias("base"), (F.col("s_acctbal") / 10000).alias("base_score"))
    rows = b.load(spark, d, "lineitem").withColumnRenamed("l_suppkey", "base")
    return scores.base_lookup(rows, bases, "base").select("base", "l_orderkey", "l_linenumber", F.round(scores.score_drop(F.col("base_score"), F.col("l_discount") * 10), 6).alias("drop_perc"))


@query("""WITH s AS (SELECT s_nationkey AS g, l_suppkey AS id, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
SELECT a.id AS a, b.id AS b, round(least(a.n, b.n) / greatest(a.n, b.n), 6) AS ratio FROM s a JOIN s b ON a.g = b.g AND a.id < b.id AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n)""")
def size_band_prefilter(spark, d):
    """JN-8: nations are entry points, suppliers their traces, lines their records."""
    lines = b.load(spark, d, "lineitem").join(b.load(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sizes = lines.groupBy(F.col("s_nationkey").alias("g"), F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"))
    return scores.size_band(sizes, group=["g"]).select("a", "b", "ratio").withColumns(_r("ratio"))


@query("""SELECT l_returnflag AS grp, round(max(CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END), 6) AS score FROM lineitem GROUP BY 1""")
def top_usable_score(spark, d):
    """SRT-4 on B5: the best score that is not NaN (0 / 0 here stands as NaN)."""
    s = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount") / F.col("l_tax"))
    return scores.top_usable(b.load(spark, d, "lineitem").select(F.col("l_returnflag").alias("grp"), s.alias("score")), "grp").withColumns(_r("score"))


@query("""SELECT hit, count(*) AS cnt FROM (SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS hit FROM customer) GROUP BY 1""")
def membership_flags(spark, d):
    """JN-14 on B5: whether an element is in a set."""
    members = b.load(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("m")).distinct()
    return b.load(spark, d, "customer").join(members, "c_custkey", "left").groupBy(F.coalesce("m", F.lit(False)).alias("hit")).agg(F.count("*").alias("cnt"))


@query("""WITH d AS (SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\n]*[^ \n][^\n]*')) AS n FROM documents)
SELECT source, count(*) AS files, round(avg(n), 6) AS avg_lines FROM d GROUP BY 1""")
def dataset_stats(spark, d):
    """AGG-18 on B4: files and non-empty lines of each submission (source)."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != ""))
    return b.load(spark, d, "documents").select("source", n.alias("n")).groupBy("source").agg(F.count("*").alias("files"), F.round(F.avg("n"), 6).alias("avg_lines"))


# functions --------------------------------------------------------------------------------


@query("""SELECT p_partkey, replace(replace(p_brand, '#', 'HASH'), ' ', 'SPACE') AS brand, replace(p_name, ' ', 'SPACE') AS name, translate(p_brand || '/x"y', '/"', '..') AS path FROM part""")
def sanitised_names(spark, d):
    """FN-30, FN-34."""
    return b.load(spark, d, "part").select("p_partkey", codes.sanitise(F.col("p_brand")).alias("brand"), codes.sanitise(F.col("p_name")).alias("name"), codes.path_safe(F.concat("p_brand", F.lit('/x"y'))).alias("path"))


@query("""SELECT o_orderkey, 'pkg/' || o_orderstatus AS declaring, 'call' || o_custkey % 7 AS name, 2 AS n_args, '[I' AS second_arg, 'V' AS ret, 'Lpkg/' || o_orderstatus || ';call' || o_custkey % 7 || '(Ljava/lang/String;[I)V' AS text FROM orders""")
def parsed_signatures(spark, d):
    """FN-32, FN-33: parse and print signatures made from orders."""
    sig = F.concat(F.lit("Lpkg/"), F.col("o_orderstatus"), F.lit(";call"), (F.col("o_custkey") % 7).cast("string"), F.lit("(Ljava/lang/String;[I)V"))
    s = b.load(spark, d, "orders").select("o_orderkey", codes.signature(sig).alias("s"))
    return s.select("o_orderkey", "s.declaring", "s.name", F.size("s.args").alias("n_args"), F.element_at("s.args", 2).alias("second_arg"), "s.ret", codes.signature_text(F.col("s")).alias("text"))


@query("""SELECT o_orderkey, CAST(o_custkey % 5 AS VARCHAR) AS chance, CAST(o_custkey % 3 AS VARCHAR) AS level, printf('%.2f', o_totalprice) AS price FROM orders""")
def level_tags(spark, d):
    """FN-36, FN-38: tags out of variant ids, and number formats."""
    tag = F.concat(F.lit("base-C"), (F.col("o_custkey") % 5).cast("string"), F.lit("-L"), (F.col("o_custkey") % 3).cast("string"), F.lit("-V1"))
    return b.load(spark, d, "orders").select("o_orderkey", codes.level_tag(tag, "C").alias("chance"), codes.level_tag(tag, "L").alias("level"), F.format_string("%.2f", "o_totalprice").alias("price"))


@query("""WITH x AS (SELECT p_partkey AS id, CAST(p_partkey * 1234567 % 2147483647 AS BIGINT) AS a, CAST(p_size AS BIGINT) - 10 AS b FROM part)
SELECT id, CAST(((a + b * 100000000 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INT) AS added,
       CAST(((a - b * 100000000 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INT) AS subtracted,
       CAST(((CAST(a AS HUGEINT) * b + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INT) AS multiplied,
       CASE WHEN b <> 0 THEN CAST(trunc(a / b) AS BIGINT) ELSE 0 END AS divided, CASE WHEN b <> 0 THEN a % b ELSE 0 END AS modulo, CAST(sign(a - b) AS INT) AS compared FROM x""")
def stack_arithmetic(spark, d):
    """FN-1..5, FN-7, FN-8 with 32-bit wrap-around; a halted division shows as 0."""
    p = b.load(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 1234567 % 2147483647).alias("a"), (F.col("p_size").cast("bigint") - 10).alias("b"))
    x, y = F.col("a"), F.col("b")
    return p.select("id", arith.add(x, y * 100000000).alias("added"), arith.sub(x, y * 100000000).alias("subtracted"), arith.mul(x, y).alias("multiplied"), F.coalesce(arith.div(x, y), F.lit(0)).alias("divided"), F.coalesce(arith.mod(x, y), F.lit(0)).alias("modulo"), arith.compare(x, y).alias("compared"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice = l_quantity * 2000 OR trunc(l_extendedprice / 1000) = trunc(l_quantity * 2) AS matches FROM lineitem""")
def number_matches(spark, d):
    """FN-27: equal as doubles or as truncated integers."""
    x, y = F.col("l_extendedprice") / 1000, F.col("l_quantity") * 2
    return b.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codes.number_match(x, y).alias("matches"))


@query("""WITH x AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS n, split_part(p_name, ' ', 2) AS m, p_retailprice > 1000 AS ret, p_type, p_size, p_brand FROM part)
SELECT a.p_partkey AS l, b.p_partkey AS r, CAST(starts_with(a.n, b.m) OR starts_with(b.m, a.n) OR a.ret = b.ret AS INT) AS matched FROM x a JOIN x b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_type = 'PROMO' AND b.p_type = 'STANDARD'""")
def call_matches(spark, d):
    """FN-21: promotional and standard parts are the calls of two graphs; names by prefix or equal return types, within candidate blocks."""
    p = b.load(spark, d, "part")
    side = lambda kind, word, out: p.filter(F.col("p_type") == kind).select(F.col("p_partkey").alias(out), "p_size", "p_brand", F.struct(F.split("p_name", " ")[word].alias("name"), (F.col("p_retailprice") > 1000).alias("ret")).alias(f"{out}_s"))
    return side("PROMO", 0, "l").join(side("STANDARD", 1, "r"), ["p_size", "p_brand"]).select("l", "r", codes.call_match(F.col("l_s"), F.col("r_s")).alias("matched"))


@query("""SELECT DISTINCT name FROM (SELECT event_type AS name FROM events UNION ALL SELECT o_orderstatus FROM orders UNION ALL SELECT p_type FROM part)""")
def feature_name_union(spark, d):
    """SET-5, SET-6: the union of feature names."""
    t = lambda n, c: b.load(spark, d, n).select(F.col(c).alias("name"))
    return features.feature_names(t("events", "event_type"), t("orders", "o_orderstatus"), t("part", "p_type"))


@query("""WITH n AS (SELECT DISTINCT event_type AS name FROM events) SELECT name, row_number() OVER (ORDER BY name) AS idx FROM n""")
def feature_index(spark, d):
    """WIN-7, SNK-4: attribute numbers in name order."""
    return features.indexed_names(b.traces(spark, d).select(F.col("kind").alias("name")))


@query(f"""WITH {_SHARES}, n AS (SELECT name, row_number() OVER (ORDER BY name) AS idx FROM (SELECT DISTINCT name FROM f)), k AS (SELECT max(idx) AS n FROM n)
SELECT user_id AS set_id, '{{0 ' || user_id || ',' || string_agg(idx || ' ' || printf('%.4f', round(CAST(value AS DECIMAL(18, 12)), 4)), ',' ORDER BY idx) || ',' || (any_value(k.n) + 1) || ' ' || user_id || '}}' AS row FROM f JOIN n USING (name), k GROUP BY user_id""")
def arff_rows(spark, d):
    """SNK-4 on B1: sparse rows with the class after the features."""
    f, _ = _kind_features(spark, d)
    return features.arff_rows(f.withColumnRenamed("trace", "set_id"))


# comparison of graphs ---------------------------------------------------------------------


@query("""WITH n AS (SELECT s_nationkey AS g, CAST(floor(s_acctbal) AS BIGINT) % 4 AS label, count(*) AS c FROM supplier GROUP BY 1, 2),
k AS (SELECT n_nationkey AS g, 1 + coalesce((SELECT sum(c) FROM n WHERE n.g = n_nationkey), 0) AS size FROM nation),
m AS (SELECT l.g AS lhs, r.g AS rhs, l.size AS nl, r.size AS nr, 1 + coalesce((SELECT sum(least(a.c, b.c)) FROM n a JOIN n b ON a.label = b.label WHERE a.g = l.g AND b.g = r.g), 0) AS mm FROM k l JOIN k r ON l.g < r.g)
SELECT lhs, rhs, round(CAST(2 * mm AS DOUBLE) / (nl + nr), 6) AS union_sim, round(CAST(mm AS DOUBLE) / nl, 6) AS lr_sim, round(CAST(mm AS DOUBLE) / nr, 6) AS rl_sim FROM m""")
def graph_similarity(spark, d):
    """SIM-1..4 on the nations' supply graphs, all pairs: in stars, operators of one label match one to one, and so do the middles."""
    n, e = b.supply_graphs(spark, d)
    ids = b.load(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    pairs = ids.select(F.col("k").alias("lhs")).join(ids.select(F.col("k").alias("rhs")), F.col("lhs") < F.col("rhs"))
    return similarity.compare_pairs(pairs, n, e).withColumns(_r("union_sim", "lr_sim", "rl_sim"))


@query("""WITH RECURSIVE c AS (SELECT user_id % 10 AS entry, user_id AS u, event_type AS code, count(*) AS c FROM events GROUP BY 1, 2, 3),
t AS (SELECT entry, u, sum(c) AS n, row_number() OVER (PARTITION BY entry ORDER BY u) AS i FROM c GROUP BY 1, 2),
s AS (SELECT a.entry, a.u, b.u AS l, sum(least(a.c, b.c)) AS both FROM c a JOIN c b ON a.entry = b.entry AND a.code = b.code AND b.u < a.u GROUP BY 1, 2, 3),
o AS (SELECT x.entry, x.i, x.u, coalesce(list(y.u) FILTER (WHERE CAST(least(x.n, y.n) AS DOUBLE) / greatest(x.n, y.n) >= 0.85 AND CAST(2 * s.both AS DOUBLE) / (x.n + y.n) >= 0.85), []) AS near
      FROM t x LEFT JOIN s ON s.entry = x.entry AND s.u = x.u LEFT JOIN t y ON y.entry = s.entry AND y.u = s.l GROUP BY 1, 2, 3),
w AS (SELECT entry, i, u AS leader, [u] AS leaders FROM o WHERE i = 1
  UNION ALL SELECT o.entry, o.i, coalesce(list_filter(w.leaders, lambda x: list_contains(o.near, x))[1], o.u),
    CASE WHEN len(list_filter(w.leaders, lambda x: list_contains(o.near, x))) = 0 THEN list_append(w.leaders, o.u) ELSE w.leaders END FROM w JOIN o ON o.entry = w.entry AND o.i = w.i + 1)
SELECT entry, leader, count(*) AS weight FROM w GROUP BY 1, 2""")
def condensed_weights(spark, d):
    """SIM-5 on B1: leaders and weights of each entry point's traces."""
    sets = b.traces(spark, d).groupBy("entry", "trace").agg(F.sort_array(F.collect_list("kind")).alias("codes"))
    return leaders.condense(sets, "entry", "trace", "codes", 0.85)[0]
