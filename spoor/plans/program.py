"""Queries of graph building, entry points, value matching and legacy counts, on records made of the driver's tables.

B6: each event is a trace record of its user's graph.  Sign-ups are entry parameters, views
library calls, clicks field puts, purchases arithmetic, errors assertions; ``k`` of the
properties names symbols and heap objects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions import arith, codes, values
from spoor.operators import builder, graph, methods, scores
from spoor.plans import bindings as b
from spoor.plans.registry import _r, query

_X = "x AS (SELECT 'u' || user_id AS g, event_id AS seq, event_type AS t, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def _records(spark, d) -> DataFrame:
    t = b.load(spark, d, "events")
    k, seq = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    no = lambda kind: F.lit(None).cast(kind)

    def val(tag: str, kind: str | None = None, text=None, uid=None, symbol=None, heap=None, expr=None):
        cells = (uid, F.lit(tag), F.lit(kind), text, symbol, heap, expr)
        return F.struct(*[(no(y) if c is None else c).cast(y).alias(n) for c, (n, y) in zip(cells, (f.split(":") for f in builder.VAL[7:-1].split(",")))])

    symbol, literal = val("symbol", "I", symbol=k), val("literal", "I", text=F.floor("value").cast("string"), uid=seq)
    box, of = val("ref", "LBox;", heap=k % 5), F.col("event_type")
    kinds = {"signup": "EntryParameter", "view": "InstanceLibraryMethodCall", "click": "ObjectFieldPut", "purchase": "StackTransformation", "error": "Assertion"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[of]
    rows = t.select(
        F.concat(F.lit("u"), "user_id").alias("graph_id"), seq.alias("seq"), kind.alias("kind"), F.when(of == "view", F.concat(F.lit("call"), (k % 3).cast("string"))).alias("method"),
        F.when(of == "click", F.concat(F.lit("f"), (k % 3).cast("string"))).when(of == "purchase", F.when(k % 2 == 0, "ADD").otherwise("MUL")).alias("operator"),
        F.when(of == "signup", symbol).when(of == "click", box).alias("ref"), F.when(of == "view", box).alias("scope"), F.when(of.isin("click", "error"), symbol).alias("value"),
        F.when(of == "purchase", symbol).alias("lhs"), F.when(of == "purchase", literal).alias("rhs"), no(builder.VAL).alias("idx"),
        F.when(of == "view", val("symbol", "J", symbol=k + 1000)).when(of == "purchase", val("expr", "I", expr=seq)).alias("result"), F.when(of == "view", F.array(literal, symbol)).alias("params"),
    )
    return rows


_BUILT = f"""{_X},
e AS (SELECT g, seq, 'ENTRYPOINT' AS src, '#' || k AS dst, 'SUPPLIES' AS kind, NULL AS label FROM x WHERE t = 'signup'
  UNION ALL SELECT g, seq, 'v' || seq, 'n' || seq, 'PARAMETER', '$0' FROM x WHERE t = 'view' UNION ALL SELECT g, seq, '#' || k, 'n' || seq, 'PARAMETER', '$1' FROM x WHERE t = 'view'
  UNION ALL SELECT g, seq, (k % 5) || '@', 'n' || seq, 'SCOPE', NULL FROM x WHERE t = 'view' UNION ALL SELECT g, seq, 'n' || seq, '#' || (k + 1000), 'SUPPLIES', NULL FROM x WHERE t = 'view'
  UNION ALL SELECT g, seq, '#' || k, (k % 5) || '@', 'AGGREGATION', 'f' || (k % 3) FROM x WHERE t = 'click'
  UNION ALL SELECT g, seq, '#' || k, 'n' || seq, 'TRANSFORMATION', NULL FROM x WHERE t = 'purchase' UNION ALL SELECT g, seq, 'v' || seq, 'n' || seq, 'TRANSFORMATION', NULL FROM x WHERE t = 'purchase'
  UNION ALL SELECT g, seq, 'n' || seq, 'e' || seq, 'TRANSFORMATION', NULL FROM x WHERE t = 'purchase'),
c AS (SELECT g, '#' || k AS id, 'VALUE' AS kind, 'I' AS label, t = 'signup' AS param FROM x WHERE t <> 'error' UNION ALL SELECT g, '#' || (k + 1000), 'VALUE', 'J', false FROM x WHERE t = 'view'
  UNION ALL SELECT g, (k % 5) || '@', 'OBJECT', 'LBox;', false FROM x WHERE t IN ('view', 'click')
  UNION ALL SELECT g, 'v' || seq, 'VALUE', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), false FROM x WHERE t IN ('view', 'purchase')
  UNION ALL SELECT g, 'e' || seq, 'VALUE', 'I', false FROM x WHERE t = 'purchase'
  UNION ALL SELECT g, 'n' || seq, 'METHODCALL', 'call' || (k % 3), false FROM x WHERE t = 'view'
  UNION ALL SELECT g, 'n' || seq, 'OPERATOR', CASE WHEN k % 2 = 0 THEN 'ADD' ELSE 'MUL' END, false FROM x WHERE t = 'purchase'),
nd AS (SELECT g, id, any_value(kind) AS kind, max(label) AS label, bool_or(param) AS param FROM c GROUP BY g, id)"""


@query(f"WITH {_BUILT} SELECT g AS graph_id, seq, src, dst, kind, label FROM e")
def built_edges(spark, d):
    """GR-1b..1f: the edges of every record of B6."""
    return builder.build_edges(_records(spark, d))


@query(f"WITH {_BUILT} SELECT g AS graph_id, id AS node_id, kind, label, param AS is_entry_param, false AS is_synthetic, false AS is_static_field FROM nd")
def built_nodes(spark, d):
    """GR-1, GR-1a: the nodes of B6, each once."""
    return builder.build_nodes(_records(spark, d))


@query(f"WITH {_X} SELECT g AS graph_id, seq, k AS symbol FROM x WHERE t = 'error'")
def kept_assertions(spark, d):
    """GR-1g."""
    return builder.assertions(_records(spark, d)).select("graph_id", "seq", F.col("value.symbol").alias("symbol"))


@query(f"WITH {_BUILT} SELECT g AS graph_id, id AS node_id FROM nd WHERE param")
def input_nodes(spark, d):
    """GR-2, PRJ-10 on B6: entry parameters."""
    return builder.inputs(builder.build_nodes(_records(spark, d)))


@query(f"""WITH {_BUILT} SELECT 'node' AS what, g AS graph_id, '#' || (2000 + CAST(replace(id, '@', '') AS INT)) AS a, 'length' AS b FROM nd WHERE kind = 'OBJECT'
UNION ALL SELECT 'edge', g, '#' || (2000 + CAST(replace(id, '@', '') AS INT)), id FROM nd WHERE kind = 'OBJECT'""")
def array_length_nodes(spark, d):
    """GR-1h: every heap object of B6 is an array with a symbolic size; those touched get a length."""
    nodes = builder.build_nodes(_records(spark, d))
    heap = nodes.select("graph_id").distinct().join(spark.range(6).withColumnRenamed("id", "h"), how="cross")  # six for each graph, the last never touched
    heap = heap.select("graph_id", F.concat(F.col("h").cast("string"), F.lit("@")).alias("node_id"), (F.col("h") + 2000).cast("int").alias("size_symbol"))
    n, e = builder.array_lengths(nodes, heap)
    return n.select(F.lit("node").alias("what"), "graph_id", F.col("node_id").alias("a"), F.col("label").alias("b")).unionByName(e.select(F.lit("edge").alias("what"), "graph_id", F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"""WITH {_BUILT}, bx AS (SELECT DISTINCT g, '#' || (k + 1000) AS box, '#' || k AS inner_id FROM x WHERE t = 'view' AND k % 2 = 0)
SELECT e.g AS graph_id, coalesce(s.inner_id, src) AS src, coalesce(o.inner_id, dst) AS dst, kind, count(*) AS cnt FROM e LEFT JOIN bx s ON s.g = e.g AND s.box = src LEFT JOIN bx o ON o.g = e.g AND o.box = dst GROUP BY ALL""")
def unboxed_edges(spark, d):
    """GR-1: results of even symbols are boxes of them, and collapse onto them."""
    r = _records(spark, d)
    k = F.col("scope.heap_id")
    boxes = r.filter(k.isNotNull() & (F.col("result.symbol") % 2 == 0)).select("graph_id", F.concat(F.lit("#"), F.col("result.symbol").cast("string")).alias("box"), F.concat(F.lit("#"), (F.col("result.symbol") - 1000).cast("string")).alias("inner")).distinct()
    return builder.unboxed(builder.build_edges(r), boxes).groupBy("graph_id", "src", "dst", "kind").agg(F.count("*").alias("cnt"))


@query(f"""WITH RECURSIVE {_BUILT}, z AS (SELECT * FROM nd WHERE kind <> 'OBJECT'), w AS (SELECT DISTINCT e.g, src AS a, dst AS o FROM e JOIN z a ON a.g = e.g AND a.id = src JOIN z o ON o.g = e.g AND o.id = dst UNION SELECT DISTINCT e.g, dst, src FROM e JOIN z a ON a.g = e.g AND a.id = src JOIN z o ON o.g = e.g AND o.id = dst),
p AS (SELECT g, id, id AS m FROM z UNION SELECT p.g, w.o, p.m FROM p JOIN w ON w.g = p.g AND w.a = p.id)
SELECT g AS graph_id, id AS node_id, min(m) AS component_id FROM p GROUP BY 1, 2""")
def concern_components(spark, d):
    """GR-5, SET-3 on B6: weakly connected components of what is left without the objects."""
    r = _records(spark, d)
    nodes, edges = builder.build_nodes(r), builder.build_edges(r).select("graph_id", "src", "dst", "kind")
    rest, inner = graph.untainted(nodes, edges, nodes.filter("kind = 'OBJECT'").select("graph_id", "node_id"))
    return graph.weak_components(rest, inner)


@query(f"""WITH {_BUILT} SELECT g AS graph_id, id AS node_id, kind = 'VALUE' AS is_value, kind = 'OBJECT' AS is_object, kind = 'OPERATOR' AS is_operator, kind = 'ENTRYPOINT' AS is_entry_point, kind = 'METHODCALL' AS is_method_call,
kind IN ('VALUE', 'OBJECT') AS is_data, param AS is_entry_parameter, false AS is_synthetic, starts_with(id, 'v') AS is_concrete, starts_with(id, '#') AS is_symbolic, false AS is_string FROM nd""")
def classified_nodes(spark, d):
    """PRJ-6 on B6."""
    nodes = builder.build_nodes(_records(spark, d)).withColumns({"is_concrete": F.col("node_id").startswith("v"), "is_symbolic": F.col("node_id").startswith("#"), "string": F.lit(None).cast("string")})
    return graph.classify_nodes(nodes)


@query(f"""WITH {_BUILT} SELECT kind = 'SCOPE' AS is_scope, kind = 'SUPPLIES' AS is_supplies, kind = 'PARAMETER' AS is_parameter, kind = 'AGGREGATION' AS is_aggregation, kind = 'TRANSFORMATION' AS is_transformation, count(*) AS cnt FROM e GROUP BY ALL""")
def classified_edges(spark, d):
    """PRJ-6 on B6: edges by what they are."""
    traits = [f"is_{k.lower()}" for k in graph.EDGE_KINDS]
    return graph.classify_edges(builder.build_edges(_records(spark, d))).groupBy(*traits).agg(F.count("*").alias("cnt"))


_COUNTED = """w AS (SELECT 'g' || (p_partkey % 7) AS g, p_partkey, p_brand, p_type, p_size, floor(p_retailprice / 100) AS price, p_name FROM part),
f AS (SELECT g, 'LABEL_' || p_brand || '_COUNT' AS name FROM w UNION ALL SELECT g, 'CLASS_' || p_type || '_COUNT' FROM w UNION ALL SELECT g, 'NODETYPE_VALUE_COUNT' FROM w
  UNION ALL SELECT g, 'TYPESIGNATURE_' || p_size || '_COUNT' FROM w WHERE p_size <= 40 UNION ALL SELECT g, 'OPERATOR_' || p_type || '_COUNT' FROM w WHERE p_size > 40 UNION ALL SELECT g, 'CASTTYPE_' || (p_size % 3) || '_COUNT' FROM w WHERE p_size > 45
  UNION ALL SELECT g, 'QUALIFED_SIGNATURE_' || p_brand || '.' || p_type || '_COUNT' FROM w WHERE p_size < 20 UNION ALL SELECT g, 'SIGNATURE_' || p_type || '_COUNT' FROM w WHERE p_size < 20
  UNION ALL SELECT g, 'VALUE_Concrete_' || (p_size % 4) || '_COUNT' FROM w UNION ALL SELECT g, 'CONCRETEVALUE_' || CAST(price AS INT) || '_int_COUNT' FROM w
  UNION ALL SELECT g, 'STRING_' || p_name || '_COUNT' FROM w WHERE p_size % 5 = 0 UNION ALL SELECT g, 'CONCRETESTRING_' || p_name FROM w WHERE p_size % 10 = 0 UNION ALL SELECT g, 'REPRESENTINGTYPE_' || p_type FROM w WHERE p_size % 9 = 0
  UNION ALL SELECT 'g' || (l_partkey % 7), 'EDGETYPE_' || l_returnflag || '_COUNT' FROM lineitem UNION ALL SELECT 'g' || (l_partkey % 7), 'LABEL_' || l_linestatus || '_COUNT' FROM lineitem)"""


@query(f"""WITH {_COUNTED} SELECT g AS graph_id, 'GRAPH_EXECUTION_GRAPH_' || name AS name, count(*) AS value FROM f GROUP BY 1, 2
UNION ALL SELECT g, 'GRAPH_EXECUTION_GRAPH_LITERAL_COUNT', count(*) FILTER (WHERE p_size < 10) FROM w GROUP BY 1""")
def legacy_graph_counts(spark, d):
    """AGG-20: parts are nodes of seven graphs, lines their edges."""
    w, size = b.load(spark, d, "part"), F.col("p_size")
    g = lambda key: F.concat(F.lit("g"), (F.col(key) % 7).cast("string")).alias("graph_id")
    nodes = w.select(
        g("p_partkey"), F.col("p_brand").alias("label"), F.col("p_type").alias("ui_class"), F.lit("VALUE").alias("kind"), F.when(size <= 40, size).alias("type_sig"), F.when(size > 40, F.col("p_type")).alias("operator"),
        F.when(size > 45, size % 3).alias("cast_type"), F.when(size < 20, F.concat_ws(".", "p_brand", "p_type")).alias("method"), F.when(size < 20, F.col("p_type")).alias("method_name"), F.lit("Concrete").alias("value_kind"),
        (size % 4).alias("value_type"), F.floor(F.col("p_retailprice") / 100).cast("int").alias("value"), F.lit("int").alias("value_class"), F.when(size % 5 == 0, F.col("p_name")).alias("string"),
        F.when(size % 10 == 0, F.col("p_name")).alias("string_text"), F.when(size % 9 == 0, F.col("p_type")).alias("representing"), (size < 10).alias("is_literal"),
    )
    edges = b.load(spark, d, "lineitem").select(g("l_partkey"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("label"))
    return graph.legacy_counts(nodes, edges, "EXECUTION_GRAPH")


# methods and types (B7): customers are methods, nations types ---------------------------------


def _methods(spark, d) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    names = {"AUTOMOBILE": "main", "BUILDING": "doGet", "FURNITURE": "onEvent", "HOUSEHOLD": "getX", "MACHINERY": "setX"}
    array = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    params = (
        F.when(segment == "AUTOMOBILE", array("java.lang.String[]")).when(segment == "BUILDING", array(methods.REQUEST, methods.RESPONSE))
        .when(segment == "FURNITURE", array(F.concat(F.lit("T"), (key % 25).cast("string")))).when((segment == "HOUSEHOLD") & (key % 2 == 0), F.array().cast("array<string>")).otherwise(array("I"))
    )
    return b.load(spark, d, "customer").select(
        F.concat(F.lit("m"), key.cast("string")).alias("method"), F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[segment].alias("name"), F.lit("C").alias("class_sig"),
        F.when(key % 2 == 0, methods.SERVLET).otherwise("java.lang.Object").alias("super_class"), F.when(segment == "HOUSEHOLD", "int").otherwise("void").alias("ret"), params.alias("params"),
        F.when(key % 11 == 0, array(methods.ANNOTATIONS[1])).alias("annotations"), F.lit(None).cast("array<string>").alias("class_annotations"), (segment == "AUTOMOBILE").alias("is_static"),
        (key % 3 != 0).alias("is_public"), (key % 7 == 0).alias("is_private"), F.lit(False).alias("is_constructor"), F.when(key % 4 != 0, (key % 4 - 1).cast("int")).alias("statements"),
    )


def _types(spark, d) -> DataFrame:
    """Chains of five types: the first of each extends an event, a view or (the last chain) nothing known."""
    n = F.col("n_nationkey")
    top = F.when(n >= 20, F.lit("java.lang.Object")).when(F.floor(n / 5) % 2 == 0, methods.EVENT).otherwise(methods.VIEW)
    name = lambda c: F.concat(F.lit("T"), c.cast("string"))
    return b.load(spark, d, "nation").select(name(n).alias("type"), F.when(n % 5 == 0, top).otherwise(name(n - 1)).alias("parent"))


_METHODS = "m AS (SELECT c_custkey AS k, c_mktsegment AS s, c_custkey % 4 <> 0 AS body, c_custkey % 4 - 1 AS n, c_custkey % 7 = 0 AS priv FROM customer)"


@query(f"""WITH {_METHODS} SELECT 'm' || k AS method FROM m WHERE (s = 'AUTOMOBILE' AND body AND k % 3 <> 0) OR (s = 'BUILDING' AND body AND NOT priv AND k % 2 = 0)
OR (s = 'FURNITURE' AND body AND NOT priv AND k % 25 < 20) OR (k % 11 = 0 AND NOT priv) OR k IN (7, 8)""")
def found_entry_points(spark, d):
    """PRJ-7, PRJ-9 on B7."""
    return methods.entry_points(_methods(spark, d), _types(spark, d), ["m7", "m8"]).select("method")


@query(f"WITH {_METHODS} SELECT 'm' || k AS method FROM m WHERE body AND n > 0 AND NOT (s = 'HOUSEHOLD' AND k % 2 <> 0 AND n = 1) AND NOT (s = 'MACHINERY' AND n = 1)")
def listed_methods(spark, d):
    """PRJ-8 on B7."""
    return methods.all_methods(_methods(spark, d)).select("method")


@query("""WITH RECURSIVE t AS (SELECT 'T' || n_nationkey AS type, CASE WHEN n_nationkey % 5 <> 0 THEN 'T' || (n_nationkey - 1) WHEN n_nationkey >= 20 THEN 'java.lang.Object' WHEN n_nationkey // 5 % 2 = 0 THEN 'java.util.EventObject' ELSE 'android.view.View' END AS parent FROM nation),
r AS (SELECT type, type AS target FROM t UNION SELECT parent, parent FROM t UNION SELECT r.type, t.parent FROM r JOIN t ON t.type = r.target) SELECT type, target FROM r""")
def assignable_types(spark, d):
    """FN-14 on B7."""
    return methods.assignable(_types(spark, d))


# values (B8): parts are values -------------------------------------------------------------------


@query("""WITH x AS (SELECT p_partkey, ['I', 'J', '[I', '[[LA;', 'LA;', 'LB;', '[LA;', '[Z'][1 + p_partkey % 8] AS a, ['J', '[D', '[[LA;', 'LA;', 'LB;', 'Z'][1 + p_size % 6] AS b FROM part),
y AS (SELECT *, least(len(regexp_extract(a, '^\\[*')), len(regexp_extract(b, '^\\[*'))) AS n FROM x)
SELECT p_partkey, substr(a, n + 1) = substr(b, n + 1) OR (substr(a, n + 1) IN ('Z', 'B', 'C', 'S', 'I', 'J', 'F', 'D') AND substr(b, n + 1) IN ('Z', 'B', 'C', 'S', 'I', 'J', 'F', 'D')) AS matches FROM y""")
def type_matches(spark, d):
    """FN-23."""
    pick = lambda names, key: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    return b.load(spark, d, "part").select("p_partkey", codes.type_match(pick(["I", "J", "[I", "[[LA;", "LA;", "LB;", "[LA;", "[Z"], "p_partkey"), pick(["J", "[D", "[[LA;", "LA;", "LB;", "Z"], "p_size")).alias("matches"))


@query("""WITH x AS (SELECT p_partkey, ['symbolic', 'concrete', 'composite'][1 + p_partkey % 3] AS k, ['symbolic', 'concrete', 'composite'][1 + p_size % 3] AS l, string_split(p_name, ' ') AS a, string_split(p_brand || ' ' || split_part(p_name, ' ', 1 + p_size % 2), ' ') AS b FROM part)
SELECT p_partkey, coalesce(k = l AND (k = 'symbolic' OR (k = 'concrete' AND a[1] = b[1 + p_partkey % 2]) OR (k = 'composite' AND len(a) = len(b[1 + p_partkey % 2:]) AND a[1] = b[1 + p_partkey % 2])), false) AS matches FROM x""")
def string_matches(spark, d):
    """FN-24."""
    kind = lambda key: F.element_at(F.array(*map(F.lit, ("symbolic", "concrete", "composite"))), (F.col(key) % 3 + 1).cast("int")).alias("kind")
    words = F.split("p_name", " ")
    other = F.array("p_brand", F.get(words, F.col("p_size") % 2))
    other = F.slice(other, (F.col("p_partkey") % 2 + 1).cast("int"), 2)
    return b.load(spark, d, "part").select("p_partkey", values.string_match(F.struct(kind("p_partkey"), words.alias("parts")), F.struct(kind("p_size"), other.alias("parts"))).alias("matches"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, ['nil', 'ref', 'symbol', 'expr', 'literal'][1 + l_orderkey % 5] AS t, ['nil', 'ref', 'symbol', 'expr', 'literal'][1 + (l_orderkey + l_linenumber // 4) % 5] AS u, l_linenumber AS n, l_suppkey % 4 AS s, l_partkey % 4 AS p, l_quantity * 1e9 AS q, l_quantity * 1e9 + l_discount * 10 AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, t = u AND CASE t WHEN 'nil' THEN true WHEN 'literal' THEN q = r OR trunc(q) = trunc(r) ELSE s = p END AS matches FROM x""")
def value_matches(spark, d):
    """FN-25: numbers of any size among them."""
    tags = F.array(*map(F.lit, ("nil", "ref", "symbol", "expr", "literal")))

    def val(shift, number, text):
        tag = F.element_at(tags, ((F.col("l_orderkey") + shift) % 5 + 1).cast("int"))
        return F.struct(tag.alias("tag"), number.cast("string").alias("type"), text.cast("string").alias("text"), number.cast("int").alias("heap_id"), number.alias("canon"))

    q = F.col("l_quantity") * 1e9
    one, two = val(F.lit(0), F.col("l_suppkey") % 4, q), val(F.floor(F.col("l_linenumber") / 4), F.col("l_partkey") % 4, q + F.col("l_discount") * 10)
    return b.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", values.stack_match(one, two).alias("matches"))


@query("""WITH x AS (SELECT p_size % 6 AS a, p_partkey % 6 AS b, p_partkey % 2 AS op FROM part), k AS (SELECT op, least(a, b) AS l, greatest(a, b) AS g, count(*) AS n FROM x GROUP BY ALL)
SELECT 2 * n AS members, count(*) AS classes FROM k GROUP BY 1""")
def canonical_expressions(spark, d):
    """FN-26: a sum or product of two leaves for each part, and its negation's operand: how large the classes of equal trees are."""
    p = b.load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_size") % 6).alias("a"), (F.col("p_partkey") % 6).alias("b"), F.when(F.col("p_partkey") % 2 == 0, "ADD").otherwise("MUL").alias("op"))
    leaf = lambda c: F.concat(F.lit("leaf"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    leaves = spark.range(6).select(F.concat(F.lit("leaf"), "id").alias("expr_id"), none.alias("op"), none.alias("lhs"), none.alias("rhs"), F.col("id").cast("string").alias("leaf"))
    trees = p.select(F.concat(F.lit("t"), "k").alias("expr_id"), "op", leaf("a").alias("lhs"), leaf("b").alias("rhs"), none.alias("leaf"))
    casts = p.select(F.concat(F.lit("c"), "k").alias("expr_id"), F.lit("CAST").alias("op"), F.concat(F.lit("t"), "k").alias("lhs"), none.alias("rhs"), none.alias("leaf"))
    canon = values.canonical(leaves.unionByName(trees).unionByName(casts))
    return canon.filter("expr_id not like 'leaf%'").groupBy("canon").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("classes"))


@query("""SELECT p_partkey, CAST(p_partkey * 8 AS BIGINT) AS l, CAST(floor((p_partkey - 1000) / 8.0) AS BIGINT) AS r, CASE WHEN p_partkey >= 1000 THEN CAST((p_partkey - 1000) // 8 AS BIGINT) ELSE 2305843009213693952 + CAST(floor((p_partkey - 1000) / 8.0) AS BIGINT) END AS u FROM part""")
def shifted_values(spark, d):
    """FN-6: three places to the left, to the right and unsigned to the right."""
    k = F.col("p_partkey")
    return b.load(spark, d, "part").select("p_partkey", arith.shifts(k, 3)[0].alias("l"), arith.shifts(k - 1000, 3)[1].alias("r"), arith.shifts(k - 1000, 3)[2].alias("u"))


# scores of projects ------------------------------------------------------------------------------

_PROJECTS = """p AS (SELECT l_suppkey % 9 AS lhs, 9 + l_partkey % 9 AS rhs, l_linenumber AS lt, CAST(l_quantity AS INT) % 7 + 1 AS rt, 0.75 + l_tax AS u, l_discount * 10 AS lr, 1 - l_discount * 5 AS rl FROM lineitem),
q AS (SELECT DISTINCT lhs, rhs FROM p), ww AS (SELECT range AS project, unnest(range(1, 8)) AS t FROM range(18)), w AS (SELECT project, t, 1 + (project + t) % 3 AS weight FROM ww),
a AS (SELECT lhs, rhs, lt, max(lr) AS best FROM p WHERE u >= 0.8 GROUP BY ALL), c AS (SELECT lhs, rhs, rt, max(rl) AS best FROM p WHERE u >= 0.8 GROUP BY ALL),
l AS (SELECT q.lhs, q.rhs, sum(coalesce(best, 0) * weight) / sum(weight) AS lsim FROM q JOIN w ON w.project = q.lhs LEFT JOIN a ON a.lhs = q.lhs AND a.rhs = q.rhs AND a.lt = w.t GROUP BY 1, 2),
r AS (SELECT q.lhs, q.rhs, sum(coalesce(best, 0) * weight) / sum(weight) AS rsim FROM q JOIN w ON w.project = q.rhs LEFT JOIN c ON c.lhs = q.lhs AND c.rhs = q.rhs AND c.rt = w.t GROUP BY 1, 2)"""


@query(f"WITH {_PROJECTS} SELECT lhs, rhs, round(greatest(lsim, rsim), 6) AS plaintiff, round(least(lsim, rsim), 6) AS score FROM l JOIN r USING (lhs, rhs)")
def project_similarity(spark, d):
    """SIM-7, SIM-8: lines are compared pairs of traces of nine projects against nine others."""
    pairs = b.load(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 9).alias("lhs"), (F.col("l_partkey") % 9 + 9).alias("rhs"), F.col("l_linenumber").alias("ltrace"), (F.col("l_quantity").cast("int") % 7 + 1).alias("rtrace"),
        (F.lit(0.75) + F.col("l_tax")).alias("union_sim"), (F.col("l_discount") * 10).alias("lr_sim"), (1 - F.col("l_discount") * 5).alias("rl_sim"),
    )
    weights = spark.range(18).select(F.col("id").alias("project"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("trace"))
    weights = weights.withColumn("weight", 1 + (F.col("project") + F.col("trace")) % 3)
    return scores.pair_scores(builder.project_scores(pairs, weights)).withColumns(_r("plaintiff", "score"))


@query("""WITH l AS (SELECT c_custkey AS k, c_nationkey AS lbl, 'call' || substr('abcdefghij', 1, 1 + c_custkey % 4) AS n, c_custkey % 40 AS ret FROM customer WHERE c_acctbal < 0),
r AS (SELECT s_suppkey AS k, s_nationkey AS lbl, 'call' || substr('abcdefghij', 1, 2 + s_suppkey % 9) AS n, s_suppkey % 40 AS ret FROM supplier)
SELECT l.k AS l, r.k AS r FROM l JOIN r ON l.lbl = r.lbl OR l.ret = r.ret OR starts_with(l.n, r.n) OR starts_with(r.n, l.n)""")
def residual_calls(spark, d):
    """JN-5 with FN-21: customers in debt and all suppliers are the calls left over of two graphs."""
    alphabet, kind = F.lit("abcdefghij"), F.lit("METHODCALL").alias("kind")
    name = lambda n: F.concat(F.lit("call"), F.substring(alphabet, F.lit(1), n.cast("int"))).alias("name")
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    left = b.load(spark, d, "customer").filter("c_acctbal < 0").select(c.alias("node_id"), kind, F.col("c_nationkey").alias("label"), name(1 + c % 4), (c % 40).alias("ret"))
    right = b.load(spark, d, "supplier").select(s.alias("node_id"), kind, F.col("s_nationkey").alias("label"), name(2 + s % 9), (s % 40).alias("ret"))
    return scores.residual(left, right)
