"""Queries of older trace counts, typed arithmetic, names, assignments and stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.functions import arith, codes
from spoor.operators import builder, legacy, similarity, trace
from spoor.operators.rounds import shared_folder
from spoor.plans import bindings as b
from spoor.plans.program import _BUILT, _records
from spoor.plans.registry import query
from spoor.sources import readers, sinks

# legacy trace counts (B8): events are flat records, their kinds by k -----------------------------

KINDS = (
    "EntryParameter", "StaticLibraryMethodCall", "InstanceLibraryMethodCall", "SynthesisedReturnValue", "StaticFieldPut", "ObjectFieldPut", "DefaultInstanceFieldValue", "ArrayMemberPut", "ArrayMemberGet",
    "StackTransformation", "NotValueTransformation", "StackCast", "StringConcat", "Stringification", "Assertion", "Halt", "UncaughtException",
)

#: The stack types that the five event types stand for.
_STACKS = {"view": "INT", "click": "REFERENCE", "purchase": "LONG", "error": "BOOLEAN", "signup": "CHAR"}
_STACK_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STACKS.items()) + " END"

_FLAT = f"""x AS (SELECT user_id AS g, event_id AS seq, {_STACK_SQL} AS stack, value > 20 AS truth, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
h AS (SELECT DISTINCT g, seq % 7 AS id, 'T' || (seq % 7) AS type FROM x),
z AS (SELECT x.g, seq, stack, truth, ({list(KINDS)})[k % 17 + 1] AS kind, 'm' || (k % 2) AS sig, 'C' || (seq % 3) AS owner, 'f' || (seq % 2) AS field, 'S' || (seq % 2) AS shape,
  CASE WHEN k % 17 = 14 THEN (['SYMBOLIC', 'NOT', 'BINARY', 'COMPUTED'])[seq % 4 + 1] END AS cond, t.type AS target, v.type AS val
  FROM x LEFT JOIN h t ON t.g = x.g AND t.id = k % 9 LEFT JOIN h v ON v.g = x.g AND v.id = k % 7 AND seq % 3 <> 0),
r AS (SELECT *, CASE WHEN kind = 'StackTransformation' OR cond = 'BINARY' THEN CASE WHEN seq % 2 = 0 THEN 'ADD' ELSE 'MUL' END END AS op FROM z)"""


def _flat(spark, d) -> tuple[DataFrame, DataFrame]:
    e = b.load(spark, d, "events")
    k, seq = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    at = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    condition = F.when(k % 17 == 14, at(("SYMBOLIC", "NOT", "BINARY", "COMPUTED"), seq % 4))
    rows = e.select(
        F.col("user_id").alias("graph_id"), at(KINDS, k % 17).alias("kind"), F.concat(text("C", seq % 3), text(".m", k % 2)).alias("method"), text("m", k % 2).alias("signature"),
        text("C", seq % 3).alias("owner"), text("f", seq % 2).alias("field"), F.when((k % 17 == 9) | (condition == "BINARY"), at(("ADD", "MUL"), seq % 2)).alias("operator"),
        (F.col("value") > 20).alias("truth"), condition.alias("condition"), F.create_map(*[F.lit(x) for kv in _STACKS.items() for x in kv])[F.col("event_type")].alias("stack"), text("S", seq % 2).alias("shape"),
        (k % 9).cast("bigint").alias("ref_id"), F.when(seq % 3 != 0, k % 7).cast("bigint").alias("value_id"),
    )
    heap = e.select(F.col("user_id").alias("graph_id"), (seq % 7).alias("heap_id"), text("T", seq % 7).alias("type")).distinct()
    return rows, heap


def _total(name: str, test: str) -> str:
    return f"SELECT g, '{name}_COUNT', count(*) FILTER (WHERE {test}) FROM r GROUP BY g"


def _keyed(name: str, key: str, test: str) -> str:
    return f"SELECT g, '{name}_' || {key} || '_COUNT', count(*) FROM r WHERE {test} AND {key} IS NOT NULL GROUP BY g, {key}"


_RECORD_COUNTS = " UNION ALL ".join([
    _total("ENTRYPOINT_PARAMETER", "kind = 'EntryParameter'"), *[_total(f"ENTRYPOINT_PARAMETER_STACKTYPE_{t}", f"kind = 'EntryParameter' AND stack = '{t}'") for t in legacy.STACK_TYPES], _keyed("ENTRYPOINT_HEAPTYPE", "val", "kind = 'EntryParameter'"),
    _total("EXEC_CALL", "kind LIKE '%LibraryMethodCall'"), _total("EXEC_STATIC_CALL", "kind LIKE 'StaticLib%'"), _total("EXEC_INSTANCE_CALL", "kind LIKE 'InstanceLib%'"),
    _keyed("EXEC_STATIC_CALL", "(owner || '.' || sig)", "kind LIKE 'StaticLib%'"), _keyed("EXEC_INSTANCE_QUALIFIED_CALL", "(owner || '.' || sig)", "kind LIKE 'InstanceLib%'"), _keyed("EXEC_INSTANCE_SIGNATURE_CALL", "sig", "kind LIKE 'InstanceLib%'"),
    _total("EXEC_SYNTHESISED", "kind LIKE 'Synth%'"), _keyed("EXEC_SYNTHESISED_QUALIFIED", "(owner || '.' || sig)", "kind LIKE 'Synth%'"), _keyed("EXEC_SYNTHESISED_SIGNATURE", "sig", "kind LIKE 'Synth%'"),
    _keyed("EXEC_SYNTHESISED_STACKTYPE", "stack", "kind LIKE 'Synth%'"), _keyed("EXEC_SYNTHESISED_HEAPTYPE", "val", "kind LIKE 'Synth%'"),
    _total("FIELD_STATIC_ASSIGNMENT", "kind = 'StaticFieldPut'"), _keyed("FIELD_STATIC_ASSIGNMENT", "owner", "kind = 'StaticFieldPut'"), _keyed("FIELD_STATIC_ASSIGNMENT", "(owner || ':' || field)", "kind = 'StaticFieldPut'"),
    _keyed("FIELD_STATIC_ASSIGNMENT", "field", "kind = 'StaticFieldPut'"), _keyed("FIELD_STATIC_ASSIGNMENT_STACKTYPE", "stack", "kind = 'StaticFieldPut'"), _keyed("FIELD_STATIC_ASSIGNMENT_HEAPTYPE", "val", "kind = 'StaticFieldPut'"),
    _total("FIELD_INSTANCE_ASSIGNMENT", "kind = 'ObjectFieldPut'"), _keyed("FIELD_INSTANCE_ASSIGNMENT", "target", "kind = 'ObjectFieldPut'"), _keyed("FIELD_INSTANCE_ASSIGNMENT_STACKTYPE", "stack", "kind = 'ObjectFieldPut'"),
    _keyed("FIELD_INSTANCE_ASSIGNMENT_HEAPTYPE", "val", "kind = 'ObjectFieldPut'"), _keyed("FIELD_INSTANCE_SYNTHESISED", "target", "kind = 'DefaultInstanceFieldValue'"),
    _total("ARRAY_PUT", "kind = 'ArrayMemberPut'"), _keyed("ARRAY_PUT_ARRTYPE", "target", "kind = 'ArrayMemberPut'"), _keyed("ARRAY_PUT_STACKTYPE", "stack", "kind = 'ArrayMemberPut'"),
    _total("ARRAY_GET", "kind = 'ArrayMemberGet'"), _keyed("ARRAY_GET_ARRTYPE", "target", "kind = 'ArrayMemberGet'"), _keyed("ARRAY_GET_ARRTYPE", "stack", "kind = 'ArrayMemberGet'"),
    _total("STACK_TRANSFORM", "kind IN ('StackTransformation', 'NotValueTransformation', 'StackCast')"), _total("STACK_TRANSFORM_BINARY", "kind = 'StackTransformation'"), _total("STACK_TRANSFORM_NOT", "kind = 'NotValueTransformation'"),
    _total("STACK_TRANSFORM_CAST", "kind = 'StackCast'"), _keyed("STACK_TRANSFORM_BINARY", "op", "kind = 'StackTransformation'"), _keyed("STACK_TRANSFORM_BINARY_RESULT", "stack", "kind = 'StackTransformation'"),
    _total("STRING_TRANSFORM_CONCAT", "kind = 'StringConcat'"), _keyed("STRING_TRANSFORM_CONCAT_RESULT_TYPE", "shape", "kind = 'StringConcat'"), _total("STRING_TRANSFORM_STRINGIFICATION", "kind = 'Stringification'"),
    _keyed("STRING_TRANSFORM_STRINGIFICATION_STACKTYPE", "stack", "kind = 'Stringification'"), _keyed("STRING_TRANSFORM_STRINGIFICATION_STACKTYPE", "shape", "kind = 'Stringification'"),
    _keyed("STRING_TRANSFORM_STRINGIFICATION_HEAPTYPE", "val", "kind = 'Stringification'"),
    _total("ASSERTIONS", "kind = 'Assertion'"), _total("ASSERTIONS_TRUTH_TRUE", "kind = 'Assertion' AND truth"), _total("ASSERTIONS_TRUTH_FALSE", "kind = 'Assertion' AND NOT truth"),
    _keyed("ASSERTIONS_TYPE", "kind", "kind = 'Assertion'"), _keyed("ASSERTIONS_BINARY_OPERATOR", "op", "kind = 'Assertion'"),
    *[_total(f"ASSERTIONS_{c}{suffix}", f"cond IN ({of}){test}") for c, of in (("SYMBOLIC", "'SYMBOLIC'"), ("COMPUTED", "'COMPUTED', 'NOT', 'BINARY'"), ("NOT", "'NOT'"), ("BINARY", "'BINARY'"))
      for suffix, test in (("", ""), ("_TRUTH_TRUE", " AND truth"), ("_TRUTH_FALSE", " AND NOT truth"))],
    _total("HALT", "kind = 'Halt'"), _total("UNCAUGHT_EXCEPTIONS", "kind = 'UncaughtException'"), _keyed("UNCAUGHT_EXCEPTIONS", "owner", "kind = 'UncaughtException'"),
])


@query(f"WITH {_FLAT}, f(g, name, value) AS ({_RECORD_COUNTS}) SELECT g AS graph_id, name, value FROM f")
def legacy_record_counts(spark, d):
    """AGG-19 on B8: nine families of counts over records and the heap objects they refer to."""
    return legacy.record_counts(legacy.flat_records(*_flat(spark, d)))


_OBJECTS = """o AS (SELECT p_brand AS g, p_partkey AS id, (['ConcreteObject', 'SymbolicObject', 'SymbolicArray', 'ClassObject', 'BoxedString', 'BoxedStackValue'])[p_partkey % 6 + 1] AS kind, p_type AS type,
  (['ConcreteString', 'SymbolicString', 'StackValueString', 'CompositeString'])[p_size % 4 + 1] AS vc, 'I' || (p_size % 3) AS stack, p_partkey % 5 = 0 AS dflt FROM part)"""


@query(f"""WITH {_OBJECTS}, t(g, c) AS (SELECT g, unnest([
  {{'n': 'HEAP', 'v': count(*)}}, {{'n': 'HEAP_CONCRETE_OBJECT', 'v': count(*) FILTER (WHERE kind = 'ConcreteObject')}}, {{'n': 'HEAP_SYMBOLIC_OBJECT', 'v': count(*) FILTER (WHERE kind = 'SymbolicObject')}},
  {{'n': 'HEAP_ARRAY_OBJECT', 'v': count(*) FILTER (WHERE kind = 'SymbolicArray')}}, {{'n': 'HEAP_CLASS_LIT_OBJECT', 'v': count(*) FILTER (WHERE kind = 'ClassObject')}},
  {{'n': 'HEAP_STRING', 'v': count(*) FILTER (WHERE kind = 'BoxedString')}}, {{'n': 'HEAP_CONCRETE_STRING', 'v': count(*) FILTER (WHERE kind = 'BoxedString' AND vc = 'ConcreteString')}},
  {{'n': 'HEAP_SYMBOLIC_STRING', 'v': count(*) FILTER (WHERE kind = 'BoxedString' AND vc = 'SymbolicString')}}, {{'n': 'HEAP_STRINGIFIED_STACK_VALUE', 'v': count(*) FILTER (WHERE kind = 'BoxedString' AND vc = 'StackValueString')}},
  {{'n': 'HEAP_COMPOSITE_STACK_VALUE', 'v': count(*) FILTER (WHERE kind = 'BoxedString' AND vc = 'CompositeString')}}, {{'n': 'HEAP_BOXED', 'v': count(*) FILTER (WHERE kind = 'BoxedStackValue')}}]) FROM o GROUP BY g)
SELECT g AS graph_id, c.n || '_COUNT' AS name, c.v AS value FROM t
UNION ALL SELECT g, 'HEAP_CONCRETE_OBJECT_' || type || '_COUNT', count(*) FROM o WHERE kind = 'ConcreteObject' GROUP BY g, type
UNION ALL SELECT g, 'HEAP_SYMBOLIC_OBJECT_' || type || '_COUNT', count(*) FROM o WHERE kind = 'SymbolicObject' AND NOT dflt GROUP BY g, type
UNION ALL SELECT g, 'HEAP_ARRAY_OBJECT_' || type || '_COUNT', count(*) FROM o WHERE kind = 'SymbolicArray' AND NOT dflt GROUP BY g, type
UNION ALL SELECT g, 'HEAP_BOXED_' || stack || '_COUNT', count(*) FROM o WHERE kind = 'BoxedStackValue' GROUP BY g, stack""")
def legacy_heap_counts(spark, d):
    """AGG-19: parts are the heap objects of their brand; every fifth is a default static's value."""
    k, size = F.col("p_partkey"), F.col("p_size")
    at = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    heap = b.load(spark, d, "part").select(
        F.col("p_brand").alias("graph_id"), k.alias("heap_id"), at(("ConcreteObject", "SymbolicObject", "SymbolicArray", "ClassObject", "BoxedString", "BoxedStackValue"), k % 6).alias("kind"), F.col("p_type").alias("type"),
        at(("ConcreteString", "SymbolicString", "StackValueString", "CompositeString"), size % 4).alias("value_class"), F.concat(F.lit("I"), (size % 3).cast("string")).alias("stack"),
    )
    return legacy.heap_counts(heap, heap.filter(F.col("heap_id") % 5 == 0).select("graph_id", "heap_id"))


@query("""WITH e AS (SELECT c_custkey AS g, 'C' || c_nationkey || '.m' || (c_custkey % 3) AS q, 'm' || (c_custkey % 3) AS s, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS scope FROM customer)
SELECT g AS graph_id, 'ENTRYPOINT_QUALIFIED_NAME' AS name, NULL AS value, q AS text FROM e UNION ALL SELECT g, 'ENTRYPOINT_SIGNATURE_NAME', NULL, s FROM e
UNION ALL SELECT g, 'ENTRYPOINT_QUALIFIED_' || q, 1, NULL FROM e UNION ALL SELECT g, 'ENTRYPOINT_SIGNATURE_' || s, 1, NULL FROM e
UNION ALL SELECT g, 'ENTRYPOINT_SCOPE_PRESENT', CASE WHEN scope IS NULL THEN 0 ELSE 1 END, NULL FROM e UNION ALL SELECT g, 'ENTRYPOINT_SCOPE_TYPE' || coalesce(scope, 'NONE'), 1, NULL FROM e""")
def legacy_entry_features(spark, d):
    """AGG-19: customers are traces, their segment the type of the scope of those not in debt."""
    k = F.col("c_custkey")
    sig = F.concat(F.lit("m"), (k % 3).cast("string"))
    return legacy.entry_features(b.load(spark, d, "customer").select(k.alias("graph_id"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string"), F.lit("."), sig).alias("method"), sig.alias("signature"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("scope_type")))


# typed values and names ------------------------------------------------------------------------


@query("""WITH v AS (SELECT p_partkey AS k, (['B', 'S', 'I', 'J', 'F', 'D', 'C', 'Z'])[p_partkey % 8 + 1] AS ka, (['B', 'S', 'I', 'J', 'F', 'D', 'C', 'Z'])[p_size % 8 + 1] AS kb, p_size, p_retailprice FROM part),
w AS (SELECT k, ka, kb, CASE ka WHEN 'B' THEN 127 - k % 9 WHEN 'S' THEN 32767 - k % 9 WHEN 'I' THEN 2147483647 - k % 99 WHEN 'J' THEN 9223372036854775807 - k % 99 WHEN 'C' THEN k % 65536 WHEN 'Z' THEN k % 2 END::HUGEINT AS a, CASE WHEN ka IN ('F', 'D') THEN p_retailprice END AS ar,
  CASE WHEN kb NOT IN ('F', 'D') THEN p_size END::HUGEINT AS b, CASE WHEN kb IN ('F', 'D') THEN p_size * 1.0E0 END AS br FROM v),
t AS (SELECT *, CASE WHEN 'C' IN (ka, kb) THEN 'I' WHEN 'Z' IN (ka, kb) THEN NULL WHEN 'D' IN (ka, kb) THEN 'D' WHEN 'F' IN (ka, kb) THEN 'F' WHEN 'J' IN (ka, kb) THEN 'J' WHEN 'I' IN (ka, kb) THEN 'I' WHEN 'S' IN (ka, kb) THEN 'S' ELSE 'B' END AS rt,
  coalesce(a, CAST(trunc(ar) AS HUGEINT)) + coalesce(b, CAST(trunc(br) AS HUGEINT)) AS s FROM w)
SELECT k, rt AS type, CASE rt WHEN 'J' THEN CASE WHEN s > 9223372036854775807 THEN s - 18446744073709551616 ELSE s END WHEN 'I' THEN CASE WHEN s > 2147483647 THEN ((s + 2147483648) % 4294967296) - 2147483648 ELSE s END
  WHEN 'S' THEN (s + 32768) % 65536 - 32768 WHEN 'B' THEN (s + 128) % 256 - 128 END::BIGINT AS whole,
  CASE rt WHEN 'D' THEN coalesce(ar, CAST(a AS DOUBLE)) + coalesce(br, CAST(b AS DOUBLE)) WHEN 'F' THEN CAST(CAST(coalesce(ar, CAST(a AS DOUBLE)) AS FLOAT) + CAST(coalesce(br, CAST(b AS DOUBLE)) AS FLOAT) AS DOUBLE) END AS real FROM t""")
def promoted_sums(spark, d):
    """FN-1: sums of parts' numbers of all pairs of types, at the ends of their ranges."""
    k, size = F.col("p_partkey"), F.col("p_size")
    types = F.array(*[F.lit(x) for x in ("B", "S", "I", "J", "F", "D", "C", "Z")])
    at, bt = F.element_at(types, (k % 8 + 1).cast("int")), F.element_at(types, (size % 8 + 1).cast("int"))
    whole = (
        F.when(at == "B", 127 - k % 9).when(at == "S", 32767 - k % 9).when(at == "I", F.lit(2147483647) - k % 99).when(at == "J", F.lit(9223372036854775807) - k % 99)
        .when(at == "C", k % 65536).when(at == "Z", k % 2)
    )
    real = F.col("p_retailprice")
    left = F.struct(at.alias("type"), whole.cast("bigint").alias("whole"), F.when(at.isin("F", "D"), real).alias("real"))
    total = arith.promoted_add(left, arith.number(bt, size))
    return b.load(spark, d, "part").select(k.alias("k"), total["type"].alias("type"), total["whole"].alias("whole"), total["real"].alias("real"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_custkey::VARCHAR END || CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE c_nationkey::VARCHAR END END AS text,
CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN 'J' END AS type, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN c_custkey + c_nationkey END AS whole FROM customer""")
def object_sums(spark, d):
    """FN-10: customers' texts and boxed numbers, added or joined."""
    k = F.col("c_custkey")
    side = lambda text, kind, n: F.struct(text.alias("text"), F.when(text.isNull(), arith.number(F.lit(kind), n)).alias("number"))
    out = arith.object_add(side(F.when(k % 3 == 0, F.col("c_mktsegment")), "J", k), side(F.when(k % 5 == 0, F.col("c_name")), "I", F.col("c_nationkey")))
    return b.load(spark, d, "customer").select(k.alias("k"), out["text"].alias("text"), out["number"]["type"].alias("type"), out["number"]["whole"].alias("whole"))


@query("""SELECT p_partkey AS k, p_size || ' INT' AS value_label, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_size < 10 THEN 'EMPTY' ELSE p_name END WHEN 1 THEN '#' || p_size || ' STRING' WHEN 2 THEN p_size || ' INT' ELSE '#CS:' || p_partkey END AS string_label FROM part""")
def value_labels(spark, d):
    """FN-37."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("concrete", "symbolic", "stack", "composite")]), (k % 4 + 1).cast("int"))
    text = F.when(kind == "symbolic", size.cast("string")).when(size < 10, "").otherwise(F.col("p_name"))
    label = codes.value_label(size, F.lit("INT"))
    return b.load(spark, d, "part").select(k.alias("k"), label.alias("value_label"), codes.string_label(kind, text, label, k).alias("string_label"))


_ODD = "<a>[b](c)/d.e,f#g h%i@j+k-l=m*n"


@query(f"""SELECT p_partkey AS k, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(p_type || '{_ODD}',
'<', '_LESS_'), '>', '_GRTR_'), '[', '_LBRACE_'), ']', '_RBRACE_'), '(', '_LPAR_'), ')', '_RPAR_'), '/', '_DIV_'), '.', '_DOT_'), ',', '_COMA_'), '#', '_HASH_'), ' ', '_SPACE_'), '%', 'PERC'), '@', 'AT'), '+', 'PLUS'), '-', 'MINUS'), '=', 'EQUALS'), '*', 'MULTIPLY') AS name FROM part""")
def legacy_names(spark, d):
    """FN-31: the older table of names."""
    return b.load(spark, d, "part").select(F.col("p_partkey").alias("k"), codes.sanitise(F.concat(F.col("p_type"), F.lit(_ODD)), codes.SANITISED_BRANCH).alias("name"))


@query("SELECT 'java/' || p_brand AS class_sig, count(*) AS cnt FROM part WHERE p_size < 25 GROUP BY 1")
def library_calls(spark, d):
    """PRJ-3: calls of small parts are the library's."""
    calls = b.load(spark, d, "part").select(F.concat(F.when(F.col("p_size") < 25, "java/").otherwise("app/java/"), F.col("p_brand")).alias("class_sig"))
    return trace.library_calls(calls).groupBy("class_sig").agg(F.count("*").alias("cnt"))


# assignment -----------------------------------------------------------------------------------


def _costs(spark, d) -> DataFrame:
    """Each order's lines against themselves: the cost of two is how far one's discount is from the other's tax."""
    lines = b.load(spark, d, "lineitem")
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = lines.select(F.col("l_orderkey").alias("grp"), place.alias("i"), "l_discount", "l_tax")
    return rows.select("grp", "i", "l_discount").join(rows.select("grp", F.col("i").alias("j"), "l_tax"), "grp").select("grp", "i", "j", F.abs(F.col("l_discount") - F.col("l_tax")).alias("cost"))


@query("""WITH a AS (SELECT l_orderkey AS grp, l_discount AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount) AS r FROM lineitem),
t AS (SELECT l_orderkey AS grp, l_tax AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_tax) AS r FROM lineitem)
SELECT grp, count(*) AS assigned, round(sum(abs(x - y)), 6) AS cost FROM a JOIN t USING (grp, r) GROUP BY grp""")
def optimal_assignment_cost(spark, d):
    """SIM-1: for distances on a line the best assignment joins the values in order, which SQL can tell."""
    out = similarity.assign(_costs(spark, d), "grp", "i", "j", "cost")
    return out.groupBy("grp").agg(F.count("*").alias("assigned"), F.round(F.sum(1 - F.col("similarity")), 6).alias("cost"))


@query("""WITH RECURSIVE p AS (SELECT l_orderkey AS grp, l_discount AS x, l_tax AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
c AS (SELECT a.grp, a.i, list({'cost': abs(a.x - b.y), 'j': b.i} ORDER BY abs(a.x - b.y), b.i) AS cs FROM p a JOIN p b ON a.grp = b.grp GROUP BY 1, 2),
w AS (SELECT grp, i, cs[1].j AS j, cs[1].cost AS cost, [cs[1].j] AS used FROM c WHERE i = 1
  UNION ALL SELECT grp, i, pick.j, pick.cost, list_append(used, pick.j) FROM (SELECT c.grp, c.i, w.used, list_filter(c.cs, lambda z: NOT list_contains(w.used, z.j))[1] AS pick FROM w JOIN c ON c.grp = w.grp AND c.i = w.i + 1))
SELECT grp, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(1 - cost, 6) AS similarity FROM w WHERE 1 - cost >= 0.97""")
def greedy_matches(spark, d):
    """SIM-2, SIM-3: row after row takes the cheapest free column; pairs of 0.97 and more count."""
    return similarity.assign(_costs(spark, d), "grp", "i", "j", "cost", "greedy", 0.97).withColumn("similarity", F.round("similarity", 6))


# stored tables --------------------------------------------------------------------------------


def _folder(spark, label: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@query(f"WITH {_BUILT} SELECT 'p' || (CAST(substr(g, 2) AS INT) % 3) AS project_id, 'La.B;m()V' AS entry_point, kind, count(*) AS cnt FROM e GROUP BY ALL")
def stored_traces(spark, d):
    """SRC-9, SNK-1, GR-1 on B6: records are written by project and entry point, read back, and their graphs built."""
    path = _folder(spark, "traces")
    project = F.concat(F.lit("p"), (F.substring("graph_id", 2, 20).cast("int") % 3).cast("string"))
    sinks.traces(_records(spark, d).withColumns({"project_id": project, "entry_point": F.lit("La/B;m()V"), "trace_id": F.col("graph_id")}), path)
    records = readers.traces(spark, path, builder.RECORDS)
    where = records.select("graph_id", "project_id", "entry_point").distinct()
    return builder.build_edges(records).join(where, "graph_id").groupBy("project_id", "entry_point", "kind").agg(F.count("*").alias("cnt"))


@query("SELECT 's' || l_suppkey AS lhs, 'p' || l_partkey AS rhs, max(l_tax) AS score FROM lineitem GROUP BY 1, 2")
def stored_scores(spark, d):
    """SRC-12, SNK-7: scores of pairs, written and read back."""
    rows = b.load(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("lhs"), F.concat(F.lit("p"), "l_partkey").alias("rhs")).agg(F.max("l_tax").alias("score"))
    path = _folder(spark, "scores")
    sinks.scores(rows, path)
    return readers.scores(spark, path)


@query("SELECT c_name AS rhs, c_acctbal AS score FROM customer")
def stored_plaintiff_scores(spark, d):
    """SRC-13, SNK-8: with a header; the left side is the file's name, which a cluster chooses."""
    path = _folder(spark, "plaintiff")
    sinks.plaintiff_scores(b.load(spark, d, "customer").select(F.col("c_name").alias("program"), F.col("c_acctbal").alias("similarity")), path)
    return readers.headed_scores(spark, path).select("rhs", "score")


@query("SELECT s_name AS lhs, 'n' || s_nationkey AS rhs, s_acctbal AS lsim, s_acctbal / 2 AS rsim FROM supplier")
def stored_pair_results(spark, d):
    """SNK-9: results of pairs as JSON, read back."""
    path = _folder(spark, "pairs")
    sinks.pair_results(b.load(spark, d, "supplier").select(F.col("s_name").alias("lhs"), F.concat(F.lit("n"), "s_nationkey").alias("rhs"), F.col("s_acctbal").alias("lsim"), (F.col("s_acctbal") / 2).alias("rsim")), path)
    return spark.read.schema("lhs string, rhs string, lsim double, rsim double").json(path)


@query("""SELECT s_nationkey AS graph_id, 'n' || s_nationkey AS src, 's' || s_suppkey AS dst, 'TRANSFORMATION' AS kind, CAST(floor(s_acctbal) AS BIGINT) % 4 AS label FROM supplier""")
def stored_graphs(spark, d):
    """SRC-10, SNK-2, SNK-3: graphs packed as rows, written as an artefact, read back and unpacked."""
    n, e = b.supply_graphs(spark, d)
    path = _folder(spark, "models")
    sinks.artefacts({"execgraph": sinks.packed_graphs(n, e)}, n.groupBy("graph_id").agg(F.count("*").alias("weight")), path)
    nodes, edges = sinks.unpacked_graphs(spark.read.parquet(f"{path}/execgraph"))
    return edges.join(nodes.select("graph_id", F.col("node_id").alias("dst"), "label"), ["graph_id", "dst"]).select("graph_id", "src", "dst", "kind", F.col("label").cast("bigint").alias("label"))


@query("""WITH d AS (SELECT 'type' AS what, 'T' || (n_nationkey % 20) AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'class' ELSE 'enum' END AS detail, 'u' || n_regionkey AS unit, n_nationkey AS place, 0 AS pos FROM nation
UNION ALL SELECT 'method', 'T' || (n_nationkey % 20) || '.m' || (s_suppkey % 3) || '()V', 'm' || s_suppkey, 'u' || n_regionkey, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'field', 'T' || (n_nationkey % 20) || '.f' || (s_suppkey % 2), 't' || s_suppkey, 'u' || n_regionkey, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT what, key, arg_max(detail, (unit, place, pos)) AS detail, max(unit) AS unit FROM d GROUP BY 1, 2""")
def declared_members(spark, d):
    """SRC-8: regions are units, nations types, suppliers methods and fields; keys are declared more than once."""
    n, s = b.load(spark, d, "nation"), b.load(spark, d, "supplier")
    k = F.col("s_suppkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    method = F.struct(F.concat(name("m", k % 3), F.lit("()V")).alias("sig"), name("m", k).alias("name"))
    field = F.struct(name("f", k % 2).alias("name"), name("t", k).alias("type"))
    owned = s.groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.struct(k.alias("k"), method.alias("m"), field.alias("f")))).alias("o"))
    of = lambda what: F.coalesce(F.transform("o", lambda x: x[what]), F.array())
    types = n.join(owned, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        "n_regionkey", F.struct(F.col("n_nationkey").alias("at"), name("T", F.col("n_nationkey") % 20).alias("sig"), F.when(F.col("n_nationkey") % 2 == 0, "class").otherwise("enum").alias("kind"), of("m").alias("methods"), of("f").alias("fields")).alias("t")
    )
    units = types.groupBy(name("u", F.col("n_regionkey")).alias("unit")).agg(F.sort_array(F.collect_list(F.col("t"))).alias("types"))
    t, m, f = readers.declarations(units)
    row = lambda df, what, key, detail: df.select(F.lit(what).alias("what"), F.col(key).alias("key"), F.col(detail).alias("detail"), "unit")
    return row(t, "type", "type", "kind").unionByName(row(m, "method", "method", "name")).unionByName(row(f, "field", "field", "type"))
