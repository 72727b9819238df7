"""Counts of a trace's records and heap objects, by the names that the older feature sets use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.operators.descriptors import Counted, Measure, Plan

#: Columns of a flat record: what the counts are keyed by, already looked up in the heap.
FLAT = (
    "graph_id string, kind string, method string, signature string, owner string, field string, operator string, truth boolean, condition string, "
    "stack string, shape string, target_type string, value_type string"
)

#: AGG-19: (kind of record, name, columns of its key); a name without a key is a total (fixed values).
RECORD_FAMILIES = (
    ("EntryParameter", "ENTRYPOINT_PARAMETER", ()), ("EntryParameter", "ENTRYPOINT_HEAPTYPE", ("value_type",)),
    ("StaticLibraryMethodCall", "EXEC_CALL", ()), ("StaticLibraryMethodCall", "EXEC_STATIC_CALL", ()), ("StaticLibraryMethodCall", "EXEC_STATIC_CALL", ("method",)),
    ("InstanceLibraryMethodCall", "EXEC_CALL", ()), ("InstanceLibraryMethodCall", "EXEC_INSTANCE_CALL", ()),
    ("InstanceLibraryMethodCall", "EXEC_INSTANCE_QUALIFIED_CALL", ("method",)), ("InstanceLibraryMethodCall", "EXEC_INSTANCE_SIGNATURE_CALL", ("signature",)),
    ("SynthesisedReturnValue", "EXEC_SYNTHESISED", ()), ("SynthesisedReturnValue", "EXEC_SYNTHESISED_QUALIFIED", ("method",)), ("SynthesisedReturnValue", "EXEC_SYNTHESISED_SIGNATURE", ("signature",)),
    ("SynthesisedReturnValue", "EXEC_SYNTHESISED_STACKTYPE", ("stack",)), ("SynthesisedReturnValue", "EXEC_SYNTHESISED_HEAPTYPE", ("value_type",)),
    ("StaticFieldPut", "FIELD_STATIC_ASSIGNMENT", ()), ("StaticFieldPut", "FIELD_STATIC_ASSIGNMENT", ("owner",)), ("StaticFieldPut", "FIELD_STATIC_ASSIGNMENT", ("owner", "field")),
    ("StaticFieldPut", "FIELD_STATIC_ASSIGNMENT", ("field",)), ("StaticFieldPut", "FIELD_STATIC_ASSIGNMENT_STACKTYPE", ("stack",)), ("StaticFieldPut", "FIELD_STATIC_ASSIGNMENT_HEAPTYPE", ("value_type",)),
    ("ObjectFieldPut", "FIELD_INSTANCE_ASSIGNMENT", ()), ("ObjectFieldPut", "FIELD_INSTANCE_ASSIGNMENT", ("target_type",)),
    ("ObjectFieldPut", "FIELD_INSTANCE_ASSIGNMENT_STACKTYPE", ("stack",)), ("ObjectFieldPut", "FIELD_INSTANCE_ASSIGNMENT_HEAPTYPE", ("value_type",)),
    ("DefaultInstanceFieldValue", "FIELD_INSTANCE_SYNTHESISED", ("target_type",)),
    ("ArrayMemberPut", "ARRAY_PUT", ()), ("ArrayMemberPut", "ARRAY_PUT_ARRTYPE", ("target_type",)), ("ArrayMemberPut", "ARRAY_PUT_STACKTYPE", ("stack",)),
    ("ArrayMemberGet", "ARRAY_GET", ()), ("ArrayMemberGet", "ARRAY_GET_ARRTYPE", ("target_type",)), ("ArrayMemberGet", "ARRAY_GET_ARRTYPE", ("stack",)),
    ("StackTransformation", "STACK_TRANSFORM", ()), ("StackTransformation", "STACK_TRANSFORM_BINARY", ()),
    ("StackTransformation", "STACK_TRANSFORM_BINARY", ("operator",)), ("StackTransformation", "STACK_TRANSFORM_BINARY_RESULT", ("stack",)),
    ("NotValueTransformation", "STACK_TRANSFORM", ()), ("NotValueTransformation", "STACK_TRANSFORM_NOT", ()), ("StackCast", "STACK_TRANSFORM", ()), ("StackCast", "STACK_TRANSFORM_CAST", ()),
    ("StringConcat", "STRING_TRANSFORM_CONCAT", ()), ("StringConcat", "STRING_TRANSFORM_CONCAT_RESULT_TYPE", ("shape",)),
    ("Stringification", "STRING_TRANSFORM_STRINGIFICATION", ()), ("Stringification", "STRING_TRANSFORM_STRINGIFICATION_STACKTYPE", ("stack",)),
    ("Stringification", "STRING_TRANSFORM_STRINGIFICATION_STACKTYPE", ("shape",)), ("Stringification", "STRING_TRANSFORM_STRINGIFICATION_HEAPTYPE", ("value_type",)),
    ("Assertion", "ASSERTIONS", ()), ("Assertion", "ASSERTIONS_TYPE", ("kind",)), ("Assertion", "ASSERTIONS_BINARY_OPERATOR", ("operator",)),
    ("Halt", "HALT", ()), ("UncaughtException", "UNCAUGHT_EXCEPTIONS", ()), ("UncaughtException", "UNCAUGHT_EXCEPTIONS", ("owner",)),
)

#: Stack types, all of which are counted of a trace's parameters, absent ones as 0 (fixed values).
STACK_TYPES = ("REFERENCE", "VOID", "BYTE", "SHORT", "INT", "LONG", "FLOAT", "DOUBLE", "CHAR", "BOOLEAN")

#: What assertions are counted by: the classes of conditions, a computed one being NOT, BINARY or any other (fixed values).
CONDITIONS = {"SYMBOLIC": ("SYMBOLIC",), "COMPUTED": ("COMPUTED", "NOT", "BINARY"), "NOT": ("NOT",), "BINARY": ("BINARY",)}

#: AGG-19 for heaps: (name, kind of object, class of its value), null for any; totals of objects (fixed values).
HEAP_TOTALS = (
    ("HEAP", None, None), ("HEAP_CONCRETE_OBJECT", "ConcreteObject", None), ("HEAP_SYMBOLIC_OBJECT", "SymbolicObject", None), ("HEAP_ARRAY_OBJECT", "SymbolicArray", None),
    ("HEAP_CLASS_LIT_OBJECT", "ClassObject", None), ("HEAP_STRING", "BoxedString", None), ("HEAP_CONCRETE_STRING", "BoxedString", "ConcreteString"), ("HEAP_SYMBOLIC_STRING", "BoxedString", "SymbolicString"),
    ("HEAP_STRINGIFIED_STACK_VALUE", "BoxedString", "StackValueString"), ("HEAP_COMPOSITE_STACK_VALUE", "BoxedString", "CompositeString"), ("HEAP_BOXED", "BoxedStackValue", None),
)


def flat_records(records: DataFrame, heap: DataFrame) -> DataFrame:
    """JN-1 for the counts: records with (ref_id, value_id) get the types of the heap objects (graph_id, heap_id, type) they refer to.

    A heap is one trace's, so both look-ups are equi-joins by trace and object; a reference to nothing has no type.
    """
    types = lambda key, out: heap.select("graph_id", F.col("heap_id").alias(key), F.col("type").alias(out))
    return records.join(types("ref_id", "target_type"), ["graph_id", "ref_id"], "left").join(types("value_id", "value_type"), ["graph_id", "value_id"], "left").drop("ref_id", "value_id")


def _name(family: str, keys: tuple[str, ...]) -> Column:
    if not keys:
        return F.lit(f"{family}_COUNT")
    return F.concat(F.lit(f"{family}_"), F.concat_ws(":", *keys), F.lit("_COUNT"))


def _totals(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row for each trace and test, 0 where no row meets it, from one aggregation."""
    counts = rows.groupBy("graph_id").agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])
    return counts.select("graph_id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in tests])))


def record_descriptors() -> list[Measure | Counted]:
    """AGG-19: totals as measures, 0 where a trace has none, and counts by key."""
    kinds: dict[str, list[str]] = {}
    out: list[Measure | Counted] = []
    kind = F.col("kind")
    for of, family, keys in RECORD_FAMILIES:
        if keys:
            out.append(Counted(family, tuple(F.col(k) for k in keys), kind == of))
        else:
            kinds.setdefault(f"{family}_COUNT", []).append(of)
    holds = kind_tests(kinds)
    asserted = kind == "Assertion"
    for label, test in {"": asserted, **{f"{c}_": asserted & F.col("condition").isin(*of) for c, of in CONDITIONS.items()}}.items():
        if label:
            holds[f"ASSERTIONS_{label}COUNT"] = test
        holds[f"ASSERTIONS_{label}TRUTH_TRUE_COUNT"] = test & F.col("truth")
        holds[f"ASSERTIONS_{label}TRUTH_FALSE_COUNT"] = test & ~F.col("truth")
    for t in STACK_TYPES:
        holds[f"ENTRYPOINT_PARAMETER_STACKTYPE_{t}_COUNT"] = (kind == "EntryParameter") & (F.col("stack") == t)
    return [*(Measure(name, F.count_if(F.coalesce(test, F.lit(False)))) for name, test in holds.items()), *out]


def record_counts(records: DataFrame) -> DataFrame:
    """AGG-19: (graph_id, name, value) over flat records, from one read. Keys of two families that spell one name add up."""
    return Plan("graph_id", record_descriptors()).features(records).select("graph_id", "name", F.col("value").cast("bigint").alias("value"))


def kind_tests(kinds: dict[str, list[str]]) -> dict[str, Column]:
    return {name: F.col("kind").isin(*of) for name, of in kinds.items()}


def heap_counts(heap: DataFrame, defaults: DataFrame) -> DataFrame:
    """AGG-19: counts over heap objects (graph_id, heap_id, kind, type, value_class, stack).

    Objects are counted by type too, symbolic ones and arrays only where no default static (graph_id, heap_id) refers to them.
    """
    kind = F.col("kind")
    tests = {}
    for name, of, value in HEAP_TOTALS:
        test = kind.isNotNull() if of is None else kind == of
        tests[f"{name}_COUNT"] = test if value is None else test & (F.col("value_class") == value)
    of_type = {"ConcreteObject": "HEAP_CONCRETE_OBJECT", "SymbolicObject": "HEAP_SYMBOLIC_OBJECT", "SymbolicArray": "HEAP_ARRAY_OBJECT"}
    named = None
    for k, family in of_type.items():
        cell = _name(family, ("type",))
        named = F.when(kind == k, cell) if named is None else named.when(kind == k, cell)
    named = named.when(kind == "BoxedStackValue", _name("HEAP_BOXED", ("stack",)))
    plain = heap.filter(~kind.isin("SymbolicObject", "SymbolicArray"))
    own = heap.filter(kind.isin("SymbolicObject", "SymbolicArray")).join(defaults.select("graph_id", "heap_id").distinct(), ["graph_id", "heap_id"], "left_anti").select(*heap.columns)
    found = plain.unionByName(own).select("graph_id", named.alias("name")).filter("name is not null").groupBy("graph_id", "name").agg(F.count("*").alias("value"))
    return _totals(heap, tests).unionByName(found)


def entry_features(entries: DataFrame) -> DataFrame:
    """AGG-19 for entry points (graph_id, method, signature, scope_type): (graph_id, name, value, text), flags as 1 and 0, names as text."""
    flag = lambda name, value=1: F.struct(name.alias("name"), F.lit(value).cast("bigint").alias("value"), F.lit(None).cast("string").alias("text"))
    text = lambda name, column: F.struct(F.lit(name).alias("name"), F.lit(None).cast("bigint").alias("value"), F.col(column).alias("text"))
    scoped = F.col("scope_type").isNotNull()
    return entries.select("graph_id", F.inline(F.array(
        text("ENTRYPOINT_QUALIFIED_NAME", "method"), text("ENTRYPOINT_SIGNATURE_NAME", "signature"),
        flag(F.concat(F.lit("ENTRYPOINT_QUALIFIED_"), "method")), flag(F.concat(F.lit("ENTRYPOINT_SIGNATURE_"), "signature")),
        F.struct(F.lit("ENTRYPOINT_SCOPE_PRESENT").alias("name"), scoped.cast("bigint").alias("value"), F.lit(None).cast("string").alias("text")),
        flag(F.concat(F.lit("ENTRYPOINT_SCOPE_TYPE"), F.coalesce("scope_type", F.lit("NONE")))),
    )))
