"""Execution graphs from trace records, and in-memory rewrites of single graphs.

Records are rows (graph_id, seq, kind, method, ref, scope, value, old_value, result, lhs, rhs,
idx, params, operator) whose values are VAL structs.  Node ids follow identity, not content:
a literal is a node for each instance (``uid``), symbols, strings, expressions and heap
objects are one node each.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VAL = "struct<uid:bigint,tag:string,type:string,text:string,symbol:int,heap_id:int,expr_id:bigint>"
RECORDS = (
    f"graph_id string, seq bigint, kind string, method string, operator string, ref {VAL}, scope {VAL}, value {VAL}, lhs {VAL}, rhs {VAL}, idx {VAL}, "
    f"result {VAL}, params array<{VAL}>"
)
_OPERATIONS = ("StackTransformation", "NotValueTransformation", "StackCast", "StringConcat", "Stringification")
_CALLS = ("StaticLibraryMethodCall", "InstanceLibraryMethodCall")


def value_id(v: Column) -> Column:
    """The node id of a value."""
    return (
        F.when(v["tag"] == "nil", F.lit("null"))
        .when(v["tag"] == "literal", F.concat(F.lit("v"), v["uid"]))
        .when(v["tag"] == "symbol", F.concat(F.lit("#"), v["symbol"]))
        .when(v["tag"] == "expr", F.concat(F.lit("e"), v["expr_id"]))
        .when(v["tag"] == "string", F.concat(F.lit("s:"), v["text"]))
        .when(v["tag"] == "ref", F.concat(v["heap_id"].cast("string"), F.lit("@")))
    )


def build_edges(records: DataFrame) -> DataFrame:
    """GR-1b..1f: (graph_id, seq, src, dst, kind, label): every record's edges in one projection."""
    own = F.concat(F.lit("n"), F.col("seq").cast("string"))
    e = lambda src, dst, kind, label=None: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if label is None else label).alias("label"))
    ident = lambda name: value_id(F.col(name))
    entry, kind = F.lit("ENTRYPOINT"), F.col("kind")
    args = F.transform(F.coalesce("params", F.array().cast(f"array<{VAL}>")), lambda p, i: e(value_id(p), own, "PARAMETER", F.concat(F.lit("$"), i.cast("string"))))
    cells = (
        F.when(kind == "EntryScope", F.array(e(ident("ref"), entry, "SCOPE")))
        .when(kind == "EntryParameter", F.array(e(entry, ident("ref"), "SUPPLIES")))
        .when(kind.isin(*_CALLS), F.concat(args, F.array(e(ident("scope"), own, "SCOPE"), e(own, ident("result"), "SUPPLIES"))))
        .when(kind.isin("ObjectFieldPut", "ArrayMemberPut", "DefaultInstanceFieldValue"), F.array(e(ident("value"), ident("ref"), "AGGREGATION", F.col("operator"))))
        .when(kind == "ArrayMemberGet", F.array(e(ident("idx"), ident("value"), "TRANSFORMATION")))
        .when(kind.isin(*_OPERATIONS), F.array(e(ident("lhs"), own, "TRANSFORMATION"), e(ident("rhs"), own, "TRANSFORMATION"), e(own, ident("result"), "TRANSFORMATION")))
    )
    return records.select("graph_id", "seq", F.inline(cells)).filter("src is not null and dst is not null")


def build_nodes(records: DataFrame) -> DataFrame:
    """GR-1a..1h: (graph_id, node_id, kind, label, flags): each node once, its flags or-ed over the records that set them."""
    own = F.concat(F.lit("n"), F.col("seq").cast("string"))
    kind = F.col("kind")
    no = F.lit(False)

    def n(ident: Column, node_kind, label: Column, param: Column = no, synthetic: Column = no, static: Column = no) -> Column:
        return F.struct(
            ident.alias("node_id"), (F.lit(node_kind) if isinstance(node_kind, str) else node_kind).alias("node_kind"), label.cast("string").alias("label"),
            param.alias("is_entry_param"), synthetic.alias("is_synthetic"), static.alias("is_static_field"),
        )

    def v(name_or_col, **flags) -> Column:
        c = F.col(name_or_col) if isinstance(name_or_col, str) else name_or_col
        return n(value_id(c), F.when(c["tag"] == "ref", "OBJECT").otherwise("VALUE"), F.coalesce(c["text"], c["type"]), **flags)

    synthetic = kind.isin("SynthesisedReturnValue", "DefaultInstanceFieldValue")
    cells = F.concat(
        F.array(
            n(F.when(kind == "EntryMethod", F.lit("ENTRYPOINT")), "ENTRYPOINT", F.col("method")),
            n(F.when(kind.isin(*_CALLS), own), "METHODCALL", F.col("method")),
            n(F.when(kind.isin(*_OPERATIONS), own), "OPERATOR", F.col("operator")),
            v("ref", param=kind == "EntryParameter"), v("scope"), v("lhs"), v("rhs"), v("idx"),
            v("value", synthetic=kind == "DefaultInstanceFieldValue", static=kind == "StaticFieldPut"), v("result", synthetic=kind == "SynthesisedReturnValue"),
        ),
        F.transform(F.coalesce("params", F.array().cast(f"array<{VAL}>")), lambda p: v(p)),
    )
    # default statics, assertions and ends have no effect on the graph
    rows = records.filter(~kind.isin("DefaultStaticFieldValue", "Assertion", "Halt", "UncaughtException")).select("graph_id", F.inline(cells)).filter("node_id is not null")
    return rows.groupBy("graph_id", "node_id").agg(
        F.first("node_kind", True).alias("kind"), F.max("label").alias("label"), *[F.bool_or(f).alias(f) for f in ("is_entry_param", "is_synthetic", "is_static_field")]
    )


def assertions(records: DataFrame) -> DataFrame:
    """GR-1g: assertions are kept aside."""
    return records.filter("kind = 'Assertion'").select("graph_id", "seq", "value", "result")


def array_lengths(nodes: DataFrame, heap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR-1h: a symbolic array that is touched has a length node and an AGGREGATION edge from it; heap is (graph_id, node_id, size_symbol)."""
    touched = heap.join(nodes.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
    size = F.concat(F.lit("#"), F.col("size_symbol").cast("string"))
    return (
        touched.select("graph_id", size.alias("node_id"), F.lit("VALUE").alias("kind"), F.lit("length").alias("label")).distinct(),
        touched.select("graph_id", size.alias("src"), F.col("node_id").alias("dst"), F.lit("AGGREGATION").alias("kind")),
    )


def unboxed(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxed strings and values collapse onto their inner value's node; boxes is (graph_id, box, inner)."""
    src = boxes.select("graph_id", F.col("box").alias("src"), F.col("inner").alias("_s"))
    dst = boxes.select("graph_id", F.col("box").alias("dst"), F.col("inner").alias("_d"))
    out = edges.join(src, ["graph_id", "src"], "left").join(dst, ["graph_id", "dst"], "left")
    return out.withColumns({"src": F.coalesce("_s", "src"), "dst": F.coalesce("_d", "dst")}).drop("_s", "_d")


def inputs(nodes: DataFrame) -> DataFrame:
    """GR-2, PRJ-10."""
    return nodes.filter("is_entry_param or is_synthetic").select("graph_id", "node_id")


def prune_chain(kinds: dict[str, str], edges: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """GR-6 on one graph: the edges that are left when operators over source-only inputs are folded away.

    Edges are a set here: an operand met twice counts once, and a unary operator's source stays where it is used
    elsewhere.  ``pruning.prune_tables`` counts edges, and is the form that follows the original in both.

    To a fixpoint: an operator with one result and only sources before it goes with its idle
    sources; one with a single connected input hands that input's edges on to its result.
    """
    into, out = defaultdict(set), defaultdict(set)
    for s, d in edges:
        into[d].add(s)
        out[s].add(d)

    def cut(s: str, d: str) -> None:
        into[d].discard(s)
        out[s].discard(d)

    def drop(node: str) -> None:
        for s in list(into[node]):
            cut(s, node)
        for d in list(out[node]):
            cut(node, d)

    todo = sorted(k for k, v in kinds.items() if v == "OPERATOR")
    changed = True
    while changed:
        changed = False
        for op in list(todo):
            if len(out[op]) != 1 or len(into[op]) not in (1, 2):
                continue
            result, args = next(iter(out[op])), sorted(into[op])
            free = [a for a in args if not into[a]]
            held = [a for a in args if into[a]]
            if not held:
                drop(op)
                for a in free:
                    if not out[a]:
                        drop(a)
            elif len(held) == 1 and (free or len(out[held[0]]) == 1):
                before = sorted(into[held[0]])
                for a in (op, *args):
                    drop(a)
                for s in before if not free else before[:1]:
                    into[result].add(s)
                    out[s].add(result)
            else:
                continue
            todo.remove(op)
            changed = True
    return {(s, d) for s in out for d in out[s]}


def prune(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-6 for many graphs: one graph in one task; nodes without edges are simply not in the result."""
    packed = nodes.groupBy("graph_id").agg(F.collect_list(F.struct("node_id", "kind")).alias("ns")).join(
        edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst")).alias("es")), "graph_id"
    )

    def run(batches):
        for pdf in batches:
            rows = [(g, s, d) for g, ns, es in zip(pdf["graph_id"], pdf["ns"], pdf["es"]) for s, d in sorted(prune_chain({n["node_id"]: n["kind"] for n in ns}, [(e["src"], e["dst"]) for e in es]))]
            yield pd.DataFrame(rows, columns=["graph_id", "src", "dst"])

    kind = nodes.schema["graph_id"].dataType.simpleString()
    return packed.mapInPandas(run, f"graph_id {kind}, src string, dst string")


def correlate(*mappings: list[tuple[str, str]]) -> dict[str, str]:
    """GR-8: pairs that every mapping agrees on: a node met with two partners is out for good, and so are both of a clash."""
    left: dict[str, str] = {}
    right: dict[str, str] = {}
    bad_l: set[str] = set()
    bad_r: set[str] = set()
    for l, r in (p for m in mappings for p in m):
        if l in bad_l or r in bad_r or left.get(l) == r:
            continue
        if l not in left and r not in right:
            left[l], right[r] = r, l
        else:
            left.pop(l, None)
            right.pop(r, None)
            bad_l.add(l)
            bad_r.add(r)
    return left


def project_scores(pairs: DataFrame, weights: DataFrame, threshold: float = 0.8) -> DataFrame:
    """SIM-7 (our definition; the original's is unknown): (lhs, rhs, lsim, rsim) of projects.

    pairs is (lhs, rhs, ltrace, rtrace, union_sim, lr_sim, rl_sim); pairs of traces below the
    threshold do not count.  lsim is the weighted mean over lhs traces of their best lr_sim,
    0 where nothing is left; rsim likewise.  weights is (project, trace, weight).
    """
    kept = pairs.filter(F.col("union_sim") >= threshold)

    def side(project: str, trace: str, sim: str, out: str) -> DataFrame:
        best = kept.groupBy("lhs", "rhs", F.col(trace).alias("trace")).agg(F.max(sim).alias("best"))
        w = weights.select(F.col("project").alias(project), "trace", "weight")
        every = pairs.select("lhs", "rhs").distinct().join(w, project)
        scored = every.join(best, ["lhs", "rhs", "trace"], "left")
        return scored.groupBy("lhs", "rhs").agg((F.sum(F.coalesce("best", F.lit(0.0)) * F.col("weight")) / F.sum("weight")).alias(out))

    return side("lhs", "ltrace", "lr_sim", "lsim").join(side("rhs", "rtrace", "rl_sim", "rsim"), ["lhs", "rhs"])
