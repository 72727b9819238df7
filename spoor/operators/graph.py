"""Property graphs as two tables: shares, ratios, signatures, reachability and leftovers.

nodes(graph_id, node_id, kind, label) and edges(graph_id, src, dst, kind).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial
from itertools import count, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.operators import tiles
from spoor.operators.rounds import cleaned, shared_folder

NODE_KINDS = ("VALUE", "OBJECT", "OPERATOR", "ENTRYPOINT", "METHODCALL")
EDGE_KINDS = ("SCOPE", "SUPPLIES", "PARAMETER", "AGGREGATION", "TRANSFORMATION")
#: GR-3: (kind class of the node, kind of the edge, out or in) that taint follows (fixed values).
TAINT_RULES = (
    ("DATA", "TRANSFORMATION", "out"), ("DATA", "AGGREGATION", "out"), ("DATA", "SUPPLIES", "out"), ("DATA", "PARAMETER", "out"), ("DATA", "SCOPE", "out"),
    ("DATA", "AGGREGATION", "in"), ("DATA", "SCOPE", "in"), ("OPERATOR", "TRANSFORMATION", "out"), ("METHODCALL", "SUPPLIES", "out"), ("METHODCALL", "SCOPE", "out"),
)


def node_class(kind):
    """PRJ-6: values and objects are data."""
    return F.when(kind.isin("VALUE", "OBJECT"), "DATA").otherwise(kind)


#: PRJ-6: what is asked of nodes and of edges.
NODE_TRAITS = {
    "is_value": "kind = 'VALUE'", "is_object": "kind = 'OBJECT'", "is_operator": "kind = 'OPERATOR'", "is_entry_point": "kind = 'ENTRYPOINT'", "is_method_call": "kind = 'METHODCALL'",
    "is_data": "kind in ('VALUE', 'OBJECT')", "is_entry_parameter": "is_entry_param", "is_synthetic": "is_synthetic", "is_concrete": "is_concrete", "is_symbolic": "is_symbolic",
    "is_string": "string is not null",
}


def classify_nodes(nodes: DataFrame) -> DataFrame:
    """PRJ-6: each trait of a node as a column; an attribute that is not set is no."""
    return nodes.select("graph_id", "node_id", *[F.coalesce(F.expr(e), F.lit(False)).alias(name) for name, e in NODE_TRAITS.items()])


def classify_edges(edges: DataFrame) -> DataFrame:
    """PRJ-6: each kind of an edge as a column."""
    return edges.select("graph_id", "src", "dst", *[F.coalesce(F.col("kind") == k, F.lit(False)).alias(f"is_{k.lower()}") for k in EDGE_KINDS])


#: AGG-20: (name of a family, columns of its key) of nodes; a node without an attribute is not of the family.
COUNT_FAMILIES = (
    ("LABEL", ("label",)), ("CLASS", ("ui_class",)), ("NODETYPE", ("kind",)), ("TYPESIGNATURE", ("type_sig",)), ("OPERATOR", ("operator",)), ("CASTTYPE", ("cast_type",)),
    ("QUALIFED_SIGNATURE", ("method",)), ("SIGNATURE", ("method_name",)), ("VALUE", ("value_kind", "value_type")), ("CONCRETEVALUE", ("value", "value_class")),
    ("STRING", ("string",)), ("CONCRETESTRING", ("string_text",)), ("REPRESENTINGTYPE", ("representing",)),
)


def legacy_counts(nodes: DataFrame, edges: DataFrame, prefix: str) -> DataFrame:
    """AGG-20: (graph_id, name, value): how often each key of each family occurs, the literals, and the edges by kind and label.

    Every family is a cell of one array, so nodes are read and shuffled once.
    """
    plain = ("CONCRETESTRING", "REPRESENTINGTYPE")  # these names have no ending

    def cell(family: str, keys: tuple[str, ...]):
        name = F.concat(F.lit(f"GRAPH_{prefix}_{family}_"), F.concat_ws("_", *(F.col(k).cast("string") for k in keys)), F.lit("" if family in plain else "_COUNT"))
        present = F.col(keys[0]).isNotNull()
        for k in keys[1:]:
            present &= F.col(k).isNotNull()
        return F.when(present, name)

    of_nodes = [cell(f, keys) for f, keys in COUNT_FAMILIES if set(keys) <= set(nodes.columns)]
    of_edges = [cell("EDGETYPE", ("kind",)), *([cell("LABEL", ("label",))] if "label" in edges.columns else [])]
    names = nodes.select("graph_id", F.explode(F.array(*of_nodes)).alias("name")).unionByName(edges.select("graph_id", F.explode(F.array(*of_edges)).alias("name")))
    out = names.filter("name is not null").groupBy("graph_id", "name").agg(F.count("*").alias("value"))
    literals = nodes.groupBy("graph_id").agg(F.lit(f"GRAPH_{prefix}_LITERAL_COUNT").alias("name"), F.count_if(F.coalesce("is_literal", F.lit(False))).alias("value"))
    return out.unionByName(literals)


def ratio(a, b):
    """A ratio whose NaN and infinities are 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def kind_shares(elements: DataFrame, kinds: tuple[str, ...], prefix: str, ratios: bool = True) -> DataFrame:
    """AGG-6: (graph_id, name, value) with each kind's share and all pairwise ratios: one aggregation a graph."""
    counts = elements.groupBy("graph_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    cells = [F.struct(F.lit(f"{prefix}_{k}_PERC").alias("name"), ratio(F.col(k), F.col("n")).alias("value")) for k in kinds]
    if ratios:
        cells += [F.struct(F.lit(f"{prefix}_RATIO_{a}_{b}").alias("name"), ratio(F.col(a), F.col(b)).alias("value")) for a, b in permutations(kinds, 2)]
    return counts.select("graph_id", F.inline(F.array(*cells)))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """PRJ-11: nodes with an edge."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
    return nodes.join(ends, ["graph_id", "node_id"], "left_semi")


def signatures(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """AGG-10, GR-7, SRT-5: a seed's kind, then kind of neighbour and edge in order; share of each signature among the seeds.

    Neighbours are counted by their kinds before a node's meet: a hub's list has a cell for each pair of kinds, not for each edge.
    """
    kinds = lambda x: nodes.select("graph_id", F.col("node_id").alias(x), F.col("kind").alias(f"{x}_kind"))
    whole = edges.join(kinds("src"), ["graph_id", "src"]).join(kinds("dst"), ["graph_id", "dst"])
    end = lambda x, other: F.struct(F.col(x).alias("node_id"), F.concat_ws(":", f"{other}_kind", "kind").alias("part"))
    counted = whole.select("graph_id", F.inline(F.array(end("src", "dst"), end("dst", "src")))).groupBy("graph_id", "node_id", "part").agg(F.count("*").cast("int").alias("n"))
    around = counted.join(seeds.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_semi")
    lists = around.groupBy("graph_id", "node_id").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"))
    spelt = F.array_join(F.transform("parts", lambda p: F.concat(p["part"], F.repeat(F.concat(F.lit(","), p["part"]), p["n"] - 1))), ",")
    named = seeds.join(lists, ["graph_id", "node_id"], "left").select("graph_id", F.concat(F.col("kind"), F.lit("_"), F.coalesce(spelt, F.lit(""))).alias("signature"))
    from spoor.operators.trace import share

    return share(named, ["graph_id"], "signature")


def _spill(df: DataFrame, label: str) -> DataFrame:
    """A reliable copy of an iteration's result, in the folder all executors share."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(spark: SparkSession, nodes: DataFrame, edges: DataFrame, rules: tuple = TAINT_RULES) -> DataFrame:
    """(graph_id, src, dst, kind, way): the single moves that taint may make, all graphs together."""
    # only edges of a kind that some rule follows meet the nodes
    table = spark.createDataFrame(list(rules), "cls string, kind string, way string")
    cls = nodes.select("graph_id", F.col("node_id").alias("src"), node_class(F.col("kind")).alias("cls"))
    of = lambda way: F.col("kind").isin(*sorted({k for _, k, w in rules if w == way}))
    moves = edges.filter(of("out")).select("graph_id", "src", "dst", "kind", F.lit("out").alias("way")).unionByName(
        edges.filter(of("in")).select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", F.lit("in").alias("way"))
    )
    return moves.join(cls, ["graph_id", "src"]).join(F.broadcast(table), ["cls", "kind", "way"]).select("graph_id", "src", "dst", "kind", "way")


def reach(moves: DataFrame, seeds: DataFrame, written: bool = False) -> DataFrame:
    """GR-3: (graph_id, node_id) reachable from the seeds: frontier joins until nothing is new.

    What has been seen is an anti-join away, so cycles end.  ``written`` moves are read as they are.
    """
    if not written:
        moves = _spill(moves.select("graph_id", "src", "dst"), "moves")  # read in every round, made once; equal moves do no harm
    seen = frontier = _spill(seeds.select("graph_id", "node_id").distinct(), "seen")
    for n in count(1):
        nxt = (
            moves.join(frontier.withColumnRenamed("node_id", "src"), ["graph_id", "src"]).select("graph_id", F.col("dst").alias("node_id")).distinct()
            .join(seen, ["graph_id", "node_id"], "left_anti")
        )
        frontier = _spill(nxt, "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)  # the written rounds side by side
        if n % 16 == 0:
            seen = _spill(seen, "seen")
    return seen


def transitions(moves: DataFrame, tainted: DataFrame) -> DataFrame:
    """GR-3/4: the moves that start at tainted nodes, in the order they are walked."""
    return moves.join(tainted.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").select("graph_id", "src", "dst", "kind").distinct()


def untainted(nodes: DataFrame, edges: DataFrame, tainted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET-3: the graph without tainted nodes, and the edges between what is left."""
    left = nodes.join(tainted, ["graph_id", "node_id"], "left_anti")
    key = left.select("graph_id", F.col("node_id"))
    inner = edges.join(key.withColumnRenamed("node_id", "src"), ["graph_id", "src"], "left_semi").join(key.withColumnRenamed("node_id", "dst"), ["graph_id", "dst"], "left_semi")
    return left, inner


def identity(nodes: DataFrame) -> Callable[[str], Column]:
    """What makes a number of the node that a column names: a hash of 64 bits, of a seed under which no two of the nodes have the same."""
    ident = lambda n, c: F.xxhash64(F.lit(n), "graph_id", c)
    for seed in count():
        twice = nodes.select(ident(seed, "node_id").alias("v"), ident(seed + 1, "node_id").alias("h")).groupBy("v").agg(F.min("h").alias("l"), F.max("h").alias("m"))
        if twice.filter("l <> m").isEmpty():
            return partial(ident, seed)


def roots(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = _spill, drop: Callable[..., None] = lambda *_: None) -> DataFrame:
    """(v, c): the node c that stands for all that hangs together with v by written links (a, b), which ``drop`` is not told of; only nodes of links have a row.

    Each node points to the least of its neighbours and itself, pointers are followed to their ends, and links are
    led over to those: what points together is one node from then on.  Each round leaves at most about half of the nodes and
    far fewer links where they are dense, and only the first one reads all of them.
    """
    pointers, given = [], links
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c")), "pointers")
        if to.isEmpty():
            break
        while True:
            ends = to.select(F.col("v").alias("c"), F.col("c").alias("cc"))
            new = keep(to.join(ends, "c").select("v", F.col("cc").alias("c"), (F.col("cc") != F.col("c")).alias("moved")), "pointers")
            drop(to)
            to = new
            if to.filter("moved").isEmpty():
                break
        pointers.append(to)
        # one end is led over and made distinct before the other
        half = links.join(to.select(F.col("v").alias("a"), "c"), "a").select(F.col("c").alias("a"), "b").distinct()
        led = half.join(to.select(F.col("v").alias("b"), F.col("c").alias("d")), "b").filter("a <> d")
        fewer = keep(led.select(F.least("a", "d").alias("a"), F.greatest("a", "d").alias("b")).distinct(), "links")
        if links is not given:
            drop(links)
        links = fewer
    # a later round knows the ends of earlier ones alone, so pointers are followed from the last round back to the first
    root = (pointers.pop() if pointers else to).select("v", "c")
    while pointers:
        root = pointers.pop().join(root.select(F.col("v").alias("c"), F.col("c").alias("top")), "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    return root


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-5: (graph_id, node_id, component_id): least node of the weakly connected component; isolated nodes are their own.

    Meanwhile a node is a hash of 64 bits, of a seed under which no two nodes have the same.  Edges lead between the nodes given.
    """
    ident = identity(nodes)
    root = roots(_spill(edges.filter("src <> dst").select(ident("src").alias("a"), ident("dst").alias("b")), "links"))
    named = nodes.select("graph_id", "node_id", ident("node_id").alias("v")).join(root, "v", "left").select("graph_id", "node_id", F.coalesce("c", "v").alias("c"))
    named = _spill(named, "named")
    least = named.groupBy("c").agg(F.min("node_id").alias("component_id"))
    return named.join(least, "c").select("graph_id", "node_id", "component_id")


def boundary(components: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-5: component members and the removed nodes one edge away, re-attached."""
    by_src = components.withColumnRenamed("node_id", "src").join(edges, ["graph_id", "src"]).select("graph_id", "component_id", F.col("dst").alias("node_id"))
    by_dst = components.withColumnRenamed("node_id", "dst").join(edges, ["graph_id", "dst"]).select("graph_id", "component_id", F.col("src").alias("node_id"))
    return components.select("graph_id", "component_id", "node_id").unionByName(by_src).unionByName(by_dst).distinct()


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written copies in which nodes are numbers that differ between graphs too: (graph_id, node_id, name, kind, label) and (graph_id, src, dst, kind)."""
    ident = identity(nodes)
    n = _spill(nodes.select("graph_id", ident("node_id").alias("node_id"), F.col("node_id").alias("name"), "kind", "label"), "nodes")
    return n, _spill(edges.select("graph_id", ident("src").alias("src"), ident("dst").alias("dst"), "kind"), "edges")


def boundary_sizes(nodes: DataFrame, edges: DataFrame, tainted: DataFrame) -> DataFrame:
    """GR-5: (component_id, n): how many rows ``boundary`` has for each component of what taint leaves, of ``numbered`` tables.

    All nodes that edges lead to from a component are its own or removed, so only edges with one end left can add nodes.
    """
    left = _spill(nodes.join(tainted.select("node_id"), "node_id", "left_anti").select("graph_id", F.col("node_id").alias("v"), "name").distinct(), "left")
    end = lambda x: left.select(F.col("v").alias(x), F.lit(True).alias(f"{x}_left"))
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a <> b").join(end("a"), "a", "left").join(end("b"), "b", "left")
    ends = _spill(ends.filter("a_left OR b_left").select("a", "b", F.expr("coalesce(a_left AND b_left, false)").alias("inner")), "ends")
    root = roots(_spill(ends.filter("inner").select("a", "b"), "links"))
    named = _spill(left.join(root, "v", "left").select("graph_id", "v", "name", F.coalesce("c", "v").alias("c")), "named")
    own = named.groupBy("c").agg(F.min("name").alias("component_id"), F.count("*").alias("n"))
    # which end is left is told by what it meets
    out = ends.filter("NOT inner").select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("x")).select("x.*").distinct()
    more = out.join(named.select("v", "c"), "v").select("c", "w").distinct().groupBy("c").agg(F.count("*").alias("m"))
    return own.join(more, "c", "left").groupBy("component_id").agg(F.sum(F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))


def graph_union(*parts: DataFrame, key: str = "node_id") -> DataFrame:
    """SET-2: union of element tables, one row for each id."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["graph_id", key])


def initial_candidates(left: DataFrame, right: DataFrame, digits: int | None = None) -> DataFrame:
    """JN-2, Q-1, Q-2: pairs of nodes with the same key and their cost 1 - deg(l) / max(deg); 1 if either has no edge.

    Both sides are (node_id, key, degree).  Costs are rounded to ``digits``, if given.
    """
    cost = F.when((F.col("ld") == 0) | (F.col("rd") == 0), F.lit(1.0)).otherwise(1 - F.col("ld") / F.greatest("ld", "rd"))
    if digits is not None:
        cost = F.round(cost, digits)
    l = left.select(F.col("node_id").alias("l"), "key", F.col("degree").alias("ld"))
    r = right.select(F.col("node_id").alias("r"), "key", F.col("degree").alias("rd"))
    # a cost is that of two degrees, of which there are few: each is told once, and the pairs themselves are joins alone
    degrees = l.select("key", "ld").distinct().join(r.select("key", "rd").distinct(), "key").select("key", "ld", "rd", cost.alias("cost"))
    costs = degrees.groupBy("key", "rd").agg(F.collect_list(F.struct("ld", "cost")).alias("costs"))
    priced = r.join(costs, ["key", "rd"]).select("key", "r", F.inline("costs"))
    return tiles.join(l, priced, ["key", "ld"]).select("l", "r", "key", "cost")
