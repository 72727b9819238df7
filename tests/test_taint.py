"""Components and taint by seed against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from spoor.operators import graph, taint
from spoor.operators.rounds import Rounds
from spoor.plans import deep


def made(seed, graphs=3, n=24, m=34):
    rng = random.Random(seed)
    kinds = ["VALUE", "OBJECT", "OPERATOR", "METHODCALL", "ENTRYPOINT"]
    nodes = [(g, f"n{i}", rng.choice(kinds)) for g in range(graphs) for i in range(n)]
    edges = [(g, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice(graph.EDGE_KINDS)) for g in range(graphs) for _ in range(m)]
    return nodes, edges


def reached(moves, start):
    seen, todo = {start}, [start]
    while todo:
        g, x = todo.pop()
        for y in moves.get((g, x), ()):
            if (g, y) not in seen:
                seen.add((g, y))
                todo.append((g, y))
    return seen


def test_taint_of_each_seed_against_a_search(spark):
    nodes, edges = made(5, n=16, m=24)
    n, e = spark.createDataFrame(nodes, "graph_id int, node_id string, kind string"), spark.createDataFrame(edges, "graph_id int, src string, dst string, kind string")
    moves = graph.steps(spark, n, e)
    out = {}
    rows = {tuple(r) for r in moves.select("graph_id", "src", "dst", "kind").collect()}
    for g, s, d, _ in rows:
        out.setdefault((g, s), set()).add(d)
    seeds = n.filter("kind in ('VALUE', 'OBJECT')")
    tainted, walked, rounds = taint.by_seed(n, moves, seeds.unionByName(seeds).unionByName(spark.createDataFrame([(0, "none", "VALUE")], n.schema)))
    starts = [(g, i) for g, i, k in nodes if k in ("VALUE", "OBJECT")]
    want = {(g, i, x) for g, i in starts for _, x in reached(out, (g, i))}
    assert {tuple(r) for r in tainted.collect()} == want and tainted.count() == len(want)
    steps = {(g, i, s, d, k) for g, i, x in want for _, s, d, k in rows if _ == g and s == x}
    assert {tuple(r) for r in walked.collect()} == steps and walked.count() == len(steps)
    ends, union = taint.taint_graph(walked)
    assert {tuple(r) for r in union.collect()} == {(g, s, d, k) for g, _, s, d, k in steps}
    assert {tuple(r) for r in ends.collect()} == {(g, x) for g, _, s, d, _ in steps for x in (s, d)}
    assert {x["kind"] for x in rounds.log} == {"components", "bits"}
    rounds.close()
    assert not rounds.paths


def test_strong_components_of_random_graphs_cycles_and_chains(spark):
    for seed, m in ((2, 34),):
        nodes, edges = made(seed, m=m)
        edges += [(0, f"c{i}", f"c{(i + 1) % 9}", "SCOPE") for i in range(9)] + [(1, f"k{i}", f"k{i + 1}", "SCOPE") for i in range(9)] + [(1, "c1", "c1", "SCOPE")]
        nodes += [(0, f"c{i}", "VALUE") for i in range(9)] + [(1, f"k{i}", "VALUE") for i in range(10)] + [(1, "c1", "VALUE")]
        out = {}
        for g, s, d, _ in edges:
            out.setdefault((g, s), set()).add(d)
        n = spark.createDataFrame(nodes, "graph_id int, node_id string, kind string")
        e = spark.createDataFrame(edges, "graph_id int, src string, dst string, kind string")
        found = {(r.graph_id, r.node_id): r.component for r in taint.strong_components(n, e, Rounds(spark, "test")).collect()}
        ahead = {x: reached(out, x) for x in found}
        assert found == {x: min(y for _, y in ahead[x] if x in ahead[x[0], y]) for x in found}


def test_more_seeds_than_a_block_has_bits(spark):
    n = spark.range(200).select(F.lit("g").alias("graph_id"), F.concat(F.lit("x"), "id").alias("node_id"), F.lit("VALUE").alias("kind"))
    hub = spark.createDataFrame([("g", "hub", "VALUE")], n.schema)
    e = n.select("graph_id", F.col("node_id").alias("src"), F.lit("hub").alias("dst"), F.lit("TRANSFORMATION").alias("kind"))
    every = n.unionByName(hub)
    tainted, _, _ = taint.by_seed(every, graph.steps(spark, every, e), n)
    assert tainted.filter("node_id = 'hub'").select("seed").distinct().count() == 200 and tainted.count() == 400


def test_no_seeds_and_no_nodes(spark):
    nodes, edges = made(5)
    n, e = spark.createDataFrame(nodes, "graph_id int, node_id string, kind string"), spark.createDataFrame(edges, "graph_id int, src string, dst string, kind string")
    for nodes_, edges_ in ((n, e), (n.filter("false"), e.filter("false"))):
        tainted, walked, _ = taint.by_seed(nodes_, graph.steps(spark, nodes_, edges_), n.filter("false"))
        assert tainted.isEmpty() and walked.isEmpty()


def test_moves_of_each_seed_are_counted_as_they_are_walked(spark):
    nodes, edges = made(7)
    n, e = spark.createDataFrame(nodes, "graph_id int, node_id string, kind string"), spark.createDataFrame(edges, "graph_id int, src string, dst string, kind string")
    moves, seeds = graph.steps(spark, n, e), n.filter("kind in ('VALUE', 'OBJECT')")
    counts, rounds = taint.walk_counts(n, moves, seeds)
    _, walked, _ = taint.by_seed(n, moves, seeds)
    want = {tuple(r) for r in walked.groupBy("graph_id", "seed", "kind").count().collect()}
    assert want and {tuple(r) for r in counts.collect()} == want and counts.count() == len(want)


def test_a_graph_without_cycles_takes_no_rounds_of_labels(spark):
    """Layers of hubs: names would go to and fro between them in every round."""
    n = spark.range(60).select(F.lit("g").alias("graph_id"), F.concat(F.lit("x"), "id").alias("node_id"), F.lit("VALUE").alias("kind"))
    edges = [("g", f"x{a}", f"x{b}", "TRANSFORMATION") for a in range(48) for b in range(12 * (a // 12) + 12, 12 * (a // 12) + 24) if (a + b) % 5]
    e = spark.createDataFrame(edges, "graph_id string, src string, dst string, kind string")
    tainted, _, rounds = taint.by_seed(n, graph.steps(spark, n, e), n)
    assert not [x for x in rounds.log if x.get("passes")] and sum(x["trimmed"] for x in rounds.log if x["kind"] == "components") == len(edges)
    assert tainted.filter("seed = 'x0'").count() == 1 + sum(b % 5 != 0 for b in range(12, 24)) + 36


def test_nodes_that_lead_to_one_another_take_no_rounds_of_labels(spark):
    def components(links):
        rounds = Rounds(spark, "test")
        moves = spark.createDataFrame([("g", *x) for x in links], "graph_id string, src string, dst string")
        nodes = moves.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id"))
        found = {r.node_id: r.component for r in taint.strong_components(nodes, moves, rounds).collect()}
        passes = [x for x in rounds.log if "passes" in x]
        rounds.close()
        return found, passes

    both = [(f"o{i}", f"l{i}{j}") for i in range(4) for j in range(3)]
    found, passes = components([*both, *((b, a) for a, b in both), *((b, f"p{b[-1]}") for _, b in both), ("p0", "s"), ("p1", "s")])
    assert not passes and found == {**{x: f"l{x[1]}0" for x in {x for two in both for x in two}}, "p0": "p0", "p1": "p1", "p2": "p2", "s": "s"}
    found, _ = components([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "a"), ("e", "c"), ("c", "e"), ("x", "a"), ("x", "x"), ("y", "z"), ("z", "y"), ("e", "y")])
    assert found == {**dict.fromkeys("abcde", "a"), "x": "x", "y": "y", "z": "y"}


def test_sizes_of_components_with_their_neighbours(spark):
    nodes, edges = made(4, n=30, m=26)
    edges += [(0, "n1", "none", "SCOPE"), (1, "n2", "n2", "SCOPE"), *edges[:9]]
    n = spark.createDataFrame([(*r, "x") for r in nodes + nodes[:5]], "graph_id int, node_id string, kind string, label string")
    e = spark.createDataFrame(edges, "graph_id int, src string, dst string, kind string")
    tainted = n.filter("kind IN ('VALUE', 'OBJECT')").select("graph_id", "node_id").distinct()
    rest, inner = graph.untainted(n, e, tainted)
    want = graph.boundary(graph.weak_components(rest, inner), e).groupBy("component_id").count()
    numbers, links = graph.numbered(n, e)
    removed = numbers.filter("kind IN ('VALUE', 'OBJECT')").select("graph_id", "node_id")
    found = graph.boundary_sizes(numbers, links, removed)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 9


def test_numbers_of_baskets(spark):
    node = lambda letter, key, line: spark.sql(f"SELECT CAST({key} AS BIGINT) AS k, CAST({line} AS BIGINT) AS n").select(deep._basket_node(letter, F.col("k"), F.col("n")).alias("seed"), F.lit(3).alias("graph_id"))
    assert deep._basket_names(node("l", (1 << 42) - 1, (1 << 18) - 1), "seed").first().seed == f"l{(1 << 42) - 1}-{(1 << 18) - 1}"
    assert tuple(deep._basket_names(node("l", 13, 4), "seed").first()) == ("l13-4", "g3")
    assert node("o", "NULL", 0).first().seed is None and node("l", 1, "NULL").first().seed is None
    for key, line in (((1 << 42), 1), (-1, 1), (1, 1 << 18), (1, -1)):
        with pytest.raises(Exception, match="no room"):
            node("l", key, line).collect()
