import random
from itertools import permutations

import numpy as np
import pytest

from spoor.functions import codes
from spoor.operators import branch, features, graph, scores, similarity, trace


@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (3, 2), (4, 4), (5, 5)])
def test_hungarian_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        c = rng.random(shape).round(2)
        out = similarity.hungarian(c)
        used = [j for j in out if j >= 0]
        assert len(set(used)) == len(used) == min(shape)
        got = sum(c[i, j] for i, j in enumerate(out) if j >= 0)
        small, big = (c, c.T) if shape[0] <= shape[1] else (c.T, c)
        best = min(sum(small[i, p[i]] for i in range(small.shape[0])) for p in permutations(range(small.shape[1]), small.shape[0]))
        assert got == pytest.approx(best)


def test_assignment_edges():
    with pytest.raises(ValueError):
        similarity.hungarian(np.array([[np.nan]]))
    assert sorted(similarity.hungarian(np.zeros((3, 3)))) == [0, 1, 2]
    assert list(similarity.greedy(np.array([[0.1, 0.0], [0.0, 0.0]]))) == [1, 0]
    assert similarity.greedy(np.zeros((3, 1))).tolist() == [0, -1, -1]
    assert similarity.matches(np.array([[0.5]]), 0.6) == []


def _graph(n):
    nodes = {"e": {"kind": "ENTRYPOINT", "label": "f"}, **{f"o{i}": {"kind": "OPERATOR", "label": "ADD"} for i in range(n)}}
    return similarity.Graph(nodes, [("e", f"o{i}", "SUPPLIES") for i in range(n)])


def test_compare_graphs():
    same = similarity.compare(_graph(3), _graph(3))
    assert same["union_sim"] == same["lr_sim"] == 1.0 and same["l_disjoint"] == 0.0
    part = similarity.compare(_graph(1), _graph(3))
    assert part["lr_sim"] == 1.0 and part["rl_sim"] == 0.5
    empty = similarity.compare(similarity.Graph({}, []), similarity.Graph({}, []))
    assert empty["union_sim"] == 0.0
    assert similarity.edge_match("PARAMETER", "SCOPE") and not similarity.edge_match("SCOPE", "SUPPLIES")


def test_large_graphs_are_assigned_optimally():
    def wide(degrees, label):
        nodes = {f"o{i:03}": {"kind": "OPERATOR", "label": label(i)} for i in range(len(degrees))}
        return similarity.Graph(nodes, [(f"o{i:03}", f"o{i:03}", "SUPPLIES") for i, n in enumerate(degrees) for _ in range(n)])

    n = 206
    label = lambda i: str(i // 2)  # noqa: E731  pairs of alike nodes, more than 200 in all
    left, right = wide([3, 1] * (n // 2), label), wide([1, 3] * (n // 2), label)
    found = dict(similarity.compare(left, right)["mapping"])
    assert found == {f"o{i:03}": f"o{i ^ 1:03}" for i in range(n)}


def test_blocks_lose_nothing():
    rng = np.random.default_rng(5)
    for _ in range(20):
        full = np.where(rng.random((9, 7)) < 0.2, rng.random((9, 7)).round(2), 1.0)
        cost = {(i, j): full[i, j] for i in range(9) for j in range(7)}
        parts = [full[np.ix_(a, b)] for a, b in similarity._blocks(cost)]
        total = lambda c: sum(s for *_, s in similarity.matches(c))
        assert sum(map(total, parts)) == pytest.approx(total(full))


def test_condense():
    close = lambda a, b: 1.0 if abs(a - b) <= 1 else 0.0
    assert similarity.condense([10, 10, 30, 11, 31], close, lambda x: x) == [(10, 3), (30, 2)]
    assert similarity.condense([10, 20], lambda a, b: 1.0, lambda x: x) == [(10, 1), (20, 1)]


@pytest.mark.parametrize(("size", "expected"), [(3, 0), (4, 1), (5, 2)])
def test_last_trigram_is_dropped(spark, size, expected):
    df = spark.createDataFrame([(1, i, "x") for i in range(size)], "t int, s int, k string")
    assert trace.trigrams(df, "t", ["s"], "k").count() == expected


def test_zero_filled_mean(spark):
    f = spark.createDataFrame([(1, "a", 1.0)], "m int, name string, value double")
    members = spark.createDataFrame([(i, "g") for i in range(1, 5)], "m int, g string")
    row = features.aggregate_features(f, members, "g", "m").first()
    assert (row["avg"], row["min"], row["max"], row["median"]) == (0.25, 0.0, 1.0, 0.0)


def test_branch_metrics_of_three_traces(spark):
    rows = [(1, 0, "c1", True), (1, 1, "c2", True), (2, 0, "c1", True), (2, 1, "c2", False), (3, 0, "c1", False)]
    from pyspark.sql import functions as F

    a = spark.createDataFrame([("e", *r) for r in rows], "entry string, trace int, seq int, c string, truth boolean")
    ch = branch.chains(a, "entry", "trace", ["seq"], F.concat("c", F.when(F.col("truth"), "=T").otherwise("=F")))
    m = branch.metrics(ch, "entry").first()
    assert (m["height"], m["size"], m["terminals"], m["internals"]) == (4, 6, 3, 2)
    assert branch.path_conditions(ch, "entry").first()["conditions"] == 3


def test_taint_cycles_end(spark):
    n = spark.createDataFrame([("g", "a", "OBJECT", ""), ("g", "b", "VALUE", ""), ("g", "c", "METHODCALL", ""), ("g", "d", "VALUE", ""), ("g", "x", "VALUE", "")], "graph_id string, node_id string, kind string, label string")
    e = spark.createDataFrame([("g", "b", "a", "AGGREGATION"), ("g", "a", "c", "SCOPE"), ("g", "c", "d", "SUPPLIES"), ("g", "x", "c", "TRANSFORMATION")], "graph_id string, src string, dst string, kind string")
    moves = graph.steps(spark, n, e)
    seen = {r["node_id"] for r in graph.reach(moves, n.filter("node_id = 'b'")).collect()}
    assert seen == {"a", "b", "c", "d"}


def test_signatures_parse(spark):
    df = spark.createDataFrame([("Ljava/lang/String;sub([ILjava/lang/Object;J)V",), ("f()I",)], "s string")
    from pyspark.sql import functions as F

    rows = df.select("s", codes.signature(F.col("s")).alias("p")).select("s", "p", codes.signature_text(F.col("p")).alias("t")).collect()
    assert all(r["s"] == r["t"] for r in rows)
    assert rows[0]["p"]["args"] == ["[I", "Ljava/lang/Object;", "J"] and rows[1]["p"]["declaring"] == ""


def test_type_match(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("I", "J", True), ("[I", "[J", True), ("[I", "J", False), ("La;", "La;", True), ("La;", "Lb;", False)], "a string, b string, m boolean")
    assert all(r["m"] == r["x"] for r in df.select("m", codes.type_match(F.col("a"), F.col("b")).alias("x")).collect())


def test_pairs_dedupe_and_exclusion(spark):
    s = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.7), ("a", "c", 0.1)], "lhs string, rhs string, score double")
    d = {(r["lhs"], r["rhs"]): r["score"] for r in scores.dedupe_pairs(s).collect()}
    assert d == {("a", "b"): 0.7, ("a", "c"): 0.1}
    bad = spark.createDataFrame([("b", "a")], "lhs string, rhs string")
    assert scores.without_pairs(s, bad).count() == 1


def test_condense_traces(spark):
    rows = [(0, 1, ["a", "b", "c"]), (0, 2, ["a", "b", "c"]), (0, 3, ["x", "y", "z"]), (1, 4, ["a"])]
    out = similarity.condense_traces(spark.createDataFrame(rows, "entry long, trace long, codes array<string>"), "entry", "trace", "codes")
    assert sorted(tuple(r) for r in out.collect()) == [(0, 1, 2), (0, 3, 1), (1, 4, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_components_of_paths_and_stars(spark, seed, monkeypatch):
    rng = random.Random(seed)
    names = [f"{i:04d}" for i in range(300)]
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(120)] + [(names[150], names[i]) for i in range(151, 250)] + [(names[260], names[260])]
    parent = {x: x for x in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    made = []
    spill = graph._spill
    monkeypatch.setattr(graph, "_spill", lambda df, label: made.append(label) or spill(df, label))
    nodes = spark.createDataFrame([("g", x) for x in names], "graph_id string, node_id string")
    found = graph.weak_components(nodes, spark.createDataFrame([("g", *x) for x in links], "graph_id string, src string, dst string"))
    assert {r["node_id"]: r["component_id"] for r in found.collect()} == {x: root(x) for x in names}
    assert made.count("links") < 10  # the links shrink from round to round
