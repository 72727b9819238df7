"""Graph comparison over tables against the in-memory form; the auction against the assignment in memory."""

import random
from collections import defaultdict

import numpy as np
import pytest

from spoor.operators import comparison, similarity
from spoor.operators import rounds as rounds_module
from spoor.operators.graph import EDGE_KINDS
from spoor.operators.rounds import Rounds
from spoor.plans import deep


def made(seed, graphs=5, n=14, m=22):
    rng = random.Random(seed)
    kinds = ["VALUE", "OBJECT", "OPERATOR", "METHODCALL", "METHODCALL", "ENTRYPOINT"]
    nodes, edges = [], []
    for g in range(graphs):
        size = rng.randrange(n // 2, n)
        nodes += [(g, f"n{i}", rng.choice(kinds), rng.choice(["f", "fo", "foo", "g", None]), rng.choice(["I", "J", None])) for i in range(size)]
        edges += [(g, f"n{rng.randrange(size)}", f"n{rng.randrange(size)}", rng.choice(EDGE_KINDS)) for _ in range(rng.randrange(m))]
    return nodes, edges


def plain(nodes, edges, pairs):
    ns, es = defaultdict(dict), defaultdict(list)
    for g, i, kind, label, type_ in nodes:
        ns[g][i] = {"kind": kind, "label": label, "type": type_}
    for g, s, d, k in edges:
        es[g].append((s, d, k))
    return {p: similarity.compare(*(similarity.Graph(ns[g], es[g]) for g in p)) for p in pairs}


def tables(spark, nodes, edges, pairs):
    return (
        spark.createDataFrame(pairs, "lhs int, rhs int"), spark.createDataFrame(nodes, "graph_id int, node_id string, kind string, label string, type string"),
        spark.createDataFrame(edges, "graph_id int, src string, dst string, kind string"),
    )


@pytest.mark.parametrize("seed,at_once", [(1, 10**6), (3, 0)])
def test_tables_equal_the_in_memory_form(spark, seed, at_once):
    nodes, edges = made(seed)
    pairs = [(a, b) for a in range(5) for b in range(5) if a <= b] if at_once else [(0, 1), (2, 3), (4, 4)]
    scores, mapping, rounds = comparison.compare_tables(*tables(spark, nodes, edges, pairs), at_once=at_once)
    want = plain(nodes, edges, pairs)
    found = defaultdict(list)
    for r in mapping.collect():
        found[r.lhs, r.rhs].append((r.l, r.r))
    rows = {(r.lhs, r.rhs): r for r in scores.collect()}
    assert set(rows) == set(pairs)
    for p, w in want.items():
        assert sorted(found[p]) == w["mapping"]
        assert all(rows[p][k] == pytest.approx(w[k]) for k in ("union_sim", "lr_sim", "rl_sim", "l_disjoint", "r_disjoint"))
    assert any(x["kind"] == "spread" for x in rounds.log)


def test_graphs_of_orders_equal_the_in_memory_form(spark, sf):
    nodes, edges = deep._orders_as_graphs(spark, sf)
    pairs = deep._order_pairs(spark, sf)
    rows = [tuple(r) for r in pairs.collect()]
    want = plain([(*r, None) for r in nodes.collect()], [tuple(r) for r in edges.collect()], rows)
    got = {(r.lhs, r.rhs): r for r in deep.compared_graphs(spark, sf).collect()}
    assert set(got) == set(rows) and all(got[p].union_sim == pytest.approx(want[p]["union_sim"]) and got[p].mapped == len(want[p]["mapping"]) for p in rows)
    assert 0 < sum(r.mapped for r in got.values()) and any(0 < r.union_sim < 1 for r in got.values())


def test_an_auction_is_optimal(spark):
    """Sparse rectangular blocks whose costs are no differences of numbers on a line."""
    rng = random.Random(1)
    rows, want = [], {}
    for block, (nl, nr) in enumerate([(3, 4), (4, 2)]):
        cost = {(f"x{i}", f"y{j}"): rng.choice([0.0, 0.25, 0.5, 0.75]) for i in range(nl) for j in range(nr) if rng.random() < 0.8}
        rows += [(1, 2, str(block), l, r, c) for (l, r), c in cost.items()]
        matrix = np.array([[cost.get((f"x{i}", f"y{j}"), 1.0) for j in range(nr)] for i in range(nl)])
        want[str(block)] = sum(s for *_, s in similarity.matches(matrix))
    candidates = spark.createDataFrame(rows, "lhs int, rhs int, block string, l string, r string, cost double")
    won = comparison.auction(candidates, Rounds(spark, "auction"), units=4).collect()
    for block, best in want.items():
        own = [r for r in won if r.block == block]
        assert sum(r.sim for r in own) == pytest.approx(best)
        assert len({r.l for r in own}) == len({r.r for r in own}) == len(own)


def test_large_blocks_go_to_the_auction(spark):
    rows = [(1, 2, f"x{i}", f"y{j}", 0.5 * (i == j)) for i in range(2) for j in range(2)] + [(1, 2, "x9", "y9", 0.1)]
    candidates = spark.createDataFrame(rows, "lhs int, rhs int, l string, r string, cost double")
    rounds = Rounds(spark, "blocks")
    split = comparison.assign(candidates, 0.0, rounds, at_once=3, cells=2, units=4).collect()
    whole = comparison.assign(candidates, 0.0, rounds).collect()
    assert any(x["kind"] == "auction" for x in rounds.log)
    assert sum(r.sim for r in split) == pytest.approx(sum(r.sim for r in whole)) and len(split) == len(whole) == 3


def test_no_pairs_and_graphs_without_nodes(spark):
    nodes, edges = made(1)
    assert comparison.compare_tables(*tables(spark, nodes, edges, []))[0].isEmpty()
    scores = comparison.compare_tables(*tables(spark, nodes, edges, [(0, 99)]))[0].first()
    assert (scores.union_sim, scores.lr_sim, scores.rl_sim, scores.r_disjoint) == (0, 0, 0, 0) and scores.l_disjoint == 1


def test_pairs_of_buckets_and_of_tables_are_alike(spark):
    """pairs of a large left graph go by tables without buckets, the others beside them by buckets."""
    nodes, edges = made(2, graphs=3)
    pairs = [(0, 1), (0, 2), (1, 2)]
    weight = {p: sum(g in p for g, *_ in nodes + edges) for p in pairs}
    held = min(weight[0, 1] + weight[0, 2], weight[1, 2])
    assert held < max(weight[0, 1] + weight[0, 2], weight[1, 2])
    scores, mapping, rounds = comparison.compare_tables(*tables(spark, nodes, edges, pairs), held=held)
    want = plain(nodes, edges, pairs)
    found = defaultdict(list)
    for r in mapping.collect():
        found[r.lhs, r.rhs].append((r.l, r.r))
    assert {p: sorted(found[p]) for p in pairs} == {p: want[p]["mapping"] for p in pairs}
    assert {(r.lhs, r.rhs): r.mapped for r in scores.collect()} == {p: len(want[p]["mapping"]) for p in pairs}


def test_rounds_of_buckets_shuffle_nothing(spark, monkeypatch):
    plans = []

    class Watched(Rounds):
        def keep(self, df, label, by=None, placed=False):
            if by == "lhs" and label in ("candidates", "matched", "mapping"):
                with rounds_module._settings(spark, rounds_module.IN_BUCKETS):
                    dealt = df if placed else df.repartition(self.buckets, by)
                    plans.append((label, dealt._jdf.queryExecution().executedPlan().toString()))
            return super().keep(df, label, by, placed)

    monkeypatch.setattr(comparison, "Rounds", Watched)
    with rounds_module._settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        comparison.compare_tables(*tables(spark, *made(1, graphs=2), [(0, 1)]))
    assert {label for label, _ in plans} == {"candidates", "matched", "mapping"}
    # what is left over meets in several ways, and the first mapping is empty
    shuffled = [plan for _, plan in plans if "Exchange" in plan]
    assert len(shuffled) <= 2 and all("Union" in plan or "LocalTableScan" in plan for plan in shuffled) and len(plans) > 6
