"""Many pairs of small graphs at once against the in-memory form."""

import random

import numpy as np
import pytest

from spoor.operators import packed, similarity
from tests.test_comparison import made, plain, tables


@pytest.mark.parametrize("within", [500, 25])
def test_pairs_at_once_equal_the_in_memory_form(spark, within, monkeypatch):
    """With ``within`` of 25 some graphs go by tables."""
    monkeypatch.setattr(packed, "CELLS", 300)
    nodes, edges = made(7, graphs=4 if within == 25 else 14, n=17, m=26)
    nodes += [(2, "odd", "OTHER", "f", None), (3, "odd", "OTHER", "f", None), (1, "odd", "ELSE", "f", None)]
    edges += [(2, "odd", "n0", "SCOPE"), (2, "odd", "none", "SCOPE"), (3, "odd", "n0", "SCOPE"), (3, "odd", "odd", "SCOPE")]
    graphs = sorted({g for g, *_ in nodes})
    pairs = [(a, b) for a in graphs for b in graphs] if within > 25 else [(0, 1), (2, 3), (1, 1), (3, 0)]
    sizes = {g: sum(x[0] == g for x in nodes + edges) for g in graphs}
    assert within > 25 or 0 < sum(max(sizes[a], sizes[b]) > 25 for a, b in pairs) < len(pairs)
    scores, rounds = packed.compare(*tables(spark, nodes, edges, [*pairs, pairs[0]]), within=within)
    # an edge to what is no node counts in degrees alone
    want = plain(nodes, [e for e in edges if e[2] != "none"], pairs)
    got = scores.collect()
    assert len(got) == len(pairs)
    for r in got:
        w = want[r.lhs, r.rhs]
        assert r.mapped == len(w["mapping"]), (r, w)
        assert all(r[k] == pytest.approx(w[k]) for k in ("union_sim", "lr_sim", "rl_sim", "l_disjoint", "r_disjoint"))


def test_no_pairs_and_graphs_without_nodes_at_once(spark):
    nodes, edges = made(1)
    assert packed.compare(*tables(spark, nodes, edges, []))[0].isEmpty()
    scores = packed.compare(*tables(spark, nodes, edges, [(0, 99)]))[0].first()
    assert (scores.union_sim, scores.lr_sim, scores.rl_sim, scores.r_disjoint) == (0, 0, 0, 0) and scores.l_disjoint == 1


def test_blocks_of_candidates_are_solved_as_each_by_itself():
    rng = random.Random(3)
    cost = {(l, r): rng.choice([0.0, 0.25, 0.5]) for l in range(120) for r in range(l // 6 * 5, l // 6 * 5 + 5) if rng.random() < 0.5}
    want = []
    for ls, rs in similarity._blocks(cost):
        matrix = np.array([[cost.get((l, r), 1.0) for r in rs] for l in ls])
        want += [(ls[i], rs[j]) for i, j, s in similarity.matches(matrix, 0.6) if s > 0]
    at = list(cost)
    l, r = packed.assign(np.array([x for x, _ in at]), np.array([x for _, x in at]), np.array([cost[x] for x in at]), 0.6)
    assert sorted(zip(l.tolist(), r.tolist())) == sorted(want)
