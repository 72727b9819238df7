"""Pruning of literal chains and branch trees against plain versions."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from spoor.operators import pruning, refine
from spoor.operators.rounds import Rounds


def rewrite(kinds, edges, rng):
    """The rules one operator after another, in random order, until none applies."""
    edges = list(edges)
    todo = [i for i, k in kinds.items() if k == "OPERATOR"]
    changed = True
    while changed:
        changed = False
        rng.shuffle(todo)
        for op in list(todo):
            into, out = [e for e in edges if e[1] == op], [e for e in edges if e[0] == op]
            if len(out) != 1 or len(into) not in (1, 2):
                continue
            result, args = out[0][1], [e[0] for e in into]
            ins = Counter(e[1] for e in edges)
            outs = Counter(e[0] for e in edges)
            free, held = [a for a in args if not ins[a]], [a for a in args if ins[a]]
            if len(args) == 1 and free:
                gone, new = {op, *args}, []
            elif len(args) == 1 and outs[args[0]] == 1:
                gone, new = {op, *args}, [(s, result, k) for s, d, k in edges if d == args[0]]
            elif len(args) == 2 and len(free) == 2:
                gone, new = {op}, []
            elif len(args) == 2 and len(free) == 1:
                s, _, k = min((e for e in edges if e[1] == held[0]), key=lambda e: (e[0], e[2]))
                gone, new = {op, *args}, [(s, result, k)]
            else:
                continue
            edges = [e for e in edges + new if e[0] not in gone and e[1] not in gone]
            todo.remove(op)
            changed = True
    return sorted(edges)


def expressions(rng, depth=0):
    """A random expression tree with calls and literals as leaves: (kinds, edges, its value's node)."""
    name = f"{rng.randrange(10**9)}"
    if depth > 4 or rng.random() < 0.3:
        if rng.random() < 0.4:
            return {f"s{name}": "METHODCALL", f"x{name}": "VALUE"}, [(f"s{name}", f"x{name}", "SUPPLIES")], f"x{name}"
        return {f"x{name}": "VALUE"}, [], f"x{name}"
    kinds, edges = {f"o{name}": "OPERATOR", f"v{name}": "VALUE"}, [(f"o{name}", f"v{name}", "TRANSFORMATION")]
    for _ in range(rng.choice([1, 2, 2])):
        k, e, v = expressions(rng, depth + 1)
        kinds.update(k)
        edges += [*e, (v, f"o{name}", "TRANSFORMATION")]
    return kinds, edges, f"v{name}"


def pruned(spark, graphs, **how):
    nodes = [(g, i, k) for g, (kinds, _) in graphs.items() for i, k in kinds.items()]
    edges = [(g, *e) for g, (_, own) in graphs.items() for e in own]
    left, kept, rounds = pruning.prune_tables(spark.createDataFrame(nodes, "graph_id int, node_id string, kind string"), spark.createDataFrame(edges, "graph_id int, src string, dst string, kind string"), **how)
    found = defaultdict(list)
    for r in kept.collect():
        found[r.graph_id].append((r.src, r.dst, r.kind))
    ends = {(g, x) for g, own in found.items() for s, d, _ in own for x in (s, d)}
    assert {(r.graph_id, r.node_id) for r in left.collect()} == ends
    return {g: sorted(found[g]) for g in graphs}, rounds


def test_expressions_in_any_order(spark):
    rng = random.Random(3)
    graphs = {g: expressions(rng)[:2] for g in range(60)}
    got, _ = pruned(spark, graphs)
    for g, (kinds, edges) in graphs.items():
        for n in range(3):
            assert got[g] == rewrite(kinds, edges, random.Random(n))


def test_a_long_chain_takes_few_rounds(spark):
    n = 80
    edges = [("s", "a0", "SUPPLIES")]
    for k in range(n):
        edges += [(f"a{k}", f"p{k}", "TRANSFORMATION"), (f"x{k}", f"p{k}", "TRANSFORMATION"), (f"p{k}", f"a{k + 1}", "TRANSFORMATION")]
    kinds = {x: "OPERATOR" if x[0] == "p" else "METHODCALL" if x == "s" else "VALUE" for e in edges for x in e[:2]}
    got, rounds = pruned(spark, {0: (kinds, edges)})
    assert got[0] == [("s", f"a{n}", "SUPPLIES")] and max(x["round"] for x in rounds.log) < 24


def test_a_literal_of_a_unary_operator_goes_even_if_used_elsewhere(spark):
    edges = [("x", "o", "TRANSFORMATION"), ("o", "v", "TRANSFORMATION"), ("x", "call", "PARAMETER"), ("y", "call", "PARAMETER")]
    kinds = {"x": "VALUE", "o": "OPERATOR", "v": "VALUE", "call": "METHODCALL", "y": "VALUE"}
    assert pruned(spark, {0: (kinds, edges)})[0][0] == [("y", "call", "PARAMETER")]


def test_an_operand_met_twice_counts_twice(spark):
    twice = [("x", "o", "TRANSFORMATION"), ("x", "o", "TRANSFORMATION"), ("o", "v", "TRANSFORMATION")]
    kinds = {"x": "VALUE", "o": "OPERATOR", "v": "VALUE", "s": "METHODCALL"}
    held = [("s", "x", "SUPPLIES"), *twice]
    got, _ = pruned(spark, {0: (kinds, twice), 1: (kinds, held), 2: (kinds, [])})
    assert got == {0: [], 1: sorted(held), 2: []}


@pytest.mark.parametrize("seed", [1])
def test_random_graphs_end_where_no_rule_applies(spark, seed):
    rng = random.Random(seed)
    graphs = {}
    for g in range(8):
        kinds = {f"n{i}": rng.choice(["OPERATOR", "VALUE", "VALUE", "METHODCALL"]) for i in range(14)}
        graphs[g] = (kinds, [(*rng.sample(sorted(kinds), 2), "TRANSFORMATION") for _ in range(18)])
    got, _ = pruned(spark, graphs)
    for g, (kinds, _) in graphs.items():
        own = {x for e in got[g] for x in e[:2]}
        left = {i: k for i, k in kinds.items() if i in own}
        # what still fits a rule has an operand that is its own result
        after = rewrite(left, got[g], random.Random(0))
        assert after == got[g] or any((d, o) in {(s, t) for s, t, _ in got[g]} for o, d, _ in got[g] if left.get(o) == "OPERATOR")


def test_graphs_of_a_task_and_of_tables_end_alike(spark):
    """F8: graphs of bounded size end in one round of tables, larger ones by rounds of their own."""
    rng = random.Random(5)
    graphs = {g: expressions(rng)[:2] for g in range(20)}
    sizes = {g: len(e) + sum(k == "OPERATOR" for k in kinds.values()) for g, (kinds, e) in graphs.items()}
    held = sorted(sizes.values())[10]
    assert min(sizes.values()) < held < max(sizes.values())
    (small, once), (mixed, rounds) = pruned(spark, graphs), pruned(spark, graphs, held=held)
    assert len(once.log) == 1 < len(rounds.log)
    assert small == mixed == {g: rewrite(kinds, edges, random.Random(0)) for g, (kinds, edges) in graphs.items()}


def test_a_graph_ends_alike_whatever_graphs_are_beside_it():
    rng = random.Random(7)
    graphs = {}
    for g in range(12):
        kinds = {f"n{i}": rng.choice(["OPERATOR", "VALUE", "VALUE", "METHODCALL"]) for i in range(14)}
        graphs[g] = (kinds, [(*rng.sample(sorted(kinds), 2), "TRANSFORMATION") for _ in range(18)])
    rows = [(g, s, d, k, None) for g, (_, edges) in graphs.items() for s, d, k in edges] + [(g, i, None, None, 31 * g + n) for g, (kinds, _) in graphs.items() for n, (i, k) in enumerate(kinds.items()) if k == "OPERATOR"]
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=["g", "s", "d", "k", "n"])
    ended = lambda some: sorted(zip(*(c.to_pylist() for c in pruning._pruned(batch(sorted(some, key=lambda r: r[0]))))))
    assert ended(rows) == sorted(e for g in graphs for e in ended([r for r in rows if r[0] == g]))


# branch trees


def grow(records):
    """The tree of traces [(trace, [(kind, condition, truth)])] as a dict of path to node."""
    nodes = {}

    def build(group, last, path):
        if not group:
            nodes[path] = ("empty", None, None, (0, 0), 0)
            return
        trace, first = group[0]
        fork = next((i for i in range(last + 1, len(first)) if first[i][0] == "Assertion"), None)
        start = 0 if last == 0 else last + 1
        if fork is None:
            end = len(first) - 1
            start = 0 if last == 0 else min(last + 1, end)
            rest = first[start:end]
            kind = {"UncaughtException": "uncaught", "Halt": "halt"}.get(rest[-1][0] if rest else None, "regular")
            nodes[path] = (kind, None, trace, (start, max(start, end)), len(group))
            return
        nodes[path] = ("fork", first[fork][1], trace, (start, max(start, fork - 1)), len(group))
        true = [t for t in group if fork < len(t[1]) and t[1][fork][0] == "Assertion" and t[1][fork][2]]
        build(true, fork, path + "T")
        build([t for t in group if t not in true], fork, path + "F")

    build(records, 0, "")
    return nodes


def test_trees_of_traces_that_disagree(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for entry in range(6):
        group = []
        for trace in range(rng.randrange(1, 14)):
            shape = rng.choice([0, 1])  # two sorts of traces whose assertions stand elsewhere
            own = []
            for i in range(rng.randrange(1, 12)):
                kind = "Assertion" if (i * (2 + shape)) % 3 == 1 and rng.random() < 0.9 else rng.choice(["Other", "Halt", "UncaughtException", "Call"])
                own.append((kind, f"c{rng.randrange(4)}" if kind == "Assertion" else None, rng.random() < 0.5 if kind == "Assertion" else None))
            group.append((trace, own))
            rows += [(entry, trace, i, *r) for i, r in enumerate(own)]
        want[entry] = grow(group)
    rng.shuffle(rows)
    records = spark.createDataFrame(rows, "entry int, trace int, at int, kind string, condition string, truth boolean")
    nodes = refine.tree(records)
    got = defaultdict(dict)
    for r in nodes.collect():
        got[r.entry][r.path] = (r.kind, r.condition, r.leader, (r.start, r.stop) if r.kind != "empty" else (0, 0), r.traces)
        assert r.depth == len(r.path)
    assert dict(got) == want
    kept = defaultdict(list)
    for r in refine.preceding(nodes, records).orderBy("at").collect():
        kept[r.entry, r.path].append(r.at)
    assert all(kept[e, p] == list(range(*n[3])) for e, own in want.items() for p, n in own.items())

    def height(own, path=""):
        return 1 + (max(height(own, path + "T"), height(own, path + "F")) if own[path][0] == "fork" else 0)

    for r in refine.measures(nodes).collect():
        own = want[r.entry]
        forks = [p for p, n in own.items() if n[0] == "fork"]
        assert (r.height, r.size, r.terminals, r.internals) == (height(own) + 1, len(own) + 1, len(own) - len(forks), len(forks))
    for r in refine.conditions(nodes).collect():
        own = want[r.entry]
        sets = {frozenset((own[p[:i]][1], p[i]) for i in range(len(p))) for p, n in own.items() if n[0] != "fork" and p}
        assert r.conditions == len(sets)


def test_no_records(spark):
    none = spark.createDataFrame([], "entry int, trace int, at int, kind string, condition string, truth boolean")
    assert refine.tree(none).isEmpty()


def test_traces_that_assert_alike_and_single_ones_take_few_rounds(spark):
    rounds = Rounds(spark, "test")
    rows = [(0, t, at, "Assertion", f"c{at % 3}", (at * 7 + t // 4) % 5 < 2) for t in range(12) for at in range(1, 60)]
    nodes = refine.tree(spark.createDataFrame(rows + [(0, t, 0, "x", None, None) for t in range(12)], "entry int, trace int, at int, kind string, condition string, truth boolean"), rounds)
    assert nodes.agg({"depth": "max"}).first()[0] == 59
    assert sum(x["kind"] == "tree" for x in rounds.log if "kind" in x) < 8
    assert {r["traces"] for r in nodes.filter("depth > 10 and kind <> 'empty'").collect()} == {4}
