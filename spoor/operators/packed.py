"""Comparison of many pairs of small graphs (SIM-4): a graph is one row of arrays, and a task compares thousands of pairs at once.

The steps are those of ``similarity.compare``, of which each is one operation on the nodes of all pairs at hand: candidates and
neighbours are joins of arrays, blocks are components by labels, and blocks of one shape are solved together.  Graphs of more
than ``WITHIN`` nodes and edges go by the tables of ``comparison``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from spoor.operators import comparison, similarity
from spoor.operators.graph import EDGE_KINDS, NODE_KINDS
from spoor.operators.rounds import Rounds

PAIR = comparison.PAIR
#: Nodes and edges of a graph that is one row, pairs that are compared at once, and their possible pairs of nodes.
WITHIN, SOME, CELLS = 500, 2048, 2_000_000
_OPERATOR, _CALL, _ENTRY = (NODE_KINDS.index(k) + 1 for k in ("OPERATOR", "METHODCALL", "ENTRYPOINT"))
_PARAMETER, _SCOPE = (EDGE_KINDS.index(k) + 1 for k in ("PARAMETER", "SCOPE"))


def pack(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, kinds, labels[, types], src, dst, links): nodes in the order of their names, edges by the places of their nodes (-1 for none).

    Kinds are numbers from 1, or 0 for others, whose names are then a part of the label.
    """
    place = lambda names: F.array_position(F.array(*map(F.lit, names)), F.col("kind")).cast("tinyint")
    kind = F.coalesce(place(NODE_KINDS), F.lit(0).cast("tinyint"))
    label = F.when(kind == 0, F.concat(F.coalesce("kind", F.lit("")), F.lit("\x00"), "label")).otherwise(F.col("label"))
    more = ["type"] if "type" in nodes.columns else []
    ns = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", kind.alias("k"), label.alias("l"), *more))).alias("ns"))
    es = edges.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", F.coalesce(place(EDGE_KINDS), F.lit(0).cast("tinyint")).alias("k"))).alias("es"))
    at = lambda end: F.transform("es", lambda e: (F.array_position("ns.node_id", e[end]) - 1).cast("int")).alias(end)
    types = [F.col("ns.type").alias("types")] if more else []
    return ns.join(es, "graph_id", "left").select("graph_id", F.col("ns.k").alias("kinds"), F.col("ns.l").alias("labels"), *types, at("src"), at("dst"), F.col("es.k").alias("links"))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and of which range each is."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), of


def _meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all equal keys a[i] == b[j]."""
    order = np.argsort(b, kind="stable")
    low = np.searchsorted(b[order], a, "left")
    j, i = _ranges(low, np.searchsorted(b[order], a, "right") - low)
    return i, order[j]


class Side:
    """One side of some pairs: the nodes of all of them in a row, ``pair`` telling whose a node is, and each edge from both of its ends."""

    def __init__(self, columns: dict[str, pa.Array], codes: dict[str, int], names: list[str]):
        size = lambda c: pc.fill_null(pc.list_value_length(columns[c]), 0).to_numpy(zero_copy_only=False)
        flat = lambda c: columns[c].flatten()
        self.sizes = size("kinds").astype(np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        n = int(self.sizes.sum())
        self.pair = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.kind = flat("kinds").to_numpy(zero_copy_only=False).astype(np.int64)

        def coded(column: str) -> np.ndarray:
            found = flat(column).dictionary_encode()
            own = []
            for x in found.dictionary.to_pylist():
                if x not in codes:
                    codes[x] = len(names)
                    names.append(x)
                own.append(codes[x])
            at = pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False)
            return np.array([*own, -1], np.int64)[at]

        self.label = coded("labels")
        self.type = coded("types") if "types" in columns else np.full(n, -1)
        edges = size("src")
        base = np.repeat(self.firsts, edges)
        src, dst = (flat(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("src", "dst"))
        links = flat("links").to_numpy(zero_copy_only=False).astype(np.int64)
        # a node's degree counts edges to what is no node, too
        twice = src != dst
        self.degree = np.bincount((base + src)[src >= 0], minlength=n) + np.bincount((base + dst)[twice & (dst >= 0)], minlength=n)
        whole = (src >= 0) & (dst >= 0)
        there, back = (base + src)[whole], (base + dst)[whole]
        loop, k = ~twice[whole], links[whole]
        node, self.other = np.concatenate((there, back[~loop])), np.concatenate((back, there[~loop]))
        link, out = np.concatenate((k, k[~loop])), np.concatenate((np.ones(len(k), bool), np.zeros(int((~loop).sum()), bool)))
        order = np.argsort(node, kind="stable")
        node, self.other, self.link, self.out = node[order], self.other[order], link[order], out[order]
        self.begin = np.searchsorted(node, np.arange(n + 1))
        self.free = np.ones(n, bool)


def _begins(l: np.ndarray, r: np.ndarray, names: list[str]) -> np.ndarray:
    """Whether one label begins the other; told once for each two labels."""
    both, at = np.unique(l * len(names) + r, return_inverse=True)
    a, b = both // len(names), both % len(names)
    return np.array([names[x].startswith(names[y]) or names[y].startswith(names[x]) for x, y in zip(a.tolist(), b.tolist())], bool)[at]


def _alike(left: Side, right: Side, l: np.ndarray, r: np.ndarray, names: list[str]) -> np.ndarray:
    """FN-21 of the nodes."""
    kind = left.kind[l]
    out = left.label[l] == right.label[r]
    out |= kind == _ENTRY
    out &= kind == right.kind[r]
    calls = np.flatnonzero((kind == _CALL) & (right.kind[r] == _CALL) & ~out)
    if len(calls):
        a, b = l[calls], r[calls]
        out[calls] = ((left.type[a] == right.type[b]) & (left.type[a] >= 0)) | _begins(left.label[a], right.label[b], names)
    return out


def assign(l: np.ndarray, r: np.ndarray, cost: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Least-cost assignments of candidates (distinct pairs of nodes, costs below 1), block by block as in ``similarity``."""
    if not len(l):
        return l, r
    (ls, li), (rs, ri) = (np.unique(x, return_inverse=True) for x in (l, r))
    name = np.arange(len(ls))
    while True:  # a block is named after its first row
        of = np.full(len(rs), len(ls))
        np.minimum.at(of, ri, name[li])
        new = name.copy()
        np.minimum.at(new, li, of[ri])
        new = new[new]
        if (new == name).all():
            break
        name = new
    blocks, lb = np.unique(name, return_inverse=True)
    rb = np.searchsorted(blocks, of)

    def ranks(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(block, kind="stable")
        sizes = np.bincount(block, minlength=len(blocks))
        rank = np.empty(len(block), np.int64)
        firsts = np.cumsum(sizes) - sizes
        rank[order] = np.arange(len(block)) - np.repeat(firsts, sizes)
        return order, firsts, rank

    lo, lf, lr = ranks(lb)
    ro, rf, rr = ranks(rb)
    height, width = np.bincount(lb, minlength=len(blocks)), np.bincount(rb, minlength=len(blocks))
    of_cell = lb[li]
    found_l, found_r = [], []
    by = np.argsort(of_cell, kind="stable")
    cells = np.bincount(of_cell, minlength=len(blocks))
    begin = np.cumsum(cells) - cells
    shape = height * (int(width.max()) + 1) + width
    for s in np.unique(shape):
        every = np.flatnonzero(shape == s)
        n, m = int(height[every[0]]), int(width[every[0]])
        for some in np.array_split(every, -(-len(every) * n * m // similarity.CELLS_AT_ONCE)):
            place, k = _ranges(begin[some], cells[some])
            c = by[place]
            matrix = np.ones((len(some), n, m))
            matrix[k, lr[li[c]], rr[ri[c]]] = cost[c]
            met = similarity.hungarian_each(matrix)
            g, i = np.nonzero(met >= 0)
            j = met[g, i]
            sim = 1 - matrix[g, i, j]
            kept = (sim >= threshold) & (sim > 0)
            g, i, j = g[kept], i[kept], j[kept]
            found_l.append(ls[lo[lf[some[g]] + i]])
            found_r.append(rs[ro[rf[some[g]] + j]])
    return np.concatenate(found_l), np.concatenate(found_r)


def mapped(left: Side, right: Side, names: list[str], residual: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that match in all pairs."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def take(two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left.free[two[0]], right.free[two[1]] = False, False
        found.append(two)
        return two

    def spread(last: tuple[np.ndarray, np.ndarray]) -> None:
        while len(last[0]):
            # all edges of one with all edges of the other
            i, of = _ranges(left.begin[last[0]], left.begin[last[0] + 1] - left.begin[last[0]])
            at = last[1][of]
            j, again = _ranges(right.begin[at], right.begin[at + 1] - right.begin[at])
            i = i[again]
            lk, rk, l, r = left.link[i], right.link[j], left.other[i], right.other[j]
            fits = (lk == rk) & (lk > 0) | (lk == _PARAMETER) & (rk == _SCOPE) | (lk == _SCOPE) & (rk == _PARAMETER)
            fits &= (left.out[i] == right.out[j]) & left.free[l] & right.free[r]
            l, r = l[fits], r[fits]
            some = _alike(left, right, l, r, names)
            both = np.unique(l[some] * len(right.kind) + r[some])
            last = take(assign(both // max(len(right.kind), 1), both % max(len(right.kind), 1), np.zeros(len(both)), 0.0))

    calls = lambda s: np.flatnonzero(((s.kind == _OPERATOR) | (s.kind == _CALL)) & (s.degree > 0))
    lc, rc = calls(left), calls(right)
    key = lambda s, x: (s.pair[x] * 8 + s.kind[x]) * len(names) + s.label[x]
    i, j = _meet(key(left, lc), key(right, rc))
    l, r = lc[i], rc[j]
    spread(take(assign(l, r, 1 - left.degree[l] / np.maximum(left.degree[l], right.degree[r]), 0.0)))
    lc, rc = np.flatnonzero(left.free), np.flatnonzero(right.free)
    i, j = _meet(left.pair[lc], right.pair[rc])
    l, r = lc[i], rc[j]
    some = _alike(left, right, l, r, names)
    spread(take(assign(l[some], r[some], np.zeros(int(some.sum())), residual)))
    return tuple(np.concatenate(x) for x in zip(*found))


def compare(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, residual: float = 0.7, within: int = WITHIN) -> tuple[DataFrame, Rounds]:
    """(scores, rounds): scores as ``comparison.compare_tables`` gives them, for pairs of graphs of any size.  A graph's nodes differ in their ids."""
    rounds = Rounds(pairs.sparkSession, "packed")
    pairs = rounds.keep(pairs.select(*PAIR).distinct(), "pairs", "lhs")
    size = lambda df: df.groupBy("graph_id").agg(F.count("*").alias("n"))
    large = rounds.keep(size(nodes).unionByName(size(edges)).groupBy("graph_id").agg(F.sum("n").alias("n")).filter(F.col("n") > within).select("graph_id"), "large")
    lean, wide = pairs, None
    if not large.isEmpty():
        of = lambda s: large.select(F.col("graph_id").alias(s))
        told = pairs.join(of("lhs").withColumn("l", F.lit(True)), "lhs", "left").join(of("rhs").withColumn("r", F.lit(True)), "rhs", "left")
        told = rounds.keep(told.select(*PAIR, F.coalesce("l", "r", F.lit(False)).alias("wide")), "told", "lhs")
        lean = told.filter("NOT wide").select(*PAIR)
        wide = rounds.keep(told.filter("wide").select(*PAIR), "wide")
        met = rounds.keep(wide.select(F.explode(F.array(*PAIR)).alias("graph_id")).distinct(), "graphs")
        wide = comparison.compare_tables(wide, nodes.join(met, "graph_id", "left_semi"), edges.join(met, "graph_id", "left_semi"), residual)[0]
        nodes, edges = (x.join(large, "graph_id", "left_anti") for x in (nodes, edges))
    typed = nodes.select("graph_id", F.col("node_id").cast("string").alias("node_id"), "kind", F.coalesce(F.col("label").cast("string"), F.lit("None")).alias("label"), *([F.col("type").cast("string").alias("type")] if "type" in nodes.columns else []))
    graphs = rounds.keep(pack(typed, edges.select("graph_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "kind")), "graphs", "graph_id")
    of = lambda s: graphs.select(F.col("graph_id").alias(s), *[F.col(c).alias(f"{s[0]}_{c}") for c in graphs.columns[1:]])
    met = lean.join(of("lhs"), "lhs", "left").join(of("rhs"), "rhs", "left")
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    names_ = ("union_sim", "lr_sim", "rl_sim", "l_disjoint", "r_disjoint")
    schema = ", ".join(f"{c} {kinds[c]}" for c in PAIR) + ", " + ", ".join(f"{c} double" for c in names_) + ", mapped bigint"
    target, order = to_arrow_schema(_parse_datatype_string(schema)), met.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {c: k for k, c in enumerate(order)}
        for whole in batches:
            # so many pairs that their possible pairs of nodes are bounded, but one
            n = [pc.fill_null(pc.list_value_length(whole.column(at[f"{x}_kinds"])), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in "lr"]
            cells, a = np.cumsum(n[0] * n[1]), 0
            while a < whole.num_rows:
                b = min(a + SOME, max(a + 1, int(np.searchsorted(cells, (cells[a - 1] if a else 0) + CELLS, "right"))))
                batch = whole.slice(a, b - a)
                a = b
                codes, names = {}, []
                left, right = (Side({c: batch.column(at[f"{x}_{c}"]) for c in graphs_columns}, codes, names) for x in "lr")
                m = np.bincount(left.pair[mapped(left, right, names, residual)[0]], minlength=batch.num_rows)
                nl, nr = left.sizes, right.sizes
                share = lambda x, y: np.divide(x, y, out=np.zeros(len(x)), where=y != 0)
                out = [batch.column(at["lhs"]), batch.column(at["rhs"]), *map(pa.array, (share(2 * m, nl + nr), share(m, nl), share(m, nr), share(nl - m, nl), share(nr - m, nr), m))]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, target)], schema=target)

    graphs_columns = graphs.columns[1:]
    scores = met.mapInArrow(run, schema)
    return (scores if wide is None else scores.unionByName(wide)), rounds
