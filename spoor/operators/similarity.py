"""Assignment, iterative graph comparison and trace condensing.

These steps are inherently sequential within one pair or one entry point; they run as
grouped pandas functions, in parallel over pairs and entry points.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def hungarian(costs: np.ndarray) -> np.ndarray:
    """SIM-1: least-cost assignment of rows to columns by shortest augmenting paths; -1 where a row gets none.

    Rectangular costs are padded with 0; NaN and infinities are refused.
    """
    c = np.asarray(costs, float)
    if not np.isfinite(c).all():
        raise ValueError("costs must be finite")
    rows, cols = c.shape
    if c.size and c.min() == c.max():  # any assignment is as good: the one in order
        return np.where(np.arange(rows) < cols, np.arange(rows), -1)
    n = max(rows, cols)
    padded = np.zeros((n, n))
    padded[:rows, :cols] = c
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, int)  # row (from 1) of each column (from 1)
    for i in range(1, n + 1):
        match[0] = i
        j = 0
        least, back, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[j]:
            used[j] = True
            free = ~used[1:]
            reduced = padded[match[j] - 1] - u[match[j]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            back[1:][better] = j
            k = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[k]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j = k
        while j:
            match[j] = match[back[j]]
            j = back[j]
    out = np.full(rows, -1)
    for j in range(1, n + 1):
        if match[j] <= rows and j <= cols:
            out[match[j] - 1] = j - 1
    return out


def greedy(costs: np.ndarray) -> np.ndarray:
    """SIM-2: row after row takes its cheapest free column."""
    c = np.array(costs, float)
    out = np.full(len(c), -1)
    for i in range(min(c.shape)):
        out[i] = int(c[i].argmin())
        c[:, out[i]] = np.inf
    return out


#: Cells of the matrices that are solved together.
CELLS_AT_ONCE = 2_000_000


def hungarian_each(costs: np.ndarray) -> np.ndarray:
    """``hungarian`` of each of many matrices of one shape, step by step for all of them at once; a matrix has the assignment it has by itself."""
    c = np.asarray(costs, float)
    if not np.isfinite(c).all():
        raise ValueError("costs must be finite")
    many, rows, cols = c.shape
    if many == 1:
        return hungarian(c[0])[None]
    out = np.where(np.arange(rows) < cols, np.arange(rows), -1)[None].repeat(many, 0)
    flat = c.reshape(many, -1)
    uneven = np.flatnonzero(flat.min(1) != flat.max(1)) if flat.size else np.zeros(0, int)
    if not len(uneven):
        return out
    n, b = max(rows, cols), len(uneven)
    padded = np.zeros((b, n, n))
    padded[:, :rows, :cols] = c[uneven]
    u, v, match = np.zeros((b, n + 1)), np.zeros((b, n + 1)), np.zeros((b, n + 1), int)
    for i in range(1, n + 1):
        match[:, 0] = i
        j = np.zeros(b, int)
        least, back, used = np.full((b, n + 1), np.inf), np.zeros((b, n + 1), int), np.zeros((b, n + 1), bool)
        on = np.arange(b)  # those whose path has not come to a free column
        while len(on):
            used[on, j[on]] = True
            row = match[on, j[on]]
            free = ~used[on, 1:]
            reduced = padded[on, row - 1] - u[on, row][:, None] - v[on, 1:]
            l = least[on, 1:]
            better = free & (reduced < l)
            l = np.where(better, reduced, l)
            back[on, 1:] = np.where(better, j[on][:, None], back[on, 1:])
            k = np.where(free, l, np.inf).argmin(1)
            delta = l[np.arange(len(on)), k]
            least[on, 1:] = np.where(free, l - delta[:, None], l)
            taken = used[on]
            g, at = np.nonzero(taken)
            u[on[g], match[on[g], at]] += delta[g]
            v[on] -= np.where(taken, delta[:, None], 0.0)
            j[on] = k + 1
            on = on[match[on, j[on]] != 0]
        on = np.flatnonzero(j)
        while len(on):
            match[on, j[on]] = match[on, back[on, j[on]]]
            j[on] = back[on, j[on]]
            on = on[j[on] != 0]
    solved = np.full((b, n), -1)
    g, at = np.nonzero(match[:, 1:])
    solved[g, match[:, 1:][g, at] - 1] = at
    solved = solved[:, :rows]
    out[uneven] = np.where(solved < cols, solved, -1)
    return out


def greedy_each(costs: np.ndarray) -> np.ndarray:
    """``greedy`` of each of many matrices of one shape."""
    c = np.array(costs, float)
    out, every = np.full(c.shape[:2], -1), np.arange(len(c))
    for i in range(min(c.shape[1:])):
        out[:, i] = c[:, i].argmin(1)
        c[every, :, out[:, i]] = np.inf
    return out


def matches(costs: np.ndarray, threshold: float = 0.0) -> list[tuple[int, int, float]]:
    """SIM-3: (row, column, similarity) of assigned pairs at or above the threshold."""
    if not np.size(costs):
        return []
    return [(i, int(j), 1 - float(costs[i][j])) for i, j in enumerate(hungarian(costs)) if j >= 0 and 1 - costs[i][j] >= threshold]


def assign(costs: DataFrame, group: str, row: str, col: str, cost: str, method: str = "optimal", threshold: float = 0.0) -> DataFrame:
    """SIM-1..3: (group, row, col, similarity) for a table of dense costs, each group one matrix; rows and columns in order of their keys.

    ``method`` is optimal or greedy.  A group's matrix is one cell array in one task: groups are
    the blocks of a pair of graphs, not whole graphs.  An absent cell is an error of the caller.
    """
    from pyspark.sql import functions as F

    solve = {"optimal": hungarian_each, "greedy": greedy_each}[method]
    packed = costs.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(row).alias("r"), F.col(col).alias("c"), F.col(cost).cast("double").alias("v")))).alias("cells"))
    t = {f.name: f.dataType.simpleString() for f in costs.schema}
    schema = f"{group} {t[group]}, {row} {t[row]}, {col} {t[col]}, similarity double"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            cells = lists.flatten()
            r, c, v = (cells.field(i) for i in range(3))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            # cells come by row, so a group's columns are as many as its first row has cells
            rows_differ = np.ones(len(r), bool)
            code = r.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            rows_differ[1:] = code[1:] != code[:-1]
            rows_differ[starts] = True
            height = np.add.reduceat(rows_differ.astype(int), starts) if len(starts) else starts
            width = sizes // np.maximum(height, 1)
            ccode = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            costs_ = v.to_numpy(zero_copy_only=False)
            parts = []
            for n, m in sorted(set(zip(height.tolist(), width.tolist()))):
                at = np.flatnonzero((height == n) & (width == m))
                full = bool((sizes[at] == n * m).all())
                if full:
                    cell = starts[at][:, None] + np.arange(n * m)
                    columns_ = ccode[cell].reshape(-1, n, m)
                    full = (columns_ == columns_[:, :1]).all() and rows_differ[cell[:, ::m]].all()
                if not full:
                    raise ValueError(f"the costs of {keys[int(at[0])].as_py()} or of another group of {n} rows are not a full matrix")
                for some in np.array_split(np.arange(len(at)), max(1, -(-len(at) * n * m // CELLS_AT_ONCE))):
                    matrix = costs_[cell[some]].reshape(-1, n, m)
                    met = solve(matrix)
                    g, i = np.nonzero(met >= 0)
                    j = met[g, i]
                    sim = 1 - matrix[g, i, j]
                    kept = sim >= threshold
                    g, i, j, sim = g[kept], i[kept], j[kept], sim[kept]
                    parts.append((at[some][g], cell[some][g, i * m], cell[some][g, j], sim))
            if parts:
                g, ri, ci, sim = (np.concatenate(x) for x in zip(*parts))
                columns = [keys.take(pa.array(g)), r.take(pa.array(ri)), c.take(pa.array(ci)), pa.array(sim)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, target)], schema=target)

    return packed.mapInArrow(run, schema)


class Graph:
    """One graph of a pair, in memory: nodes {id: row} and edges (src, dst, kind)."""

    def __init__(self, nodes: dict[str, dict], edges: list[tuple[str, str, str]]):
        self.nodes, self.around = nodes, defaultdict(list)
        for s, d, k in edges:
            self.around[s].append((d, k, True))
            if s != d:
                self.around[d].append((s, k, False))


def edge_match(a: str, b: str) -> bool:
    """FN-20: the same kind, or a parameter and a scope."""
    return a == b or {a, b} == {"PARAMETER", "SCOPE"}


def node_match(a: dict, b: dict) -> bool:
    """FN-21 on kind and label: entry points; equal operators; calls by name, prefix or type; data by label."""
    if a["kind"] != b["kind"]:
        return False
    if a["kind"] == "ENTRYPOINT":
        return True
    x, y = str(a["label"]), str(b["label"])
    if a["kind"] == "METHODCALL":
        return x == y or x.startswith(y) or y.startswith(x) or (a.get("type") is not None and a.get("type") == b.get("type"))
    return x == y


def _blocks(cost: dict[tuple[str, str], float]) -> list[tuple[list[str], list[str]]]:
    """Rows and columns joined by costs below 1, the cost of unlike pairs: blocks can be solved each by itself without loss."""
    rows, columns = defaultdict(list), defaultdict(list)
    for (l, r), v in cost.items():
        if v < 1:
            rows[l].append(r)
            columns[r].append(l)
    seen: set[str] = set()
    out = []
    for first in sorted(rows):
        if first in seen:
            continue
        seen.add(first)
        todo, ls, rs = [first], [], set()
        while todo:
            l = todo.pop()
            ls.append(l)
            for r in rows[l]:
                if r not in rs:
                    rs.add(r)
                    new = [x for x in columns[r] if x not in seen]
                    seen.update(new)
                    todo += new
        out.append((sorted(ls), sorted(rs)))
    return out


def compare(left: Graph, right: Graph, match: Callable[[dict, dict], bool] = node_match, residual: float = 0.7) -> dict:
    """SIM-4: initial candidates, assignment, propagation over matching edges, residual assignment, propagation.

    Candidates are operators with the same label and calls with the same signature; their
    cost is 1 - deg(l) / max(deg) (quirk Q-1), 1 without edges (Q-2).  Of several edge pairs
    that lead to one pair of neighbours the cheapest counts (our stance on Q-4).
    """
    lmap: dict[str, str] = {}
    rmap: dict[str, str] = {}

    def best(ls: list[str], rs: list[str], cost: dict[tuple[str, str], float], threshold: float = 0.0) -> list[tuple[str, str]]:
        if not ls or not rs:
            return []
        out = []
        for bl, br in _blocks(cost):
            c = np.array([[cost.get((l, r), 1.0) for r in br] for l in bl])
            out += [(bl[i], br[j]) for i, j, s in matches(c, threshold) if s > 0]
        return sorted(out)

    def take(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
        for l, r in pairs:
            lmap[l], rmap[r] = r, l
        return pairs

    def spread(last: list[tuple[str, str]]) -> None:
        while last:
            cost: dict[tuple[str, str], float] = {}
            for l, r in last:
                for lo, lk, lout in left.around[l]:
                    if lo in lmap:
                        continue
                    for ro, rk, rout in right.around[r]:
                        if ro in rmap or lout != rout:
                            continue
                        c = 0.0 if edge_match(lk, rk) and match(left.nodes[lo], right.nodes[ro]) else 1.0
                        cost[lo, ro] = min(c, cost.get((lo, ro), 1.0))
            ls, rs = sorted({l for l, _ in cost}), sorted({r for _, r in cost})
            last = take(best(ls, rs, cost))

    keyed: dict[tuple, list[str]] = defaultdict(list)
    for i, n in sorted(right.nodes.items()):
        if n["kind"] in ("OPERATOR", "METHODCALL"):
            keyed[n["kind"], n["label"]].append(i)
    calls: dict[tuple, list[str]] = defaultdict(list)
    for i, n in sorted(left.nodes.items()):
        if (n["kind"], n["label"]) in keyed:
            calls[n["kind"], n["label"]].append(i)
    cost, free = {}, []
    for key, ls in calls.items():
        # nodes without edges cost 1; if no right node has more edges than a left one, all else costs 0 and goes in order
        ls, rs = [i for i in ls if left.around[i]], [j for j in keyed[key] if right.around[j]]
        if ls and rs and min(len(left.around[i]) for i in ls) >= max(len(right.around[j]) for j in rs):
            free += zip(ls, rs)
        else:
            cost |= {(i, j): 1 - len(left.around[i]) / max(len(left.around[i]), len(right.around[j])) for i in ls for j in rs}
    spread(take(sorted(free + best(sorted({l for l, _ in cost}), sorted({r for _, r in cost}), cost))))
    rest_l, rest_r = [i for i in sorted(left.nodes) if i not in lmap], [j for j in sorted(right.nodes) if j not in rmap]
    if rest_l and rest_r:
        c = {(i, j): 0.0 for i in rest_l for j in rest_r if match(left.nodes[i], right.nodes[j])}
        spread(take(best(rest_l, rest_r, c, residual)))
    nl, nr, ml, mr = len(left.nodes), len(right.nodes), len(lmap), len(rmap)
    share = lambda a, b: a / b if b else 0.0  # noqa: E731  two empty graphs have nothing in common
    return {
        "union_sim": share(ml + mr, nl + nr), "lr_sim": share(ml, nl), "rl_sim": share(mr, nr),
        "l_disjoint": share(nl - ml, nl), "r_disjoint": share(nr - mr, nr), "mapping": sorted(lmap.items()),
    }


def compare_pairs(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SIM-4 for (lhs, rhs) pairs of graph ids: each pair's two graphs meet in one task, packed as one row a graph."""
    from pyspark.sql import functions as F

    packed = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "kind", "label"))).alias("ns"))
    linked = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "kind"))).alias("es"))
    g = packed.join(linked, "graph_id", "left")
    l, r = (g.select(F.col("graph_id").alias(s), F.struct("ns", "es").alias(f"{s}_g")) for s in ("lhs", "rhs"))
    rows = pairs.join(l, "lhs").join(r, "rhs")

    def graph(x) -> Graph:
        return Graph({n["node_id"]: {"kind": n["kind"], "label": n["label"]} for n in x["ns"]}, [(e["src"], e["dst"], e["kind"]) for e in (x["es"] if x["es"] is not None else [])])

    def run(batches):
        for pdf in batches:
            out = [compare(graph(a), graph(b)) for a, b in zip(pdf["lhs_g"], pdf["rhs_g"])]
            yield pd.DataFrame({"lhs": pdf["lhs"], "rhs": pdf["rhs"], **{k: [o[k] for o in out] for k in ("union_sim", "lr_sim", "rl_sim")}})

    t = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return rows.mapInPandas(run, f"lhs {t['lhs']}, rhs {t['rhs']}, union_sim double, lr_sim double, rl_sim double")


def condense(items: list, similar: Callable[[object, object], float], size: Callable[[object], int], threshold: float = 0.9) -> list[tuple[object, int]]:
    """SIM-5: leader clustering in order; a leader's weight is its cluster's size.

    An item joins the first leader whose size is within the ratio and whose similarity
    reaches the threshold.
    """
    leaders: list[list] = []
    for x in items:
        for leader in leaders:
            a, b = size(leader[0]), size(x)
            if max(a, b) and min(a, b) / max(a, b) < threshold:
                continue
            if similar(leader[0], x) >= threshold:
                leader[1] += 1
                break
        else:
            leaders.append([x, 1])
    return [(x, n) for x, n in leaders]


def condense_traces(sets: DataFrame, entry: str, trace: str, codes: str, threshold: float = 0.9) -> DataFrame:
    """SIM-5 over (entry, trace, codes): one row for each leader, found in rounds over tables (``leaders``)."""
    from spoor.operators import leaders

    return leaders.condense(sets, entry, trace, codes, threshold)[0]
