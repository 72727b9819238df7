"""Pruning of chains of literals over tables (GR-6), all graphs together.

An operator with one result goes where it only works on values that nothing leads to:

* fold: nothing leads to any of its one or two operands (two if a binary one); its edges go, and with them
  a lone operand of a unary operator altogether, even if it is used elsewhere;
* pass: a unary operator whose operand has other edges into it and leads nowhere else hands them on to the result;
* absorb: of two operands nothing leads to one; both go with all their edges, and the first edge into the
  other one leads to the result instead.

An operand met twice (x op x) counts as two.  This repeats until nothing changes; nodes without edges are gone in the end.

In a round the operators that can be folded all go; of the others those go whose neighbourhood no other claims
that comes before it in this round's random order.  So each round is one of the orders in which operators could be visited, and a
chain of any length is contracted in rounds that grow with its logarithm.

Graphs of up to ``HELD`` rows are dealt over tasks, where the rounds of many graphs are array operations; a graph's random orders come from
its own names and rounds, so it ends alike whatever graphs are beside it.  The rounds of larger graphs are joins of written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spoor.operators.rounds import Rounds

_SAME = ["graph_id", "node_id"]
#: Edges and operators of a graph that goes to a task, and rows that are worked on there at once.
HELD, AT_ONCE = 10_000, 100_000


def _degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select("graph_id", F.inline(F.array(F.struct(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy(*_SAME).agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"))


def _operators(operators: DataFrame, edges: DataFrame, degrees: DataFrame) -> DataFrame:
    """(graph_id, op, result, args, rule): operators with one result and one or two operands, and the rule that applies."""
    fit = operators.join(degrees, _SAME).filter("outs = 1 AND ins IN (1, 2)").select("graph_id", F.col("node_id").alias("op"))
    arg = degrees.select("graph_id", F.col("node_id").alias("src"), F.col("ins").alias("a_ins"), F.col("outs").alias("a_outs"))
    args = edges.join(fit.withColumnRenamed("op", "dst"), ["graph_id", "dst"], "left_semi").join(arg, ["graph_id", "src"]).groupBy("graph_id", F.col("dst").alias("op")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("src").alias("id"), F.col("a_ins").alias("ins"), F.col("a_outs").alias("outs")))).alias("args")
    )  # at most two
    result = edges.join(fit.withColumnRenamed("op", "src"), ["graph_id", "src"], "left_semi").select("graph_id", F.col("src").alias("op"), F.col("dst").alias("result"))
    unary, a, z = F.size("args") == 1, F.col("args")[0], F.try_element_at("args", F.lit(2))
    free = F.size(F.filter("args", lambda x: x["ins"] == 0))
    rule = (
        F.when(unary & (free == 1), F.when(a["outs"] == 1, "fold").otherwise("erase")).when(unary & (a["outs"] == 1), "pass")
        .when(~unary & (free == 2), "fold").when(~unary & (free == 1) & (a["id"] != z["id"]), "absorb")
    )
    # an operator that is its own operand or result is left alone
    odd = (F.col("result") == F.col("op")) | F.exists("args", lambda x: x["id"].isin(F.col("op"), F.col("result")))
    return args.join(result, ["graph_id", "op"]).withColumn("rule", rule).filter("rule IS NOT NULL").filter(~odd)


def prune_tables(nodes: DataFrame, edges: DataFrame, held: int = HELD) -> tuple[DataFrame, DataFrame, Rounds]:
    """(nodes, edges, rounds): what is left of nodes (graph_id, node_id, kind) and edges (graph_id, src, dst, kind)."""
    rounds = Rounds(nodes.sparkSession, "prune")
    # edges have an id, so that equal ones count as two; the first of a node is the least by source and kind
    now = rounds.keep(edges.select("graph_id", "src", "dst", "kind").withColumn("id", F.monotonically_increasing_id()), "edges")
    operators = rounds.keep(nodes.filter("kind = 'OPERATOR'").select(*_SAME).distinct(), "operators")
    sizes = now.select("graph_id").unionByName(operators.select("graph_id")).groupBy("graph_id").count()
    large = rounds.keep(sizes.filter((F.col("count") > held) | F.col("graph_id").isNull()).select("graph_id"), "large")
    if large.isEmpty():
        out = rounds.keep(_in_tasks(operators, now), "left")
        rounds.note(kind="prune", round=1)
        rounds.drop(now, operators)
    else:
        part = lambda df, how: df.join(large, F.equal_null(df["graph_id"], large["graph_id"]), how)
        small = rounds.keep(_in_tasks(part(operators, "left_anti"), part(now, "left_anti")), "left")
        out = small.unionByName(_in_rounds(rounds.keep(part(operators, "left_semi"), "operators"), rounds.keep(part(now, "left_semi"), "edges"), rounds).select(*small.columns))
        rounds.drop(now, operators)
    rounds.drop(large)
    left = nodes.join(_degrees(out).select(*_SAME), _SAME, "left_semi")
    return left, out, rounds


def _in_rounds(operators: DataFrame, now: DataFrame, rounds: Rounds) -> DataFrame:
    """The edges that are left of kept edges, by rounds of tables."""
    step = 0
    while True:
        step += 1
        degrees = rounds.keep(_degrees(now), "degrees")
        able = rounds.keep(_operators(operators, now, degrees), "able")
        rounds.note(kind="prune", round=step)
        if able.isEmpty():
            rounds.drop(degrees, able, operators)
            break
        # folds need only that nothing leads to their operands, which stays so: all of them at once
        folded = able.filter("rule = 'fold'").select("graph_id", F.col("op").alias("node_id"))
        if not folded.isEmpty():
            gone = rounds.keep(folded, "gone")
            new = rounds.keep(_without(now, gone), "edges")
        else:
            gone, chosen = _claimed(able, now, rounds, step)
            kept = _without(now, gone)
            new = rounds.keep(kept.unionByName(_handed(chosen, now, gone)), "edges")
            rounds.drop(chosen)
        rounds.drop(now, degrees, able, gone)
        now = new
    return now


def _in_tasks(operators: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that are left, of graphs that are dealt over tasks as a whole."""
    # an operator is a row without ends but with a number of its own, for the random orders
    ops = operators.filter("node_id IS NOT NULL").select("graph_id", F.col("node_id").alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"), F.lit(None).cast("string").alias("kind"), F.xxhash64(*_SAME).alias("number"))
    rows = edges.select("graph_id", "src", "dst", "kind", F.lit(None).cast("bigint").alias("number")).unionByName(ops)
    out = edges.select("graph_id", "src", "dst", "kind").schema
    target = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n < AT_ONCE:
                continue
            rows = pa.concat_batches(waiting)
            starts = _starts(rows.column(0))
            # the last graph may go on
            waiting, n = [rows.slice(starts[-1])], rows.num_rows - int(starts[-1])
            if starts[-1]:
                yield pa.RecordBatch.from_arrays(_pruned(rows.slice(0, starts[-1])), schema=target)
        if n:
            yield pa.RecordBatch.from_arrays(_pruned(pa.concat_batches(waiting)), schema=target)

    return rows.repartition("graph_id").sortWithinPartitions("graph_id").mapInArrow(run, out)


def _starts(graphs: pa.Array) -> np.ndarray:
    """Where each graph's rows begin."""
    differ = pc.not_equal(graphs[1:], graphs[:-1]).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(differ) + 1))


def _pruned(rows: pa.RecordBatch) -> list[pa.Array]:
    """The columns of the edges that are left of whole graphs' rows (graph_id, src, dst, kind, number)."""
    graph, src, dst, kind, number = rows.columns
    starts = _starts(graph)
    of_row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
    edge = pc.is_null(number).to_numpy(zero_copy_only=False)
    e, o = np.flatnonzero(edge), np.flatnonzero(~edge)
    # nodes are numbers in the order of their graphs and names, edges come by source and kind
    rank = lambda x: pc.rank(x, tiebreaker="dense").to_numpy().astype(np.int64)
    names = pa.concat_arrays([src, dst.take(pa.array(e))])
    code = rank(names)
    key = np.concatenate((of_row, of_row[e])) * (code.max(initial=0) + 1) + code
    nodes, first, node = np.unique(key, return_index=True, return_inverse=True)
    order = np.lexsort((rank(kind.take(pa.array(e))), node[e]))
    s, d, row = node[e][order], node[rows.num_rows :][order], e[order]
    own = np.concatenate((of_row, of_row[e]))[first]
    operator, numbers = np.zeros(len(nodes), bool), np.zeros(len(nodes), np.uint64)
    operator[node[o]] = True
    numbers[node[o]] = number.take(pa.array(o)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    row, d = _rounds_of_arrays(s, d, row, operator, numbers, own)
    at = pa.array(row)
    return [graph.take(at), src.take(at), names.take(pa.array(first[d])), kind.take(at)]


def _mixed(numbers: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Other 64-bit numbers for each round."""
    x = numbers + (rounds.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rounds_of_arrays(s: np.ndarray, d: np.ndarray, row: np.ndarray, operator: np.ndarray, numbers: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, d) of the edges that are left of edges s to d, which come by s and kind; ``own`` is the graph of each node.

    The rules are those of ``_operators``, the choice that of ``_claimed``.
    """
    n = len(operator)
    past = np.zeros(own.max(initial=-1) + 1, np.int64)  # rounds of choices of each graph
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(s):
        ins, outs = np.bincount(d, minlength=n), np.bincount(s, minlength=n)
        fit = operator & (outs == 1) & (ins > 0) & (ins < 3)
        result = np.zeros(n, np.int64)
        result[s] = d
        into = np.flatnonzero(fit[d])
        into = into[np.lexsort((s[into], d[into]))]
        op, at, many = np.unique(d[into], return_index=True, return_counts=True)
        unary = many == 1
        a, z = s[into][at], s[into][at + many - 1]
        free = (ins[a] == 0).astype(int) + (~unary & (ins[z] == 0))
        odd = (result[op] == op) | (a == op) | (z == op) | (a == result[op]) | (z == result[op])
        fold = ~odd & np.where(unary, (free == 1) & (outs[a] == 1), free == 2)
        erase = ~odd & unary & (free == 1) & (outs[a] != 1)
        hand = ~odd & np.where(unary, (free == 0) & (outs[a] == 1), (free == 1) & (a != z))
        able = fold | erase | hand
        # graphs without such operators are at their end
        going = np.zeros(len(past), bool)
        going[own[op[able]]] = True
        on = going[own[s]]
        done.append((row[~on], d[~on]))
        s, d, row = s[on], d[on], row[on]
        # folds need only that nothing leads to their operands, which stays so: all of a graph's at once
        folding = np.zeros(len(past), bool)
        folding[own[op[fold]]] = True
        gone = np.zeros(n, bool)
        gone[op[fold]] = True
        c = np.flatnonzero((erase | hand) & ~folding[own[op]])
        if len(c):
            drawn = np.empty(len(c), np.int64)
            drawn[np.lexsort((op[c], _mixed(numbers[op[c]], past[own[op[c]]])))] = np.arange(len(c))
            past[np.unique(own[op[c]])] += 1
            near = np.stack((op[c], result[op[c]], a[c], z[c]))
            least = np.full(n, len(c))
            np.minimum.at(least, near, drawn[None].repeat(4, 0))
            # a claim also reaches the nodes one edge away that are claimed
            reach = least.copy()
            np.minimum.at(reach, s, least[d])
            np.minimum.at(reach, d, least[s])
            won = c[(reach[near] >= drawn).all(0)]
            for x in (op, a, z):
                gone[x[won]] = True
            # edges into held operands lead to the results instead: all of a passed operand's, the first of an absorbed one's
            h = won[hand[won]]
            held = np.where(unary[h] | (ins[a[h]] > 0), a[h], z[h])
            to, every = np.full(n, -1), np.zeros(n, bool)
            to[held], every[held] = result[op[h]], unary[h]
            i = np.flatnonzero(to[d] >= 0)
            first = np.zeros(len(s), bool)
            first[i[np.unique(d[i], return_index=True)[1]]] = True
            i = i[every[d[i]] | first[i]]
            d[i] = to[d[i]]
        stay = ~(gone[s] | gone[d])
        s, d, row = s[stay], d[stay], row[stay]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*done)) or ([], [])))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of which neither end is gone."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(gone.withColumnRenamed("node_id", end), ["graph_id", end], "left_anti")
    return out.select("graph_id", "src", "dst", "kind", "id")


def _claimed(able: DataFrame, edges: DataFrame, rounds: Rounds, step: int) -> tuple[DataFrame, DataFrame]:
    """The nodes that go in this round, and the operators that go."""
    order = F.struct(F.xxhash64(F.lit(step), "graph_id", "op").alias("h"), F.col("op"))
    near = F.array_union(F.array("op", "result"), F.transform("args", lambda x: x["id"]))
    claims = rounds.keep(able.select("graph_id", "op", order.alias("order"), F.explode(near).alias("node_id")), "claims")
    least = claims.groupBy(*_SAME).agg(F.min("order").alias("least"))
    # a claim also reaches the nodes one edge away that are claimed
    around = edges.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("other")).unionByName(edges.select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("other")))
    from_near = around.join(least.withColumnRenamed("node_id", "other"), ["graph_id", "other"]).select(*_SAME, "least")
    reach = least.unionByName(from_near).groupBy(*_SAME).agg(F.min("least").alias("least"))
    lost = claims.join(reach, _SAME).filter("least < order").select("graph_id", "op").distinct()
    chosen = rounds.keep(able.join(lost, ["graph_id", "op"], "left_anti"), "chosen")
    gone = rounds.keep(chosen.select("graph_id", F.explode(F.array_union(F.array("op"), F.transform("args", lambda x: x["id"]))).alias("node_id")).distinct(), "gone")
    rounds.drop(claims)
    return gone, chosen


def _handed(chosen: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges into operands that lead to the results of chosen operators instead: all of a passed operand's, the first of an absorbed one's."""
    held = F.filter("args", lambda x: x["ins"] > 0)[0]["id"]
    to = chosen.filter("rule IN ('pass', 'absorb')").select("graph_id", held.alias("dst"), "result", "rule")
    into = edges.join(to, ["graph_id", "dst"])
    first = into.groupBy("graph_id", "dst").agg(F.min(F.struct("src", "kind", "id"))["id"].alias("first"))
    out = into.join(first, ["graph_id", "dst"]).filter("rule = 'pass' OR id = first").select("graph_id", "src", F.col("result").alias("dst"), "kind", "id")
    return _without(out, gone)
