"""Comparison of pairs of graphs over tables (SIM-1, SIM-4), all pairs together and of any size.

The state is a table of matched nodes.  Candidates come from joins: equal keys at first, then the
neighbours of what was matched last, then what is left over.  An assignment problem falls
into blocks, the components of its candidates with a cost below that of unlike nodes; each block can be solved
by itself without loss.  Pairs with few candidates are cut into blocks in their task, the
candidates of others by label rounds over the table; a block of up to ``cells`` possible pairs is
solved exactly in its task, a larger one by an auction whose bids and prices are tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from spoor.operators import graph, similarity
from spoor.operators.rounds import Rounds

#: Candidates of one pair that one task cuts into blocks, and possible pairs of a block that one task solves.
AT_ONCE, CELLS = 100_000, 1_000_000
#: Nodes and edges of all pairs of one left graph that a bucket's task holds.
HELD = 1_000_000
#: Gains are whole numbers of this fraction in an auction, which is exact for them.
UNITS = 1_000_000
PAIR = ["lhs", "rhs"]


def _around(edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, other, kind, out): each edge from both of its ends, a loop once."""
    there = edges.select("graph_id", F.col("src").alias("node_id"), F.col("dst").alias("other"), "kind", F.lit(True).alias("out"))
    back = edges.filter("src <> dst").select("graph_id", F.col("dst").alias("node_id"), F.col("src").alias("other"), "kind", F.lit(False).alias("out"))
    return there.unionByName(back)


def _side(nodes: DataFrame, which: str, *columns: str) -> DataFrame:
    """Nodes as one side of pairs: the graph's id and the columns under the side's names."""
    x = which[0]
    return nodes.select(F.col("graph_id").alias(which), *[F.col(c).alias(f"{x}_{c}") for c in columns])


def like(l: str = "l", r: str = "r") -> Column:
    """FN-21 on kind, label and, where nodes have one, type."""
    a, b = F.col(f"{l}_label"), F.col(f"{r}_label")
    call = (a == b) | a.startswith(b) | b.startswith(a) | F.coalesce(F.col(f"{l}_type") == F.col(f"{r}_type"), F.lit(False))
    kind = F.col(f"{l}_kind")
    return (kind == F.col(f"{r}_kind")) & F.when(kind == "ENTRYPOINT", True).when(kind == "METHODCALL", call).otherwise(a == b)


def like_edges(a: Column, b: Column) -> Column:
    """FN-20."""
    return (a == b) | ((a == "PARAMETER") & (b == "SCOPE")) | ((a == "SCOPE") & (b == "PARAMETER"))


def _solve(rows: list[str], columns: list[str], cost: dict[tuple[str, str], float], threshold: float) -> list[tuple[str, str, float]]:
    matrix = np.array([[cost.get((l, r), 1.0) for r in columns] for l in rows])
    return [(rows[i], columns[j], s) for i, j, s in similarity.matches(matrix, threshold) if s > 0]


def _in_tasks(candidates: DataFrame, keys: list[str], threshold: float, placed: bool = False) -> DataFrame:
    """Assignments of groups that one task holds each, one after another, cut into blocks there; ``placed`` groups are each in one task already."""
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    rows = candidates.select(*keys, "l", "r", "cost")
    dealt = (rows if placed else rows.repartition(*keys)).sortWithinPartitions(*keys)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*PAIR, "l", "r")) + ", sim double"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cost, out = None, {}, []

        def close() -> None:
            out.extend((*now[:2], *m) for ls, rs in similarity._blocks(cost) for m in _solve(ls, rs, cost, threshold))
            cost.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *key, l, r, c in zip(*columns):
                if key != now:
                    if now is not None:
                        close()
                    now = key
                cost[l, r] = c
            yield made()
        if now is not None:
            close()
        yield made()

    return dealt.mapInArrow(run, schema)


def assign(candidates: DataFrame, threshold: float, rounds: Rounds, at_once: int = AT_ONCE, cells: int = CELLS, units: int = UNITS, by: str | None = None) -> DataFrame:
    """(lhs, rhs, l, r, sim): least-cost assignments of candidates (lhs, rhs, l, r, cost); what is no candidate costs 1 and is not matched.

    With ``by`` candidates and assignments are kept in buckets by that column.
    """
    candidates = rounds.keep(candidates.filter("cost < 1").select(*PAIR, "l", "r", "cost"), "candidates", by)
    many = candidates.groupBy(*PAIR).count().filter(F.col("count") > at_once).select(*PAIR)
    many = rounds.keep(many, "many")
    if many.isEmpty():
        # a candidate's bucket is one task's, and so are its assignments
        out = rounds.keep(_in_tasks(candidates, PAIR, threshold, by is not None), "matched", by, placed=True)
        rounds.drop(candidates, many)
        return out
    out = _in_tasks(candidates.join(many, PAIR, "left_anti"), PAIR, threshold)
    large = candidates.join(many, PAIR, "left_semi").withColumn("graph_id", F.struct(*PAIR))
    ends = large.select("graph_id", F.explode(F.array(F.concat(F.lit("l"), "l"), F.concat(F.lit("r"), "r"))).alias("node_id")).distinct()
    links = large.select("graph_id", F.concat(F.lit("l"), "l").alias("src"), F.concat(F.lit("r"), "r").alias("dst"))
    blocks = graph.weak_components(ends, links)
    named = rounds.keep(large.withColumn("node_id", F.concat(F.lit("l"), "l")).join(blocks, ["graph_id", "node_id"]).select(*PAIR, F.col("component_id").alias("block"), "l", "r", "cost"), "blocks")
    size = lambda c: named.select(*PAIR, "block", c).distinct().groupBy(*PAIR, "block").agg(F.count("*").alias(f"n_{c}"))
    key = [*PAIR, "block"]
    wide = rounds.keep(size("l").join(size("r"), key).filter(F.col("n_l") * F.col("n_r") > cells).select(*key), "wide")
    out = out.unionByName(_in_tasks(named.join(wide, key, "left_anti"), key, threshold))
    if not wide.isEmpty():
        won = auction(named.join(wide, key, "left_semi"), rounds, units)
        out = out.unionByName(won.filter(F.col("sim") >= threshold).select(*PAIR, "l", "r", "sim"))
    return rounds.keep(out, "matched", by)


def auction(candidates: DataFrame, rounds: Rounds, units: int = UNITS, shrink: int = 5) -> DataFrame:
    """(lhs, rhs, block, l, r, sim): an optimal assignment by an auction with epsilon scaling, all blocks at once.

    Each node also has a partner of its own that gains nothing, so everything can be assigned and a block is a
    square problem.  Bidders without an object bid for the one they gain most from, up to what the second best would
    leave them and epsilon; an object goes to its highest bidder and the one who had it bids again.  Prices stay
    when epsilon is divided by ``shrink``; assignments that no longer come within the new epsilon of the best are given up.
    With gains in whole units times the number of bidders and one, an epsilon of 1 makes the last assignment optimal.
    """
    key = [*PAIR, "block"]
    gain = F.round((1 - F.col("cost")) * units).cast("bigint")
    real = candidates.select(*key, F.concat(F.lit("l"), "l").alias("i"), F.concat(F.lit("r"), "r").alias("j"), gain.alias("gain"))
    alone = lambda a, b, x: real.select(*key, F.col(x).alias("i" if a else "j"), F.concat(F.lit(b), x).alias("j" if a else "i"), F.lit(0).cast("bigint").alias("gain")).distinct()
    twins = real.select(*key, F.concat(F.lit("*"), "j").alias("i"), F.concat(F.lit("*"), "i").alias("j"), F.lit(0).cast("bigint").alias("gain"))
    every = real.unionByName(alone(True, "*", "i")).unionByName(alone(False, "*", "j")).unionByName(twins)
    bidders = every.select(*key, "i").distinct().groupBy(*key).agg((F.count("*") + 1).alias("scale"))
    arcs = rounds.keep(every.join(bidders, key).withColumn("gain", F.col("gain") * F.col("scale")).select(*key, "i", "j", "gain"), "arcs")
    prices = rounds.keep(arcs.select(*key, "j").distinct().select(*key, "j", F.lit(0).cast("bigint").alias("price"), F.lit(None).cast("string").alias("owner")), "prices")
    epsilon = max(1, (arcs.agg(F.max("gain")).first()[0] or 0) // 2)
    step = 0
    while True:
        free = arcs.select(*key, "i").distinct().join(prices.select(*key, F.col("owner").alias("i")), [*key, "i"], "left_anti")
        free = rounds.keep(free, "free")
        while not free.isEmpty():
            step += 1
            worth = F.col("gain") - F.col("price")
            order = W.partitionBy(*key, "i").orderBy(F.desc("worth"), "j")
            # the second best is what the next object in the order leaves
            offers = arcs.join(free, [*key, "i"], "left_semi").join(prices, [*key, "j"]).withColumn("worth", worth)
            offers = offers.withColumns({"place": F.row_number().over(order), "next": F.lead("worth").over(order)}).filter("place = 1")
            bid = F.col("price") + F.col("worth") - F.coalesce("next", "worth") + epsilon
            best = offers.groupBy(*key, "j").agg(F.max(F.struct(bid.alias("bid"), F.col("i"))).alias("best"))
            new = rounds.keep(prices.join(best, [*key, "j"], "left").select(*key, "j", F.coalesce("best.bid", "price").alias("price"), F.coalesce("best.i", "owner").alias("owner")), "prices")
            rest = rounds.keep(arcs.select(*key, "i").distinct().join(new.select(*key, F.col("owner").alias("i")), [*key, "i"], "left_anti"), "free")
            rounds.drop(free, prices)
            free, prices = rest, new
        rounds.note(kind="auction", round=step, epsilon=epsilon)
        rounds.drop(free)
        if epsilon == 1:
            break
        epsilon = max(1, epsilon // shrink)
        worth = arcs.join(prices, [*key, "j"]).withColumn("worth", F.col("gain") - F.col("price"))
        best = worth.groupBy(*key, "i").agg(F.max("worth").alias("top"))
        held = worth.filter("i = owner").join(best, [*key, "i"]).filter(F.col("worth") + epsilon >= F.col("top")).select(*key, "j", F.lit(True).alias("held"))
        new = rounds.keep(prices.join(held, [*key, "j"], "left").select(*key, "j", "price", F.when(F.col("held"), F.col("owner")).alias("owner")), "prices")
        rounds.drop(prices)
        prices = new
    met = prices.select(*key, F.col("owner").alias("i"), "j").filter("i LIKE 'l%' AND j LIKE 'r%'")
    kinds = {c: candidates.schema[c].dataType for c in ("l", "r")}
    named = met.select(*key, F.expr("substring(i, 2)").cast(kinds["l"]).alias("l"), F.expr("substring(j, 2)").cast(kinds["r"]).alias("r"))
    out = rounds.keep(named.join(candidates, [*key, "l", "r"]).select(*key, "l", "r", (1 - F.col("cost")).alias("sim")).filter("sim > 0"), "won")
    rounds.drop(arcs, prices)
    return out


def compare_tables(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, residual: float = 0.7, at_once: int = AT_ONCE, cells: int = CELLS, held: int = HELD) -> tuple[DataFrame, DataFrame, Rounds]:
    """SIM-4, SIM-4a for (lhs, rhs) pairs of graph ids: (scores, mapping, rounds).

    scores is (lhs, rhs, union_sim, lr_sim, rl_sim, l_disjoint, r_disjoint, mapped), mapping (lhs, rhs, l, r).
    nodes is (graph_id, node_id, kind, label[, type]).  The steps are those of ``similarity.compare``, which
    it equals where assignments are solved in tasks; an auction may choose another assignment of the same cost.

    Where all pairs of a left graph have up to ``held`` nodes and edges, their tables are kept in buckets of left graphs and nodes are
    numbers in the order of their names: rounds shuffle nothing but the candidates of what is left over.  Others are dealt by node, and
    shuffled in each round.
    """
    rounds = Rounds(pairs.sparkSession, "compare")
    pairs = rounds.keep(pairs.select(*PAIR).distinct(), "pairs", "lhs")
    typed = nodes if "type" in nodes.columns else nodes.withColumn("type", F.lit(None).cast("string"))
    typed = typed.select("graph_id", F.col("node_id").cast("string").alias("node_id"), "kind", F.coalesce(F.col("label").cast("string"), F.lit("None")).alias("label"), F.col("type").cast("string").alias("type"))
    edges = edges.select("graph_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "kind")
    size = lambda df: df.groupBy("graph_id").agg(F.count("*").alias("n"))
    sizes = rounds.keep(size(typed).unionByName(size(edges)).groupBy("graph_id").agg(F.sum("n").alias("n")), "sizes", "graph_id")
    sized = pairs
    for s in PAIR:
        sized = sized.join(sizes.select(F.col("graph_id").alias(s), F.col("n").alias(f"n{s[0]}")), s, "left")
    sized = sized.fillna(0, ["nl", "nr"])
    large = rounds.keep(sized.groupBy("lhs").agg(F.sum(F.col("nl") + F.col("nr")).alias("n")).filter(F.col("n") > held).select("lhs"), "large")
    if large.isEmpty():
        scores, mapping = _compared(pairs, typed, edges, rounds, residual, at_once, cells, "lhs")
    else:
        wide = rounds.keep(pairs.join(large, "lhs", "left_semi"), "pairs")
        lean = rounds.keep(pairs.join(large, "lhs", "left_anti"), "pairs", "lhs")
        parts = []
        for some, by in ((lean, "lhs"), (wide, None)):
            met = rounds.keep(some.select(F.explode(F.array(*PAIR)).alias("graph_id")).distinct(), "graphs")
            parts.append(_compared(some, typed.join(met, "graph_id", "left_semi"), edges.join(met, "graph_id", "left_semi"), rounds, residual, at_once, cells, by))
        scores, mapping = (a.unionByName(b) for a, b in zip(*parts))
    rounds.drop(large, sizes)
    return scores, mapping, rounds


def _compared(pairs: DataFrame, typed: DataFrame, edges: DataFrame, rounds: Rounds, residual: float, at_once: int, cells: int, by: str | None) -> tuple[DataFrame, DataFrame]:
    """(scores, mapping) of kept pairs, in buckets of left graphs unless ``by`` is None."""
    graphs = by and "graph_id"
    around = _around(edges)
    degree = around.groupBy("graph_id", "node_id").agg(F.count("*").alias("degree"))
    # a node's number in the order of names stands for it where a task may hold its graph
    number = F.dense_rank().over(W.partitionBy("graph_id").orderBy("node_id")) if by else F.col("node_id")
    named = rounds.keep(typed.join(degree, ["graph_id", "node_id"], "left").select("graph_id", "node_id", number.alias("v"), "kind", "label", "type", F.coalesce("degree", F.lit(0)).cast("int").alias("degree")), "nodes", graphs)
    of = lambda end: named.select("graph_id", F.col("node_id").alias(end), F.col("v").alias(f"{end}_v"))
    links = rounds.keep(edges.join(of("src"), ["graph_id", "src"]).join(of("dst"), ["graph_id", "dst"]).select("graph_id", F.col("src_v").alias("src"), F.col("dst_v").alias("dst"), "kind"), "links", graphs)
    left, right = (rounds.keep(pairs.join(_side(named, s, "v", "kind", "label", "type", "degree"), s).withColumnRenamed(f"{s[0]}_v", s[0]), s, by) for s in PAIR)
    # left edges lie beside their pairs as they are, right ones are told to their left graphs
    told = rounds.keep(pairs.join(links.withColumnRenamed("graph_id", "rhs"), "rhs").select(*PAIR, "src", "dst", "kind"), "told", by)

    mapping = rounds.keep(left.select(*PAIR, "l", F.col("l").alias("r")).filter("false"), "mapping", by)
    step = 0

    def take(found: DataFrame) -> None:
        nonlocal mapping
        new = rounds.keep(mapping.unionByName(found.select(*PAIR, "l", "r")), "mapping", by)
        rounds.drop(mapping)
        mapping = new

    def unmatched(side: DataFrame, x: str) -> DataFrame:
        return side.join(mapping.select(*PAIR, x), [*PAIR, x], "left_anti")

    def spread(last: DataFrame) -> None:
        nonlocal step
        l_near = _around(links).select(F.col("graph_id").alias("lhs"), F.col("node_id").alias("l"), F.col("other").alias("lo"), F.col("kind").alias("lk"), "out")
        r_near = _around(told.withColumn("graph_id", F.struct(*PAIR))).select("graph_id.*", F.col("node_id").alias("r"), F.col("other").alias("ro"), F.col("kind").alias("rk"), "out")
        while not last.isEmpty():
            step += 1
            at = last.select(*PAIR, "l", "r").join(l_near, ["lhs", "l"]).join(r_near, [*PAIR, "r", "out"]).filter(like_edges(F.col("lk"), F.col("rk")))
            at = at.select(*PAIR, F.col("lo").alias("l"), F.col("ro").alias("r")).distinct()
            free = at.join(unmatched(left, "l"), [*PAIR, "l"]).join(unmatched(right, "r"), [*PAIR, "r"]).filter(like())
            before, last = last, assign(free.withColumn("cost", F.lit(0.0)), 0.0, rounds, at_once, cells, by=by)
            rounds.note(kind="spread", round=step)
            rounds.drop(before)
            take(last)
        rounds.drop(last)

    calls = F.col("l_kind").isin("OPERATOR", "METHODCALL")
    keyed = lambda df, x: df.withColumns({"kind": F.col(f"{x}_kind"), "label": F.col(f"{x}_label")})
    same = keyed(left.filter(calls), "l").join(keyed(right, "r"), [*PAIR, "kind", "label"])
    some = (F.col("l_degree") > 0) & (F.col("r_degree") > 0)
    cost = F.when(some, 1 - F.col("l_degree") / F.greatest("l_degree", "r_degree")).otherwise(1.0)
    first = assign(same.withColumn("cost", cost), 0.0, rounds, at_once, cells, by=by)
    take(first)
    spread(first)
    last = assign(leftover(unmatched(left, "l"), unmatched(right, "r")).withColumn("cost", F.lit(0.0)), residual, rounds, at_once, cells, by=by)
    take(last)
    spread(last)

    n = named.groupBy("graph_id").agg(F.count("*").alias("n"))
    m = mapping.groupBy(*PAIR).agg(F.count("*").alias("m"))
    size = lambda s: n.select(F.col("graph_id").alias(s), F.col("n").alias(f"n{s[0]}"))
    sized = pairs.join(m, PAIR, "left").join(size("lhs"), "lhs", "left").join(size("rhs"), "rhs", "left").fillna(0, ["nl", "nr", "m"])
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)  # noqa: E731  two empty graphs have nothing in common
    nl, nr, mm = F.col("nl"), F.col("nr"), F.col("m")
    scores = rounds.keep(sized.select(*PAIR, share(2 * mm, nl + nr).alias("union_sim"), share(mm, nl).alias("lr_sim"), share(mm, nr).alias("rl_sim"), share(nl - mm, nl).alias("l_disjoint"), share(nr - mm, nr).alias("r_disjoint"), mm.alias("mapped")), "scores")
    rounds.drop(links, left, right, told)
    name = lambda s: named.select(F.col("graph_id").alias(s), F.col("v").alias(s[0]), F.col("node_id").alias(f"{s[0]}_name"))
    names = mapping.join(name("lhs"), ["lhs", "l"]).join(name("rhs"), ["rhs", "r"]).select(*PAIR, F.col("l_name").alias("l"), F.col("r_name").alias("r"))
    return scores, (names if by else mapping)


def leftover(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN-5: (lhs, rhs, l, r) of unmatched nodes that are alike, by a join on each way to be so."""
    key = lambda df, x, column: df.withColumns({"kind": F.col(f"{x}_kind"), "key": F.col(column)})
    on = [*PAIR, "kind", "key"]
    by = lambda lc, rc, where="true": key(left, "l", lc).join(key(right, "r", rc), on).filter(where).select(*PAIR, "l", "r")
    same = by("l_label", "r_label")
    entries = by("l_kind", "r_kind", "kind = 'ENTRYPOINT'")
    types = by("l_type", "r_type", "kind = 'METHODCALL'")
    # a name meets those that it begins: all its beginnings against whole names
    starts = lambda df, x: df.filter(f"{x}_kind = 'METHODCALL'").withColumn(f"{x}_start", F.explode(F.transform(F.sequence(F.lit(0), F.length(f"{x}_label")), lambda i: F.substring(F.col(f"{x}_label"), F.lit(1), i))))
    l_in = key(left.filter("l_kind = 'METHODCALL'"), "l", "l_label").join(key(starts(right, "r"), "r", "r_start"), on).select(*PAIR, "l", "r")
    r_in = key(starts(left, "l"), "l", "l_start").join(key(right.filter("r_kind = 'METHODCALL'"), "r", "r_label"), on).select(*PAIR, "l", "r")
    return same.unionByName(entries).unionByName(types).unionByName(l_in).unionByName(r_in).distinct()


def correlate_tables(mappings: DataFrame, group: list[str]) -> DataFrame:
    """GR-8: (group, l, r) of the pairs of data nodes on which all mappings (group, l, r, l_kind, r_kind) agree.

    Pairs of two mappings that share a node are a clash, and all that hangs together by clashes is out: in the graph whose
    edges are the distinct pairs, a component is kept if it is a single pair, which is so if neither node has another partner.
    (The original visits pairs one by one, and may keep one side of a clash that it met later.)
    """
    data = F.col("l_kind").isin("VALUE", "OBJECT") & F.col("r_kind").isin("VALUE", "OBJECT")
    pairs = mappings.filter(data).select(*group, "l", "r").distinct()
    # one pair for each l, and of those one for each r: what is dropped in the first step is still a partner of its r
    by_l = pairs.groupBy(*group, "l").agg(F.min("r").alias("r"), F.count("*").alias("n"))
    by_r = pairs.groupBy(*group, "r").agg(F.count("*").alias("m"))
    return by_l.filter("n = 1").join(by_r.filter("m = 1"), [*group, "r"]).select(*group, "l", "r")
