"""Taint for each input by itself (GR-3, GR-4), all graphs together.

What a seed reaches depends on its strongly connected component alone.  So components are found
first: nodes that lead to one another directly are one, what nothing leads to or what leads nowhere is trimmed, the rest falls apart by rounds of forward and backward labels.
Then each seed is one bit of a block, and blocks are handed down the condensed graph until none gains a bit.  A seed
meets the nodes and moves it taints only in the last join.  Meanwhile a node is a hash of 64 bits (``graph.identity``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.operators.graph import identity, roots
from spoor.operators.rounds import Rounds

#: Seeds of a block: the bits of a long that is never negative.
BITS = 63
#: Links are trimmed again as long as a pass takes this share of them.
TRIM = 0.1


def _trimmed(links: DataFrame, rounds: Rounds) -> DataFrame:
    """Links (a, b) without most of those that are in no cycle: neither end may be without a link into it or out of it."""
    n, first = links.count(), links
    while n:
        end = lambda x: links.select(F.col(x).alias("v"), F.lit(x == "b").alias("i"), F.lit(x == "a").alias("o"))  # noqa: E731, B023
        inner = end("a").unionByName(end("b")).groupBy("v").agg(F.bool_or("i").alias("i"), F.bool_or("o").alias("o")).filter("i AND o").select("v")
        inner = rounds.keep(inner, "inner")
        rest = links.join(inner.withColumnRenamed("v", "a"), "a", "left_semi").join(inner.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b")
        rest = rounds.keep(rest, "links")
        left = rest.count()
        rounds.note(kind="components", trimmed=n - left)
        rounds.drop(inner, *(() if links is first else (links,)))
        links, n, before = rest, left, n
        if before - left < TRIM * before:
            break
    return links


def _cycles(links: DataFrame, rounds: Rounds) -> tuple[list[DataFrame], DataFrame]:
    """Tables (v, c): components c of nodes v; a node in none of them is a component of its own.  And the links (a, b) between components.

    Links that go both ways hang together as they would without a way, so their ends are one node before others are looked at.
    """
    way = F.when(F.col("a") < F.col("b"), 1).otherwise(2)
    pairs = links.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.bit_or(way).alias("ways"))
    pairs = rounds.keep(pairs, "pairs")
    mutual = rounds.keep(roots(pairs.filter("ways = 3").select("a", "b"), rounds.keep, rounds.drop), "mutual")
    # the others go one way each
    one = pairs.filter("ways <> 3").select(F.expr("IF(ways = 1, a, b)").alias("a"), F.expr("IF(ways = 1, b, a)").alias("b"))
    led = rounds.keep(_named(_named(one, [mutual], "a"), [mutual], "b").filter("a <> b").select("a", "b").distinct(), "links")
    rounds.drop(pairs)
    found = _rounds_of_labels(led, rounds)
    if not found:
        return [mutual], led
    condensed = rounds.keep(_named(_named(led, found, "a"), found, "b").filter("a <> b").select("a", "b").distinct(), "links")
    top = rounds.keep(_named(mutual, found, "c"), "mutual")
    rest = [rounds.keep(t.join(mutual, "v", "left_anti"), "found") for t in found]
    rounds.drop(led, mutual, *found)
    return [top, *rest], condensed


def _rounds_of_labels(links: DataFrame, rounds: Rounds) -> list[DataFrame]:
    """Tables (v, c) as ``_cycles`` gives them, by rounds over all links, which stay.

    In a round each node takes the least name among the nodes that reach it and the least among
    those that it reaches, itself included.  A node for which both are the same is in the component
    of that node and done.  Moves between nodes that differ in either name are in no cycle and
    go, as do those of nodes that are done.
    """
    none = F.lit(None).cast("bigint")
    found: list[DataFrame] = []
    given, links = links, _trimmed(links, rounds)
    step = 0
    while not links.isEmpty():
        step += 1
        ends = links.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        labels = rounds.keep(ends.select("v", F.col("v").alias("f"), F.col("v").alias("b")), "labels")
        passes = 0
        while True:
            passes += 1
            # the names of both ways in one shuffle by node
            link = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
            ahead = link.join(labels.select(F.col("v").alias("src"), "f"), "src").select(F.col("dst").alias("v"), "f", none.alias("b"))
            behind = link.join(labels.select(F.col("v").alias("dst"), "b"), "dst").select(F.col("src").alias("v"), none.alias("f"), "b")
            own = labels.select("v", "f", "b", F.col("f").alias("f0"), F.col("b").alias("b0"))
            met = own.unionByName(ahead.unionByName(behind).withColumns({"f0": none, "b0": none})).groupBy("v")
            new = rounds.keep(met.agg(F.min("f").alias("f"), F.min("b").alias("b"), F.max("f0").alias("f0"), F.max("b0").alias("b0")), "labels")
            settled = new.filter("f <> f0 OR b <> b0").isEmpty()
            rounds.drop(labels)
            labels = new
            if settled:
                break
        found.append(rounds.keep(labels.filter("f = b").select("v", F.col("f").alias("c")), "found"))
        rest = labels.filter("f <> b")
        s, d = (rest.select(F.col("v").alias(x), F.col("f").alias(f"{x}_f"), F.col("b").alias(f"{x}_b")) for x in ("a", "b"))
        fewer = rounds.keep(links.join(s, "a").join(d, "b").filter("a_f = b_f AND a_b = b_b").select("a", "b"), "links")
        rounds.note(kind="components", round=step, passes=passes)
        rounds.drop(labels, *(() if links is given else (links,)))
        links = _trimmed(fewer, rounds)
        if links is not fewer:
            rounds.drop(fewer)
    if links is not given:
        rounds.drop(links)
    return found


def _named(df: DataFrame, found: list[DataFrame], x: str) -> DataFrame:
    """``df`` with the node in ``x`` replaced by its component."""
    if not found:
        return df
    own = reduce(DataFrame.unionByName, found).select(F.col("v").alias(x), F.col("c").alias("_c"))
    return df.join(own, x, "left").withColumn(x, F.coalesce("_c", x)).drop("_c")


def _links(moves: DataFrame, ident: Callable[[str], Column]) -> DataFrame:
    return moves.filter("src <> dst").select(ident("src").alias("a"), ident("dst").alias("b"))


def strong_components(nodes: DataFrame, moves: DataFrame, rounds: Rounds) -> DataFrame:
    """(graph_id, node_id, component) of every node; a component's name is its least node."""
    ident = identity(nodes)
    found, links = _cycles(_links(moves, ident), rounds)
    rounds.drop(links)
    own = _named(nodes.select("graph_id", "node_id", ident("node_id").alias("c")).distinct(), found, "c")
    own = rounds.keep(own, "named")
    rounds.drop(*found)
    return own.join(own.groupBy("c").agg(F.min("node_id").alias("component")), "c").select("graph_id", "node_id", "component")


def seed_blocks(seeds: DataFrame, rounds: Rounds) -> DataFrame:
    """(graph_id, seed, block, bit): seeds numbered as they are written, in order and BITS to a block; the driver sees none."""
    dealt = seeds.select("graph_id", F.col("node_id").alias("seed")).distinct().repartitionByRange("graph_id", "seed").sortWithinPartitions("graph_id", "seed")
    written = rounds.keep(dealt.withColumn("at", F.monotonically_increasing_id()), "seeds")
    # the number's upper bits are the task's, its lower 33 bits the row's
    row = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    block = F.shiftleft(F.shiftright("at", 33), 28) + F.floor(row / BITS)
    return written.select("graph_id", "seed", block.alias("block"), F.pmod(row, F.lit(BITS)).cast("int").alias("bit"))


class Taint(NamedTuple):
    """What is known when all bits are handed down: nodes have ``ident``, components ``found`` and seeds ``blocks``; ``bits`` is (c, block, bits).

    Where ends were not asked for ``made`` is (c, kind, n), how many moves start in a component.
    """

    ident: Callable[[str], Column]
    found: list[DataFrame]
    moves: DataFrame
    blocks: DataFrame
    bits: DataFrame
    rounds: Rounds
    made: DataFrame | None = None


def held(first: DataFrame, links: DataFrame, rounds: Rounds) -> DataFrame:
    """(c, block, bits): which seeds taint a component, from those in it and the links (a, b) of components."""
    zero = F.lit(0).cast("bigint")
    seen = rounds.keep(first.select("c", "block", zero.alias("had"), "bits"), "bits")
    step = 0
    while True:
        step += 1
        gained = seen.filter("bits <> had").select(F.col("c").alias("a"), "block", F.col("bits").bitwiseXOR(F.col("had")).alias("bits"))
        if gained.isEmpty():
            return seen.drop("had")
        sent = gained.join(links, "a").select(F.col("b").alias("c"), "block", zero.alias("had"), "bits")
        own = seen.select("c", "block", F.col("bits").alias("had"), "bits")
        new = rounds.keep(own.unionByName(sent).groupBy("c", "block").agg(F.bit_or("had").alias("had"), F.bit_or("bits").alias("bits")), "bits")
        rounds.note(kind="bits", round=step)
        rounds.drop(seen)
        seen = new


def spread(nodes: DataFrame, moves: DataFrame, seeds: DataFrame, ends: bool = True, ident: Callable[[str], Column] | None = None, rounds: Rounds | None = None) -> Taint:
    """Taint of every seed; without ``ends`` only of nodes that some move starts at.

    ``ident`` makes the node in a column a number of its own among all graphs; one is found unless it is given.
    """
    rounds = rounds or Rounds(nodes.sparkSession, "taint")
    moves = rounds.keep(moves.select("graph_id", "src", "dst", "kind").distinct(), "moves")
    ident = ident or identity(nodes)
    blocks = seed_blocks(seeds, rounds)
    found, links = _cycles(_links(moves, ident), rounds)
    made = None
    if not ends:
        # by node before by component
        by_node = moves.groupBy("graph_id", "src", "kind").agg(F.count("*").alias("n")).select(ident("src").alias("c"), "kind", "n")
        made = rounds.keep(_named(by_node, found, "c").groupBy("c", "kind").agg(F.sum("n").alias("n")), "made")
        rest = rounds.keep(links.join(made.select(F.col("c").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "condensed")
        rounds.drop(links)
        links = rest
    known = nodes.select("graph_id", F.col("node_id").alias("seed"))
    at = blocks.join(known, ["graph_id", "seed"], "left_semi").select(ident("seed").alias("c"), "block", "bit")
    first = _named(at, found, "c").groupBy("c", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    bits = held(first, links, rounds)
    rounds.drop(links)
    return Taint(ident, found, moves, blocks, bits, rounds, made)


def _seeds_of(bits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks spelt out: one row for each seed."""
    return bits.join(blocks, "block").filter("(bits & shiftleft(1L, bit)) <> 0").drop("block", "bit", "bits")


def by_seed(nodes: DataFrame, moves: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, Rounds]:
    """(tainted, walked, rounds): tainted is (graph_id, seed, node_id), the seed among them; walked is (graph_id, seed, src, dst, kind).

    A seed that is no node taints nothing.  The tables that both read stay until ``rounds.close``.
    """
    t = spread(nodes, moves, seeds)
    seeded = t.blocks.drop("graph_id")
    every = nodes.select("graph_id", "node_id", t.ident("node_id").alias("c"))
    # a node given twice is told once
    every = _named(every.distinct(), t.found, "c")
    tainted = _seeds_of(every.join(t.bits, "c").drop("c"), seeded)
    walked = _seeds_of(_named(t.moves.withColumn("c", t.ident("src")), t.found, "c").join(t.bits, "c").drop("c"), seeded)
    return tainted.select("graph_id", "seed", "node_id"), walked.select("graph_id", "seed", "src", "dst", "kind"), t.rounds


def walk_counts(nodes: DataFrame, moves: DataFrame, seeds: DataFrame, ident: Callable[[str], Column] | None = None, rounds: Rounds | None = None) -> tuple[DataFrame, Rounds]:
    """(counts, rounds): counts is (graph_id, seed, kind, moves), the number of rows of ``walked`` for each kind.

    Moves are counted before they meet seeds: those of a component first, then of all components that the same seeds of a block taint.
    """
    t = spread(nodes, moves, seeds, False, ident, rounds)
    alike = t.made.join(t.bits, "c").groupBy("block", "bits", "kind").agg(F.sum("n").alias("n"))
    return _seeds_of(alike, t.blocks).groupBy("graph_id", "seed", "kind").agg(F.sum("n").alias("moves")), t.rounds


def taint_graph(walked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR-3: the union of all seeds' moves as one graph: (graph_id, node_id) and (graph_id, src, dst, kind)."""
    ends = walked.select("graph_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return ends, walked.select("graph_id", "src", "dst", "kind").distinct()
