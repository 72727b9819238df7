"""Leader clustering of an entry point's traces as rounds over tables (SIM-5).

In order, a trace that is not like any leader before it becomes a leader; the others join the
first leader they are like.  The leaders are the lexicographically first maximal independent
set of the graph of alike traces, so they can be found in rounds, all entry points together:
an undecided trace without an undecided smaller one beside it is a leader, and what is like a
leader leaves.  No group of rows ever holds an entry point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.operators.rounds import Rounds


def independent(items: DataFrame, pairs: DataFrame, rounds: Rounds) -> DataFrame:
    """(entry, id) of the leaders of ``items`` (entry, id); pairs (entry, a, b) with a < b are alike.

    Each round looks at the undecided and the pairs between them alone.
    """
    left = rounds.keep(items.select("entry", "id"), "left")
    alike = rounds.keep(pairs.select("entry", "a", "b").distinct(), "alike")
    found, step = [], 0
    while not left.isEmpty():
        step += 1
        waits = alike.select("entry", F.col("b").alias("id")).distinct()
        new = rounds.keep(left.join(waits, ["entry", "id"], "left_anti"), "leaders")
        found.append(new)
        gone = new.join(alike, (new["entry"] == alike["entry"]) & (new["id"] == alike["a"])).select(alike["entry"], F.col("b").alias("id")).distinct()
        rest = rounds.keep(left.join(new.unionByName(gone), ["entry", "id"], "left_anti"), "left")
        key = lambda x: rest.select("entry", F.col("id").alias(x))  # noqa: E731, B023
        fewer = rounds.keep(alike.join(key("a"), ["entry", "a"], "left_semi").join(key("b"), ["entry", "b"], "left_semi").select("entry", "a", "b"), "alike")
        rounds.note(kind="leaders", round=step)
        rounds.drop(left, alike)
        left, alike = rest, fewer
    rounds.drop(left, alike)
    out = items.select("entry", "id").filter("false")
    for part in found:
        out = out.unionByName(part)
    return out


def weights(items: DataFrame, leaders: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entry, leader, weight): each of ``items`` (entry, id, copies) counts for the least leader it is like, a leader for itself."""
    joined = pairs.join(leaders.withColumnRenamed("id", "a"), ["entry", "a"], "left_semi").groupBy("entry", F.col("b").alias("id")).agg(F.min("a").alias("a"))
    own = leaders.select("entry", "id", F.col("id").alias("own"))
    counted = items.join(own, ["entry", "id"], "left").join(joined, ["entry", "id"], "left").withColumn("leader", F.coalesce("own", "a"))
    return counted.groupBy("entry", "leader").agg(F.sum("copies").cast("bigint").alias("weight"))


# bags of codes ----------------------------------------------------------------------------


def bags(sets: DataFrame, entry: str, trace: str, codes: str) -> DataFrame:
    """(entry, id, copies, size, bag): distinct bags; traces with equal codes stand together under the least, empty ones alone."""
    own = sets.select(F.col(entry).alias("entry"), F.col(trace).alias("id"), F.array_sort(F.col(codes)).alias("codes"))
    same = F.when(F.size("codes") == 0, F.col("id"))  # an empty bag is like no other
    alike = own.groupBy("entry", "codes", same.alias("alone")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    spread = alike.select("entry", "id", "copies", F.size("codes").alias("size"), F.explode_outer("codes").alias("code")).groupBy("entry", "id", "copies", "size", "code").agg(F.count("*").cast("int").alias("n"))
    cells = F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "n")))
    return spread.groupBy("entry", "id", "copies", "size").agg(F.map_from_entries(cells).alias("bag"))


def rare_first(found: DataFrame, threshold: float) -> DataFrame:
    """(entry, id, token): the prefix of each bag's tokens, the rarest first, of which two alike bags share at least one.

    The k-th occurrence of a code is a token.  Alike bags have threshold / 2 of their sizes in
    common and sizes within the threshold, so that of |x| tokens at least
    threshold (1 + threshold) / 2 |x| are shared; what is beyond the rest of them cannot be missed.
    """
    tokens = found.filter("size > 0").select("entry", "id", "size", F.explode("bag").alias("code", "n")).select("entry", "id", "size", "code", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    often = tokens.groupBy("entry", "code", "k").agg(F.count("*").alias("often"))
    ranked = tokens.join(often, ["entry", "code", "k"]).withColumn("place", F.row_number().over(W.partitionBy("entry", "id").orderBy("often", "code", "k")))
    shared = F.ceil(F.col("size") * (threshold * (1 + threshold) / 2) - 1e-9)
    return ranked.filter(F.col("place") <= F.col("size") - shared + 1).select("entry", "id", "code", "k")


def _common(a: str, b: str) -> Column:
    """How many codes two bags share."""
    return F.expr(f"aggregate(map_keys({a}), 0L, (s, c) -> s + least({a}[c], coalesce(try_element_at({b}, c), 0)))")


def alike(left: DataFrame, right: DataFrame, prefixes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(entry, a, b), a < b: bags of ``left`` and ``right`` (entry, id) that share a prefix token, have sizes within the threshold and reach it."""
    side = lambda ids, x: prefixes.join(ids, ["entry", "id"], "left_semi").withColumnRenamed("id", x)
    met = side(left, "a").join(side(right, "b"), ["entry", "code", "k"]).filter("a < b").select("entry", "a", "b").distinct()
    whole = lambda x: found.select("entry", F.col("id").alias(x), F.col("size").alias(f"{x}_size"), F.col("bag").alias(f"{x}_bag"))
    band = F.least("a_size", "b_size") / F.greatest("a_size", "b_size") >= threshold
    near = met.join(whole("a"), ["entry", "a"]).join(whole("b"), ["entry", "b"]).filter(band)
    return near.filter(2 * _common("a_bag", "b_bag") / (F.col("a_size") + F.col("b_size")) >= threshold).select("entry", "a", "b")


def condense(sets: DataFrame, entry: str, trace: str, codes: str, threshold: float = 0.9) -> tuple[DataFrame, Rounds]:
    """SIM-5 over (entry, trace, codes): (entry, leader, weight), traces as bags of codes, similarity by their shared share.

    First come rounds in which only sure leaders meet others: an undecided bag that is the least
    of all its prefix tokens.  They take the large clusters away without a pair between their
    members.  When a round decides less than a quarter, the pairs of what is left are made.
    """
    rounds = Rounds(sets.sparkSession, "condense")
    found = rounds.keep(bags(sets, entry, trace, codes), "bags")
    prefixes = rounds.keep(rare_first(found, threshold), "prefixes")
    left = rounds.keep(found.select("entry", "id"), "left")
    sure, n = found.select("entry", "id").filter("false"), left.count()
    while n:
        mine = prefixes.join(left, ["entry", "id"], "left_semi")
        least = mine.groupBy("entry", "code", "k").agg(F.min("id").alias("least"))
        later = mine.join(least, ["entry", "code", "k"]).filter("id <> least").select("entry", "id").distinct()
        new = rounds.keep(left.join(later, ["entry", "id"], "left_anti"), "sure")
        gone = alike(new, left, prefixes, found, threshold).select("entry", F.col("b").alias("id")).distinct()
        rest = rounds.keep(left.join(new.unionByName(gone), ["entry", "id"], "left_anti"), "left")
        sure, was, n = sure.unionByName(new), n, rest.count()
        rounds.note(kind="sure", undecided=n)
        rounds.drop(left)
        left = rest
        if was - n < was / 4:
            break
    pairs = alike(left, left, prefixes, found, threshold)
    leaders = rounds.keep(sure.unionByName(independent(left, pairs, rounds)), "all")
    joined = alike(leaders, found.select("entry", "id"), prefixes, found, threshold)
    out = rounds.keep(weights(found.select("entry", "id", "copies"), leaders, joined), "weights")
    rounds.close(out)
    return out.withColumnRenamed("entry", entry), rounds
