"""Leader clustering in rounds against the sequential form."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spoor.operators import leaders, similarity
from spoor.operators.rounds import Rounds


def dice(a, b):
    return 2 * sum((a[1] & b[1]).values()) / max(1, a[2] + b[2])


def plain(data, threshold):
    out = set()
    for e in {e for e, *_ in data}:
        items = sorted((t, Counter(c), len(c)) for x, t, c in data if x == e)
        out |= {(e, x[0], n) for x, n in similarity.condense(items, dice, lambda x: x[2], threshold)}
    return out


@pytest.mark.parametrize("seed,threshold", [(1, 0.85), (2, 0.6), (3, 0.95)])
def test_bags_in_rounds_are_the_sequential_leaders(spark, seed, threshold):
    rng = random.Random(seed)
    data = []
    for e in range(3):
        cores = [[rng.choice("abcdefghij") for _ in range(rng.randrange(3, 14))] for _ in range(4)]
        for t in range(45):
            bag = list(rng.choice(cores))
            for _ in range(rng.randrange(4)):
                bag[rng.randrange(len(bag))] = rng.choice("abcxyz")
            data.append((e, t, bag if rng.random() > 0.04 else []))
    df = spark.createDataFrame(data, "entry int, trace int, codes array<string>").repartition(3)
    out, rounds = leaders.condense(df, "entry", "trace", "codes", threshold)
    assert {tuple(r) for r in out.select("entry", "leader", "weight").collect()} == plain(data, threshold)
    assert any(x["kind"] == "sure" for x in rounds.log)


def test_rounds_of_an_arbitrary_graph(spark):
    rng = random.Random(7)
    items = [(e, i) for e in range(3) for i in range(40)]
    pairs = {(e, *sorted(rng.sample(range(40), 2))) for e in range(3) for _ in range(60)} | {(0, i, i + 1) for i in range(39)}
    want = set()
    for e, i in items:
        if not any((e, j, i) in pairs for x, j in want if x == e):
            want.add((e, i))
    got = leaders.independent(spark.createDataFrame(items, "entry int, id int"), spark.createDataFrame(sorted(pairs), "entry int, a int, b int"), Rounds(spark, "t"))
    assert {tuple(r) for r in got.collect()} == want


def test_one_large_cluster_makes_no_pairs_between_its_members(spark):
    """5,000 traces that are all alike: the first leader takes them in one round."""
    codes = F.concat(F.array_repeat(F.lit("a"), 40), F.array((F.col("id") % 997).cast("string")))
    df = spark.range(5000).select(F.lit(1).alias("entry"), F.col("id").alias("trace"), codes.alias("codes"))
    out, rounds = leaders.condense(df, "entry", "trace", "codes", 0.9)
    assert [tuple(r) for r in out.select("leader", "weight").collect()] == [(0, 5000)]


def test_no_traces(spark):
    assert leaders.condense(spark.createDataFrame([], "entry int, trace int, codes array<string>"), "entry", "trace", "codes")[0].isEmpty()
