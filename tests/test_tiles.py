"""Pairs of few keys with many rows: tiles, pairs told once, and work dealt over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.operators import scores, similarity, tiles
from spoor.plans import deep


def test_tiles_meet_as_a_join_does(spark):
    l = spark.createDataFrame([(i % 3 if i else None, i) for i in range(40)], "k int, l int")
    r = spark.createDataFrame([(i % 4 if i else None, i) for i in range(30)], "k int, r int")
    found = tiles.join(l, r, ["k"], side=4)
    assert sorted(map(tuple, found.select("k", "l", "r").collect())) == sorted(map(tuple, l.join(r, "k").select("k", "l", "r").collect()))


def test_residual_tells_each_pair_once_without_comparing_pairs(spark):
    kind = "METHODCALL"
    l = spark.createDataFrame([(1, kind, 1, "ab", 7), (2, kind, None, "abc", None), (3, kind, 2, "x", 7)], "node_id int, kind string, label int, name string, ret int")
    r = spark.createDataFrame([(4, kind, 1, "ab", 7), (5, kind, 2, "abc", 7), (6, kind, None, "a", None)], l.schema)
    found = scores.residual(l, r)
    assert "keys=[l#" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 4), (1, 5), (1, 6), (2, 4), (2, 5), (2, 6), (3, 4), (3, 5)]
    again = scores.residual(l.unionByName(l.limit(1).selectExpr("node_id", "kind", "2 AS label", "name", "ret")), r)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def test_expansion_with_several_ways_to_a_pair(spark):
    pairs = spark.createDataFrame([(1, 11), (2, 12)], "l int, r int")
    left = spark.createDataFrame([(1, 5, "SCOPE", True), (2, 5, "SCOPE", True), (2, 6, "SUPPLIES", True)], "node int, other int, kind string, way boolean")
    right = spark.createDataFrame([(11, 7, "PARAMETER", True), (12, 7, "SCOPE", True), (12, 8, "SUPPLIES", True)], left.schema)
    none = spark.createDataFrame([], "node int")
    assert sorted(map(tuple, scores.expansion(pairs, left, right, none, none).collect())) == [(5, 7), (6, 8)]


def test_stars_of_equal_degrees_need_no_matrix(monkeypatch):
    def star(n):
        return similarity.Graph({"m": {"kind": "ENTRYPOINT", "label": "n"}, **{f"{i:05d}": {"kind": "OPERATOR", "label": str(i % 2)} for i in range(n)}}, [("m", f"{i:05d}", "SCOPE") for i in range(n)])

    solve = similarity.hungarian
    monkeypatch.setattr(similarity, "hungarian", lambda c: solve(c) if len(c) < 100 else pytest.fail("a matrix of all operators"))
    found = similarity.compare(star(600), star(500))
    assert len(found["mapping"]) == 501


def test_class_files_are_made_in_many_tasks(spark, sf):
    assert deep._classes(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_many_assignments_at_once_are_those_of_each(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for shape in ((1, 1), (1, 4), (4, 1), (3, 3), (3, 5), (5, 3)):
        for costs in (rng.random((40, *shape)), rng.integers(0, 3, (40, *shape)) / 4):
            assert (similarity.hungarian_each(costs) == [similarity.hungarian(c) for c in costs]).all()
            assert (similarity.greedy_each(costs) == [similarity.greedy(c) for c in costs]).all()
    rows = [(g, f"r{i}", j, float(x)) for g in range(30) for (i, j), x in np.ndenumerate(rng.random((1 + g % 3, 1 + g % 4)))]
    found = similarity.assign(spark.createDataFrame(rows, "g int, i string, j bigint, cost double"), "g", "i", "j", "cost", threshold=0.2)
    want = []
    for g in range(30):
        matrix = np.array([x for k, *_, x in rows if k == g]).reshape(1 + g % 3, 1 + g % 4)
        want += [(g, f"r{i}", j, s) for i, j, s in similarity.matches(matrix, 0.2)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    for bad in ([(1, "a", 1, 0.5), (1, "a", 2, 0.5), (1, "b", 1, 0.5)], [(1, "a", 1, 0.5), (1, "a", 2, 0.1), (1, "b", 1, 0.5), (1, "b", 3, 0.2)]):
        with pytest.raises(Exception, match="not a full matrix"):
            similarity.assign(spark.createDataFrame(bad, "g int, i string, j bigint, cost double"), "g", "i", "j", "cost").collect()


def test_residual_sends_no_row_to_many_tiles_where_most_pairs_match(spark):
    """As in F4: all names begin alike."""
    schema = "node_id int, kind string, label int, name string, ret int"
    rows = lambda n, at, names: [(at + i, "METHODCALL" if i % 9 else "VALUE", i % 5 if i % 4 else None, names[i % len(names)], i % 3 if i % 7 else None) for i in range(n)]
    for names, dense in ((["call", "calla", "callab", "", None], True), ([f"{x}{y}" for x in "abcdefghijk" for y in "lmnopqrst"], False)):
        a, b = rows(60, 0, names), [(i, k, None if dense or x is None else x + 4, n, None if dense or t is None else t + 2) for i, k, x, n, t in rows(40, 100, names)]
        like = lambda x, y: x is not None and x == y
        call = lambda x, y: x[1] == "METHODCALL" and (like(x[4], y[4]) or (x[3] is not None and y[3] is not None and (x[3].startswith(y[3]) or y[3].startswith(x[3]))))
        want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and (like(x[2], y[2]) or call(x, y)))
        l, r = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
        found = scores.residual(l, r)
        assert ("Generate explode" in found._jdf.queryExecution().toString()) != dense
        assert sorted(map(tuple, found.collect())) == want
        side = lambda df, x: df.select(F.col("node_id").alias(x), "kind", *[F.col(c).alias(f"{x}_{c}") for c in ("label", "name", "ret")])
        parts = scores._ways(side(l, "l"), side(r, "r"), most=3)
        assert ("CartesianProduct" in parts._jdf.queryExecution().toString()) == dense
        assert sorted(map(tuple, parts.collect())) == want
        assert sorted((y, x) for x, y in map(tuple, scores.residual(r, l).collect())) == want
