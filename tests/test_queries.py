import pytest

from spoor.plans import deep, legacy, more, program, registry  # noqa: F401
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sf, name):
    assert_same(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_components_against_union_find(spark, sf):
    from spoor.operators import graph

    n, e, _, seen = registry._tainted(spark, sf, registry._CAREFUL)
    rest, inner = graph.untainted(n, e, seen)
    parent = {r["node_id"]: r["node_id"] for r in rest.collect()}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in inner.collect():
        a, b = root(r["src"]), root(r["dst"])
        parent[max(a, b)] = min(a, b)
    found = {r["node_id"]: r["component_id"] for r in graph.weak_components(rest, inner).collect()}
    assert found == {x: root(x) for x in parent}


def test_whole_branch_chains_drop_no_assertion(spark, sf):
    longest = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'error'").groupBy("user_id").count().agg({"count": "max"}).first()[0]
    assert longest > 6
    assert max(r["height"] for r in registry.QUERIES["branch_metrics"](spark, sf).collect()) == longest + 2
    assert max(r["depth"] for r in registry.QUERIES["branch_prefixes"](spark, sf).collect()) == longest
