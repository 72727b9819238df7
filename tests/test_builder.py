from pyspark.sql import Row

from spoor.functions import values
from spoor.operators import builder, methods
from spoor.streaming import kinds


def val(tag, uid=None, type="I", text=None, symbol=None, heap_id=None, expr_id=None):
    return Row(uid=uid, tag=tag, type=type, text=text, symbol=symbol, heap_id=heap_id, expr_id=expr_id)


def record(seq, kind, **kw):
    names = ("method", "operator", "ref", "scope", "value", "lhs", "rhs", "idx", "result", "params")
    r = {n: kw.get(n) for n in names}
    return ("g", seq, kind, r["method"], r["operator"], r["ref"], r["scope"], r["value"], r["lhs"], r["rhs"], r["idx"], r["result"], r["params"])


def test_add_one(spark):
    a = val("symbol", symbol=1)
    rows = [
        record(0, "EntryMethod", method="f(I)I"), record(1, "EntryParameter", ref=a),
        record(2, "StackTransformation", lhs=a, rhs=val("literal", uid=7, text="1"), result=val("expr", expr_id=1), operator="ADD"),
        record(3, "Assertion", value=a), record(4, "DefaultStaticFieldValue", value=val("literal", uid=9)),
    ]
    df = spark.createDataFrame(rows, builder.RECORDS)
    nodes = {r["node_id"]: r for r in builder.build_nodes(df).collect()}
    assert set(nodes) == {"ENTRYPOINT", "#1", "v7", "n2", "e1"} and nodes["#1"]["is_entry_param"] and nodes["n2"]["label"] == "ADD"
    edges = builder.build_edges(df).collect()
    assert sorted(e["kind"] for e in edges) == ["SUPPLIES"] + ["TRANSFORMATION"] * 3
    assert [r["node_id"] for r in builder.inputs(builder.build_nodes(df)).collect()] == ["#1"] and builder.assertions(df).count() == 1


def test_calls_fields_and_literal_identity(spark):
    obj = val("ref", heap_id=3, type="LA;")
    rows = [
        record(0, "InstanceLibraryMethodCall", method="m", scope=obj, params=[val("literal", uid=1, text="5"), val("literal", uid=2, text="5")], result=val("symbol", symbol=4)),
        record(1, "ObjectFieldPut", ref=obj, value=val("symbol", symbol=4), operator="x"), record(2, "SynthesisedReturnValue", result=val("symbol", symbol=4)),
    ]
    df = spark.createDataFrame(rows, builder.RECORDS)
    assert {r["node_id"] for r in builder.build_nodes(df).collect()} == {"3@", "n0", "v1", "v2", "#4"}
    edges = {(e["src"], e["dst"], e["kind"], e["label"]) for e in builder.build_edges(df).collect()}
    assert edges == {("v1", "n0", "PARAMETER", "$0"), ("v2", "n0", "PARAMETER", "$1"), ("3@", "n0", "SCOPE", None), ("n0", "#4", "SUPPLIES", None), ("#4", "3@", "AGGREGATION", "x")}
    boxes = spark.createDataFrame([("g", "3@", "#4")], "graph_id string, box string, inner string")
    assert builder.unboxed(builder.build_edges(df), boxes).filter("src = '3@' or dst = '3@'").count() == 0


def test_pruning():
    kinds_ = {"a": "VALUE", "b": "VALUE", "o": "OPERATOR", "r": "VALUE", "c": "METHODCALL", "p": "OPERATOR", "s": "VALUE"}
    edges = [("a", "o"), ("b", "o"), ("o", "r"), ("r", "c")]
    assert builder.prune_chain(kinds_, edges) == {("r", "c")}
    chain = [("c", "a"), ("a", "o"), ("b", "o"), ("o", "r"), ("r", "p"), ("p", "s")]
    assert builder.prune_chain(kinds_, chain) == {("c", "s")}


def test_prune_many(spark):
    n = spark.createDataFrame([("g", x, k) for x, k in (("a", "VALUE"), ("o", "OPERATOR"), ("r", "VALUE"), ("c", "METHODCALL"))], "graph_id string, node_id string, kind string")
    e = spark.createDataFrame([("g", "a", "o"), ("g", "o", "r"), ("g", "r", "c")], "graph_id string, src string, dst string")
    assert [tuple(r) for r in builder.prune(n, e).collect()] == [("g", "r", "c")]


def test_correlation():
    assert builder.correlate([("a", "x"), ("b", "y")], [("a", "x"), ("b", "z")]) == {"a": "x"}
    assert builder.correlate([("a", "x")], [("b", "x")], [("b", "q")]) == {"a": "x"}


def test_project_scores(spark):
    pairs = spark.createDataFrame([("L", "R", 1, 1, 0.9, 0.8, 1.0), ("L", "R", 2, 1, 0.5, 1.0, 1.0)], "lhs string, rhs string, ltrace int, rtrace int, union_sim double, lr_sim double, rl_sim double")
    w = spark.createDataFrame([("L", 1, 1), ("L", 2, 3), ("R", 1, 2)], "project string, trace int, weight int")
    row = builder.project_scores(pairs, w).first()
    assert (row["lsim"], row["rsim"]) == (0.2, 1.0)


def test_entry_points(spark):
    schema = (
        "method string, name string, class_sig string, super_class string, ret string, params array<string>, annotations array<string>, "
        "class_annotations array<string>, is_static boolean, is_public boolean, is_private boolean, is_constructor boolean, statements int"
    )
    m = lambda name, ret="void", params=(), sup="java.lang.Object", ann=None, static=False, public=True, statements=2: (name, name, "A", sup, ret, list(params), ann, None, static, public, False, False, statements)
    rows = [
        m("main", params=["java.lang.String[]"], static=True), m("doGet", params=[methods.REQUEST, methods.RESPONSE], sup=methods.SERVLET), m("clicked", params=["my.Click"]),
        m("api", ann=["javax.ws.rs.GET"]), m("plain"), m("getX", ret="int", params=["int"], statements=1), m("getY", ret="int", statements=1), m("setX", params=["int"], statements=1), m("none", statements=0),
    ]
    df = spark.createDataFrame(rows, schema)
    types = spark.createDataFrame([("my.Click", "my.Event"), ("my.Event", methods.EVENT)], "type string, parent string")
    assert sorted(r["name"] for r in methods.entry_points(df, types).collect()) == ["api", "clicked", "doGet", "main"]
    assert sorted(r["name"] for r in methods.all_methods(df).collect()) == ["api", "clicked", "doGet", "getY", "main", "plain"]
    assert sorted(r["name"] for r in methods.entry_points(df, types, ["plain"]).collect()) == ["api", "clicked", "doGet", "main", "plain"]


def test_canonical_hashes_commute(spark):
    rows = [(1, None, None, None, "a"), (2, None, None, None, "b"), (3, "SUB", 1, 2, None), (4, "SUB", 2, 1, None), (5, "NOT", 3, None, None), (6, "ADD", 1, 2, None)]
    h = {r["expr_id"]: r["canon"] for r in values.canonical(spark.createDataFrame(rows, "expr_id long, op string, lhs long, rhs long, leaf string")).collect()}
    assert h[3] == h[4] == h[5] != h[6]


def test_streaming_counts(spark, tmp_path):
    src = spark.createDataFrame([("t", "a", "2024-01-01 00:00:00"), ("t", "a", "2024-01-01 00:01:00"), ("t", "Halt", "2024-01-01 00:02:00"), ("u", "a", "2024-01-03 00:00:00")], "trace string, kind string, ts string").selectExpr("trace", "kind", "to_timestamp(ts) ts")
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = kinds.kind_counts(stream, "ts").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["trace"], r["kind"]): r["cnt"] for r in spark.table("counts").collect()} == {("t", "a"): 2, ("t", "Halt"): 1, ("u", "a"): 1}
    assert kinds.finished(src, "ts").filter("halted").first()["n"] == 3


def test_deep_trees_get_their_hash(spark):
    rows = [(0, None, None, None, "x"), *[(i, "NOT", i - 1, None, None) for i in range(1, 68)]]
    h = {r["expr_id"]: r["canon"] for r in values.canonical(spark.createDataFrame(rows, "expr_id long, op string, lhs long, rhs long, leaf string")).collect()}
    assert len(h) == 68 and len(set(h.values())) == 1
