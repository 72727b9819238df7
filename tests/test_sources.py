import json

import pytest

from spoor.sources import readers, sinks


def test_config_and_json(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"title": "t", "projectLibraries": {"a": ["x", "y"]}, "maxRecursiveCalls": 3, "other": 1}))
    row = readers.config(spark, str(p)).first()
    assert row["title"] == "t" and row["projectLibraries"] == {"a": ["x", "y"]} and row["maxRecursiveCalls"] == 3
    q = tmp_path / "s.json"
    q.write_text(json.dumps({"knownSuspicious": [{"lhs": "a", "rhs": "b"}]}))
    assert [tuple(r) for r in readers.suspicious(spark, str(q)).collect()] == [("a", "b")]
    assert readers.suspicious(spark, None).count() == 0
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"modifications": {"F": {"n": 1}}}))
    assert readers.modifications(spark, str(m)).first()["filter"] == "F"


def test_listing(spark, tmp_path):
    for name in ("p2/src/A.java", "p1/B.java", "p1/._B.java", "p1/x.txt"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x\n")
    assert sorted(r["name"] for r in readers.files(spark, str(tmp_path), ".java").collect()) == ["A.java", "B.java"]
    assert [r["project_id"] for r in readers.projects(spark, str(tmp_path)).collect()] == ["p1", "p2"]
    assert readers.directories(spark, str(tmp_path)).count() == 3


def test_score_files(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("a\tb\t0.5\nb\tc\tNaN\n")
    assert readers.scores(spark, str(tmp_path / "s.tsv")).count() == 2
    (tmp_path / "prog.tsv").write_text("program\tsimilarity\nq\t0.25\n")
    assert tuple(readers.headed_scores(spark, str(tmp_path / "prog.tsv")).first()) == ("prog", "q", 0.25)
    (tmp_path / "b.tsv").write_text("x\tNaN\n")
    assert readers.base_scores(spark, str(tmp_path / "b.tsv")).first()["score"] == 100.0
    (tmp_path / "l.txt").write_text("0\n1\n2\n3\n")
    assert [r["line"] for r in readers.line_range(spark, str(tmp_path / "l.txt"), 1, 2).collect()] == ["1", "2"]


def test_arff_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("a-1", "x", 1.0), ("a-1", "y", 0.5), ("b-1", "y", 2.0)], "set_id string, name string, value double")
    sinks.sparse_arff(f, str(tmp_path / "out"))
    text = lambda: "".join(open(p.removeprefix("file:")).read() for p in sinks.arff_files(spark, str(tmp_path / "out")))
    lines = [x.replace("{ ", "{") for x in text().splitlines()]
    assert lines[:6] == ["@RELATION features", "@ATTRIBUTE id {a-1,b-1}", "@ATTRIBUTE x NUMERIC", "@ATTRIBUTE y NUMERIC", "@ATTRIBUTE cls {a,b}", "@DATA"]
    assert sorted(lines[6:]) == ["{0 a-1,1 1.0000,2 0.5000,3 a}", "{0 b-1,2 2.0000,3 b}"]
    assert sinks.read_back(spark, str(tmp_path / "out"), 2) == 2
    sinks.sparse_arff(f.filter("set_id = 'b-1'"), str(tmp_path / "out"))  # again: nothing of the first run stays
    assert [x.replace("{ ", "{") for x in text().splitlines()] == ["@RELATION features", "@ATTRIBUTE id {b-1}", "@ATTRIBUTE y NUMERIC", "@ATTRIBUTE cls {b}", "@DATA", "{0 b-1,1 2.0000,2 b}"]
    with pytest.raises(ValueError):
        sinks.read_back(spark, str(tmp_path / "out"), 2)
    with pytest.raises(ValueError):
        sinks.sparse_arff(f.withColumnRenamed("name", "n").selectExpr("set_id", "'cls' as name", "value"), str(tmp_path / "no"))


def test_graph_packing_round_trip(spark):
    n = spark.createDataFrame([("g", "a", "VALUE", "1"), ("h", "b", "VALUE", "2")], "graph_id string, node_id string, kind string, label string")
    e = spark.createDataFrame([("g", "a", "a", "SCOPE")], "graph_id string, src string, dst string, kind string")
    n2, e2 = sinks.unpacked_graphs(sinks.packed_graphs(n, e))
    assert sorted(map(tuple, n2.collect())) == sorted(map(tuple, n.collect())) and list(map(tuple, e2.collect())) == list(map(tuple, e.collect()))


def test_opcodes(spark, tmp_path):
    (tmp_path / "o.csv").write_text('nop,00,x,"a, b"\naload,19,,\n')
    assert [tuple(r) for r in readers.opcodes(spark, str(tmp_path / "o.csv")).collect()] == [("nop", "00"), ("aload", "19")]


def test_averages_are_over_all_members(spark, tmp_path):
    f = spark.createDataFrame([("a-1", "x", 1.0), ("a-2", "y", 3.0)], "member string, name string, value double")
    m = spark.createDataFrame([("a-1", "a"), ("a-2", "a"), ("a-3", "a")], "member string, set_id string")
    assert sinks.averaged_rows(f, m, "set_id", "member").first()["row"] == "{0 a,1 0.3333,2 1.0000,3 a}"
    path = str(tmp_path / "avg")
    sinks.averaged_arff(f, m, path, "set_id", "member")
    assert sinks.read_back(spark, path, 1) == 1


def test_declarations_keep_the_last(spark):
    member = lambda n: [(f"{n}()V", n)]
    units = spark.createDataFrame([("b", [("T", "class", member("m"), [("f", "J")])]), ("a", [("T", "enum", member("m"), [("f", "I")]), ("U", "class", [], [])])], readers.UNITS)
    types, methods, fields = readers.declarations(units)
    assert {tuple(r) for r in types.collect()} == {("T", "class", "b"), ("U", "class", "a")}
    assert [tuple(r) for r in methods.collect()] == [("T.m()V", "T", "m", "b")]
    assert [tuple(r) for r in fields.collect()] == [("T.f", "T", "J", "b")]


def test_traces_of_one_entry_point_go_to_files_of_some_size(spark, tmp_path):
    rows = [(p, e, f"t{t}", s) for p, e, n in (("a", "L/x;", 12), ("a", "L/y;", 1), (None, "L/x;", 6)) for t in range(n) for s in range(10)]
    df = spark.createDataFrame(rows, "project_id string, entry_point string, trace_id string, seq bigint")
    sinks.traces(df, str(tmp_path / "out"), size=20)
    back = readers.traces(spark, str(tmp_path / "out"), "seq bigint").selectExpr("project_id", "entry_point", "trace_id", "seq", "_metadata.file_path file", "_metadata.row_index at")
    assert sorted(map(str, (tuple(r)[:4] for r in back.collect()))) == sorted(str((p, e.replace("/", "."), t, s)) for p, e, t, s in rows)
    files = back.groupBy("project_id", "entry_point").agg({"file": "approx_count_distinct"})
    of = {tuple(r)[:2]: r[2] for r in files.collect()}
    assert of["a", "L.x;"] > 1 and of["a", "L.y;"] == 1 and of[None, "L.x;"] > 1
    traces = back.groupBy("project_id", "entry_point", "trace_id").agg({"file": "approx_count_distinct"})
    assert {r[3] for r in traces.collect()} == {1}
    last = {}
    for r in back.orderBy("file", "at").collect():
        key = r.project_id, r.entry_point, r.trace_id
        assert last.get(key, -1) < r.seq
        last[key] = r.seq
