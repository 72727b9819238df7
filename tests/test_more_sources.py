"""Class files, feature descriptors, exact medians, correlation of mappings and trigrams of arriving traces."""

import glob
import os
import random
import statistics
from collections import Counter
from datetime import datetime, timedelta

import pyspark
import pytest
from pyspark.sql import functions as F

from spoor.operators import builder, comparison, descriptors, features, trace
from spoor.plans.deep import class_file
from spoor.sources import classfiles, readers
from spoor.streaming import trigrams


def test_class_files_and_archives(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "B.class").write_bytes(class_file("a/B", 0x4021, [("x", "I")], [("m", "(J)V")]))
    (tmp_path / "._B.class").write_bytes(b"junk")
    (tmp_path / "bad.class").write_bytes(class_file("a/C", 0x21, [], [])[:40])
    (tmp_path / "none.class").write_bytes(b"")
    (tmp_path / "bad.jar").write_bytes(b"PK\x03\x04 no archive")
    units = classfiles.read(spark, str(tmp_path)).collect()
    good = [r for r in units if r.error is None]
    assert len(units) == 3 and len(good) == 1 and all(r.types == [] for r in units if r.error)
    t = good[0].types[0]
    assert (t.sig, t.kind, [tuple(m) for m in t.methods], [tuple(f) for f in t.fields]) == ("La/B;", "enum", [("m(J)V", "m")], [("x", "I")])


def test_classes_of_a_real_archive(spark, tmp_path):
    jar = min(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "jsr305*.jar")) or glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "*.jar")), key=os.path.getsize)
    os.symlink(jar, tmp_path / "real.jar")
    units = classfiles.read(spark, str(tmp_path))
    assert units.count() > 0 and units.filter("error is not null").count() == 0
    types, methods, fields = readers.declarations(units)
    assert types.filter(~F.col("type").rlike("^L[^;]+;$")).count() == 0 and methods.count() > 0


def test_descriptors_of_three_types_and_of_keys(spark):
    rows = spark.createDataFrame([("s", "x", 1, "q"), ("s", "y", 2, None), ("t", None, None, None)], "id string, k string, n int, c string")
    plan = descriptors.Plan("id", [
        descriptors.Measure("SUM", F.sum("n")), descriptors.Measure("LAST", F.max("c"), descriptors.Enumerated(("q", "r"))), descriptors.Measure("TEXT", F.max("k"), descriptors.Text()),
        descriptors.Counted("K", (F.col("k"),)), descriptors.Counted("KN", (F.col("k"), F.col("n")), F.col("n") > 1),
    ])
    found = {(r.id, r.name): (r.value, r.type) for r in plan.features(rows).collect()}
    assert found == {
        ("s", "SUM"): ("3", "NUMERIC"), ("s", "LAST"): ("q", "{q,r}"), ("s", "TEXT"): ("y", "STRING"), ("s", "K_x_COUNT"): ("1", "NUMERIC"), ("s", "K_y_COUNT"): ("1", "NUMERIC"),
        ("s", "KN_y:2_COUNT"): ("1", "NUMERIC"), ("t", "SUM"): ("0", "NUMERIC"), ("t", "LAST"): ("?", "{q,r}"), ("t", "TEXT"): ("", "STRING"),
    }
    assert {r.row for r in plan.dense(rows).collect()} == {"s,q,3,y", "t,?,0,"}
    assert plan.attributes()[1] == ("LAST", "{q,r}", "?")
    with pytest.raises(ValueError):
        plan.register(descriptors.Measure("SUM", F.max("n")))
    wrong = descriptors.Plan("id", [descriptors.Measure("LAST", F.max("c"), descriptors.Enumerated(("r",)))])
    with pytest.raises(Exception, match="no value of LAST"):
        wrong.features(rows).collect()


def test_medians_with_zeros_in_many_parts(spark):
    rng = random.Random(9)
    members = [(m, "g" if m < 40 else "h") for m in range(61)]
    data = [(m, n, rng.choice([-1.0, 0.0, 0.25, 0.5, 2.0, rng.random()])) for m, _ in members for n in "abc" if rng.random() < 0.6]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = features.aggregate_features(spark.createDataFrame(data, "m int, name string, value double"), spark.createDataFrame(members, "m int, g string"), "g", "m").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(out) == 6
    for r in out:
        own = [m for m, g in members if g == r.g]
        have = {m: v for m, n, v in data if n == r.name}
        values = [have.get(m, 0.0) for m in own]
        assert r.median == pytest.approx(statistics.median(values)) and r.variance == pytest.approx(statistics.pvariance(values)) and r.avg == pytest.approx(statistics.mean(values))
        assert (r.min, r.max) == (min(values), max(values))


def test_correlation_keeps_pairs_that_nothing_clashes_with(spark):
    pairs = [(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (1, "b", "z"), (1, "c", "z"), (1, "d", "w"), (2, "b", "y")]
    rows = [(*p, "VALUE", "OBJECT") for p in pairs] + [(1, "e", "v", "OPERATOR", "OPERATOR"), (1, "d", "q", "VALUE", "METHODCALL")]
    got = comparison.correlate_tables(spark.createDataFrame(rows, "g int, l string, r string, l_kind string, r_kind string"), ["g"])
    assert {tuple(r) for r in got.collect()} == {(1, "a", "x"), (1, "d", "w"), (2, "b", "y")}
    assert builder.correlate([(l, r) for g, l, r in pairs if g == 1]) == {"a": "x", "d": "w"}


def test_trigrams_of_shuffled_batches_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(f"t{t}", start + timedelta(seconds=i * 20), t * 100 + i, rng.choice("abc")) for t in range(5) for i in range(rng.randrange(2, 30))]
    schema = "trace string, ts timestamp, seq long, kind string"
    # batches that overlap in time, records in them in any order
    order = sorted(rows, key=lambda r: r[1] + timedelta(seconds=rng.randrange(240)))
    n = 4
    for k in range(n):
        part = order[k * len(order) // n : (k + 1) * len(order) // n]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k in (1, 2):  # others come later, and move the watermark on
        spark.createDataFrame([("end", start + timedelta(days=k), 10**6 + k, "z")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = trigrams.trigrams(stream).writeStream.format("memory").queryName("trigrams").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = Counter((r.trace, r.code) for r in spark.table("trigrams").collect() if r.trace != "end")
    batch = trace.trigram_share(spark.createDataFrame(rows, schema), "trace", ["ts", "seq"], "kind")
    assert got == {(r.trace, r.code): r.cnt for r in batch.collect()}
