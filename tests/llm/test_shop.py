"""Cohort retention and mixing against plain versions."""

import math
import random
import re
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spoor.llm import cohorts, common, mixing

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def plain_retention(clicks, cities):
    """Both states from all rows, without deltas."""
    day, run = 86_400_000_000, 3 * 86_400_000_000
    zero = datetime(1970, 1, 1)
    us = lambda t: (t - zero) // timedelta(microseconds=1)
    seen = []
    for c in {tuple(c[:7]) for c in clicks if c[1] is not None and c[3] is not None}:
        arrives = None if c[2] is None else us(c[2])
        if arrives is not None and c[0] is not None and (h := zlib.crc32(str(c[0]).encode())) % 3 == 0:
            arrives += h % 100 * day
        cents = 0 if c[5] is None or not math.isfinite(c[5]) else math.floor(100 * c[5] + 0.5)
        seen.append((c[3], us(c[1]), c[4] == "purchase", cents, arrives is not None and arrives < us(cohorts.CUTOFF)))
    starts = []
    for state in (0, 1):
        s = {}
        for client, at, bought, _, early in seen:
            if bought and (state or early):
                s[client] = min(s.get(client, at), at)
        starts.append(s)
    cells = defaultdict(lambda: [set(), set(), 0])
    for state in (0, 1):
        for client, at, _, cents, early in seen:
            start = starts[state].get(client)
            if start is None or at < start or not (state or early):
                continue
            cell = cells[state, cities.get(client) or "", start // run, (at - start) // run]
            cell[0].add(client)
            other = starts[1 - state].get(client)
            if other is not None and other // run != start // run:
                cell[1].add(client)
            cell[2] += cents
    return sorted((*k, len(u), sum(zlib.crc32(str(x).encode()) for x in u), len(m), c) for k, (u, m, c) in cells.items())


def made_clicks(n, seed):
    """Rows of few clients, one of which has a third; late, repeated, early and broken ones."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(80 * 86_400_000_000))
        client = 7 if rng.random() < 0.33 else rng.choice([None, *range(30)])
        out.append((
            rng.choice([i, i, i, i // 2, None]), at if rng.random() > 0.03 else None, at + timedelta(days=rng.randrange(3)) if rng.random() > 0.03 else None, client,
            rng.choice(["view", "view", "click", None, "purchase"]), rng.choice([None, 0.005, -1.5, 3.333, float("nan"), float("inf"), 12.0]), rng.choice(["{}", None]),
        ))
    return out + out[: n // 5]


def found(df):
    columns = ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("split", [1, 4, 4096])
def test_retention_by_deltas_against_all_rows(spark, monkeypatch, split):
    monkeypatch.setattr(common.heavy_keys, "__defaults__", (split,))
    clicks = made_clicks(1500, split)
    extra = "state int, segment string, start long, users long, part string"
    table = spark.createDataFrame([(*c, 1, "s", 2, 3, "p") for c in clicks], f"{CLICKS}, {extra}")
    cities = {i: ["Arl", "Bo", None][i % 3] for i in range(20)}
    clients = spark.createDataFrame([(i, c, "x") for i, c in cities.items()] + [(None, "Arl", "x")], "client_id long, city string, cohort string")
    assert found(cohorts.retention(table, clients)) == plain_retention(clicks, cities)


def test_retention_of_nothing_and_of_repeated_clients(spark):
    empty = spark.createDataFrame([], CLICKS)
    clients = spark.createDataFrame([(1, "B"), (1, "A"), (1, None)], "client_id long, city string")
    assert found(cohorts.retention(empty, clients)) == []
    at = datetime(2024, 1, 5, 3)
    one = spark.createDataFrame([(1, at, at, 1, "purchase", 2.0, None)], CLICKS)
    assert [(r[0], r[1], r[7]) for r in found(cohorts.retention(one, clients))] == [(0, "A", 200), (1, "A", 200)]
    assert [r[1] for r in found(cohorts.retention(one, clients.filter("false")))] == ["", ""]


def test_retention_does_not_depend_on_the_zone_of_the_session(spark, sf):
    clicks, clients = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("clicks", "clients"))
    want = found(cohorts.retention(clicks, clients))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert found(cohorts.retention(clicks, clients)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# mixing


def plain_targets(sizes, weights, budget, most):
    """Shares by weight; what is above a source's limit is shared again."""
    full = set()
    while True:
        rest = budget - sum(most * sizes[i] for i in full)
        units = sum(w for i, w in enumerate(weights) if i not in full)
        share = [most * sizes[i] if i in full else rest * weights[i] / units for i in range(len(sizes))]
        above = {i for i, x in enumerate(share) if i not in full and x > most * sizes[i]}
        if not above:
            return share
        full |= above


def mixed(spark, docs, **options):
    known, order = mixing.mix(docs, **options)
    return [r.asDict() for r in known.collect()], [r.asDict() for r in order.orderBy("at").collect()]


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("split", [3, 4096])
def test_mix_of_uneven_sources(spark, monkeypatch, split):
    monkeypatch.setattr(common.heavy_keys, "__defaults__", (split,))
    rng = random.Random(4)
    data = [(i, " ".join("w" * rng.choice([1, 1, 2, 5, 40])), s) for i, s in enumerate(rng.choices(["a", "b", "ö", "z", None], [40, 2, 5, 1, 1], k=400))]
    data += [(1000, "x " * 3000, "a"), (None, "null id here", "b"), (None, None, "b"), (5, "five again", "a"), (5, "five again", "a")]
    known, order = mixed(spark, spark.createDataFrame(data, "doc_id long, text string, source string"))
    assert sorted((r["id"] or -1, r["size"]) for r in known) == sorted((i or -1, size_of(t)) for i, t, _ in data)
    names = ["a", "b", "z", "ö", None]
    sizes = [sum(size_of(t) for _, t, s in data if s == n) for n in names]
    want = plain_targets(sizes, [1, 2, 3, 1, 2], sum(sizes), 3)
    by = {r["source"]: r for r in known}
    assert [by[n]["source_size"] for n in names] == sizes
    assert all(math.isclose(by[n]["target"], w) for n, w in zip(names, want)) and any(w == 3 * s for w, s in zip(want, sizes))
    source = {r["row"]: r for r in known}
    taken, per_row = defaultdict(int), defaultdict(int)
    at = 0
    for r in order:
        assert r["at"] == at and 0 < r["words"] <= source[r["row"]]["size"]
        at += r["words"]
        taken[source[r["row"]]["source"]] += r["words"]
        per_row[r["row"]] += r["words"]
    assert all(abs(taken[n] - w) < 1 for n, w in zip(names, want)) and at <= sum(sizes)
    assert all(n <= 3 * source[row]["size"] for row, n in per_row.items())
    # anywhere in the mix no source is off its share by more than a document
    sent, longest = defaultdict(int), defaultdict(int)
    for r in known:
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for r in order[:-1]:
        s = source[r["row"]]["source"]
        sent[s] += r["words"]
        time = sent[s] / by[s]["target"]
        for n in names:
            assert time * by[n]["target"] - sent[n] <= longest[n] + 1e-6


def test_mix_is_the_same_again_whatever_the_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, second = (
        sorted((s["id"], r["pass"], r["words"], r["at"]) for known, order in [mixed(spark, d)] for s in known for r in order if r["row"] == s["row"])
        for d in (docs, docs.repartition(7, F.rand(3)))
    )
    assert first == second


def test_mix_of_odd_rows(spark, odd, none):
    known, order = mixed(spark, odd)
    assert len(known) == odd.count() and sum(r["words"] for r in order) <= sum(r["size"] for r in known)
    assert mixed(spark, none) == ([], [])
    known, order = mixed(spark, odd.withColumn("text", F.lit(" ")))
    assert order == [] and all(r["target"] == 0 and r["size"] == 0 for r in known)


def test_running_sums_over_groups_in_many_tasks(spark):
    rng = random.Random(1)
    data = [(g, i, rng.randrange(5)) for i, g in enumerate(rng.choices([0, 1, 2, 9, 10], [3, 1, 90, 1, 1], k=3000))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = common.running(spark.createDataFrame(data, "g long, i long, v long"), "g", ["i"], "v", "before", "sums").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sums, want = defaultdict(int), set()
    for g, i, v in sorted(data):
        want.add((g, i, v, sums[g]))
        sums[g] += v
    assert {tuple(r) for r in out} == want and len(out) == len(data)
