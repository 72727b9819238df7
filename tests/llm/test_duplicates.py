import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from spoor.llm import near, substring
from spoor.llm.graph import _mark, components


def shingles(text):
    w = (text or "").encode().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            parent[root(j)] = root(i)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(k)
    ids = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return sorted((str(k), str(ids[root(i)]), links[i]) for i, (k, _) in enumerate(rows))


def noisy(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_links_against_all_pairs(spark, odd, monkeypatch):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (120, 200, 60)]
    rows = [(i, noisy(rng, rng.choice(base), rng.randrange(6))) for i in range(150)] + [(900 + i, base[0]) for i in range(30)]
    rows += [(1000 + i, " ".join(f"v{rng.randrange(9999)}" for _ in range(50))) for i in range(30)]
    rows += [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    rows += [(2000, "one two"), (2001, "one two"), (2002, "one two three")]
    monkeypatch.setattr(near, "TILE_TEXTS", 20)  # several tiles in a block
    got = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["id"]), str(r["class_id"]), r["n_links"]) for r in got.collect()) == brute(rows)


def test_one_of_each_class_stays(spark, odd, none):
    out = near.stage_near(spark, odd, "")
    kept = out.select("doc_id", "text").collect()
    assert out.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "4", "5", "None", "None", "6", "7", "8", "9", "10"])
    assert near.near_classes(none).count() == 0 and near.stage_near(spark, none, "").count() == 0


def test_pruning_bound():
    least = near.least_matches()
    assert sorted(least) == list(range(near.STEP, near.HASHES + 1, near.STEP))
    assert all(m < 0.8 * n for n, m in least.items())


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:889], rng.integers(0, 1 << 63, 111).astype(np.uint64)])
    assert (near.signature(a) == near.signature(b)).mean() == pytest.approx(0.8, abs=0.12)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def brute_removed(rows, window=20):
    """(id, kept text) by the definition: windows are ordered by id, nulls last, then start."""
    seen = {}
    split = [((k is None, k or 0), k, (t or "").split()) for k, t in rows]
    for order, _, w in split:
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            seen[s] = min(seen.get(s, (order, i)), (order, i))
    out = []
    for order, k, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] != (order, i):
                gone.update(range(i, i + window))
        out.append((str(k), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [20, 32, 7])
def test_substrings_against_brute_force(spark, odd, none, window):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(55))
    rows = []
    for i in range(60):
        own = [f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))]
        at = rng.randrange(len(own))
        rows.append((rng.randrange(1000), " ".join([*own[:at], *([passage] * rng.randrange(3)), *own[at:]])))
    rows += [(2000, "to " * 50), (2001, "to " * 20), (2002, "to " * 19), (2003, rows[0][1]), (2003, rows[0][1]), (None, passage), (None, None), (None, rows[1][1])]
    # rows of one id with different texts, which share passages with each other and with others
    rows += [(7, passage), (7, "x " + passage), (7, passage + " y"), (7, passage), (3, "a b c " + passage), (None, "z " + passage), (8, passage.replace("p40 ", ""))]
    rows += [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring.deduplicate(df, window=window)
    assert sorted((str(r["doc_id"]), r["kept"]) for r in got.collect()) == brute_removed(rows, window)
    assert got.filter("n_removed <> aggregate(removed, 0L, (a, x) -> a + x.stop - x.start)").count() == 0
    assert substring.deduplicate(none, window=window).count() == 0


def test_rows_without_ids_are_told_of_their_own_windows_alone(spark):
    """What is told grows with the rows, not with their square."""
    rng = random.Random(6)
    passage = [" ".join(f"p{k}-{i}" for i in range(40)) for k in range(4)]

    def made(n):
        return [(None if i % 3 else i // 30, " ".join([*(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 30))), rng.choice(passage)])) for i in range(n)]

    told = []
    for n in (60, 240):
        rows = made(n)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        told.append(substring.repeats(df).selectExpr("sum(size(firsts))").first()[0] or 0)
    assert told[1] <= 5 * max(told[0], 100)
    assert sorted((str(r["doc_id"]), r["kept"]) for r in substring.deduplicate(df).collect()) == brute_removed(rows)


def test_levels_double():
    assert substring.levels(20) == [10, 20] and substring.levels(64) == [8, 16, 32, 64] and substring.levels(7) == [7]


def test_nothing_repeats(spark):
    rows = [(i, " ".join(f"w{i}-{j}" for j in range(40))) for i in range(4)]
    assert substring.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).filter("n_removed > 0 or n_words <> 40").count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 10, 20])
def test_window_hashes_tell_windows_apart(size):
    codes = np.random.default_rng(2).integers(0, 3, 500).astype(np.uint64)
    h = substring.windows(codes, size)
    seen = {}
    for i in range(len(codes) - size + 1):
        assert seen.setdefault(tuple(codes[i : i + size]), h[i]) == h[i]
    assert len(set(h.tolist())) == len(seen)


def test_mark_of_more_edges_than_a_long_can_sum(spark):
    edges = spark.range(18_000_000).selectExpr("id + 1 as u", "0L as v")
    n, mark = _mark(edges)
    assert n == 18_000_000 and mark != _mark(edges.filter("u <> 7"))[1]
