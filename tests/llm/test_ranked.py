"""Ranked search against every score, and the cut into blocks against all cuts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from spoor.llm import ranked
from tests.llm.conftest import LONG

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top):
    """(item_id, rank, doc_id, score) from every score."""
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    found = [(i, Counter(w), len(w)) for i, t in docs if (w := split(t))]
    n, length = len(found), sum(x for *_, x in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c, size in found:
            m = 75 + 25 * size * n // length
            score = sum(int(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def prose(rng, n):
    return " ".join(f"{rng.choice(['a', 'B', 'ü'])}{int(rng.paretovariate(0.7)) % 300}" for _ in range(n))


@pytest.mark.parametrize("postings,at_once", [(100, 1 << 26), (3000, 600), (1 << 20, 1 << 26)])
def test_best_of_made_documents(spark, postings, at_once, monkeypatch):
    rng = random.Random(postings)
    docs = [(i, prose(rng, rng.choice([3, 30, 90]))) for i in range(700)]
    docs += [(1000 + i, docs[0][1]) for i in range(40)] + [(3, docs[9][1]), (None, docs[9][1]), (None, None), (2000, " .,! ")]
    items = [(i, prose(rng, rng.choice([1, 8, 60]))) for i in range(12)] + [(3, docs[0][1]), (3, docs[0][1]), (90, None), (91, "!"), (92, "nosuchterm"), (None, docs[5][1])]
    monkeypatch.setattr(ranked.build, "__defaults__", ("doc_id", "text", postings))
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, score int, item string").repartition(3)
    q = spark.createDataFrame([(*r, 2, 3) for r in items], "item_id long, text string, rank int, terms int")
    assert rows(ranked.ranked(d, q, top=7, bytes_at_once=at_once)) == plain(docs, items, 7)


def test_odd_rows_and_empty_tables(spark, odd, none):
    items = [(1, "the quick brown fox"), (2, "word1 and3 Wald"), (3, LONG), (4, "")]
    q = spark.createDataFrame(items, "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows(ranked.ranked(odd, q)) == plain(docs, items, 20)
    assert rows(ranked.ranked(none, q)) == []
    assert rows(ranked.ranked(odd, q.filter("false"))) == []
    assert rows(ranked.ranked(odd.filter("doc_id = 5"), q)) == []


def cost(g, ends, price):
    starts = [0, *ends[:-1]]
    return sum(price + sum(max(g[a:b]) - x for x in g[a:b]) for a, b in zip(starts, ends))


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for most, price in ((3, 5), (4, 0), (6, 40)):
        lists = [[rng.randrange(60) for _ in range(rng.randrange(1, 9))] for _ in range(12)]
        firsts = np.cumsum([0, *map(len, lists)])
        ends = ranked.cut(firsts, np.array([x for one in lists for x in one]), most, price).tolist()
        for one, a, b in zip(lists, firsts[:-1], firsts[1:]):
            own = [e - int(a) for e in ends if a < e <= b]
            assert own[-1] == len(one) and max(np.diff([0, *own])) <= most
            best = [0.0]
            for j in range(1, len(one) + 1):
                best.append(min(best[i] + cost(one[i:j], [j - i], price) for i in range(max(0, j - most), j)))
            assert cost(one, own, price) == pytest.approx(best[-1])


def test_blocks_are_skipped():
    """Documents of one common term and few of a rare one: those without the rare one are not read."""
    rng = np.random.default_rng(3)
    n = 20_000
    rare = np.sort(rng.choice(2000, 60, replace=False)) + 9000
    parts = [(np.arange(n, dtype=np.int32), np.full(n, 1, np.uint64), rng.integers(1, 4, n).astype(np.int32)), (rare.astype(np.int32), np.full(60, 2, np.uint64), np.full(60, 2, np.int32))]
    made = ranked._shard(parts, list(range(n)), [100] * n, n, 100 * n)
    shard = ranked.Shard(made.pop("ids"), {k: np.asarray(v) for k, v in made.items()})
    read = []
    scores = shard._scores
    shard._scores = lambda block, w, want, *a: read.append(int(want.sum())) or scores(block, w, want, *a)
    docs, found = shard.search(np.array([1, 2], np.uint64), np.array([30, 9000]), 1, 20)
    assert sum(read) < n / 5
    every = 30 * shard.impact[:n].astype(np.int64)
    every[rare] += 9000 * shard.impact[n:]
    best = np.lexsort((np.arange(n), -every))[:20]
    assert set(best.tolist()) <= set(docs.tolist()) and all(every[d] == s for d, s in zip(docs, found))


def test_a_task_holds_one_shard_at_a_time(spark, monkeypatch):
    rng = random.Random(4)
    docs, items = [(i, prose(rng, 4)) for i in range(6000)], [(i, prose(rng, 8)) for i in range(5)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    q = spark.createDataFrame(items, "item_id long, text string")
    shards, _ = ranked.build(d, postings=300)
    assert len(shards.inputFiles()) == shards.count() == 6  # as 1024 rows are indexed at once
    read = ranked._shards

    def checked(batches):
        for batch in batches:
            assert batch.num_rows == 1
            yield from read([batch])

    monkeypatch.setattr(ranked, "_shards", checked)
    monkeypatch.setattr(ranked.build, "__defaults__", ("doc_id", "text", 300))
    assert rows(ranked.ranked(d, q, top=7)) == plain(docs, items, 7)
