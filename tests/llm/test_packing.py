import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.llm import ordering, packing, tokens


def sequences(sizes, limits, losses=None, pool=32):
    p = packing.Packer(limits, pool)
    out = []
    for i, n in enumerate(sizes):
        out += list(p.add(packing.Example(i, n, n if losses is None else losses[i])))
    return out + list(p.finish())


@pytest.mark.parametrize("seed", range(25))
def test_limits_hold_and_every_id_is_in_one_piece(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 50, 70, 500]) for _ in range(rng.randrange(1, 60))]
    losses = [rng.randrange(n + 1) for n in sizes]
    limits = packing.Limits(rng.choice([64, 128, 4096]), rng.choice([1, 2, 8, 128]), rng.choice([8, 16, 64, 5000]))
    placed = defaultdict(list)
    for s in sequences(sizes, limits, losses):
        total = sum(n for _, _, n in s)
        assert total == limits.tokens or total & (total - 1) == 0  # no padding
        assert len(s) <= limits.segments
        assert sum(max(0, a + n - max(a, e.tokens - e.loss)) for e, a, n in s) <= limits.loss
        for e, a, n in s:
            placed[e.key].append((a, n))
    for i, n in enumerate(sizes):
        at = 0
        for a, k in sorted(placed[i]):
            assert a == at
            at += k
        assert at == n


def test_refuses_impossible_limits():
    with pytest.raises(ValueError):
        packing.Packer(packing.Limits(loss=0))


def test_words_are_encoded_as_texts_are(spark, sf):
    e = tokens.Encoder()
    items = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    items += ["Hello WORLD's don't", "é́ x İstanbul ΣΑΣ", "<|endoftext|> x<|endoftext|>y", "it's,they'll. 12345abc", "\x1c\x85 q", "#$%&*** €%%%", "", "  ", " ́a", "ﬁ Å", None, "a" * 500]
    items += ["Straße GROẞE ÀÖØÞ ×÷ À×b", "ab\x00c x", "Ça1va2 ..a..b", "b" * 40_000 + " c " + "x1" * 30, "naïve—dash", "A<|B <|startoftext|>", "x'S y'Ll"]
    for text, ids in zip(items, e.batch(items)):
        assert ids.tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_rows_of_pack(spark, odd, none):
    rows = packing.pack(odd).collect()
    e = tokens.Encoder()
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(x["length"] for x in s[:i]) for i in range(len(s))]
    ids = {}
    for r in odd.select("doc_id", "text").collect():
        ids.setdefault(r["doc_id"], []).append(np.array(e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    for key, found in ids.items():
        pieces = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["doc_id"] == key)
        assert sorted(n for a, _, _, n in pieces if a == 0) == sorted(len(x) // 4 for x in found)
        assert sum(p[1] for p in pieces) == sum(len(x) // 4 for x in found)
        for a, n, crc, total in pieces:
            assert any(total == len(x) // 4 and zlib.crc32(x[4 * a : 4 * (a + n)]) == crc for x in found)
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 1000])
def test_permutation(n):
    out = ordering.permute(np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 10 or out.tolist() != ordering.permute(np.arange(n), n, key=1).tolist()


def test_shards_hold_every_sequence_at_its_slot(spark, odd, none):
    seqs = ordering.sequences(odd, length=64)
    shards = ordering.materialise(seqs, length=64, file_bytes=4096)
    rows = sorted(ordering.read_from(spark, shards).collect(), key=lambda r: r["slot"])
    index = {r["slot"]: r for r in shards.index.collect()}
    assert [r["slot"] for r in rows] == list(range(seqs.count())) == sorted(index)
    assert all(r["shard"] == r["slot"] // shards.per_file and r["offset"] == r["slot"] % shards.per_file * (128 + 9) for r in rows)
    e, whole = tokens.Encoder(), []
    for r in odd.select("text").collect():
        whole += [*e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
    found = [np.frombuffer(r["ids"], "<u2")[: index[r["slot"]]["n_tokens"]].tolist() for r in rows]
    assert sorted(x for ids in found for x in ids) == sorted(whole)
    assert sorted(map(str, ((r["doc_ids"], r["n_tokens"]) for r in index.values()))) == sorted(map(str, ((r["doc_ids"], r["n_tokens"]) for r in seqs.collect())))
    rest = ordering.read_from(spark, shards, 20).collect()
    assert sorted(r["slot"] for r in rest) == list(range(20, len(rows)))
    path = shards.folder.removeprefix("file:")
    files = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    with open(f"{path}/{files[rows[21]['shard']]}", "rb") as f:  # as a reader that resumes does
        f.seek(rows[21]["offset"])
        assert f.read(8 + 128) == (21).to_bytes(8, "little") + rows[21]["ids"]
        assert f.read(1 + 8)[1:] in ((22).to_bytes(8, "little"), b"")
    assert ordering.read_from(spark, ordering.materialise(ordering.sequences(none))).count() == 0


def test_training_order_query_against_the_definition(spark, sf):
    rows = ordering.op10_training_order(spark, sf).collect()
    n = len(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    e, streams = tokens.Encoder(), []
    for r in docs:
        streams += [(r["doc_id"], x) for x in [*e.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]]
    assert sum(r["n_tokens"] for r in rows) == len(streams) and sorted(r["slot"] for r in rows) == list(range(n))
    assert spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions() == 1  # then numbers follow the rows
    slots = ordering.permute(np.arange(n), n)
    by_slot = {r["slot"]: r for r in rows}
    for k in range(n):
        part = streams[k * ordering.LENGTH : (k + 1) * ordering.LENGTH]
        ids = np.array([x for _, x in part] + [0] * (ordering.LENGTH - len(part)), "<u2").tobytes()
        r = by_slot[slots[k]]
        assert r["ids_crc32"] == zlib.crc32(ids) and r["n_tokens"] == len(part) and r["doc_ids"] == list(dict.fromkeys(d for d, _ in part))


def test_three_limits_bind_on_turns(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    limits = packing.Limits(1024, 12, 384)
    rows = packing.pack(turns, "key", "text", limits, loss=F.col("role") == "assistant").collect()
    roles = {r["key"]: r["role"] for r in turns.collect()}
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
        assert r["loss_tokens"] == (r["length"] if roles[r["key"]] == "assistant" else 0)
    sums = [(sum(r["length"] for r in s), len(s), sum(r["loss_tokens"] for r in s)) for s in by_seq.values()]
    assert all(t <= 1024 and n <= 12 and loss <= 384 for t, n, loss in sums)
    assert any(n == 12 for _, n, _ in sums)
    free = packing.pack(turns, "key", "text", packing.Limits(1024, 12, 1024), loss=F.col("role") == "assistant").groupBy("sequence_id").agg(F.sum("loss_tokens").alias("n"))
    assert free.filter("n > 384").count() > 0  # so the third limit binds as well
