"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of shingles: five consecutive words, or all words of a shorter text.  Equal
texts are one vertex with a weight.  Banded MinHash keys give buckets; a bucket's members
are tied to its least one, and connected components of these ties are the blocks outside
which no pair can be a candidate.  Each text of a block meets the block's head (its first text) once,
and from then on stands for itself as its MinHash values, the shingles it shares with the head (bits) and those it adds.
Blocks are cut into tiles of bounded size, each pair of
tiles is one unit of work.  There the MinHash values of all pairs are compared a few at a
time, and a pair is dropped as soon as the posterior probability that its Jaccard
similarity reaches the threshold (uniform prior, binomial likelihood) is below the
tolerance; the pairs that stay are verified exactly on their shingles.  Work units give
sums and spanning ties, never pairs: the output is one row for each document.

Defined cases: a text without words (or null) has no shingles, links to nothing and is a
class of its own; a class id is the least id of the class (nulls aside); equal texts link
to each other; a repeated row is a document of its own; rows of one id with different texts
are documents of their own; a very long text is one set of shingles in the memory of a task;
an empty table gives no rows; columns other than id and text are not read, so their names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import give_back, load, map_batches, scratch, slices, staged
from spoor.llm.graph import components
from spoor.llm.words import blocks, bounds, hashes

SHINGLE, THRESHOLD = 5, 0.8
#: 32 bands of 4: a pair at the threshold shares no bucket with probability 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP, TOLERANCE = 32, 1e-6
#: A tile has about so many texts and shingles.
TILE_TEXTS, TILE_SHINGLES = 128, 500_000

_RNG = np.random.default_rng(17)
_MUL = (_RNG.integers(1, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def _chained(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    m = len(codes) - size + 1
    h = np.full(m, size, np.uint64)
    for i in range(size):
        h = (h ^ codes[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text of a column."""
    for a, b, data, offsets in blocks(column):
        starts, ends, rows = bounds(data, offsets)
        codes = hashes(data, starts, ends)
        runs = _chained(codes, size) if len(codes) >= size else None
        for lo, hi in zip(rows.tolist(), rows[1:].tolist()):
            if hi - lo >= size:
                found = np.sort(runs[lo : hi - size + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            else:
                yield _chained(codes[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        h = (low[i : i + 1024, None] ^ _XOR) * _MUL
        h ^= h >> np.uint32(15)
        np.minimum(out, h.min(0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, with the band's number in it."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for i in range(ROWS):
        h = (h ^ rows[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def least_matches(hashes: int = HASHES, step: int = STEP, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After n compared values, the fewest matches for which P(J >= threshold) is not below the tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and P(J >= t) = P(Binomial(n + 1, t) <= m).
    """
    from math import comb

    out = {}
    for n in range(step, hashes + 1, step):
        total, m = 0.0, -1
        while total < tolerance and m < n:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


_LEAST = least_matches()


class Unit:
    """The texts of one or two tiles of a block, each as what it shares with the block's head and what it adds.

    Of two texts the shingles that both keep of the head are counted on bits, those that both add by their
    numbers, which together are all they have in common.
    """

    def __init__(self, rows: list[tuple]):
        """Rows are (r, tile, copies, size, signature, kept, added), the last three as bytes."""
        self.rows = rows
        self.sizes = np.array([r[3] for r in rows])
        self.sigs = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(len(rows), HASHES)
        self.kept = np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1)
        added = [np.frombuffer(r[6], np.uint64) for r in rows]
        self.firsts = np.concatenate(([0], np.cumsum([len(x) for x in added])))
        found, codes = np.unique(np.concatenate(added), return_inverse=True)
        self.codes, self.mark = codes.reshape(-1), np.zeros(len(found), bool)

    def linked(self, left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        """For each text of ``left`` the texts of ``right`` (or the later ones of ``left``) that it is linked to."""
        other = left if right is None else right
        sigs, kept, sizes = self.sigs[other], self.kept[other], self.sizes[other]
        codes = np.concatenate([self.codes[self.firsts[j] : self.firsts[j + 1]] for j in other])
        ends = np.cumsum(self.firsts[other + 1] - self.firsts[other])
        for k, i in enumerate(left):
            size = self.sizes[i]
            alive = np.flatnonzero((np.minimum(sizes, size) >= THRESHOLD * np.maximum(sizes, size) - 1e-9) & ((np.arange(len(other)) > k) | (right is not None)))
            matches = np.zeros(len(alive), int)
            for at in range(0, HASHES, STEP):
                if not len(alive):
                    break
                matches += (sigs[alive, at : at + STEP] == self.sigs[i, at : at + STEP]).sum(1)
                stay = matches >= _LEAST[at + STEP]
                alive, matches = alive[stay], matches[stay]
            if not len(alive):
                continue
            own = self.codes[self.firsts[i] : self.firsts[i + 1]]
            self.mark[own] = True
            shared = np.concatenate(([0], np.cumsum(self.mark[codes])))
            self.mark[own] = False
            added = shared[ends[alive]] - shared[ends[alive] - (self.firsts[other[alive] + 1] - self.firsts[other[alive]])]
            common = np.bitwise_count(kept[alive] & self.kept[i]).sum(1, dtype=np.int64) + added
            # J >= 4/5 without rounding
            found = other[alive][5 * common >= 4 * (size + sizes[alive] - common)]
            if len(found):
                yield int(i), found


def against(head: np.ndarray, shingles: np.ndarray) -> tuple[bytes, bytes]:
    """What a sorted set keeps of a sorted head, as bits in whole words, and what it adds to it."""
    at = np.searchsorted(head, shingles)
    at[at == len(head)] = 0
    held = head[at] == shingles
    bits = np.zeros(-(-len(head) // 64) * 64, np.uint8)
    bits[at[held]] = 1
    return np.packbits(bits).tobytes(), shingles[~held].tobytes()


def _links(rows: list[tuple], left: np.ndarray, right: np.ndarray | None) -> list[tuple]:
    """(r, links, root) of the linked texts of one unit of work."""
    weight = np.array([r[2] for r in rows])
    links = np.zeros(len(rows), np.int64)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, found in Unit(rows).linked(left, right):
        links[i] += int(weight[found].sum())
        links[found] += int(weight[i])
        for j in found.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
    least: dict[int, int] = {}
    for k, row in enumerate(rows):
        least[root(k)] = min(least.get(root(k), row[0]), row[0])
    return [(row[0], int(links[k]), least[root(k)]) for k, row in enumerate(rows) if links[k]]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and 128 bits of hash of the text."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("2"), text).alias("t2"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t1, t2, r, class_id, n_links, keep) of every row; keep marks one row's text for each class."""
    own = _keyed(docs, id_col, text_col)
    kind = own.schema["id"].dataType.simpleString()

    def sign(batch: pa.RecordBatch) -> dict:
        sizes, keys = [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            keys.append(band_keys(signature(s)) if len(s) else None)
        return {"id": batch.column(0), "t1": batch.column(2), "t2": batch.column(3), "size": sizes, "keys": keys}

    signed = staged(map_batches(own, f"id {kind}, t1 bigint, t2 bigint, size int, keys array<bigint>", sign), "signed")
    reps = staged(
        signed.filter("size > 0").groupBy("t1", "t2").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.max("size").alias("size")).withColumn("r", F.monotonically_increasing_id()),
        "texts",
    )
    same = ["t1", "t2"]
    keys = signed.filter("size > 0").join(reps.select("t1", "t2", "first_id", "r"), same).filter("id <=> first_id").select("r", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo < hi").select("key", "lo")
    ties = keys.join(buckets, "key").filter("r <> lo").select(F.col("r").alias("u"), F.col("lo").alias("v"))
    blocks = components(ties)

    # tiles: blocks of any size are cut into parts of bounded size by a hash of the text's number
    members = blocks.withColumnRenamed("v", "r").join(reps, "r")
    sized = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    tiles = F.ceil(F.greatest(F.col("n") / TILE_TEXTS, F.col("s") / TILE_SHINGLES)).cast("int")
    placed = members.join(sized, "root").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("r"), F.col("tiles")).cast("int"))
    with_text = own.join(placed.select("t1", "t2", "first_id", "root", "r", "copies", "tile", "tiles"), same).filter("id <=> first_id")
    # each text meets the head of its block once; the head goes to every tile
    meets = F.when(F.col("r") == F.col("root"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("tile"))
    met = with_text.select("root", F.explode(meets).alias("at"), "r", "copies", "tile", "tiles", (F.col("r") != F.col("root")).alias("follows"), "text").repartition("root", "at").sortWithinPartitions("root", "at", "follows")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        now, head, seen = None, np.zeros(0, np.uint64), set()
        for batch in slices(batches):
            out = []
            for (root, at, r, copies, tile, tiles, follows), shingles in zip(zip(*(c.to_pylist() for c in batch.columns[:-1])), shingle_sets(batch.column(7))):
                if (root, at) != now:
                    now, seen = (root, at), set()
                if not follows:
                    head = shingles
                if tile == at and r not in seen:  # repeated rows are one
                    seen.add(r)
                    out.append((root, r, copies, tile, tiles, len(shingles), signature(shingles).tobytes(), *against(head, shingles)))
            columns = zip(*out) if out else [[]] * 9
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["root", "r", "copies", "tile", "tiles", "size", "sig", "kept", "added"])

    schema = "root bigint, r bigint, copies bigint, tile int, tiles int, size bigint, sig binary, kept binary, added binary"
    told = staged(met.mapInArrow(describe, schema), "told")
    units = told.select("root", "r", "copies", "tile", "size", "sig", "kept", "added", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")).select(
        "root", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "r", "tile", "copies", "size", "sig", "kept", "added"
    )
    dealt = units.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        now, held, out = None, [], []

        def close() -> None:
            if held:
                side = np.array([r[1] for r in held])
                if now[1] == now[2]:
                    out.extend(_links(held, np.arange(len(held)), None))
                elif (side == now[1]).any() and (side == now[2]).any():
                    out.extend(_links(held, np.flatnonzero(side == now[1]), np.flatnonzero(side == now[2])))
                held.clear()

        def batch_out() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["r", "links", "root"])

        for batch in slices(batches):
            for root, a, b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, a, b) != now:
                    close()
                    now = (root, a, b)
                held.append(tuple(row))
            if len(out) > 4096:
                yield batch_out()
        close()
        yield batch_out()

    found = staged(dealt.mapInArrow(verify, "r bigint, links bigint, root bigint"), "links")
    classes = components(found.select(F.col("r").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"v": "r", "root": "class"})
    counted = found.groupBy("r").agg(F.sum("links").alias("links"))
    full = staged(reps.join(classes, "r", "left").join(counted, "r", "left").withColumn("class", F.coalesce("class", "r")), "classes")
    heads = full.groupBy("class").agg(F.min("first_id").alias("class_id"), F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "r"))).alias("head"), F.min("r").alias("any_r"))
    heads = staged(heads, "heads")  # as in components(): then a hot class can be split
    named = full.join(heads, "class").select(
        "t1", "t2", "r", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "first_id", (F.col("r") == F.coalesce("head.r", "any_r")).alias("is_head")
    )
    rows = signed.select("id", "t1", "t2").join(named, same, "left")
    return rows.select(
        "id", "t1", "t2", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("r").isNull(), True).otherwise(F.col("is_head") & F.col("id").eqNullSafe(F.col("first_id"))).alias("keep"),
    )


def op5_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and n_links (documents with similarity of 0.8 or more) of every document."""
    with scratch() as result:
        return result(near_classes(load(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links"))


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the least id."""
    names = ["__near_id", "__near_t1", "__near_t2"]
    with scratch() as result:
        kept = result(near_classes(docs).filter("keep").select("id", "t1", "t2").toDF(*names))
    text = F.col("text")
    keyed = docs.withColumns({"__near_a": F.xxhash64(text), "__near_b": F.xxhash64(F.lit("2"), text)})
    same = F.col("doc_id").eqNullSafe(F.col("__near_id")) & (F.col("__near_a") == F.col("__near_t1")) & (F.col("__near_b") == F.col("__near_t2"))
    out = keyed.join(kept.distinct(), same, "left_semi")
    if kept.groupBy(*names).count().filter("count > 1").limit(1).count():  # repeated rows
        out = out.dropDuplicates(["doc_id", "__near_a", "__near_b"])
    return out.drop("__near_a", "__near_b")
