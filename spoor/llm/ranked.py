"""Exact ranked lexical search with variable-block-max WAND.

Index.  Every task turns the documents it reads into shards of a bounded number of postings.
In a shard a term's documents ascend, and dynamic programming cuts its list into blocks: of all
ways to cut it into blocks of up to MAX_BLOCK postings it takes one that minimises the sum of
bound errors (the block's largest impact less each posting's) and BLOCK_COST a block.  A shard
is one row of arrays, so a search needs nothing but that row.  A task holds one shard at a time, whatever it
reads: a file has one, and they reach Python one by one.

Search.  WAND's test, whether the bounds of the terms at a place reach the threshold, changes only
at block ends.  So for one item and shard the bounds of all blocks are added up over the ranges they
cover, which tells it for every document at once; no pivot is met one by one.  The documents of
the largest bounds are scored first and set the threshold; then every block without a document whose
bound reaches the threshold is skipped, the rest is read and scored exactly.  A document
whose bound equals the threshold is scored, as it may win by its id.  The threshold goes on
from shard to shard of a task, which returns the best of each item alone.

Items go to the tasks in groups of up to MAX_ITEM_BYTES of terms, one search after another, so
a table of items may have any size.

Defined cases: a null or wordless text has no terms and is in no result, nor counted in N; an item
without terms, or of terms that no document has, has no rows; items that share an id are
ranked each for itself; documents that share an id (null ones last) are ranked each for itself; an empty table gives
no rows; a very long text is indexed as a whole; columns other than id and text are not read,
so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spoor.llm.common import give_back, load, map_batches, one_by_one, running, scratch, slices, staged
from spoor.llm.decontam import _TABLE
from spoor.llm.words import blocks, bounds, hashes

TOP = 20
#: Postings of a shard; one document more may be above it.
SHARD = 1 << 20
#: Shards of a file: its writer and its reader hold all of them, as rows so few are one row group and one batch.
SHARDS_A_FILE = 1
#: Largest block, and what a block costs in units of the impact of bound errors.
MAX_BLOCK, BLOCK_COST = 64, 2_000_000
#: Lists that are cut at once.
LISTS = 4096
#: Bytes of the terms of items that are searched for at once (16 a term of an item).
MAX_ITEM_BYTES = 64 << 20
_LOWER = np.frombuffer(_TABLE, np.uint8)
#: Sums below are exact in doubles.
_EXACT = 1 << 53


def terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of some texts after others: the hashes of their terms, and for each text (and the end) the number of its first."""
    for _, _, data, offsets in blocks(column):
        data = _LOWER[data]
        starts, ends, rows = bounds(data, offsets)
        yield hashes(data, starts, ends), rows


def counted(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the distinct terms of each text."""
    of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((codes, of))
    codes, of = codes[order], of[order]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    return of[at], codes[at], np.diff(np.append(at, len(codes)))


def norms(n: np.ndarray, total: int, length: int) -> np.ndarray:
    """m of documents of n terms, of ``total`` documents with ``length`` terms."""
    if int(n.max(initial=0)) * 25 * total >= 1 << 63:
        return np.array([75 + 25 * int(x) * total // length for x in n], np.int64)
    return 75 + 25 * n.astype(np.int64) * total // length


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def cut(lists: np.ndarray, impact: np.ndarray, most: int = MAX_BLOCK, cost: float = BLOCK_COST) -> np.ndarray:
    """Ends (in all postings) of the blocks that minimise bound errors and costs of blocks.

    ``lists`` are the places where lists begin, and the end.  All lists advance by one posting at
    a time: of the last ``most`` possible starts of a block that ends here the cheapest is kept.
    """
    order = np.argsort(-np.diff(lists), kind="stable")
    firsts, sizes = lists[:-1][order], np.diff(lists)[order]
    back = np.ones(int(lists[-1]), np.int16)  # right for lists of one posting
    for at in range(0, int(np.searchsorted(-sizes, -1, "left")), LISTS):
        _cut_some(firsts[at : at + LISTS], sizes[at : at + LISTS], impact, min(most, int(sizes[at])), cost, back)
    ends, at = [], lists[1:][np.diff(lists) > 0]
    low = lists[:-1][np.diff(lists) > 0]
    while len(at):
        ends.append(at)
        at = at - back[at - 1]
        stay = at > low
        at, low = at[stay], low[stay]
    return np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)


def _cut_some(firsts: np.ndarray, sizes: np.ndarray, impact: np.ndarray, most: int, cost: float, back: np.ndarray) -> None:
    """Lengths of the best blocks that end at each posting of some lists, the longest first."""
    n = len(sizes)
    best = np.full((n, most), np.inf)  # cost of the lists' first postings up to each possible start, the nearest first
    best[:, 0] = 0
    high = np.zeros((n, most))  # the largest impact from each possible start to here
    length = np.arange(1, most + 1, dtype=float)
    for j in range(int(sizes[0])):
        alive = int(np.searchsorted(-sizes, -j, "left"))  # lists longer than j
        g = impact[firsts[:alive] + j].astype(float)
        h, b = high[:alive], best[:alive]
        h[:, 1:] = h[:, :-1].copy()
        h[:, 0] = 0
        np.maximum(h, g[:, None], out=h)
        total = h * length
        total += b
        pick = total.argmin(1)
        back[firsts[:alive] + j] = pick + 1
        b[:, 1:] = b[:, :-1].copy()
        # errors are the blocks' maxima less the impacts, whose sum is the same for every cut
        b[:, 0] = total[np.arange(alive), pick] + cost


SHARD_SCHEMA = "ids array<{kind}>, m array<bigint>, terms array<bigint>, firsts array<int>, docs array<int>, tf array<int>, ends array<int>, high array<int>"


def _shard(parts: list[tuple], ids: list, n: list, total: int, length: int) -> dict:
    """The arrays of one shard of (text, term, times)."""
    of, codes, tf = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((of, codes))
    of, codes, tf = of[order], codes[order], tf[order]
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    firsts = np.append(at, len(codes))
    m = norms(np.array(n, np.int64), total, length)
    g = impacts(tf, m[of])
    ends = cut(firsts, g)
    high = np.maximum.reduceat(g, np.concatenate(([0], ends[:-1]))) if len(ends) else g
    return {"ids": ids, "m": m, "terms": codes[at].view(np.int64), "firsts": firsts, "docs": of, "tf": tf, "ends": ends, "high": high}


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", postings: int = SHARD) -> tuple[DataFrame, int]:
    """(shards, N): the index of all rows, and the number of documents with terms."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        texts = words = 0
        for batch in slices(batches):
            for _, _, data, offsets in blocks(batch.column(0)):
                n = np.diff(bounds(_LOWER[data], offsets)[2])
                texts, words = texts + int(np.count_nonzero(n)), words + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([texts]), pa.array([words])], names=["texts", "words"])

    total, length = (x or 0 for x in own.select("text").mapInArrow(lengths, "texts bigint, words bigint").agg(F.sum("texts"), F.sum("words")).first())
    schema = SHARD_SCHEMA.format(kind=own.schema["id"].dataType.simpleString())
    target = to_arrow_schema(_parse_datatype_string(schema))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        parts, ids, n, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal held
            made = _shard(parts, list(ids), n, total, length)
            parts.clear(), ids.clear(), n.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) for f in target], schema=target)

        for batch in slices(batches):
            names, row = batch.column(0).to_pylist(), 0
            for codes, rows in terms(batch.column(1)):
                of, term, times = counted(codes, rows)
                sizes = np.diff(rows)
                full = np.flatnonzero(sizes)  # texts without terms are no documents
                number = np.cumsum(sizes > 0) - 1 + len(ids)
                parts.append((number[of].astype(np.int32), term, times.astype(np.int32)))
                ids.extend(names[row + i] for i in full.tolist())
                n.extend(sizes[full].tolist())
                row += len(sizes)
                held += len(of)
                if held >= postings:
                    yield close()
        if ids:
            yield close()

    return staged(own.mapInArrow(index, schema), "index", SHARDS_A_FILE), total


class Shard:
    """One row of the index, ready for searches."""

    def __init__(self, ids: pa.Array, arrays: dict[str, np.ndarray]):
        self.ids, self.__dict__ = ids, {**arrays, "ids": ids}
        self.codes = self.terms.view(np.uint64)
        self.impact = impacts(self.tf, self.m[self.docs])
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.low, self.top = self.docs[self.starts], self.docs[self.ends - 1] + 1  # documents that a block covers
        self.block_of = np.searchsorted(self.ends, self.firsts[:-1], "right")
        self.block_of = np.append(self.block_of, len(self.ends))

    def search(self, codes: np.ndarray, weights: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (and scores) among which are all that belong to the best ``top`` of those with scores of ``least`` or more."""
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        there = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        at, weights = at[there], weights[there]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        block, of = _ranges(self.block_of[at], self.block_of[at + 1])
        w = weights[of]
        n = len(self.m)
        whole = int(weights.sum()) * int(self.high.max()) >= _EXACT
        bound = np.cumsum(_sums(self.low[block], w * self.high[block], n + 1, whole) - _sums(self.top[block], w * self.high[block], n + 1, whole))[:n]
        done = np.zeros(n, bool)
        docs, scores = [], []
        want = 8 * top
        if n > 4 * want:  # the most promising first
            some = bound >= max(np.partition(bound, n - want)[n - want], 1)
            docs.append(np.flatnonzero(some))
            scores.append(self._scores(block, w, some, n, whole)[docs[-1]])
            done |= some
            if len(scores[-1]) >= top:
                least = max(least, int(np.partition(scores[-1], len(scores[-1]) - top)[len(scores[-1]) - top]))
        rest = (bound >= max(least, 1)) & ~done
        docs.append(np.flatnonzero(rest))
        scores.append(self._scores(block, w, rest, n, whole)[docs[-1]])
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        good = scores >= max(least, 1)
        return docs[good], scores[good]

    def _scores(self, block: np.ndarray, w: np.ndarray, want: np.ndarray, n: int, whole: bool) -> np.ndarray:
        """Scores, right for the documents that are wanted; blocks without one are skipped."""
        before = np.concatenate(([0], np.cumsum(want)))
        read = before[self.top[block]] > before[self.low[block]]
        place, of = _ranges(self.starts[block[read]], self.ends[block[read]])
        doc = self.docs[place]
        mine = want[doc]
        return _sums(doc[mine], self.impact[place[mine]] * w[read][of[mine]], n, whole)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and of which range each is."""
    sizes = (ends - starts).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts.astype(np.int64), sizes), of


def _sums(at: np.ndarray, values: np.ndarray, n: int, whole: bool) -> np.ndarray:
    """Sums of values by place; in whole numbers where doubles would round."""
    if whole:
        out = np.zeros(n, np.int64)
        np.add.at(out, at, values)
        return out
    return np.bincount(at, values, n).astype(np.int64)


class Best:
    """The best rows of one item over the shards of a task."""

    def __init__(self, top: int):
        self.top, self.rows, self.least = top, [], 1

    def add(self, scores: list[int], ids: list) -> None:
        self.rows += zip(scores, ids)
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        del self.rows[self.top :]
        if len(self.rows) == self.top:
            self.least = self.rows[-1][0]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            lists = {name: batch.column(k)[i].values for k, name in enumerate(batch.schema.names)}
            ids = lists.pop("ids")
            yield Shard(ids, {k: v.to_numpy(zero_copy_only=False) for k, v in lists.items()})


def asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a number of its own), item_id, and its distinct terms with how often each occurs."""
    own = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))

    def split(batch: pa.RecordBatch) -> dict:
        found, times = [], []
        for codes, rows in terms(batch.column(1)):
            of, term, n = counted(codes, rows)
            at = np.searchsorted(of, np.arange(len(rows)))
            found += [term[a:b].view(np.int64) for a, b in zip(at[:-1], at[1:])]
            times += [n[a:b] for a, b in zip(at[:-1], at[1:])]
        return {"item_id": batch.column(0), "terms": found, "times": times}

    kind = own.schema["item_id"].dataType.simpleString()
    return staged(map_batches(own, f"item_id {kind}, terms array<bigint>, times array<bigint>", split).filter("size(terms) > 0").withColumn("item", F.monotonically_increasing_id()), "items")


def search(shards: DataFrame, total: int, items: DataFrame, top: int = TOP) -> DataFrame:
    """item, doc_id, score: of every task the best of the items of one group (item, terms, times)."""
    held = [(r.item, np.array(r.terms, np.int64), np.array(r.times, np.int64)) for r in items.select("item", "terms", "times").collect()]
    known = np.unique(np.concatenate([t for _, t, _ in held]))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(known), np.int64)
        for batch in batches:
            for codes, firsts in zip(batch.column(0), batch.column(1)):
                codes, firsts = codes.values.to_numpy(), firsts.values.to_numpy()
                at = np.searchsorted(known, codes)
                at[at == len(known)] = 0
                mine = known[at] == codes
                df[at[mine]] += np.diff(firsts)[mine]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["place", "df"])

    with one_by_one(shards.sparkSession):
        found = shards.select("terms", "firsts").mapInArrow(frequency, "place bigint, df bigint").groupBy("place").agg(F.sum("df").alias("df")).collect()
    weight = np.zeros(len(known), np.int64)
    for place, df in found:
        weight[place] = int(1000 * log((2 * total + 2) / (2 * df + 1)))
    queries = []
    for item, codes, times in held:
        w = weight[np.searchsorted(known, codes)] * times
        queries.append((item, codes.view(np.uint64)[w > 0], w[w > 0]))
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        best = [Best(top) for _ in queries]
        for shard in _shards(batches):
            for (_, codes, w), mine in zip(queries, best):
                docs, scores = shard.search(codes, w, mine.least, top)
                if len(docs):
                    mine.add(scores.tolist(), shard.ids.take(pa.array(docs)).to_pylist())
        rows = [(item, doc, score) for (item, *_), mine in zip(queries, best) for score, doc in mine.rows]
        columns = zip(*rows) if rows else ([], [], [])
        kinds = (pa.int64(), shard_kind, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    shard_kind = to_arrow_type(shards.schema["ids"].dataType.elementType)
    return shards.mapInArrow(run, f"item bigint, doc_id {kind}, score bigint")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", bytes_at_once: int = MAX_ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents of every item."""
    shards, total = build(docs, id_col, text_col)
    queries = running(asked(items, item_col, text_col).withColumns({"all": F.lit(0).cast("bigint"), "bytes": F.size("terms").cast("bigint") * 16}), "all", ["item"], "bytes", "at", "asked")
    last = queries.agg(F.max("at")).first()[0]
    groups = range(0 if last is None else last // bytes_at_once + 1)
    with one_by_one(docs.sparkSession):
        found = [staged(search(shards, total, group, top), "found") for g in groups if (group := queries.filter((F.col("at") / bytes_at_once).cast("bigint") == g)).limit(1).count()]
    if not found:
        kind = shards.schema["ids"].dataType.elementType.simpleString()
        found = [docs.sparkSession.createDataFrame([], f"item bigint, doc_id {kind}, score bigint")]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = rows.withColumn("rank", place).filter(F.col("rank") <= top)
    return best.join(queries.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every item of ``benchmark``."""
    with scratch() as result:
        return result(ranked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


ORACLE_OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT r, unnest(w) AS term FROM d),
c AS (SELECT r, term, count(*) AS tf FROM t GROUP BY ALL),
a AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * a.n) // a.l AS m FROM d, a WHERE len(w) > 0),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(a.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM c, a GROUP BY term),
q AS (SELECT i, item_id, unnest(w) AS term FROM i),
s AS (
  SELECT i, item_id, r, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score, any_value(doc_id) AS doc_id
  FROM q JOIN f USING (term) JOIN c USING (term) JOIN m USING (r) GROUP BY i, item_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""
