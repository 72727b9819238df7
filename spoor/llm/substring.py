"""Substring deduplication by level-wise doubling.

A window is ``window`` consecutive words of one document.  The levels are lengths that double
up to it.  Below the last, of the windows of a length inside each window of twice that length
only the one with the least hash (the leftmost of equals) is exchanged, which equal windows
choose alike.  Only where such a window occurs more than once is it extended to twice its
length; a level without survivors ends the search.  Windows of full length are exchanged all,
and of each the first occurrence (by document id, then start) is told to its document.
Longer repeats are unions of full windows, so no candidate of a further doubling could
change which words go.  Words covered by a candidate window that is not the first of its
kind are removed.

Beyond the first level equal texts take part once, under their least id: every full window of a further copy also
starts in the first one, so all its words go (texts shorter than a window have none).

Defined cases: a null or wordless text has no words; null ids come last and count as one id;
of rows that share an id none is earlier than another but by the start of a window; an empty
table gives no rows; a very long text is worked on as a whole, of up to 2^27 words;
columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import discard, load, map_batches, numbered, scratch, staged
from spoor.llm.words import blocks, bounds, hashes, text_column

WINDOW = 20
START_BITS, TAG_BITS = 27, 31
#: The first level has at least so many words.
LEAST = 8
_P = np.uint64(0x9E3779B97F4A7C15)


def levels(window: int) -> list[int]:
    """Lengths that double up to ``window``; an odd length is not halved."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= LEAST:
        out.insert(0, out[0] // 2)
    return out


def windows(codes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` words, built by doubling."""
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    # powers[k] hashes runs of 2^k words; a size is a sum of such runs
    run, length, out, done = codes ^ np.uint64(seed), 1, None, 0
    while True:
        if size & length:
            part = run[done:]
            if out is None:
                out = part.copy()
            else:
                n = min(len(out), len(part))
                out = _join(out[:n], part[:n])
            done += length
        length *= 2
        if length > size:
            break
        run = _join(run[: len(run) - length // 2], run[length // 2 :])
    return out[: len(codes) - size + 1]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _P) ^ (a >> np.uint64(32))
    h = (h + b) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Block:
    """The words of some rows of text, one row after another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.rows = bounds(data, offsets)
        if np.diff(self.rows).max(initial=0) >> START_BITS:
            raise ValueError("a document has too many words")
        self.codes = hashes(data, self.starts, self.ends)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, at, "right") - 1

    def fits(self, size: int) -> np.ndarray:
        """Starts of the runs of ``size`` words that stay in their row."""
        lo, hi = self.rows[:-1], self.rows[1:] - size + 1
        return np.flatnonzero(_covered(len(self.codes), lo[hi > lo], hi[hi > lo]))

    def choice(self, size: int, fits: np.ndarray) -> np.ndarray:
        """For each run of twice ``size`` words at ``fits`` the place of its least window of ``size`` words, the leftmost of equals."""
        if not len(fits):
            return fits
        h = windows(self.codes, size)
        least, at = h[fits], np.zeros(len(fits), np.int64)
        for i in range(1, size + 1):
            other = h[fits + i]
            less = other < least
            least[less], at[less] = other[less], i
        return fits + at

    def candidates(self, length: int, places: pa.ListArray | None) -> np.ndarray:
        """Starts of the windows of ``length`` whose chosen half is at one of ``places`` of their row; of all windows without places."""
        fits = self.fits(length)
        if places is None:
            return fits
        row, at = _spread(places)
        inside = at < np.diff(self.rows)[row]  # texts that share a hash share their places
        flag = np.zeros(len(self.codes), bool)
        flag[(self.rows[row] + at)[inside]] = True
        return fits[flag[self.choice(length // 2, fits)]]

    def tags(self, at: np.ndarray, size: int) -> np.ndarray:
        """A second hash of the windows at ``at``."""
        return (windows(self.codes, size, seed=0x5BD1E995)[at] >> np.uint64(64 - TAG_BITS)).astype(np.int64)


def _covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n places the ranges cover."""
    steps = np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows at ``starts`` cover."""
    return _covered(n, starts, starts + window)


def _spread(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element of lists; a null list is empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, pa.Array], Block]]:
    """The other columns and the words of some rows after others."""
    for a, b, data, offsets in blocks(batch.column(batch.schema.get_field_index("text"))):
        yield {n: batch.column(i).slice(a, b - a) for i, n in enumerate(batch.schema.names) if n != "text"}, Block(data, offsets)


def _one(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("2"), text).alias("t2"))


def _survivors(source: DataFrame, length: int) -> DataFrame:
    """(t1, places): where the chosen windows of ``length`` that occur more than once are, by text.

    ``source`` has t1, text and, beyond the first level, the places of the level before.
    """

    def chosen(batch: pa.RecordBatch) -> dict:
        hs, ts, ps = [], [], []
        for columns, block in _blocks(batch):
            at = np.unique(block.choice(length, block.fits(2 * length)))
            if "places" in columns:
                at = np.intersect1d(at, block.candidates(length, columns["places"]))
            row = block.row_of(at)
            hs.append(windows(block.codes, length)[at] if len(at) else np.zeros(0, np.uint64))
            ts.append(columns["t1"].to_numpy(zero_copy_only=False)[row])
            ps.append(at - block.rows[row])
        return {"h": _one(hs, np.uint64).view(np.int64), "t1": _one(ts, np.int64), "place": _one(ps, np.int32)}

    alone = map_batches(source, "h bigint", chosen)
    # written before it is joined: a join of two plain exchanges is one that Spark can split where a window is hot
    repeated = staged(alone.groupBy("h").count().filter("count > 1").select("h"), "repeated")
    places = map_batches(source, "h bigint, t1 bigint, place int", chosen)
    out = staged(places.join(repeated, "h", "left_semi").groupBy("t1").agg(F.collect_set("place").alias("places")), "candidates")
    discard(repeated)
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(t1, t2, first_id, places, firsts) of every text.

    ``places`` are those of the last level below ``window`` (null if there is no such level);
    ``firsts`` are starts of first windows of the text, each with a tag of its window in the low bits.
    A first window is known by its id's number and its start.  That names its text where an
    id has one; where it has several (null ids, shared ids) their windows are held against the first ones
    of their kind, so no text is told of more windows than it has.
    """
    own = _keyed(docs, id_col, text_col)
    per_text = own.groupBy("t1", "t2").agg(F.min("id").alias("first_id"))
    ids, _ = numbered(per_text.select(F.col("first_id").alias("of")).distinct().orderBy(F.asc_nulls_last("of")), "o", "ids")
    texts = staged(per_text.join(ids, F.col("first_id").eqNullSafe(F.col("of"))).drop("of"), "texts")
    several = staged(texts.groupBy("o").count().filter("count > 1").select("o", F.lit(True).alias("several")), "several")
    texts = staged(texts.join(several, "o", "left").withColumn("several", F.coalesce("several", F.lit(False))), "texts")
    none = texts.withColumn("places", F.lit(None).cast("array<int>"))
    told, source, steps = none, own.select("t1", "text"), levels(window)

    def reps(told: DataFrame) -> DataFrame:
        return own.join(told, ["t1", "t2"]).filter("id <=> first_id").select("t1", "o", "several", "places", "text")

    for length in steps[:-1]:
        found = _survivors(source.drop("o", "several"), length)
        if not found.limit(1).count():  # so no longer window repeats
            return none.withColumn("firsts", F.lit(None).cast("array<bigint>")).drop("o", "several")
        told = texts.join(found, "t1", "left")
        source = reps(told.filter("places is not null"))
    if len(steps) == 1:
        source = reps(none).drop("places")

    def extend(batch: pa.RecordBatch) -> dict:
        hs, gs, cs, ts = [], [], [], []
        for columns, block in _blocks(batch):
            at = block.candidates(window, columns.get("places"))
            if not len(at):
                continue
            row = block.row_of(at)
            hs.append(windows(block.codes, window)[at])
            gs.append(block.tags(at, window))
            cs.append((columns["o"].to_numpy(zero_copy_only=False)[row] << START_BITS) + at - block.rows[row])
            ts.append(columns["t1"].to_numpy(zero_copy_only=False)[row])
        return {"h": _one(hs, np.uint64).view(np.int64), "g": _one(gs, np.int32), "code": _one(cs, np.int64), "t1": _one(ts, np.int64)}

    schema = "h bigint, g int, code bigint, t1 bigint"
    first = map_batches(source.drop("several"), schema, extend).groupBy("h", "g").agg(F.min("code").alias("code"))
    some = not several.isEmpty()
    first = staged(first, "first") if some else first
    start = F.col("code").bitwiseAND((1 << START_BITS) - 1)
    tagged = (F.shiftleft(start, TAG_BITS) + F.col("g")).alias("first")
    per_id = first.select(F.shiftright("code", START_BITS).alias("o"), tagged)
    firsts = staged(per_id.join(several, "o", "left_anti").groupBy("o").agg(F.collect_list("first").alias("firsts")), "firsts")
    told = told.join(firsts, "o", "left")
    if some:
        held = map_batches(source.filter("several").drop("several"), schema, extend).join(first, ["h", "g", "code"], "left_semi")
        shared = staged(held.select("t1", tagged).groupBy("t1").agg(F.collect_set("first").alias("shared")), "shared")
        told = told.join(shared, "t1", "left").withColumn("firsts", F.coalesce("firsts", "shared"))
    return told.select("t1", "t2", "first_id", "places", "firsts")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """id, n_words, removed [(start, stop)] in word places, and the kept text (words joined by one space) of every row."""
    own = _keyed(docs, id_col, text_col)
    told = repeats(docs, id_col, text_col, window)
    rows = own.join(told, ["t1", "t2"], "left").select("id", "text", F.col("id").eqNullSafe(F.col("first_id")).alias("first"), "places", "firsts")
    whole = len(levels(window)) == 1

    def columns(batch: pa.RecordBatch) -> dict:
        n_words, n_removed, removed, kept = [], [], [], []
        for found, block in _blocks(batch):
            n, sizes = len(block.codes), np.diff(block.rows)
            at = block.candidates(window, None if whole else found["places"])
            later = at
            if len(at):
                row, first = _spread(found["firsts"])
                told_at = (block.rows[row] << TAG_BITS) + first  # a first is its start and its tag
                later = at[~np.isin((at << TAG_BITS) + block.tags(at, window), told_at)]
            gone = covered(n, later, window)
            copy = ~found["first"].to_numpy(zero_copy_only=False).astype(bool)
            gone |= np.repeat(copy & (sizes >= window), sizes)
            totals = np.concatenate(([0], np.cumsum(gone)))[block.rows]
            n_words.append(sizes)
            n_removed.append(np.diff(totals))
            removed.append(_runs(gone, block.rows))
            kept.append(_kept(block, ~gone))
        return {
            "id": batch.column(0), "n_words": _one(n_words, np.int64), "n_removed": _one(n_removed, np.int64),
            "removed": pa.concat_arrays(removed) if removed else [], "kept": pa.concat_arrays(kept) if kept else [],
        }

    schema = f"id {own.schema['id'].dataType.simpleString()}, n_words bigint, n_removed bigint, removed array<struct<start:bigint,stop:bigint>>, kept string"
    return map_batches(rows, schema, columns).withColumnRenamed("id", id_col)


def _runs(flag: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """Runs of flagged words in each row, as (start, stop) in the row."""
    edge = np.zeros(len(flag) + 1, bool)
    edge[rows] = True
    edge[1:-1] |= flag[1:] != flag[:-1]
    starts, stops = np.flatnonzero(flag & edge[:-1]), np.flatnonzero(flag & edge[1:]) + 1
    base = rows[np.searchsorted(rows, starts, "right") - 1]
    spans = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(stops - base, pa.int64())], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, rows), pa.int32()), spans)


def _kept(block: Block, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    at = np.flatnonzero(keep)
    row = block.row_of(at)
    more = np.zeros(len(at), bool)  # another kept word of the row follows: a white space byte stands between
    more[:-1] = row[1:] == row[:-1]
    starts, stops = block.starts[at], block.ends[at] + more
    data = block.data.copy()
    data[block.ends[at][more]] = 32
    sizes = np.bincount(row, stops - starts, minlength=len(block.rows) - 1).astype(np.int64)
    return text_column(data[_covered(len(data), starts, stops)], np.concatenate(([0], np.cumsum(sizes))))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as result:
        return result(deduplicate(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


ORACLE_OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT row_id, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j, len(w) AS n FROM d),
x AS (
  SELECT row_id, doc_id, j, n, string_agg(word, ' ') OVER (PARTITION BY row_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM v),
p AS (SELECT row_id, j, rank() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, j) AS place FROM x WHERE j <= n - 19),
c AS (SELECT DISTINCT row_id, unnest(range(j, j + 20)) AS j FROM p WHERE place > 1),
k AS (SELECT row_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM v ANTI JOIN c USING (row_id, j) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (row_id)
"""
