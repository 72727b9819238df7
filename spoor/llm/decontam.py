"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised on their UTF-8 bytes: A-Z become a-z, every other ASCII byte that is
neither letter nor digit becomes a space, bytes from 128 on stay.  Words are what spaces
part.  Each window of ``window`` consecutive item words (a shorter item as a whole) is one
pattern; the patterns of all items are in one automaton that reads every document once.
A match is a range of word positions, and word positions are mapped back to code-point
offsets of the original text.

Defined cases: a null or wordless text has no words, no hits and empty lists; an item
without words, or with a null id, adds no pattern; repeated rows (of either table) are each
judged alone, equal item ids count once; an empty benchmark hits nothing; input columns
other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import load, map_batches, replace_rows, texts

WINDOW = 10
#: Most bytes of item text that one automaton may hold; it is checked before items reach the driver.
MAX_ITEM_BYTES = 64 << 20

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of a text."""
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> set[bytes]:
    """The patterns of one item: its windows joined by spaces."""
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


class Scanner:
    """The automaton over all items, with what a match stands for."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = WINDOW):
        found: dict[bytes, set] = {}
        for item, text in items:
            if item is not None:
                for w in windows_of(words_of(text), window):
                    found.setdefault(w, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w, ids in found.items():
            # latin-1 keeps one character for each byte, so ends are byte offsets
            self.automaton.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, frozenset(ids)))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set]:
        """Number of words, a flag for each word that is hit, and the items found."""
        words = words_of(text)
        if self.empty or not words:
            return len(words), np.zeros(len(words), bool), set()
        joined = b" " + b" ".join(words) + b" "
        matches = list(self.automaton.iter(joined.decode("latin-1")))
        steps = np.zeros(len(words) + 1, np.int32)
        items: set = set()
        if matches:
            spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
            last = np.searchsorted(spaces, [end for end, _ in matches])  # the word after the match
            for stop, (_, (n, ids)) in zip(last.tolist(), matches):
                steps[stop - n] += 1
                steps[stop] -= 1
                items |= ids
        return len(words), np.cumsum(steps[:-1]) > 0, items


def hit_spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point ranges of the original text, one for each run of hit words."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    word = np.frombuffer(raw.tobytes().translate(_TABLE), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before each byte
    runs = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in zip(runs[::2], runs[1::2])]


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", max_bytes: int = MAX_ITEM_BYTES) -> list[tuple]:
    """The items on the driver, once their size is known to be within ``max_bytes``."""
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text, one automaton takes {max_bytes}: pass it in parts")
    return [tuple(r) for r in benchmark.select(item_col, text_col).distinct().collect()]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row for each document: id, n_words, n_hit, items (sorted as strings), spans [(start, end)].

    No shuffle: the automaton goes to the executors with the task, documents stay where they are.
    """
    items = benchmark_items(benchmark, item_col, item_text_col)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = own.schema["id"].dataType.simpleString()
    made: list[Scanner] = []

    def columns(batch):
        if not made:
            made.append(Scanner(items, window))
        out = {"id": batch.column(0), "n_words": [], "n_hit": [], "items": [], "spans": []}
        for text in texts(batch):
            n, hit, ids = made[0].scan(text)
            out["n_words"].append(n)
            out["n_hit"].append(int(hit.sum()))
            out["items"].append(sorted(map(str, ids)))
            out["spans"].append([{"start": a, "stop": b} for a, b in hit_spans(text, hit)] if ids else [])
        return out

    schema = f"id {id_type}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,stop:bigint>>"
    return map_batches(own, schema, columns).withColumnRenamed("id", id_col)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_OP8 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM p),
t AS (
  SELECT row_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT row_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
m AS (SELECT row_id, i, t.k, item_id FROM t JOIN p ON t.k = p.k AND t.win = p.win),
h AS (SELECT row_id, count(DISTINCT j) AS n_hit FROM (SELECT row_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY row_id),
q AS (
  SELECT row_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY row_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row_id) LEFT JOIN q USING (row_id)
"""


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words that benchmark windows cover out of the documents; a document left without words goes."""
    items = benchmark_items(load(spark, sf_dir, "benchmark"))
    made: list[Scanner] = []

    def clean(batch):
        from spoor.llm.common import set_column

        if not made:
            made.append(Scanner(items))
        kept, rewritten = [], []
        for text in texts(batch):
            n, hit, _ = made[0].scan(text)
            if hit.any():
                pieces, at = [], 0
                for a, b in hit_spans(text, hit):
                    pieces.append(text[at:a])
                    at = b
                text = "".join([*pieces, text[at:]])
            kept.append(not (hit.any() and hit.all()))
            rewritten.append(text)
        import pyarrow as pa

        if "n_chars" in batch.schema.names:
            batch = set_column(batch, "n_chars", [None if t is None else len(t) for t in rewritten])
        return set_column(batch, "text", rewritten).filter(pa.array(kept, pa.bool_()))

    return replace_rows(docs, clean)
