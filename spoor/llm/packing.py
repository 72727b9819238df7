"""Packing of examples into sequences under several limits at once.

Vector bin packing: an example asks for tokens, for one segment and for loss-bearing
tokens.  One sequence is open at a time; of the examples at hand that fit, the one with the
largest dot product of its demand and the room left goes in.  If none fits, the longest is
cut to fill what is left.  Whatever cannot fill a sequence is cut down to a power of two,
which needs no padding, and the rest goes back to the pool.

Every partition of the input packs its own rows in one pass: no shuffle, and a pool of
bounded size.  Sequence ids are the partition's number and a counter, so a task that runs
again gives the same rows.

Defined cases: a null text is empty and is the end id alone; repeated rows are packed one
by one, ties go to the example that came first; a very long text is cut into as many
sequences as it fills and its ids alone are held; an empty table gives no rows; columns other
than id, text and those of ``loss`` are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm.common import give_back, load
from spoor.llm.tokens import shared_encoder


@dataclass(frozen=True)
class Limits:
    """Room of a sequence."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


@dataclass
class Example:
    """``tokens`` ids of which the last ``loss`` bear loss; ``start`` have been placed."""

    key: object
    tokens: int
    loss: int
    start: int = 0

    def left(self) -> int:
        return self.tokens - self.start

    def loss_in(self, size: int) -> int:
        """Loss-bearing ids among the next ``size``."""
        return max(0, self.start + size - max(self.start, self.tokens - self.loss))

    def most(self, tokens: int, loss: int) -> int:
        """The longest next piece within both limits."""
        free = max(0, self.tokens - self.loss - self.start)
        return min(self.left(), tokens, free + loss)


Piece = tuple[Example, int, int]  # example, start, length


class Packer:
    """Takes examples one by one and gives whole sequences (lists of pieces)."""

    def __init__(self, limits: Limits = Limits(), pool: int = 512):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("every limit must be positive")
        self.limits, self.size = limits, pool
        self.room = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.pool: list[Example] = []
        self.need = np.zeros((pool + 1, 3))  # of each example in the pool

    def add(self, example: Example) -> Iterator[list[Piece]]:
        cap = min(self.limits.tokens, self.limits.loss) if example.loss else self.limits.tokens
        while cap == self.limits.tokens and example.left() >= cap:  # a part that fills a sequence alone
            yield [(example, example.start, cap)]
            example.start += cap
        if example.left():
            self.need[len(self.pool)] = example.left(), 1, example.loss_in(example.left())
            self.pool.append(example)
        while len(self.pool) >= self.size:
            yield self._sequence()

    def finish(self) -> Iterator[list[Piece]]:
        while self.pool:
            yield self._sequence()

    def _sequence(self) -> list[Piece]:
        need = self.need[: len(self.pool)]
        weight = need.mean(0) / self.room**2  # scarce dimensions count more
        room, pieces, picks, unused = self.room.copy(), [], [], np.ones(len(need), bool)
        while room[0] >= 1 and room[1] >= 1:
            fits = (need <= room).all(1) & unused
            # the last segment goes to a cut that fills the sequence, if there is one
            if room[1] == 1 and room[0] > need[fits, 0].max(initial=0):
                fits[:] = False
            if fits.any():
                pick = int(np.where(fits, need @ (weight * room), -1).argmax())
                size = int(need[pick, 0])
            else:
                free = np.where(unused, need[:, 0], 0)
                pick = int(free.argmax())
                size = self.pool[pick].most(int(room[0]), int(room[2])) if free[pick] else 0
                if not size:
                    others = [i for i in np.flatnonzero(unused) if self.pool[i].most(int(room[0]), int(room[2]))]
                    if not others:
                        break
                    pick = others[0]
                    size = self.pool[pick].most(int(room[0]), int(room[2]))
            e = self.pool[pick]
            room -= (size, 1, e.loss_in(size))
            pieces.append((e, e.start, size))
            e.start += size
            unused[pick] = False
            picks.append(pick)
        self._trim(pieces)
        for i in picks:
            e = self.pool[i]
            need[i] = e.left(), 1, e.loss_in(e.left())
        stay = need[:, 0] > 0
        kept = need[stay]
        self.need[: len(kept)] = kept
        self.pool = [e for e, s in zip(self.pool, stay.tolist()) if s]
        return pieces

    def _trim(self, pieces: list[Piece]) -> None:
        """Cut what does not fill the sequence down to a power of two."""
        total = sum(n for _, _, n in pieces)
        extra = 0 if total == self.limits.tokens else total - (1 << total.bit_length() - 1)
        while extra:
            e, start, n = pieces.pop()
            kept = max(0, n - extra)
            e.start -= n - kept
            extra -= n - kept
            if kept:
                pieces.append((e, start, kept))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), tokenizer: str | None = None, pool: int = 512, loss: Column | None = None
) -> DataFrame:
    """One row for each piece.

    ``loss`` says of each row whether its ids bear loss, such as ``col("role") == "assistant"``
    of turns; null is no.  Without it all ids do, and the third limit cannot bind before the first.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(True).alias("loss") if loss is None else F.coalesce(loss, F.lit(False)).alias("loss"))
    schema = (
        f"{id_col} {own.schema['id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, sequence_tokens bigint, loss_tokens bigint"
    )
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder, packer = shared_encoder(tokenizer), Packer(limits, pool)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        rows: list[tuple] = []

        def note(sequences: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset, total = 0, sum(n for _, _, n in pieces)
                for e, start, n in pieces:
                    key, ids = e.key
                    rows.append((key, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), e.tokens, sequence, offset, total, n if e.loss else 0))
                    offset += n
                sequence += 1

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)
            rows.clear()
            return batch

        for batch in batches:
            keys = batch.column(0)
            for a, b, ids, offsets in encoder.column(batch.column(1)):
                raw, ends = ids.astype("<u4").tobytes(), (4 * offsets).tolist()
                for key, bears, p, q in zip(keys[a:b].to_pylist(), batch.column(2)[a:b].to_pylist(), ends, ends[1:]):
                    note(packer.add(Example((key, raw[p:q]), (q - p) // 4, (q - p) // 4 if bears else 0)))
                if len(rows) >= 8192:
                    yield out()
        note(packer.finish())
        if rows:
            yield out()

    return own.mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: one row for each piece."""
    return pack(docs)
