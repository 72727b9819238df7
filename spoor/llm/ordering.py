"""Training-order materialisation of token sequences.

Documents become fixed-length sequences of token ids.  A keyed Feistel network permutes
[0, 2^b), and cycle-walking (apply it again until the result is below n) makes it a
permutation of [0, n): every sequence's number gives its global slot with no sort and no
coordination.  Rows are then dealt by slot range, and each range is one file of records of
equal stride: slot s is record s % per_file of file s // per_file, at byte
(s % per_file) * stride.  A reader that knows the slot seeks there and reads on, which is all
that resuming takes.  A record is its slot (64 bits, little-endian), its ids (16 bits each)
and the line break that Spark's text writer adds.  An index table holds the documents and
the length of each slot.

The sequences are written once, and a sequence's number is its file's first number plus
its row in the file: a task that runs again cannot change it.

Defined cases: a null text is empty and gives its end id alone; a very long text is cut into
as many sequences as it fills; the last sequence of an input partition may be short and is
padded with id 0 (``n_tokens`` tells); an empty table gives no rows and no files; repeated
rows stay; ids of 16 bits or more raise; columns other than id and text are not read, so
their names cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from spoor.llm.common import give_back, load, map_batches, numbered, shared_dir
from spoor.llm.tokens import shared_encoder

LENGTH, KEY, ROUNDS = 1024, 20240607, 6
#: A file has about so many bytes.
FILE_BYTES = 64 << 20
HEAD = 8


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of x under a round key."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of the numbers ``index`` under the keyed permutation of [0, n)."""
    half = max(1, -(-max(1, n - 1).bit_length() // 2))
    low, bits = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [(key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF for r in range(1, rounds + 1)]
    x = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            a, b = x[todo] >> bits, x[todo] & low
            for k in keys:
                a, b = b, a ^ (_mix(b, k) & low)
            x[todo] = (a << bits) | b
            todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """(doc_ids, n_tokens, ids): the id streams of each input partition, cut every ``length`` ids (unsigned 16 bits)."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"doc_ids array<{own.schema['id'].dataType.simpleString()}>, n_tokens int, ids binary"
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = shared_encoder(tokenizer)
        if encoder.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        held, members, rows = np.zeros(0, "<u2"), [], []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)
            rows.clear()
            return batch

        for batch in batches:
            keys = batch.column(0)
            for a, b, ids, offsets in encoder.column(batch.column(1)):
                stream = np.concatenate([held, ids.astype("<u2")])
                stops = offsets[1:] + len(held)  # of the documents in the stream
                names = keys[a:b].to_pylist()
                for at in range(0, len(stream) - length + 1, length):
                    lo, hi = np.searchsorted(stops, [at, at + length - 1], "right").tolist()
                    rows.append(((members if at == 0 else []) + names[lo : hi + 1], length, stream[at : at + length].tobytes()))
                whole = len(stream) // length * length
                members = (members if not whole else []) + names[int(np.searchsorted(stops, whole, "right")) :]
                held = stream[whole:].copy()
                if len(rows) >= 1024:
                    yield out()
        if len(held):
            rows.append((members, len(held), held.tobytes() + b"\0\0" * (length - len(held))))
        if rows:
            yield out()

    return own.mapInArrow(run, schema)


@dataclass(frozen=True)
class Shards:
    """A folder of shard files and the index of their slots."""

    folder: str
    slots: int
    per_file: int
    stride: int
    index: DataFrame  # (slot, doc_ids, n_tokens)


def materialise(seqs: DataFrame, key: int = KEY, length: int = LENGTH, file_bytes: int = FILE_BYTES) -> Shards:
    """Write the shard files, one for each range of slots."""
    spark = seqs.sparkSession
    rows, n = numbered(seqs, "number", "sequences")

    @F.pandas_udf("bigint")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, key))

    stride = HEAD + 2 * length + 1
    parts = max(1, -(-n * stride // file_bytes))
    per_file = max(1, -(-n // parts))

    def squeezed(batch: pa.RecordBatch) -> dict:  # what is exchanged
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return {"slot": permute(batch.column(0).to_numpy(), n, key), "ids": [squeeze(x) for x in batch.column(1).to_pylist()]}

    slotted = map_batches(rows.select("number", "ids"), "slot bigint, ids binary", squeezed)
    dealt = slotted.repartitionById(parts, F.floor(F.col("slot") / per_file).cast("int")).sortWithinPartitions("slot")

    def record(batch: pa.RecordBatch) -> dict:
        opened = zstandard.ZstdDecompressor().decompress
        return {"record": [slot.to_bytes(HEAD, "little") + opened(x) for slot, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]}

    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    map_batches(dealt, "record binary", record).select(F.col("record").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").text(folder)
    return Shards(folder, n, per_file, stride, rows.select(slot_of("number").alias("slot"), "doc_ids", "n_tokens"))


def read_from(spark: SparkSession, shards: Shards, slot: int = 0) -> DataFrame:
    """Records from ``slot`` on as the files hold them: (slot, shard, offset, ids). Files before it are not opened."""
    per_file, stride, paths = shards.per_file, shards.stride, shards.folder
    schema = "slot bigint, shard bigint, offset bigint, ids binary"
    if not shards.slots or slot >= shards.slots:
        return spark.createDataFrame([], schema)
    if slot >= per_file:
        number = F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("bigint")
        paths = ",".join(r["path"] for r in spark.read.format("binaryFile").load(shards.folder).filter(number >= slot // per_file).select("path").collect())

    def rows(records: Iterator[bytes]) -> Iterator[tuple]:
        for r in records:
            at = int.from_bytes(r[:HEAD], "little")
            if at >= slot:
                yield at, at // per_file, at % per_file * stride, r[HEAD : stride - 1]

    return spark.createDataFrame(spark.sparkContext.binaryRecords(paths, stride).mapPartitions(rows), schema)


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as the files hold it: its slot, place, documents and the crc32 of its stored ids."""
    shards = materialise(sequences(load(spark, sf_dir, "documents")))
    stored = read_from(spark, shards).select("slot", "shard", "offset", F.crc32("ids").alias("ids_crc32"))
    return stored.join(shards.index, "slot").select("slot", "shard", "offset", F.col("n_tokens").cast("bigint").alias("n_tokens"), "doc_ids", "ids_crc32")
