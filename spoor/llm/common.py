"""Shared plumbing of the corpus operators: staged tables, Arrow maps and folds."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster.  Only in a session of a single machine
    (a test) one under the warehouse is used where that is unset.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return found.rstrip("/")


#: Spark removes the shuffle files of a query when it ends, rather than when the driver next collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Spark hands to Python at once.
AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Paths that open scratches will remove, the innermost last.
_OPEN: list[list[str]] = []


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def cleaned(spark: SparkSession) -> AbstractContextManager[None]:
    """The shuffle files of what is written meanwhile go with each write."""
    return _set(spark, CLEAN, "true")


def one_by_one(spark: SparkSession) -> AbstractContextManager[None]:
    """What runs meanwhile hands rows to Python one at a time, for rows of many megabytes."""
    return _set(spark, AT_ONCE, "1")


def staged(df: DataFrame, label: str, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with a copy that outlives any executor; each call has a folder of its own.
    ``rows_a_file``, unless 0, bounds the rows of a file: writer and reader may hold all rows of a file that has few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for table in tables:
        if files := table.inputFiles():
            _delete(table.sparkSession, files[0].rsplit("/", 1)[0])


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes in the end what was staged within it, but not its results, which the yielded function stages."""
    _OPEN.append([])
    results = []

    def result(df: DataFrame) -> DataFrame:
        out = staged(df, "result")
        results.append((df.sparkSession, _OPEN[-1].pop()))
        return out

    try:
        yield result
    finally:
        paths = _OPEN.pop()
        if _OPEN:
            _OPEN[-1] += [path for _, path in results]
        for spark, _ in results[:1]:
            for path in paths:
                _delete(spark, path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus


def give_back() -> None:
    """Return to the system what earlier tasks of this worker process have freed: allocators keep it, stage after stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


#: Rows that are worked on at once.
SOME_ROWS = 1024


def slices(batches: Iterator[pa.RecordBatch], rows: int = SOME_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of batches, a bounded number at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``mapInArrow`` for a function that turns one record batch into columns of equal length."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in slices(batches):
            columns = fn(batch)
            yield pa.RecordBatch.from_arrays(
                [x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in target], schema=target
            )

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def replace_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """``mapInArrow`` that keeps the schema of ``df``: ``fn`` drops rows or rewrites columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in slices(batches):
            yield fn(batch)

    return df.mapInArrow(run, df.schema)


def set_column(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    i = batch.schema.get_field_index(name)
    return batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))


#: Files of a staged table up to which their first numbers are sent to every executor.
MOST_FILES = 50_000


def numbered(df: DataFrame, name: str, label: str) -> tuple[DataFrame, int]:
    """Write ``df`` and number its rows 0, 1, ... in file order, which is sort order for a sorted ``df``; also how many.

    The number is the file's first number plus the row's place in the file; one count for each
    file is all that reaches the driver, and a task that runs again cannot change a number.
    """
    written = staged(df, label)
    rows = written.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    firsts, at = [], 0
    # by the task's number, whatever its digits
    order = lambda r: (int(re.match(r"part-(\d+)", r["_file"])[1]), r["_file"])
    for file, n in sorted(rows.groupBy("_file").count().collect(), key=order):
        firsts.append((file, at))
        at += n
    base = df.sparkSession.createDataFrame(firsts, "_file string, _first bigint")
    base = F.broadcast(base) if len(firsts) <= MOST_FILES else base
    return rows.join(base, "_file").withColumn(name, F.col("_first") + F.col("_row")).drop("_file", "_row", "_first"), at


#: Parts that rows are dealt into where a key is hot: no part holds more than 1/SPLIT of the rows and one.
SPLIT = 4096


def heavy_keys(rows: DataFrame, key: str, split: int = SPLIT) -> DataFrame:
    """(key, parts) of the keys that hold more than 1/split of the rows, so fewer than ``split`` keys."""
    total = rows.count()
    return rows.groupBy(key).count().filter(F.col("count") * split > total).select(key, F.ceil(F.col("count") * split / max(total, 1)).cast("int").alias("parts"))


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, deal: str, heavy: DataFrame) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row a key): the rows of a heavy key are dealt by ``deal`` over parts that each get its row.

    ``heavy`` has fewer than SPLIT rows whatever the input, which bounds what is broadcast and
    what is repeated; neither side of the join is broadcast.
    """
    heavy = F.broadcast(heavy)
    many = rows.join(heavy, key, "left").withColumn("_part", F.coalesce(F.pmod(F.col(deal), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    each = keyed.join(heavy, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return many.hint("merge").join(each.hint("merge"), [key, "_part"]).drop("_part")


def running(df: DataFrame, group: str, order: list[str], value: str, before: str, label: str) -> DataFrame:
    """``df`` written in the order of ``group`` (a long, never null) and ``order``, with the sum of ``value`` (long, not
    negative) over the earlier rows of its group in column ``before``.

    Rows are range-sorted, so a large group lies in many tasks.  Each task sums for itself; of a
    task only its first and last group and their sums reach the driver, to tell the next tasks
    what came before.  The order must be total but for rows that may change places.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("_local", LongType())])
    target, at_group, at_value = to_arrow_schema(schema), df.columns.index(group), df.columns.index(value)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(at_group).to_numpy(zero_copy_only=False)
            v = batch.column(at_value).to_numpy(zero_copy_only=False)
            first = np.concatenate(([True], g[1:] != g[:-1]))
            ends = np.cumsum(v)
            base = (ends - v)[first]
            if g[0] == last:
                base[0] -= total
            out = ends - v - base[np.cumsum(first) - 1]
            last, total = g[-1], int(out[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], schema=target)

    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = staged(dealt.mapInArrow(local, schema).withColumn("_task", F.spark_partition_id()), label)
    ends = rows.groupBy("_task").agg(F.min(group).alias("first"), F.max(F.struct(F.col(group).alias("g"), (F.col("_local") + F.col(value)).alias("sum"))).alias("last"))
    bases, base, past = [], 0, None
    for task, first, last in sorted(ends.collect()):
        base = base + past.sum if past is not None and past.g == first else 0
        bases.append((task, first, base))
        base, past = (base if last.g == first else 0), last
    told = F.broadcast(df.sparkSession.createDataFrame(bases, "_task int, _first bigint, _base bigint"))
    total = F.col("_local") + F.when(F.col(group) == F.col("_first"), F.col("_base")).otherwise(0)
    return rows.join(told, "_task").withColumn(before, total).drop("_task", "_first", "_base", "_local")
