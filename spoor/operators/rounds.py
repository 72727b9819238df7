"""Tables written between the rounds of an iteration, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where Spark runs on one machine may it be unset, for a folder under the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_rounds"
    return found.rstrip("/")


#: Tables of buckets by one column meet without a shuffle though they are joined by more columns, and are read by buckets even where only broadcasts meet them.
IN_BUCKETS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written meanwhile go with each write, not when the driver next collects its garbage."""
    with _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


class Rounds:
    """Written copies of an iteration's tables; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        self.tables: dict[int, str] = {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.log: list[dict] = []

    def keep(self, df: DataFrame, label: str, by: str | None = None, placed: bool = False) -> DataFrame:
        """``df`` written and read back: its lineage ends there, and the copy outlives any executor.

        With ``by`` it is a table of buckets: joins and groups by this column, or by more than it, of tables kept so shuffle
        nothing.  All rows of one value are read by one task, so the caller sees to it that they are few.
        ``placed`` rows are in the tasks of their buckets already, though Spark may not know.
        """
        unique = uuid.uuid4().hex
        path = f"{self.base}/{len(self.log)}-{label}-{unique}"
        if by is None:
            with cleaned(self.spark):
                df.write.parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        else:
            with cleaned(self.spark), _settings(self.spark, IN_BUCKETS):
                # which Spark leaves out where the rows come from tables of these buckets
                dealt = df if placed else df.repartition(self.buckets, by)
                dealt.write.bucketBy(self.buckets, by).sortBy(by).option("path", path).option("compression", "zstd").saveAsTable(f"rounds_{unique}")
            out = self.spark.read.table(f"rounds_{unique}")
            self.tables[id(out)] = f"rounds_{unique}"
        self.paths[id(out)] = (out, path)
        return out

    def note(self, **what) -> None:
        """Tell what a round did."""
        self.log.append(what)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if found := self.paths.pop(id(table), None):
                if name := self.tables.pop(id(table), None):
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                self._delete(found[1])

    def close(self, *but: DataFrame) -> None:
        """Drop all tables except the results."""
        self.drop(*(t for t, _ in list(self.paths.values()) if all(t is not b for b in but)))

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` written, and all other tables dropped."""
        out = self.keep(df, "result")
        self.close(out)
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
