"""Record kinds of traces that are still arriving (beyond the original, which is batch only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kind_counts(records: DataFrame, time: str, late: str = "10 minutes", span: str = "1 hour", trace: str = "trace", kind: str = "kind") -> DataFrame:
    """Counts by trace and kind in windows of event time; windows close when the watermark passes them."""
    return records.withWatermark(time, late).groupBy(F.window(time, span), trace, kind).agg(F.count("*").alias("cnt"))


def finished(records: DataFrame, time: str, gap: str = "30 minutes", late: str = "10 minutes", trace: str = "trace") -> DataFrame:
    """A trace is over when nothing of it has come for ``gap``: its session, number of records and whether it halted."""
    return (
        records.withWatermark(time, late).groupBy(F.session_window(time, gap), trace)
        .agg(F.count("*").alias("n"), F.bool_or(F.col("kind") == "Halt").alias("halted"))
    )
