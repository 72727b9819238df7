"""Feature descriptors: typed plug-ins that say what a feature is, planned together into one scan.

A descriptor names its features and how their values come about from the rows of a set: as an aggregate under a fixed name
(``Measure``) or as a count for each key that occurs (``Counted``).  ``Plan`` puts any number of them into one
aggregation of one read, and knows the type, default and ARFF attribute of every feature.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Type(Protocol):
    """How values of a feature are written: the default where a set lacks it, and the attribute's domain."""

    default: str

    def domain(self) -> str: ...

    def legal(self, value: Column) -> Column: ...


@dataclass(frozen=True)
class Numeric:
    default: str = "0"

    def domain(self) -> str:
        return "NUMERIC"

    def legal(self, value: Column) -> Column:
        return value.try_cast("double").isNotNull()


@dataclass(frozen=True)
class Text:
    default: str = ""

    def domain(self) -> str:
        return "STRING"

    def legal(self, value: Column) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Enumerated:
    """One of some values; any other is refused."""

    values: tuple[str, ...]
    default: str = "?"

    def domain(self) -> str:
        return "{" + ",".join(self.values) + "}"

    def legal(self, value: Column) -> Column:
        return value.isin(*self.values)


@dataclass(frozen=True)
class Measure:
    """One feature with a fixed name: an aggregate over the rows of a set."""

    name: str
    value: Column
    type: Type = field(default_factory=Numeric)


@dataclass(frozen=True)
class Counted:
    """A feature for each key that occurs: how many rows of a set have it; a null key is none."""

    family: str
    keys: tuple[Column, ...]
    where: Column | None = None
    separator: str = ":"
    suffix: str = "_COUNT"
    type: Type = field(default_factory=Numeric)

    def cell(self) -> Column:
        present = self.where if self.where is not None else F.lit(True)
        for k in self.keys:
            present = present & k.isNotNull()
        return F.when(present, F.concat(F.lit(f"{self.family}_"), F.concat_ws(self.separator, *(k.cast("string") for k in self.keys)), F.lit(self.suffix)))


class Plan:
    """Descriptors by the order in which they were registered; a name may be registered once."""

    def __init__(self, set_id: str, descriptors: Sequence[Measure | Counted] = ()):
        self.set_id, self.measures, self.counted = set_id, [], []
        for d in descriptors:
            self.register(d)

    def register(self, descriptor: Measure | Counted) -> Plan:
        """Add a plug-in."""
        if isinstance(descriptor, Measure):
            if any(m.name == descriptor.name for m in self.measures):
                raise ValueError(f"{descriptor.name} is registered twice")
            self.measures.append(descriptor)
        else:
            self.counted.append(descriptor)
        return self

    def features(self, rows: DataFrame) -> DataFrame:
        """(set_id, name, value as text, type) of every feature of every set, from one read of ``rows``.

        A row becomes one row for the measures and one for each of its keys; both kinds meet in one aggregation by set and
        name, which Spark begins where the rows are.
        """
        cells = [F.lit(None).cast("string"), *(c.cell() for c in self.counted)]
        spread = rows.select("*", F.posexplode(F.array(*cells)).alias("_at", "_name")).filter("_at = 0 OR _name IS NOT NULL")
        # rows without a name are each row once: their group has the measures
        measured = [m.value.cast("string").alias(f"_m{i}") for i, m in enumerate(self.measures)]
        found = spread.groupBy(self.set_id, "_name").agg(F.count("*").alias("_n"), *measured)
        counts = found.filter("_name IS NOT NULL").select(self.set_id, F.col("_name").alias("name"), F.col("_n").cast("string").alias("value"), F.lit("NUMERIC").alias("type"))
        fixed = [F.struct(F.lit(m.name).alias("name"), self._checked(m, F.col(f"_m{i}")).alias("value"), F.lit(m.type.domain()).alias("type")) for i, m in enumerate(self.measures)]
        if not fixed:
            return counts
        return found.filter("_name IS NULL").select(self.set_id, F.inline(F.array(*fixed))).unionByName(counts)

    @staticmethod
    def _checked(m: Measure, value: Column) -> Column:
        """The value, or the default where there is none; one that is not of the type is an error."""
        wrong = F.raise_error(F.concat(F.lit(f"no value of {m.name}: "), value)).cast("string")
        return F.when(value.isNull(), F.lit(m.type.default)).when(m.type.legal(value), value).otherwise(wrong)

    def dense(self, rows: DataFrame) -> DataFrame:
        """SNK-5: one line for each set: its id and every fixed feature, in the order of names."""
        order = sorted((m.name, i) for i, m in enumerate(self.measures))
        found = rows.groupBy(self.set_id).agg(*[m.value.cast("string").alias(f"_m{i}") for i, m in enumerate(self.measures)])
        return found.select(self.set_id, F.concat_ws(",", F.col(self.set_id).cast("string"), *[self._checked(self.measures[i], F.col(f"_m{i}")) for _, i in order]).alias("row"))

    def attributes(self) -> list[tuple[str, str, str]]:
        """(name, domain, default) of the features with fixed names."""
        return [(m.name, m.type.domain(), m.type.default) for m in self.measures]
