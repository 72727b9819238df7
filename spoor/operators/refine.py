"""Branch trees by partition refinement (BR-1, BR-2): every entry point's tree at once, one level a round.

A node of a tree is a group of traces.  Its condition is that of the next assertion of the group's first trace;
all traces of the group go on by the truth of their own record at that place.  Traces that assert alike are one row with their
number, and each row carries the assertions still ahead of it.  So a round is a join of the groups with their leaders;
a group of one such row is done, its nodes are read off its list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.operators.rounds import Rounds

#: Kinds of records that end a trace in their own way (fixed values), and how such an end is named.
ENDS = {"UncaughtException": "uncaught", "Halt": "halt"}


def tree(records: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(entry, path, depth, kind, condition, leader, start, stop, traces) of every node of every tree.

    records is (entry, trace, at, kind, condition, truth): traces are in order of ``trace``, at counts
    a trace's records from 0, condition and truth are those of assertions.  ``path`` is the
    truths from the root as T and F; kind is fork, uncaught, halt, regular or empty (a side
    that no trace takes).  [start, stop) are the places of the leader's records that precede
    the fork, or come last.

    The quirks kept: an assertion at place 0 is no fork; the record before a fork (the branch itself) and a trace's last record
    are not among the preceding ones, so an end is told by the last record but one; and if there is no fork left in the leader
    the others are not looked at.  A trace without an assertion where its leader forks goes to the false side (the original fails).
    """
    rounds = rounds or Rounds(records.sparkSession, "tree")
    records = rounds.keep(records.select("entry", "trace", "at", "kind", "condition", "truth"), "records")
    sizes = records.groupBy("entry", "trace").agg((F.max("at") + 1).alias("size"))
    # the one record that tells how a trace ends, if it is the leader of a leaf
    final = records.select("entry", "trace", (F.col("at") + 2).alias("size"), F.col("kind").alias("final"))
    cell = F.struct("at", F.coalesce("truth", F.lit(False)).alias("truth"), "condition")
    lists = records.filter("kind = 'Assertion' AND at > 0").groupBy("entry", "trace").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    none = F.array().cast(lists.schema["cells"].dataType)
    sized = sizes.join(final, ["entry", "trace", "size"], "left").join(lists, ["entry", "trace"], "left").withColumn("cells", F.coalesce("cells", none))
    # traces that assert alike never part: they go on as the first of them
    alike = sized.groupBy("entry", "cells").agg(F.min(F.struct("trace", "size", "final")).alias("x"), F.count("*").alias("n"))
    groups = rounds.keep(alike.select("entry", "x.*", F.lit("").alias("path"), F.lit(0).alias("last"), "cells", "n"), "groups")
    levels = []
    step = 0
    while not groups.isEmpty():
        step += 1
        head = F.min(F.struct("trace", "size", "final", "last", "cells")).alias("head")
        found = groups.groupBy("entry", "path").agg(head, F.sum("n").alias("traces"), (F.count("*") == 1).alias("alone"))
        h, cells = F.col("head"), F.col("head.cells")
        first = F.try_element_at(cells, F.lit(1))
        found = found.select(
            "entry", "path", h["trace"].alias("leader"), h["size"].alias("size"), h["final"].alias("final"), h["last"].alias("last"), "traces", "alone",
            first["at"].cast("int").alias("fork"), first["condition"].alias("condition"), F.when(F.col("alone"), cells).alias("cells"),
        )
        found = rounds.keep(found, "nodes")
        levels.append(rounds.paths[id(found)][1])
        open_ = groups.join(found.filter("NOT alone AND fork IS NOT NULL").select("entry", "path", "fork"), ["entry", "path"])
        truth = F.exists("cells", lambda c: (c["at"] == F.col("fork")) & c["truth"])
        later = F.filter("cells", lambda c: c["at"] > F.col("fork"))
        more = open_.select("entry", "trace", "size", "final", F.concat("path", F.when(truth, "T").otherwise("F")).alias("path"), F.col("fork").alias("last"), later.alias("cells"), "n")
        more = rounds.keep(more, "groups")
        rounds.note(kind="tree", round=step)
        rounds.drop(groups)
        groups = more
    if not levels:
        return records.select("entry", F.lit("").alias("path"), F.lit(0).alias("depth"), F.lit("").alias("kind"), "condition", F.col("trace").alias("leader"), F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("traces")).filter("false")
    # all levels are one table, so the plan does not grow with them; a group that cannot part any more is the rest of one chain
    every = records.sparkSession.read.schema(found.schema).parquet(*levels)
    parting = every.filter("NOT alone").drop("alone", "cells")
    rest = every.filter("alone").select("*", F.explode(F.sequence(F.lit(0), F.size("cells"))).alias("k"))
    spelt = F.concat("path", F.array_join(F.transform(F.slice("cells", F.lit(1), F.col("k")), lambda c: F.when(c["truth"], "T").otherwise("F")), ""))
    before, ahead = F.try_element_at("cells", F.greatest("k", F.lit(1))), F.try_element_at("cells", F.col("k") + 1)
    rest = rest.select("entry", spelt.alias("path"), "leader", "size", "final", F.when(F.col("k") > 0, before["at"].cast("int")).otherwise(F.col("last")).alias("last"), "traces", ahead["at"].cast("int").alias("fork"), ahead["condition"].alias("condition"))
    every = parting.unionByName(rest)
    last, fork, end = F.col("last"), F.col("fork"), F.col("size") - 1
    start = F.when(last == 0, 0).when(fork.isNull() & (last + 1 > end), end).otherwise(last + 1)
    stop = F.greatest(start, F.when(fork.isNotNull(), fork - 1).otherwise(end))
    every = every.withColumns({"start": start.cast("int"), "stop": stop.cast("int")})
    ended = F.coalesce(F.create_map(*[F.lit(x) for kv in ENDS.items() for x in kv])[F.when(F.col("stop") > F.col("start"), F.col("final"))], F.lit("regular"))
    own = rounds.keep(every.select("entry", "path", F.when(fork.isNotNull(), "fork").otherwise(ended).alias("kind"), "condition", "leader", "start", "stop", "traces"), "own")
    # a fork has two sides, whether a trace takes them or not
    sides = own.filter("kind = 'fork'").select("entry", F.explode(F.array(F.concat("path", F.lit("T")), F.concat("path", F.lit("F")))).alias("path"))
    none = lambda c: F.lit(None).cast(own.schema[c].dataType).alias(c)
    empty = sides.join(own.select("entry", "path"), ["entry", "path"], "left_anti").select("entry", "path", F.lit("empty").alias("kind"), none("condition"), none("leader"), F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit(0).cast("bigint").alias("traces"))
    return own.unionByName(empty).select("entry", "path", F.length("path").alias("depth"), "kind", "condition", "leader", "start", "stop", "traces")


def preceding(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """(entry, path, at, kind): the records that each node holds."""
    named = records.select("entry", F.col("trace").alias("leader"), "at", F.col("kind").alias("record"))
    return nodes.join(named, ["entry", "leader"]).filter("at >= start AND at < stop").select("entry", "path", "at", F.col("record").alias("kind"))


def measures(nodes: DataFrame) -> DataFrame:
    """BR-2: (entry, height, size, terminals, internals) of each tree, its root above the first node."""
    fork = F.col("kind") == "fork"
    return nodes.groupBy("entry").agg(
        (F.max("depth") + 2).cast("bigint").alias("height"), (F.count("*") + 1).alias("size"), F.count_if(~fork).alias("terminals"), F.count_if(fork).alias("internals"),
    )


def conditions(nodes: DataFrame) -> DataFrame:
    """BR-2: (entry, conditions): the number of distinct sets of (condition, truth) over the sides that are no forks; 0 without forks.

    A leaf's conditions are those of the forks whose paths begin its own: one join on (entry, path) with its beginnings.
    """
    leaves = nodes.filter("kind <> 'fork' AND depth > 0").select("entry", "path", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("n"))
    begun = leaves.select("entry", F.col("path").alias("leaf"), F.expr("substring(path, 1, n)").alias("path"), F.expr("substring(path, n + 1, 1)").alias("truth"))
    forks = nodes.filter("kind = 'fork'").select("entry", "path", "condition")
    sets = begun.join(forks, ["entry", "path"]).groupBy("entry", "leaf").agg(F.array_sort(F.collect_set(F.struct("condition", "truth"))).alias("s"))
    counted = sets.select("entry", "s").distinct().groupBy("entry").agg(F.count("*").alias("conditions"))
    return nodes.select("entry").distinct().join(counted, "entry", "left").withColumn("conditions", F.coalesce("conditions", F.lit(0)))
