"""Writers of traces, graphs, features and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.operators.features import arff_rows, indexed_names, zero_filled_average

ARTEFACTS = ("execgraph", "taint", "scs", "heap", "assertions")


#: Records of a file of traces, about.
FILE = 200_000


def traces(records: DataFrame, path: str, size: int = FILE) -> None:
    """SNK-1: one directory for each project and entry point; slashes of a signature become dots.

    A directory of many records has several files of about ``size``, each written by a task of its own; a trace is in one of them, in order.
    """
    key = ["project_id", "entry_point"]
    named = records.withColumn("entry_point", F.translate("entry_point", "/", "."))
    files = named.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.ceil(F.count("*") / size).cast("int").alias("_files")).filter("_files > 1")
    many = files.agg(F.sum("_files")).first()[0] or 0
    same = F.col("project_id").eqNullSafe(F.col("_project_id")) & F.col("entry_point").eqNullSafe(F.col("_entry_point"))
    file = F.pmod(F.xxhash64("trace_id"), F.coalesce("_files", F.lit(1))).cast("int")
    # only directories of more than one file are told, so they are fewer than records over ``size``
    dealt = named.join(F.broadcast(files), same, "left").withColumn("_file", file).drop("_files", "_project_id", "_entry_point")
    tasks = max(int(named.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * many)
    dealt.repartition(tasks, *key, "_file").sortWithinPartitions(*key, "trace_id", "seq").drop("_file").write.mode("overwrite").partitionBy(*key).parquet(path)


def artefacts(tables: dict[str, DataFrame], weights: DataFrame, path: str) -> None:
    """SNK-2: the five artefact tables of every model and the manifest."""
    for name in ARTEFACTS:
        if name in tables:
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    weights.write.mode("overwrite").parquet(f"{path}/manifest")


def packed_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-3: one row for each graph with its nodes and edges as arrays."""
    n = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "kind", "label"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "kind"))).alias("edges"))
    return n.join(e, "graph_id", "left")


def unpacked_graphs(packed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-10: node and edge rows of packed graphs."""
    return packed.select("graph_id", F.inline("nodes")), packed.select("graph_id", F.inline_outer("edges")).filter("src is not null")


#: Parts of a written ARFF in the order in which they make the file (fixed values).
PARTS = ("0-relation", "1-ids", "2-attributes", "3-classes", "4-data")
DONE = "_written"


def sparse_arff(features: DataFrame, path: str, relation: str = "features", set_id: str = "set_id") -> None:
    """SNK-4: header and sparse rows; features may not be called id or cls.

    Each part is a folder of text that its own tasks write: rows as they come, nominal values and attributes range-sorted, each
    value of a nominal ended by its comma, so that no value list is in one cell and nothing is sorted as a whole.
    ``_written`` comes last and tells how many rows there are; it goes first when a folder is written again,
    so a folder that has it is whole.
    """
    if not features.filter(F.col("name").isin("id", "cls")).isEmpty():
        raise ValueError("id and cls are not names of features")
    spark = features.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{DONE}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    write = lambda df, part, end="\n": df.write.mode("overwrite").option("lineSep", end).text(f"{path}/{part}")
    line = lambda *lines: spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1)

    def nominal(values: DataFrame, part: str, name: str) -> None:
        """``@ATTRIBUTE name {a,b,c}``: the values but the last, and the last one with the bracket."""
        last = values.agg(F.max("v")).first()[0]
        write(line(f"@ATTRIBUTE {name} {{"), f"{part}/0", " ")
        write(values.filter(F.col("v") < (last or "")).repartitionByRange("v").sortWithinPartitions("v"), f"{part}/1", ",")
        write(line(f"{last or ''}}}"), f"{part}/2")

    ids = features.select(F.col(set_id).cast("string").alias("v")).distinct()
    write(line(f"@RELATION {relation}"), PARTS[0])
    nominal(ids, PARTS[1], "id")
    attributes = indexed_names(features).select("idx", F.concat(F.lit("@ATTRIBUTE "), "name", F.lit(" NUMERIC")).alias("line"))
    write(attributes.repartitionByRange("idx").sortWithinPartitions("idx").select("line"), PARTS[2])
    nominal(ids.select(F.split("v", "-")[0].alias("v")).distinct(), PARTS[3], "cls")
    write(line("@DATA"), f"{PARTS[4]}/0")
    write(arff_rows(features, set_id).select(F.col("row").alias("line")), f"{PARTS[4]}/1")
    rows = spark.read.text(f"{path}/{PARTS[4]}/1").count()
    write(line(str(rows)), DONE)


def arff_files(spark: SparkSession, path: str) -> list[str]:
    """The written files in the order in which their bytes make the ARFF."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").filter(~F.col("path").contains(f"/{DONE}/"))
    return sorted(r["path"] for r in rows.filter(F.element_at(F.split("path", "/"), -1).startswith("part-")).collect())


def averaged_rows(features: DataFrame, members: DataFrame, group: str, member: str) -> DataFrame:
    """SNK-6: one sparse row for each group: means over all its members of the numeric features they have, four digits."""
    means = zero_filled_average(features, members, group, member).withColumnRenamed("avg", "value")
    return arff_rows(means, group)


def averaged_arff(features: DataFrame, members: DataFrame, path: str, group: str, member: str, relation: str = "features") -> None:
    """SNK-6: header and averaged rows as text."""
    sparse_arff(zero_filled_average(features, members, group, member).withColumnRenamed("avg", "value"), path, relation, group)


def dense_rows(features: DataFrame, defaults: dict[str, str], set_id: str = "set_id") -> DataFrame:
    """SNK-5: one line for each set with every named feature or its default; for small sets of names."""
    wide = features.groupBy(set_id).pivot("name", sorted(defaults)).agg(F.first("value"))
    cells = [F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(defaults[n])) for n in sorted(defaults)]
    return wide.select(set_id, F.concat_ws(",", F.col(set_id).cast("string"), *cells).alias("row"))


def scores(rows: DataFrame, path: str) -> None:
    """SNK-7: three columns, tabs, no header."""
    rows.select("lhs", "rhs", "score").write.mode("overwrite").csv(path, sep="\t")


def plaintiff_scores(rows: DataFrame, path: str) -> None:
    """SNK-8: with a header."""
    rows.select("program", "similarity").write.mode("overwrite").csv(path, sep="\t", header=True)


def pair_results(rows: DataFrame, path: str) -> None:
    """SNK-9: (lhs, rhs, lsim, rsim) as JSON."""
    rows.select("lhs", "rhs", "lsim", "rsim").write.mode("overwrite").json(path)


def read_back(spark: SparkSession, path: str, expected: int) -> int:
    """SNK-10: the number of data rows of a written ARFF, which must be what its writer told and as expected."""
    told = int(spark.read.text(f"{path}/{DONE}").first()[0])
    n = spark.read.text(f"{path}/{PARTS[4]}/1").filter(F.col("value").startswith("{")).count()
    if n != expected or n != told:
        raise ValueError(f"{n} rows were written, {expected} expected, {told} told by the writer")
    return n


def unfinished(todo: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """SNK-11: what is left to do."""
    return todo.join(done.select(*keys), list(keys), "left_anti")
