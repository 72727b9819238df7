"""Readers of the file formats that the pipelines exchange."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = (
    "title string, projectsRoot string, output string, globalLibraries array<string>, projectLibraries map<string,array<string>>, "
    "entryPoints map<string,array<string>>, loggingEnabled boolean, maxRecursiveCalls int, maxLoopExecutions int"
)
SCORES = "lhs string, rhs string, score double"


def config(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: a pipeline's configuration; unknown properties are ignored."""
    return spark.read.schema(CONFIG).json(path, multiLine=True)


def files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """SRC-2: (path, name, length) of files with the suffix at any depth, without ``._*`` companions."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select("path", name.alias("name"), "length").filter(~F.col("name").startswith("._"))


def directories(spark: SparkSession, root: str) -> DataFrame:
    """SRC-3: every directory below the root that holds a file at any depth."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.split("path", "/").alias("p"))
    depth = root.rstrip("/").count("/") if "://" not in root else root.split("://", 1)[1].rstrip("/").count("/")
    own = paths.select(F.array_join(F.slice("p", 1, F.size("p") - 1), "/").alias("path")).distinct()
    parts = own.select(F.split("path", "/").alias("p")).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))).alias("path"))
    return parts.distinct().filter(F.size(F.split(F.regexp_replace("path", "^file:", ""), "/")) - 1 > depth)


def projects(spark: SparkSession, root: str) -> DataFrame:
    """SRC-4: the immediate sub-directories of the root, sorted."""
    tail = F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^" + root.replace("file:", "").rstrip("/") + "/", "")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.split(tail, "/").alias("p")).filter(F.size("p") > 1).select(F.col("p")[0].alias("project_id")).distinct().orderBy("project_id")


def without_syntax_errors(projects_: DataFrame, messages: DataFrame) -> DataFrame:
    """SRC-6: projects none of whose messages tells of a syntax error or an unresolved name."""
    bad = messages.filter(F.col("message").contains("Syntax error") | F.col("message").contains("cannot be resolved"))
    return projects_.join(bad.select("project_id"), "project_id", "left_anti")


#: SRC-8: a parsed unit: its types with the methods and fields they declare.
UNITS = "unit string, types array<struct<sig:string,kind:string,methods:array<struct<sig:string,name:string>>,fields:array<struct<name:string,type:string>>>>"


def declarations(units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-8: the tables of types, methods and fields of parsed units, keyed by signature.

    Of two declarations with one key the one of the last unit by name counts, as in a map that
    units are added to in order.  A field's key is its class and its name.
    """
    types = units.select("unit", F.posexplode("types").alias("at", "t")).select("unit", "at", "t.sig", "t.kind", "t.methods", "t.fields")

    def last(rows: DataFrame, key: str, *columns: str) -> DataFrame:
        return rows.groupBy(key).agg(F.max_by(F.struct(*columns, "unit"), F.struct("unit", "at", "pos")).alias("d")).select(key, "d.*")

    def members(what: str) -> DataFrame:
        return types.select("unit", "at", F.col("sig").alias("declaring"), F.posexplode(what).alias("pos", "m"))

    methods = members("methods").select("unit", "at", "pos", "declaring", F.concat_ws(".", "declaring", "m.sig").alias("method"), "m.name")
    fields = members("fields").select("unit", "at", "pos", "declaring", F.concat_ws(".", "declaring", "m.name").alias("field"), "m.type")
    return (
        last(types.select("unit", "at", F.lit(0).alias("pos"), F.col("sig").alias("type"), "kind"), "type", "kind"),
        last(methods, "method", "declaring", "name"), last(fields, "field", "declaring", "type"),
    )


def traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-9: records of stored traces, project and entry point from the names of folders.

    ``schema`` is the records' own (``builder.RECORDS`` for graph building) and prunes what is read.
    """
    return spark.read.schema(f"{schema}, project_id string, entry_point string, trace_id string").parquet(path)


def opcodes(spark: SparkSession, path: str) -> DataFrame:
    """SRC-17: (name, opcode) from the table of instructions, whose further columns are not read."""
    return spark.read.schema("name string, opcode string").csv(path, quote='"', escape='"', enforceSchema=True)


def project_models(spark: SparkSession, root: str) -> DataFrame:
    """SRC-11: (dir, idx, artefacts): artefact files grouped by their number, without the manifest."""
    listed = files(spark, root, "").filter("name <> 'manifest.ser'")
    return (
        listed.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.split("name", "-")[0].cast("int").alias("idx"), "name")
        .groupBy("dir", "idx").agg(F.sort_array(F.collect_list("name")).alias("artefacts"))
    )


def scores(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: three columns, no header."""
    return spark.read.schema(SCORES).csv(path, sep="\t")


def headed_scores(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: (lhs, rhs, score) from files with a header whose name is the left side."""
    rows = spark.read.schema("program string, similarity double").csv(path, sep="\t", header=True)
    lhs = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return rows.select(lhs.alias("lhs"), F.col("program").alias("rhs"), F.col("similarity").alias("score"))


def base_scores(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: two columns; NaN reads as 100."""
    return spark.read.schema("id string, score double").csv(path, sep="\t").withColumn("score", F.when(F.isnan("score"), F.lit(100.0)).otherwise(F.col("score")))


def suspicious(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC-15: known pairs; no file, no pairs."""
    none = spark.createDataFrame([], "lhs string, rhs string")
    if path is None:
        return none
    try:
        rows = spark.read.schema("knownSuspicious array<struct<lhs:string,rhs:string>>").json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none
    return rows.select(F.inline("knownSuspicious"))


def modifications(spark: SparkSession, path: str) -> DataFrame:
    """SRC-16: (file, filter) for each modification that a variant's analytics name."""
    rows = spark.read.schema("modifications map<string,string>").json(path, multiLine=True)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.explode(F.map_keys("modifications")).alias("filter"))


def line_range(spark: SparkSession, path: str, skip: int, limit: int) -> DataFrame:
    """SRC-18: lines skip .. skip + limit of one text file, in order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return rows.filter((F.col("n") >= skip) & (F.col("n") < skip + limit)).orderBy("n")
