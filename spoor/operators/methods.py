"""Entry points among the methods of a project.

methods: (method, name, class_sig, super_class, ret, params array<string>, annotations array<string>,
class_annotations array<string>, is_static, is_public, is_private, is_constructor, statements int);
types: (type, parent) for super-classes and interfaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and types that mark entry points (fixed values).
SERVLET_METHODS = ("doGet", "doPost", "doPut", "doDelete")
SERVLET, REQUEST, RESPONSE = "javax.servlet.http.HttpServlet", "javax.servlet.http.HttpServletRequest", "javax.servlet.http.HttpServletResponse"
EVENT, VIEW = "java.util.EventObject", "android.view.View"
ANNOTATIONS = (
    "javax.ws.rs.Path", "javax.ws.rs.GET", "javax.ws.rs.POST", "javax.ws.rs.UPDATE", "javax.ws.rs.DELETE", "javax.jws.WebService",
    "org.springframework.web.bind.annotation.RequestMapping",
)


def subtypes(types: DataFrame, ancestor: str) -> DataFrame:
    """PRJ-9: every type that extends or implements ``ancestor``, itself included; rounds are as many as the hierarchy is deep."""
    from spoor.operators.graph import _spill

    seen = types.sparkSession.createDataFrame([(ancestor,)], "type string")
    frontier = seen
    while True:
        nxt = types.join(frontier.withColumnRenamed("type", "parent"), "parent").select("type").distinct().join(seen, "type", "left_anti")
        nxt = _spill(nxt, "types")
        if nxt.isEmpty():
            break
        seen, frontier = seen.unionByName(nxt), nxt
    return seen


def _handler() -> Column:
    return F.col("statements").isNotNull() & ~F.col("is_static") & ~F.col("is_private") & (F.col("ret") == "void")


def entry_points(methods: DataFrame, types: DataFrame, advice: list[str] | None = None) -> DataFrame:
    """PRJ-7: methods that a runtime calls: main, servlets, event and view callbacks, annotated ones, and those advised.

    ``statements`` is null where a method has no body; an empty body is one.
    """
    one = F.size("params") == 1
    main = F.col("statements").isNotNull() & F.col("is_static") & F.col("is_public") & (F.col("ret") == "void") & one & (F.get("params", F.lit(0)) == "java.lang.String[]")
    servlet = _handler() & F.col("name").isin(*SERVLET_METHODS) & (F.col("super_class") == SERVLET) & (F.col("params") == F.array(F.lit(REQUEST), F.lit(RESPONSE)))
    marked = lambda c: F.arrays_overlap(F.coalesce(c, F.array().cast("array<string>")), F.array(*map(F.lit, ANNOTATIONS)))
    annotated = ~F.col("is_constructor") & ~F.col("is_private") & (marked(F.col("annotations")) | marked(F.col("class_annotations")))
    handled = subtypes(types, EVENT).unionByName(subtypes(types, VIEW)).distinct().select(F.col("type").alias("_handled"))
    rows = methods.join(handled, F.get("params", F.lit(0)) == F.col("_handled"), "left")
    callback = _handler() & one & F.col("_handled").isNotNull()
    return rows.filter(main | servlet | annotated | callback | F.col("method").isin(*(advice or ()))).drop("_handled")


def assignable(types: DataFrame) -> DataFrame:
    """FN-14: (type, target): every type with each super-type and interface it may be assigned to, itself included.

    Pairs double their reach in each round, which is written to the shared folder.
    """
    from spoor.operators.graph import _spill

    every = types.select("type").unionByName(types.select(F.col("parent").alias("type"))).filter("type is not null").distinct()
    known = _spill(every.select("type", F.col("type").alias("target")).unionByName(types.filter("parent is not null").select("type", F.col("parent").alias("target"))).distinct(), "assignable")
    n = known.count()
    while True:
        further = known.select("type", F.col("target").alias("via")).join(known.select(F.col("type").alias("via"), "target"), "via").select("type", "target")
        known = _spill(further.distinct(), "assignable")  # itself included, so nothing known is lost
        if (m := known.count()) == n:
            return known
        n = m


def all_methods(methods: DataFrame) -> DataFrame:
    """PRJ-8: methods with a body, but for one-line getters (with parameters, as in the original rule) and setters."""
    short = F.col("statements") == 1
    getter = (F.col("name").startswith("get") | F.col("name").startswith("is")) & (F.col("ret") != "void") & (F.size("params") > 0) & short
    is_get = F.col("name").startswith("get") | F.col("name").startswith("is")
    setter = ~is_get & F.col("name").startswith("set") & (F.col("ret") == "void") & (F.size("params") == 1) & short
    return methods.filter((F.col("statements") > 0) & ~getter & ~setter)
