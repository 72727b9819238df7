"""Pair scores: building, cleaning, matching and evaluating them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spoor.operators import tiles


def overlap_scores(features: DataFrame, entity: str, name: str, value: str) -> DataFrame:
    """JN-6: (lhs, rhs, score) of all pairs lhs < rhs of entities that share a feature: weighted Jaccard of their features.

    Joined on the feature's name, so pairs come from shared names alone; totals give the union.
    """
    f = features.select(F.col(entity).alias("e"), F.col(name).alias("k"), F.col(value).alias("v"))
    totals = f.groupBy("e").agg(F.sum("v").alias("t"))
    a, b = f.select(F.col("e").alias("lhs"), "k", F.col("v").alias("lv")), f.select(F.col("e").alias("rhs"), "k", F.col("v").alias("rv"))
    common = a.join(b, "k").filter("lhs < rhs").groupBy("lhs", "rhs").agg(F.sum(F.least("lv", "rv")).alias("c"))
    lt, rt = totals.select(F.col("e").alias("lhs"), F.col("t").alias("lt")), totals.select(F.col("e").alias("rhs"), F.col("t").alias("rt"))
    return common.join(lt, "lhs").join(rt, "rhs").select("lhs", "rhs", (F.col("c") / (F.col("lt") + F.col("rt") - F.col("c"))).alias("score"))


def plaintiff(scores: DataFrame, one) -> DataFrame:
    """JN-7: scores of one program against every other: (program, similarity)."""
    other = F.when(F.col("lhs") == one, F.col("rhs")).otherwise(F.col("lhs"))
    return scores.filter((F.col("lhs") == one) | (F.col("rhs") == one)).groupBy(other.alias("program")).agg(F.max("score").alias("similarity"))


def group_average(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """AGG-11: mean score of every pair of groups over all pairs of members; a missing pair counts as 1.0.

    groups is (id, grp).  Missing pairs are counted, not built: sizes multiply.
    """
    l, r = groups.select(F.col("id").alias("lhs"), F.col("grp").alias("lg")), groups.select(F.col("id").alias("rhs"), F.col("grp").alias("rg"))
    both = scores.select("lhs", "rhs", "score").unionByName(scores.select(F.col("rhs").alias("lhs"), F.col("lhs").alias("rhs"), "score"))
    sums = both.join(l, "lhs").join(r, "rhs").groupBy("lg", "rg").agg(F.sum("score").alias("s"), F.count("*").alias("k"))
    sizes = groups.groupBy("grp").agg(F.count("*").alias("n"))
    pairs = sizes.select(F.col("grp").alias("lg"), F.col("n").alias("ln")).crossJoin(sizes.select(F.col("grp").alias("rg"), F.col("n").alias("rn")))
    n = F.col("ln") * F.col("rn")
    return pairs.join(sums, ["lg", "rg"], "left").select("lg", "rg", ((F.coalesce("s", F.lit(0.0)) + n - F.coalesce("k", F.lit(0))) / n).alias("avg_score"))


def dedupe_pairs(scores: DataFrame) -> DataFrame:
    """AGG-12: one row for each unordered pair with its greatest score."""
    return scores.groupBy(F.least("lhs", "rhs").alias("lhs"), F.greatest("lhs", "rhs").alias("rhs")).agg(F.max("score").alias("score"))


def without_pairs(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """JN-9: scores whose unordered pair is not among the suspicious ones; dashes in ids do not count."""

    def pair(end):
        return end(*(F.regexp_replace(F.col(c).cast("string"), "-", "") for c in ("lhs", "rhs")))

    bad = pairs.select(pair(F.least).alias("_a"), pair(F.greatest).alias("_b"))
    return scores.join(bad, (pair(F.least) == F.col("_a")) & (pair(F.greatest) == F.col("_b")), "left_anti")


def other_base(scores: DataFrame, separator: str = "_") -> DataFrame:
    """JN-10: scores of programs with different bases (what precedes the separator)."""
    return scores.filter(F.split("lhs", separator)[0] != F.split("rhs", separator)[0])


def usable(scores: DataFrame) -> DataFrame:
    """PRJ-12: scores that are neither NaN, null nor 0."""
    return scores.filter(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") != 0))


def best_matches(scores: DataFrame, side: str, other: str, valid: Column | None = None) -> DataFrame:
    """WIN-6, SIM-6: the best partner of each element, the least partner of equals; one aggregation, no sort."""
    rows = scores if valid is None else scores.filter(valid)
    best = F.min_by(F.struct(other, "score"), F.struct((-F.col("score")).alias("s"), F.col(other).alias("o")))
    return rows.groupBy(side).agg(best.alias("b")).select(side, F.col(f"b.{other}").alias(other), F.col("b.score").alias("score"))


def ranked(scores: DataFrame, group: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """SRT-2: places by score, greatest first, ties broken by the columns given."""
    return scores.withColumn("rn", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score"), *ties)))


def topk_errors(scores: DataFrame, group: Sequence[str], level: str, ties: Sequence[str], hit: str, per_level: int = 5) -> DataFrame:
    """SRT-3: among the first level * 5 scores of a group: true positives and errors ((k - tp) * 2)."""
    k = F.col(level) * per_level
    top = ranked(scores, group, ties).filter(F.col("rn") <= k)
    tp = F.count_if(F.col(hit)).alias("tp")
    return top.groupBy(*group, level).agg(tp).withColumn("errors", (k - F.col("tp")) * 2)


def pooled_f(rows: DataFrame, *group: str) -> DataFrame:
    """AGG-17: F-score of pooled counts: tp / (tp + errors / 2)."""
    sums = rows.groupBy(*group).agg(F.sum("tp").alias("tp"), F.sum("errors").alias("errors"))
    d = F.col("tp") + F.col("errors") * 0.5
    return sums.withColumn("f_score", F.when(d == 0, F.lit(0.0)).otherwise(F.col("tp") / d))


def sweep(scores: DataFrame, group: Sequence[str], hit: str, ties: Sequence[str]) -> DataFrame:
    """WIN-3: at every cut of the ranking: true and false positives, false negatives and errors."""
    w = W.partitionBy(*group).orderBy(F.desc("score"), *ties)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    flag = F.col(hit).cast("int")
    out = scores.select(*group, "score", *ties, F.row_number().over(w).alias("rn"), F.sum(flag).over(run).alias("tp"), F.sum(flag).over(W.partitionBy(*group)).alias("p"))
    out = out.withColumns({"fp": F.col("rn") - F.col("tp"), "fn": F.col("p") - F.col("tp")})
    return out.withColumn("errors", F.col("fp") + F.col("fn")).drop("p")


def first_minimum(swept: DataFrame, group: Sequence[str]) -> DataFrame:
    """WIN-4: the cut before the errors first rise (the last cut if they never do)."""
    w = W.partitionBy(*group).orderBy("rn")
    rise = swept.withColumn("up", F.col("errors") > F.lag("errors").over(w))
    stop = F.coalesce(F.min(F.when(F.col("up"), F.col("rn") - 1)), F.max("rn"))
    cut = rise.groupBy(*group).agg(stop.alias("rn"))
    return swept.join(cut, [*group, "rn"], "left_semi")


def average_of_averages(rows: DataFrame, outer: Sequence[str], inner: str, value: str) -> DataFrame:
    """AGG-14: mean per base, then mean of those means per outer group."""
    return rows.groupBy(*outer, inner).agg(F.avg(value).alias("m")).groupBy(*outer).agg(F.avg("m").alias("avg_of_avgs"))


def score_drop(base: Column, variant: Column) -> Column:
    """AGG-15: loss of score in percent; negative and NaN losses are 0."""
    return F.greatest(F.nanvl(base - variant, F.lit(0.0)), F.lit(0.0)) * 100


def base_lookup(variants: DataFrame, bases: DataFrame, key: str) -> DataFrame:
    """JN-11: each variant with its base's row; a base that is not single is an error when it is met."""
    single = bases.groupBy(key).agg(F.count("*").alias("_n"), F.first("base_score").alias("base_score"))
    checked = variants.join(single, key)
    return checked.filter(F.coalesce(F.assert_true(F.col("_n") == 1, "a base is not single").cast("boolean"), F.lit(True))).drop("_n")


def size_band(sizes: DataFrame, least: float = 0.9, key: str = "id", size: str = "n", group: Sequence[str] = ()) -> DataFrame:
    """JN-8: pairs a < b of a group whose sizes are within the ratio: an equi-join on logarithmic bands, then the exact test.

    A band's width is the ratio, so a partner is in the same band or a neighbouring one.
    """
    band = F.floor(F.log(F.greatest(F.col(size), F.lit(1)).cast("double")) / -math.log(least)).cast("bigint")
    rows = sizes.select(*group, F.col(key).alias("k"), F.col(size).alias("s"), band.alias("band"))
    left = rows.select(*group, F.col("k").alias("a"), F.col("s").alias("sa"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = rows.select(*group, F.col("k").alias("b"), F.col("s").alias("sb"), "band")
    near = tiles.join(left, right, [*group, "band"]).filter("a < b")
    return near.filter(F.least("sa", "sb") >= least * F.greatest("sa", "sb")).select(*group, "a", "b", (F.least("sa", "sb") / F.greatest("sa", "sb")).alias("ratio"))


def error_rollup(rows: DataFrame, *dims: str, value: str = "errors") -> DataFrame:
    """AGG-16: sums at every level of the dimensions."""
    return rows.rollup(*dims).agg(F.sum(value).alias(value))


def top_usable(scores: DataFrame, *group: str) -> DataFrame:
    """SRT-4: the best score of each group that is not NaN."""
    return scores.filter(~F.isnan("score")).groupBy(*group).agg(F.max("score").alias("score"))


def by_prefix(variants: DataFrame, roots: DataFrame, variant: str, root: str, separator: str = "-") -> DataFrame:
    """JN-12: variants of each root, matched on the part before the separator.

    The original tests for any prefix, which also gives P10 to P1; an equi-join on the whole
    part does not, and needs no nested loop.
    """
    return variants.withColumn("_root", F.split(F.col(variant), separator)[0]).join(roots, F.col("_root") == F.col(root)).drop("_root")


def expansion(pairs: DataFrame, left: DataFrame, right: DataFrame, lmapped: DataFrame, rmapped: DataFrame) -> DataFrame:
    """JN-4: neighbours of mapped pairs that are not mapped yet, over edges of equal way and matching kind.

    pairs (l, r); edges (node, other, kind, way); mapped sets (node).
    """
    from spoor.functions.codes import edge_match

    a = pairs.join(left.toDF("l", "lo", "lk", "way"), "l").join(lmapped.toDF("lo"), "lo", "left_anti").select("lo", "r", "way", "lk").distinct()
    b = right.toDF("r", "ro", "rk", "way").join(rmapped.toDF("ro"), "ro", "left_anti").distinct()
    # two nodes can meet twice only if both are met in several ways; other pairs need not be compared with one another
    several = lambda df, x: df.groupBy(x).agg((F.count("*") > 1).alias(f"{x}_s"))
    a, b = a.join(several(a, "lo"), "lo"), b.join(several(b, "ro"), "ro")
    fits = edge_match(F.col("lk"), F.col("rk")) == 1
    met = lambda l, r: tiles.join(l, r, ["r", "way"]).filter(fits).select("lo", "ro")
    once = met(a.filter("NOT lo_s"), b).unionByName(met(a.filter("lo_s"), b.filter("NOT ro_s")))
    return once.unionByName(met(a.filter("lo_s"), b.filter("ro_s")).distinct())


def residual(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN-5: unmapped nodes of both sides that match: of one kind, and with equal labels or, for calls, by FN-21.

    Nodes are (node_id, kind, label) and, for calls, name and ret.  The ways to match are
    equi-joins whose results are united: equal labels, equal return types, and names of which
    one is a prefix of the other (each prefix of a name is looked up), unless most pairs match.
    """
    of = lambda df, x: df.select(F.col("node_id").alias(x), "kind", *[F.col(c).alias(f"{x}_{c}") for c in ("label", "name", "ret") if c in df.columns]).distinct()
    a, b = of(left, "l"), of(right, "r")
    if a.groupBy("l").count().filter("count > 1").isEmpty() and b.groupBy("r").count().filter("count > 1").isEmpty():
        return _ways(a, b)
    return _ways(a, b).distinct()  # a node with several rows may meet another in several of them


#: Pairs of one kind are all tested where the ways to match make so large a share of them.
DENSE = 0.25


def _ways(a: DataFrame, b: DataFrame, most: int = tiles.MOST) -> DataFrame:
    """The pairs of each way to match that no way before it tells, so each pair of rows is told once.

    Where most pairs match, a join on each way would send each row to very many tiles; there all pairs of a kind are tested.
    """
    key = lambda df, x, c: df.withColumn("key", F.col(f"{x}_{c}"))
    on = ["kind", "key"]
    ways = [(key(a, "l", "label"), key(b, "r", "label"), "true")]
    test = "l_label = r_label"
    if "l_name" in a.columns and "r_name" in b.columns:
        calls = [x.filter("kind = 'METHODCALL'") for x in (a, b)]
        no = lambda *told: " AND ".join(f"NOT coalesce(l_{c} = r_{c}, false)" for c in told)
        starts = lambda df, x: df.withColumn("key", F.explode(F.transform(F.sequence(F.lit(0), F.length(f"{x}_name")), lambda i: F.substring(F.col(f"{x}_name"), F.lit(1), i))))
        l, r = calls
        ways.append((key(l, "l", "ret"), key(r, "r", "ret"), no("label")))
        ways.append((key(l, "l", "name"), starts(r, "r"), no("label", "ret")))
        ways.append((starts(l, "l"), key(r, "r", "name"), no("label", "ret", "name")))
        test = f"{test} OR (kind = 'METHODCALL' AND (l_ret = r_ret OR startswith(r_name, l_name) OR startswith(l_name, r_name)))"
    total = tiles.meetings(a, b, ["kind"])[1]
    if total and sum(tiles.meetings(l, r, on)[1] for l, r, _ in ways) >= DENSE * total:
        return tiles.tested(a, b.withColumnRenamed("kind", "r_kind"), F.col("kind") == F.col("r_kind"), F.expr(test), total, most).select("l", "r")
    out = None
    for l, r, where in ways:
        met = tiles.join(l, r, on).filter(where).select("l", "r")
        out = met if out is None else out.unionByName(met)
    return out


def pair_scores(sims: DataFrame) -> DataFrame:
    """SIM-8: of (lhs, rhs, lsim, rsim) the plaintiff's score, the greater side, and the pair's, the lesser."""
    return sims.select("lhs", "rhs", F.greatest("lsim", "rsim").alias("plaintiff"), F.least("lsim", "rsim").alias("score"))
