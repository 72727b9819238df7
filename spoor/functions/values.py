"""Comparison of strings, stack values and computed values.

Computed values are trees; a table of their nodes (expr_id, op, lhs, rhs) gets canonical
hashes bottom-up, so that two trees match when their hashes are equal.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def string_match(a: Column, b: Column) -> Column:
    """FN-24 on (kind, parts): symbolic always; concrete by text; composite by size and the first part alone, as in the original."""
    either = (a["kind"] == "symbolic") & (b["kind"] == "symbolic")
    text = (a["kind"] == "concrete") & (b["kind"] == "concrete") & (F.get(a["parts"], F.lit(0)) == F.get(b["parts"], F.lit(0)))
    many = (a["kind"] == "composite") & (b["kind"] == "composite") & (F.size(a["parts"]) == F.size(b["parts"])) & (F.get(a["parts"], F.lit(0)) == F.get(b["parts"], F.lit(0)))
    return F.coalesce(either | text | many, F.lit(False))


def stack_match(a: Column, b: Column) -> Column:
    """FN-25 on VAL structs with a canonical hash: nil, references by id, symbols by type, computed by hash, literals by FN-27."""
    from spoor.functions.codes import number_match

    same = a["tag"] == b["tag"]
    number = number_match(a["text"].try_cast("double"), b["text"].try_cast("double"))
    return F.coalesce(
        same
        & F.when(a["tag"] == "nil", True).when(a["tag"] == "ref", a["heap_id"] == b["heap_id"]).when(a["tag"] == "symbol", a["type"] == b["type"])
        .when(a["tag"] == "expr", a["canon"] == b["canon"]).otherwise((a["text"] == b["text"]) | F.coalesce(number, F.lit(False))),
        F.lit(False),
    )


def canonical(exprs: DataFrame) -> DataFrame:
    """FN-26: (expr_id, canon): hashes of expression trees; both operands of every operator commute, not and cast unwrap.

    exprs is (expr_id, op, lhs, rhs, leaf); a leaf has text, the others operands.  Rounds are
    as many as the deepest tree has levels.
    """
    from spoor.operators.graph import _spill

    done = exprs.filter("leaf is not null").select("expr_id", F.xxhash64("leaf").alias("canon"))
    rest = exprs.filter("leaf is null")
    for n in count(1):
        l, r = done.select(F.col("expr_id").alias("lhs"), F.col("canon").alias("lc")), done.select(F.col("expr_id").alias("rhs"), F.col("canon").alias("rc"))
        ready = rest.join(l, "lhs").join(r, "rhs", "left").filter("rhs is null or rc is not null")
        value = F.when(F.col("op").isin("NOT", "CAST"), F.col("lc")).otherwise(F.xxhash64("op", F.least("lc", "rc"), F.greatest("lc", "rc")))
        new = _spill(ready.select("expr_id", value.alias("canon")).join(done, "expr_id", "left_anti"), "new")
        if new.isEmpty():
            break
        done = done.unionByName(new)
        rest = rest.join(new.select("expr_id"), "expr_id", "left_anti")
        if n % 4 == 0:  # plans stay short however deep the trees are
            done, rest = _spill(done, "done"), _spill(rest, "rest")
    return done
