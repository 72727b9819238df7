"""Stack arithmetic with Java's results: integers wrap, division truncates, comparisons are on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wrap(value: Column, bits: int) -> Column:
    """A whole number (as decimal) folded into a signed integer of ``bits`` bits."""
    # as text: beyond 64 bits a literal is no long
    size, half = (F.lit(str(x)).cast("decimal(38,0)") for x in (1 << bits, 1 << (bits - 1)))
    n = value.cast("decimal(38,0)")
    return (F.pmod(n + half, size) - half).cast("int" if bits <= 32 else "bigint")


def add(a: Column, b: Column, bits: int = 32) -> Column:
    """FN-1."""
    return _wrap(a.cast("decimal(19,0)") + b.cast("decimal(19,0)"), bits)


#: Numeric types from the one that wins; a sum of characters is an int whatever the other operand (fixed values).
PROMOTION = ("D", "F", "J", "I", "S", "B")
NUMBER = "struct<type:string,whole:bigint,real:double>"


def number(type_code: Column, value: Column) -> Column:
    """A typed number: whole ones (characters by code) beside real ones."""
    real = type_code.isin("D", "F")
    return F.struct(type_code.alias("type"), F.when(~real, value.cast("bigint")).alias("whole"), F.when(real, value.cast("double")).alias("real"))


def promoted(a: Column, b: Column) -> Column:
    """FN-1: the type of a result of two typed numbers; null where a boolean takes part, which the original leaves open."""
    either = lambda t: (a["type"] == t) | (b["type"] == t)
    out = F.when(either("C"), "I").when(either("Z"), None)
    for t in PROMOTION:
        out = out.when(either(t), t)
    return out


def promoted_add(a: Column, b: Column) -> Column:
    """FN-1: the sum of two typed numbers with promotion and Java's wrap-around; null where there is none.

    A real operand beside a character is cut to an int first, at the ends of its range where it is beyond.
    """
    t = promoted(a, b)
    cut = lambda c: F.when(F.isnan(c), F.lit(0.0)).otherwise(F.least(F.greatest(c, F.lit(-2147483648.0)), F.lit(2147483647.0))).cast("bigint")
    whole = lambda x: F.coalesce(x["whole"], cut(x["real"])).cast("decimal(20,0)")
    real = lambda x: F.coalesce(x["real"], x["whole"].cast("double"))
    total = whole(a) + whole(b)
    bits = {"J": 64, "I": 32, "S": 16, "B": 8}
    folded = None
    for code, n in bits.items():
        folded = F.when(t == code, _wrap(total, n).cast("bigint")) if folded is None else folded.when(t == code, _wrap(total, n).cast("bigint"))
    single = (real(a).cast("float") + real(b).cast("float")).cast("double")
    fraction = F.when(t == "D", real(a) + real(b)).when(t == "F", single)
    return F.when(t.isNotNull(), F.struct(t.alias("type"), folded.alias("whole"), fraction.alias("real")))


def number_text(x: Column) -> Column:
    """A typed number as text."""
    return F.coalesce(x["whole"].cast("string"), x["real"].cast("string"))


def object_add(a: Column, b: Column) -> Column:
    """FN-10 on structs (text, number): a text operand makes a concatenation, boxed numbers are taken out and added."""
    both = promoted_add(a["number"], b["number"])
    joined = F.concat(F.coalesce(a["text"], number_text(a["number"])), F.coalesce(b["text"], number_text(b["number"])))
    texts = a["text"].isNotNull() | b["text"].isNotNull()
    none = F.lit(None)
    return F.struct(F.when(texts, joined).alias("text"), F.when(texts, none.cast(NUMBER)).otherwise(both).alias("number"))


def sub(a: Column, b: Column, bits: int = 32) -> Column:
    """FN-2."""
    return _wrap(a.cast("decimal(19,0)") - b.cast("decimal(19,0)"), bits)


def mul(a: Column, b: Column, bits: int = 32) -> Column:
    """FN-3 for factors of at most 32 bits."""
    return _wrap(a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), bits)


def div(a: Column, b: Column) -> Column:
    """FN-4: truncated; null (a halted run) for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a, b))


def mod(a: Column, b: Column) -> Column:
    """FN-5: the sign of the dividend; null for a zero divisor."""
    return F.when(b != 0, a % b)


def shifts(a: Column, n: int) -> tuple[Column, Column, Column]:
    """FN-6: left, right and unsigned right."""
    return F.shiftleft(a, n), F.shiftright(a, n), F.shiftrightunsigned(a, n)


def compare(a: Column, b: Column) -> Column:
    """FN-7/8: the sign of a - b as doubles."""
    return F.signum(a.cast("double") - b.cast("double")).cast("int")


def logic(a: Column, b: Column) -> dict[str, Column]:
    """FN-9: boolean operators; each is recorded under its own name."""
    return {"NOT": ~a, "AND": a & b, "OR": a | b, "XOR": a != b}


def stringified(value: Column) -> Column:
    """FN-11: a value as text."""
    return value.cast("string")


def concat(a: Column, b: Column) -> Column:
    """FN-10, FN-11: string concatenation of any two operands."""
    return F.concat(stringified(a), stringified(b))


#: FN-15: default values of primitive types (fixed values).
DEFAULTS = {"Z": "false", "B": "0", "C": "0", "S": "0", "I": "0", "J": "0", "F": "0.0", "D": "0.0"}


def default_value(type_code: Column) -> Column:
    """FN-15: the default of a primitive type as text; references have none."""
    out = None
    for code, text in DEFAULTS.items():
        out = F.when(type_code == code, text) if out is None else out.when(type_code == code, text)
    return out


def literal(text: Column, type_code: Column) -> Column:
    """FN-12: the number that a literal stands for: an L suffix goes, booleans count as 0 and 1."""
    bare = F.regexp_replace(text, "[lL]$", "")
    return F.when(type_code == "Z", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(bare.try_cast("double"))


def java_cast(value: Column, type_code: str) -> Column:
    """FN-13: a number narrowed as Java does: integers wrap, fractions are cut."""
    if type_code in ("F", "D"):
        return value.cast("float" if type_code == "F" else "double")
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return _wrap(whole, {"I": 32, "J": 64}[type_code])
