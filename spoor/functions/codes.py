"""Scalar functions on record kinds, names and signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that feature names may not hold, and what stands for them, in order (fixed values).
SANITISED = (
    ("<", "LESS"), (">", "GRTR"), ("[", "LBRACE"), ("]", "RBRACE"), ("(", "LPAR"), (")", "RPAR"), ("{", "LBRACKET"), ("}", "RBRACKET"),
    ("/", "DIV"), (".", "DOT"), (",", "COMA"), ("#", "HASH"), (" ", "SPACE"), ("%", "PERC"), ("@", "AT"), ("+", "PLUS"), ("-", "MINUS"),
    ("=", "EQUALS"), ("*", "MULTIPLY"), ('"', "QUOTE"), ("'", "SQUOTE"), ("\n", "NL"), ("\r", "CF"), ("\t", "TAB"), ("\f", "_ff"),
    ("\0", "_null"), (":", "COLON"), (";", "SEMI"),
)

#: The older form for features of branches, in order (fixed values).
SANITISED_BRANCH = (
    ("<", "_LESS_"), (">", "_GRTR_"), ("[", "_LBRACE_"), ("]", "_RBRACE_"), ("(", "_LPAR_"), (")", "_RPAR_"), ("/", "_DIV_"), (".", "_DOT_"), (",", "_COMA_"),
    ("#", "_HASH_"), (" ", "_SPACE_"), ("%", "PERC"), ("@", "AT"), ("+", "PLUS"), ("-", "MINUS"), ("=", "EQUALS"), ("*", "MULTIPLY"),
)

#: Codes of record kinds; {t} takes the record's type or signature (fixed values).
RECORD_CODES = {
    "EntryMethod": "EM", "EntryScope": "Es", "EntryParameter": "Ep{t}", "StaticLibraryMethodCall": "Sm{t}", "InstanceLibraryMethodCall": "Im{t}",
    "SynthesisedReturnValue": "Xr{t}", "StaticFieldPut": "Sp{t}", "ObjectFieldPut": "Op", "ArrayMemberPut": "Ap", "ArrayMemberGet": "Ag",
    "DefaultInstanceFieldValue": "Di", "DefaultStaticFieldValue": "Ds{t}", "StackTransformation": "St{t}", "NotValueTransformation": "N",
    "StackCast": "Sc{t}", "StringConcat": "Stc", "Stringification": "Stf{t}", "Assertion": "A", "Halt": "H", "UncaughtException": "Ue{t}",
}

#: Primitive type codes (fixed values).
PRIMITIVES = {"Z": "boolean", "B": "byte", "C": "char", "S": "short", "I": "int", "J": "long", "F": "float", "D": "double", "V": "void"}


def sanitise(name: Column, table: tuple[tuple[str, str], ...] = SANITISED) -> Column:
    """FN-30: a name fit for a feature; FN-31 with the older table (averages use the same one)."""
    for old, new in table:
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def record_code(kind: Column, detail: Column, codes: dict[str, str] = RECORD_CODES) -> Column:
    """PRJ-4: the short code of a record."""
    out = None
    for k, code in codes.items():
        value = F.concat(F.lit(code[: -len("{t}")]), F.coalesce(detail, F.lit(""))) if code.endswith("{t}") else F.lit(code)
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return out


def generalise(type_sig: Column, other: str = "_ReferenceType_") -> Column:
    """PRJ-5: library types keep their name."""
    return F.when(type_sig.contains("Ljava"), type_sig).otherwise(F.lit(other))


def signature(sig: Column) -> Column:
    """FN-32: "Ldecl;name(args)ret" as a struct: declaring class, name, argument types, return type."""
    args = F.regexp_extract(sig, r"\(([^)]*)\)", 1)
    return F.struct(
        F.regexp_extract(sig, r"^(?:L([^;]+);)?", 1).alias("declaring"),
        F.regexp_extract(sig, r"^(?:L[^;]+;)?([^(]*)\(", 1).alias("name"),
        F.regexp_extract_all(args, F.lit(r"(\[*(?:[ZBCSIJFDV]|L[^;]+;))"), 1).alias("args"),
        F.regexp_extract(sig, r"\)(.*)$", 1).alias("ret"),
    )


def signature_text(s: Column) -> Column:
    """FN-33: the text of a parsed signature."""
    return F.concat(F.when(s["declaring"] != "", F.concat(F.lit("L"), s["declaring"], F.lit(";"))).otherwise(""), s["name"], F.lit("("), F.array_join(s["args"], ""), F.lit(")"), s["ret"])


def value_label(number: Column, type_name: Column) -> Column:
    """FN-37: what a concrete stack value is called."""
    return F.concat(number.cast("string"), F.lit(" "), type_name)


def string_label(kind: Column, text: Column, inner: Column, own: Column) -> Column:
    """FN-37 for strings: concrete ones by text, symbolic ones by number, stringified ones by their value's label, composites by id.

    ``own`` is the row's id: the original takes the object's address, which no second run repeats.
    """
    return (
        F.when(kind == "concrete", F.when(text == "", "EMPTY").otherwise(text)).when(kind == "symbolic", F.concat(F.lit("#"), text, F.lit(" STRING")))
        .when(kind == "stack", inner).when(kind == "composite", F.concat(F.lit("#CS:"), own.cast("string")))
    )


def path_safe(name: Column) -> Column:
    """FN-34."""
    return F.translate(name, '/"', "..")


def level_tag(name: Column, tag: str) -> Column:
    """FN-36: the number after ``-tag`` in a variant's id, exact where the original matched prefixes."""
    return F.regexp_extract(name, rf"-{tag}(\d+)(?:-|$)", 1)


def type_match(a: Column, b: Column) -> Column:
    """FN-23: equal types; arrays by component; any two primitives; equal classes."""
    strip = lambda c, o: F.substring(c, F.least(F.length(F.regexp_extract(c, r"^\[*", 0)), F.length(F.regexp_extract(o, r"^\[*", 0))) + 1, F.length(c))
    x, y = strip(a, b), strip(b, a)
    prim = list(PRIMITIVES)
    return (x == y) | (x.isin(*prim) & y.isin(*prim))


def number_match(a: Column, b: Column) -> Column:
    """FN-27: equal as doubles or as truncated integers."""
    trunc = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))
    return (a == b) | (trunc(a) == trunc(b))


def edge_match(a: Column, b: Column) -> Column:
    """FN-20."""
    return ((a == b) | ((a == "PARAMETER") & (b == "SCOPE")) | ((a == "SCOPE") & (b == "PARAMETER"))).cast("int")


def call_match(a: Column, b: Column) -> Column:
    """FN-21 for parsed signatures: names equal or one a prefix of the other, or the same return type."""
    return (a["name"].startswith(b["name"]) | b["name"].startswith(a["name"]) | (a["ret"] == b["ret"])).cast("int")


def composition_match(a: Column, b: Column) -> Column:
    """FN-22, SET-4: owned types: not both empty, equal numbers, and no type of b is missing in a."""
    return (F.size(a) > 0) & (F.size(a) == F.size(b)) & (F.size(F.array_except(b, a)) == 0)
