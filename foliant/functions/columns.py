"""Column helpers that the rule operators share. Python's text rules are kept: \\s and \\d are Unicode, round() is half-even."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING = "struct<severity:string,page:int,block_id:string,evidence:string,message:string,suggestion:string,confidence:string,layer:string>"
EMPTY = f"array<{FINDING}>"


def of(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """f as a function of one parameter, where it binds more by default: Spark passes an index to functions of two."""
    return lambda x: f(x)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value made once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), of(f)), F.lit(0))


def texts(*parts: str | Column) -> Column:
    """The parts as one string; null parts as empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def finding(rule, message: Column, suggestion: Column | str = "", page: Column | None = None, block: Column | None = None, evidence: Column | None = None, manual: bool = False) -> Column:
    """A finding of a rule; a manual one is an info that a person has to settle. Evidence is cut at 200 characters."""
    none = lambda t: F.lit(None).cast(t)
    return F.struct(
        F.lit("info" if manual else rule.severity).alias("severity"),
        (page.cast("int") if page is not None else none("int")).alias("page"),
        (block if block is not None else none("string")).alias("block_id"),
        F.substring(evidence if evidence is not None else F.lit(""), 1, 200).alias("evidence"),
        message.alias("message"),
        (F.lit(suggestion) if isinstance(suggestion, str) else suggestion).alias("suggestion"),
        F.lit("manual_required" if manual else "deterministic").alias("confidence"),
        F.lit("rule").alias("layer"),
    )


def given(condition: Column, found: Column) -> Column:
    """[found] where the condition holds, else []."""
    return F.when(condition, F.array(found)).otherwise(none())


def none() -> Column:
    return F.array().cast(EMPTY)


def joined(*lists: Column) -> Column:
    return F.concat(none(), *lists)


#: Characters that are white space in Unicode, as \\s of a pattern with (?U) has them.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def java(pattern: str) -> str:
    """A Python pattern for Java: named groups, and Unicode classes."""
    return "(?U)" + re.sub(r"\(\?P<", "(?<", pattern)


def whole(c: Column, pattern: str) -> Column:
    """fullmatch."""
    return F.regexp_like(c, F.lit(rf"(?U)\A(?:{java(pattern).removeprefix('(?U)')})\z"))


def quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def mode(values: Column) -> Column:
    """The most frequent item of an array; of equally frequent ones the first seen. Null for none."""

    def of_array(values: Column) -> Column:
        count = lambda x: F.size(F.filter(values, lambda y: y == x))
        ranked = F.transform(F.array_distinct(values), lambda x, i: F.struct(count(x).alias("n"), (-i).alias("i"), x.alias("v")))
        return F.array_max(ranked)["v"]

    return let(values, of_array)


def sum_of(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x.cast(kind))
