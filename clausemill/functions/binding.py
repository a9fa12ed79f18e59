"""Values that an expression names several times, worked out once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(word: str) -> str:
    """A text as SQL writes it."""
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def each(items: Column, f: str) -> Column:
    """items with a lambda of SQL applied to each: a long expression is one call to the JVM so, where one of Columns takes thousands."""
    return F.call_function("transform", items, F.expr(f))


def let(name: str, value: str, body: str) -> str:
    """SQL with value worked out once as name in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def told(body: str, **values: Column) -> Column:
    """SQL over s, a struct of the values."""
    return each(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), f"s -> {body}")[0]


def replaced(c: str, *changes: tuple[str, str]) -> str:
    """SQL that replaces (pattern, by) one after the other."""
    for pattern, by in changes:
        c = f"regexp_replace({c}, {quoted(pattern)}, {quoted(by)})"
    return c


def bound(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]
