"""Column expressions for whole texts, shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Words are runs of anything but space and the five control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable is bound, never inlined again by the optimizer."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (in any case of letters), made from the given one."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_of(text: Column, char_class: str) -> Column:
    """How many characters of a regular-expression class a text holds."""
    return F.size(F.split(text, char_class, -1)) - 1
