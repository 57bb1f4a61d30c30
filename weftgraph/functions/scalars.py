"""Expressions with the query language's meaning where Spark's own differ. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of any script, at one end or both.
LEADING, TRAILING = "(?U)^\\s+", "(?U)\\s+$"


def truth(x: Column, kind: str = "boolean") -> Column:
    """Two-valued logic: null is false; numbers are true unless 0, texts and lists unless empty."""
    as_bool = {"boolean": lambda: x, "number": lambda: x != 0, "string": lambda: x != "", "array": lambda: F.size(x) > 0}[kind]()
    return F.coalesce(as_bool, F.lit(False))


def not_(x: Column) -> Column:
    """True also where x is null."""
    return ~truth(x)


def equal(a: Column, b: Column, kind_a: str, kind_b: str) -> Column:
    """Null if either side is; values of different kinds are never equal, whatever their text."""
    if kind_a == kind_b:
        return a == b
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))


def is_in(x: Column, values: Column) -> Column:
    """Null for a null list only; null is equal to null."""
    return F.when(values.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(F.exists(values, lambda v: v.eqNullSafe(x)), F.lit(False)))


def size(x: Column, kind: str) -> Column:
    of = {"array": lambda: F.size(x), "string": lambda: F.char_length(x), "map": lambda: F.size(F.map_keys(x))}[kind]()
    return F.when(x.isNotNull(), of.cast("long"))


def to_string(x: Column, kind: str = "string") -> Column:
    if kind == "boolean":
        return F.when(x.isNotNull(), F.when(x, F.lit("True")).otherwise(F.lit("False")))
    if kind in ("array", "map"):
        return F.to_json(x)
    return x.cast("string")


def to_lower(x: Column) -> Column:
    return F.lower(x.cast("string"))


def to_upper(x: Column) -> Column:
    return F.upper(x.cast("string"))


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"{LEADING}|{TRAILING}", "")


def ltrim(x: Column) -> Column:
    return F.regexp_replace(x, LEADING, "")


def rtrim(x: Column) -> Column:
    return F.regexp_replace(x, TRAILING, "")


def replace(x: Column, find: str, by: str | None) -> Column:
    """Literal; null text for `by` is empty."""
    return F.replace(x, F.lit(find), F.lit(by or ""))


def split(x: Column, by: str) -> Column:
    """By a literal delimiter."""
    if not by:
        raise ValueError("split needs a delimiter")
    import re

    return F.split(x, re.escape(by), -1)


def substring(x: Column, start: int, length: int | None = None) -> Column:
    """From a place counted from 0."""
    if start < 0 or (length or 0) < 0:
        raise ValueError("substring counts from 0")
    return F.substring(x, F.lit(start + 1), F.lit(2**31 - 1 if length is None else length))


def to_float(x: Column) -> Column:
    return x.try_cast("double")


def to_integer(x: Column) -> Column:
    """Towards zero; null for what isn't a number."""
    return x.try_cast("double").try_cast("long")


def at(x: Column, i: int) -> Column:
    """Element i of a list: from the end if negative, null outside."""
    return F.try_element_at(x, F.lit(i + 1 if i >= 0 else i))


def append(x: Column, value: Column) -> Column:
    """list + scalar; a null list is empty."""
    return F.array_append(F.coalesce(x, F.array()), value)


def prepend(value: Column, x: Column) -> Column:
    return F.array_prepend(F.coalesce(x, F.array()), value)


def concat_lists(a: Column, b: Column) -> Column:
    """A null list leaves the other one as it is."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.concat(a, b))


def plus(a: Column, b: Column, kind_a: str, kind_b: str) -> Column:
    """Addition; text if either side is text."""
    if "string" in (kind_a, kind_b):
        return F.concat(to_string(a, kind_a), to_string(b, kind_b))
    return a + b


def divide(a: Column, b: Column) -> Column:
    """True division; dividing by zero is an error."""
    return a.cast("double") / b


def comprehension(values: Column, keep: Callable[[Column], Column] | None = None, make: Callable[[Column], Column] | None = None) -> Column:
    """[x IN values WHERE keep(x) | make(x)]; null for a null list."""
    if keep is not None:
        values = F.filter(values, lambda x: truth(keep(x)))
    return values if make is None else F.transform(values, make)


def properties(df: DataFrame, var: str) -> Column:
    """All properties of a variable as a struct."""
    names = [c for c in df.columns if c.startswith(f"{var}.") and c.rpartition(".")[2] not in ("id", "label", "type")]
    return F.struct(*(F.col(f"`{c}`").alias(c.rpartition(".")[2]) for c in names))


class Registry:
    """User functions by name, in any case: Column builders, or Python callables that run on Arrow batches."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[..., Column]] = {}

    def column(self, *names: str) -> Callable:
        def add(f: Callable[..., Column]) -> Callable[..., Column]:
            self.known.update({n.lower(): f for n in names})
            return f

        return add

    def scalar(self, *names: str, returns: str | T.DataType) -> Callable:
        """A callable over pandas Series."""
        return lambda f: self.column(*names)(F.pandas_udf(f, returns))

    def aggregate(self, *names: str, returns: str | T.DataType) -> Callable:
        """A callable from a pandas Series to one value."""
        from pyspark.sql.pandas.functions import PandasUDFType

        return lambda f: self.column(*names)(F.pandas_udf(f, returns, PandasUDFType.GROUPED_AGG))

    def __call__(self, name: str, *args: Any) -> Column:
        if name.lower() not in self.known:
            raise KeyError(f"unknown function {name}; known: {', '.join(sorted(self.known))}")
        return self.known[name.lower()](*args)
