"""Clauses over rows: grouping by identity, ordering with nulls last, slices, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import p


def order(df: DataFrame, *keys: str | tuple[str, str], skip: int = 0, limit: int | None = None) -> DataFrame:
    """Sorted by several keys, nulls last in either direction; a key is a name or (name, "desc")."""
    by = [p(k).asc_nulls_last() if isinstance(k, str) else p(k[0]).desc_nulls_last() for k in keys]
    df = df.orderBy(*by)
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)


def group(df: DataFrame, variables: list[str], *aggregates: Column) -> DataFrame:
    """Grouped by the identity of variables; their properties are carried along."""
    keys = [p(f"{v}.id") for v in variables]
    carried = [F.first(p(c)).alias(c) for v in variables for c in df.columns if c.startswith(f"{v}.") and c != f"{v}.id"]
    return df.groupBy(*keys).agg(*carried, *aggregates)


def collect(x: Column, distinct: bool = False) -> Column:
    """Non-null values as a list, sorted, since a distributed group has no first-seen order."""
    return F.sort_array(F.collect_set(x) if distinct else F.collect_list(x))


def unwind(df: DataFrame, values: Column, name: str) -> DataFrame:
    """A row per element; none for null and empty lists."""
    return df.select("*", F.explode(values).alias(name))


def union(*parts: DataFrame, all: bool = False) -> DataFrame:
    """Concatenation by name; without all, equal rows of the whole result are one."""
    if any(set(x.columns) != set(parts[0].columns) for x in parts):
        raise ValueError("the parts of a union have different columns")
    whole = reduce(DataFrame.unionByName, parts)
    return whole if all else whole.dropDuplicates()
