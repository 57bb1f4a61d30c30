"""A property graph over versioned records: live nodes with any number of labels, live relationships, live vectors.

Nodes and relationships stay in one table each: a label is a filter on the node's list, a type one on the relationship's column, and
hops are equi-joins on ids. `match` and `optional` take such a graph as they take one over tables. Rows have `n.id`, `n.labels`,
`n.props` and `r.id`, `r.type`, `r.src`, `r.dst`, `r.props`; properties are variants, which `prop` reads as a kind of value.

Defined results: a node must have all labels of its pattern; unknown labels and types give no rows; relationships with a missing
end are not there; `uuid` is the property of that name or else the record's id; a property of another kind reads as null, and text
and number are never equal.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import records
from . import versions as V

NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
OF_KIND = {"string": "^STRING", "boolean": "^BOOLEAN", "int": NUMBER, "bigint": NUMBER, "double": NUMBER}


def _typed(value: Column, kind: str) -> Column:
    got = F.try_variant_get(value, "$", kind)
    return F.when(F.schema_of_variant(value).rlike(OF_KIND[kind]), got) if kind in OF_KIND else got


def prop(name: str, kind: str = "string") -> Column:
    """A property of a variable as a kind of value, null where it is missing or of another kind: prop("n.age", "double")."""
    var, _, key = name.rpartition(".")
    got = _typed(F.col(f"`{var}.props`")[key], kind)
    return F.coalesce(got, F.col(f"`{var}.id`")) if (key, kind) == ("uuid", "string") else got


def has_label(var: str, label: str) -> Column:
    """Whether the node has the label; false for a null node."""
    return F.coalesce(F.array_contains(F.col(f"`{var}.labels`"), label), F.lit(False))


def _same(name: str, wanted: Any) -> Column:
    """Null-safe equality with a literal, or with a text column."""
    var, _, key = name.rpartition(".")
    value = F.col(f"`{var}.props`")[key]
    if isinstance(wanted, Column | str):
        return prop(name).eqNullSafe(wanted)
    if wanted is None:
        missing = value.isNull() | F.is_variant_null(value)
        return missing & F.col(f"`{var}.id`").isNull() if key == "uuid" else missing
    if isinstance(wanted, bool):
        return prop(name, "boolean").eqNullSafe(wanted)
    if isinstance(wanted, int):  # a double alone would not tell large numbers apart, a bigint alone cuts fractions
        return prop(name, "double").eqNullSafe(float(wanted)) & prop(name, "bigint").eqNullSafe(wanted)
    if isinstance(wanted, float):
        return prop(name, "double").eqNullSafe(wanted)
    return F.to_json(value).eqNullSafe(F.to_json(F.parse_json(F.lit(json.dumps(wanted)))))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class RecordGraph:
    """nodes: id, labels, props. edges: id, type, src, dst, props, with live ends. vectors: id, property, vec, dim."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame

    def _fits(self, name: str, node: Any) -> Column:
        return _all([has_label(name, x) for x in node.labels] + [_same(f"{name}.{k}", v) for k, v in node.props.items()])

    def _ends(self, name: str, node: Any) -> DataFrame:
        rows = self.nodes.select(*(F.col(c).alias(f"{name}.{c}") for c in ("id", "labels", "props")))
        return rows.filter(self._fits(name, node))

    def _hop(self, rel: Any, var: str, as_stored: bool, loops_once: bool) -> DataFrame:
        edges = self.edges.filter(F.col("type").isin(*rel.types)) if rel.types else self.edges

        def walked(rows: DataFrame, left: str, right: str) -> DataFrame:
            return rows.select(*(F.col(c).alias(f"{var}.{c}") for c in ("id", "type", "src", "dst", "props")), F.col(left).alias(f"{var}.__left"), F.col(right).alias(f"{var}.__right"))

        if rel.direction == "in":
            rows = walked(edges, "dst", "src")
        else:
            rows = walked(edges, "src", "dst")
            if rel.direction == "both" and not as_stored:
                rows = rows.unionAll(walked(edges.filter("src <> dst") if loops_once else edges, "dst", "src"))
        return rows.filter(_all([_same(f"{var}.{k}", v) for k, v in rel.props.items()]))

    def pattern(self, path: list[Any], bound: set[str] | frozenset[str] = frozenset()) -> DataFrame:
        """All matches of a path of nodes and relationships; the rules for undirected ones are those of `match.pattern`."""
        nodes, rels = path[::2], path[1::2]
        names = [n.var or f"__n{k}" for k, n in enumerate(nodes)]
        if not rels:
            return self._shown(self._ends(names[0], nodes[0]))
        free = len(rels) == 1 and not any(n.props.get("uuid") or n.var in bound for n in nodes)
        as_stored = free and not any(n.labels for n in nodes)
        plain = [n.var is None and not n.labels and not n.props for n in nodes]  # live relationships have live ends
        df = None if plain[0] else self._ends(names[0], nodes[0])
        placed = {names[0]}
        for k, r in enumerate(rels):
            var, a, b = r.var or f"__r{k}", names[k], names[k + 1]
            hop = self._hop(r, var, as_stored, free)
            left, right = F.col(f"`{var}.__left`"), F.col(f"`{var}.__right`")
            df = hop.withColumn(f"{a}.id", left) if df is None else df.join(hop, F.col(f"`{a}.id`") == left)
            if b in placed:
                df = df.filter((F.col(f"`{b}.id`") == right) & self._fits(b, nodes[k + 1]))
            elif plain[k + 1]:
                df = df.withColumn(f"{b}.id", right)
            else:
                df = df.join(self._ends(b, nodes[k + 1]), right == F.col(f"`{b}.id`"))
            placed.add(b)
            df = df.drop(f"{var}.__left", f"{var}.__right")
        return self._shown(df)

    def _shown(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f"`{c}`") for c in df.columns if not c.startswith("__")))


def of_versions(versions: DataFrame) -> RecordGraph:
    """The graph of the winners of these versions."""
    won = V.winners(versions)
    nodes = V.live_nodes(won).select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "props")
    return RecordGraph(nodes, V.live_edges(won).select("id", "type", "src", "dst", "props"), V.live_vectors(won).select("id", "property", "vec", "dim"))


def open_folder(spark: SparkSession, folder: str) -> RecordGraph:
    """The graph of a record folder as it is now."""
    return of_versions(records.read(spark, folder)[0])
