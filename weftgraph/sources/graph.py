"""A property graph over DataFrames: a table per node label, and tables per relationship type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Names that a pattern gives to nodes and relationships itself; properties of these names get an underscore more.
NODE_OWN, EDGE_OWN = ("id", "label"), ("id", "type")


def shown(name: str, own: tuple[str, ...]) -> str:
    """The name of a property beside such names: id -> id_, id_ -> id__."""
    return f"{name}_" if name.rstrip("_") in own else name


def _rows(source: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    return source() if callable(source) else source


def _key(columns: tuple[str, ...]) -> Column:
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(columns)))


@dataclass(frozen=True)
class NodeTable:
    """The nodes of one label; key columns hold their ids, one column or several. source: their rows, or what reads them when a query asks."""

    label: str
    source: DataFrame | Callable[[], DataFrame]
    key: tuple[str, ...]

    @property
    def df(self) -> DataFrame:
        return _rows(self.source)

    def key_column(self) -> Column:
        return _key(self.key)

    def text_id(self) -> Column:
        """An id that is unique over all labels."""
        return F.concat_ws(":", F.lit(self.label), *(F.col(k).cast("string") for k in self.key))


@dataclass(frozen=True)
class EdgeTable:
    """Relationships of one type between two labels. identity: columns that tell parallel edges apart."""

    type: str
    rows: DataFrame | Callable[[], DataFrame]
    source: str
    target: str
    src: tuple[str, ...]
    dst: tuple[str, ...]
    identity: tuple[str, ...] = ()
    props: tuple[str, ...] = ()

    @property
    def df(self) -> DataFrame:
        return _rows(self.rows)

    def end(self, columns: tuple[str, ...], label: str, as_text: bool) -> Column:
        if as_text:
            return F.concat_ws(":", F.lit(label), *(F.col(c).cast("string") for c in columns))
        return _key(columns)


@dataclass
class Graph:
    """The catalog that patterns are matched against.

    clean: every edge's ends are known to exist, so an end of which nothing is asked need not be joined."""

    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: list[EdgeTable] = field(default_factory=list)
    clean: bool = True

    def add_nodes(self, label: str, df: DataFrame | Callable[[], DataFrame], *key: str) -> Graph:
        self.nodes[label] = NodeTable(label, df, key)
        return self

    def add_edges(self, type: str, df: DataFrame | Callable[[], DataFrame], source: str, target: str, src: str | tuple[str, ...], dst: str | tuple[str, ...], identity: tuple[str, ...] = (), props: tuple[str, ...] = ()) -> Graph:
        one = lambda x: (x,) if isinstance(x, str) else tuple(x)
        self.edges.append(EdgeTable(type, df, source, target, one(src), one(dst), identity or (*one(src), *one(dst)), props))
        return self

    def scan(self, *labels: str) -> DataFrame:
        """Nodes of any of the labels (all, if none are given) under ids unique over labels: id, labels and their properties, null where a label has none."""
        tables = [self.nodes[x] for x in labels or self.nodes]
        frames = [t.df.select(t.text_id().alias("id"), F.array(F.lit(t.label)).alias("labels"), *(F.col(c).alias(shown(c, ("id", "labels"))) for c in t.df.columns)) for t in tables]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def label_counts(self) -> DataFrame:
        """label, n: the number of nodes of each label."""
        frames = [t.df.select(F.lit(t.label).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")) for t in self.nodes.values()]
        return reduce(DataFrame.unionAll, frames)

    def type_counts(self) -> DataFrame:
        """type, n: the number of relationships of each type."""
        frames = [t.df.select(F.lit(t.type).alias("type")) for t in self.edges]
        return reduce(DataFrame.unionAll, frames).groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def dangling(self, type: str) -> DataFrame:
        """Edges of a type with a missing end, as stored; the edges are read once."""
        frames = []
        for e in (e for e in self.edges if e.type == type):
            there = []
            for columns, table in ((e.src, self.nodes[e.source]), (e.dst, self.nodes[e.target])):
                on = reduce(lambda a, b: a & b, [F.col(f"e.{c}").outer() == F.col(f"n.{k}") for c, k in zip(columns, table.key)])
                there.append(table.df.select(*table.key).alias("n").filter(on).exists())
            frames.append(e.df.alias("e").filter(~there[0] | ~there[1]))
        return reduce(DataFrame.unionAll, frames)

    def neighbors(self, label: str, key, type: str | None = None) -> DataFrame:
        """id: the distinct ends of the node's outgoing relationships."""
        frames = []
        for e in (e for e in self.edges if e.source == label and type in (None, e.type)):
            frames.append(e.df.filter(F.col(e.src[0]) == F.lit(key)).select(F.lit(e.target).alias("label"), e.end(e.dst, e.target, False).cast("string").alias("id")))
        return reduce(DataFrame.unionAll, frames).distinct()
