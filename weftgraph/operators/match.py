"""Pattern matching: a path of nodes and relationships becomes joins that Catalyst orders.

Rows are a DataFrame whose columns are named `variable.property`, with `variable.id` for identity (refer to them with `p`).
A node's id is its native key where the pattern pins one label, so joins stay on native keys; where several labels are
possible it is the text `label:key`. A property called id or label (of relationships: id or type) is `variable.id_` and so on
(see `shown`); property maps name it as it is. Matching is homomorphic: an edge may be used twice in a path.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.graph import EDGE_OWN, NODE_OWN, EdgeTable, Graph, shown
from .record_graph import RecordGraph


def p(name: str) -> Column:
    """A property or id of a variable: p("n.name")."""
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Node:
    var: str | None
    labels: tuple[str, ...] = ()
    props: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Rel:
    var: str | None
    types: tuple[str, ...]
    direction: str
    props: dict[str, Any] = field(default_factory=dict)


def node(var: str | None = None, *labels: str, **props: Any) -> Node:
    return Node(var, labels, props)


def out(*types: str, var: str | None = None, **props: Any) -> Rel:
    return Rel(var, types, "out", props)


def into(*types: str, var: str | None = None, **props: Any) -> Rel:
    return Rel(var, types, "in", props)


def both(*types: str, var: str | None = None, **props: Any) -> Rel:
    return Rel(var, types, "both", props)


def _same(column: Column, value: Any) -> Column:
    """Property maps compare null-safely: {k: null} finds what lacks k."""
    return column.eqNullSafe(value if isinstance(value, Column) else F.lit(value))


def _with_props(df: DataFrame, prefix: str, props: dict[str, Any], own: tuple[str, ...]) -> DataFrame:
    for k, v in props.items():
        name = f"{prefix}.{shown(k, own)}"
        df = df.filter(_same(p(name), v) if name in df.columns else F.lit(v is None))
    return df


def _candidates(graph: Graph, rel: Rel, left: set[str], right: set[str]) -> list[tuple[EdgeTable, bool]]:
    """Edge tables that may stand here, each with whether it is walked against its direction."""
    found = []
    for e in graph.edges:
        if rel.types and e.type not in rel.types:
            continue
        if rel.direction in ("out", "both") and e.source in left and e.target in right:
            found.append((e, False))
        if rel.direction in ("in", "both") and e.target in left and e.source in right:
            found.append((e, True))
    return found


def _hop(found: list[tuple[EdgeTable, bool]], rel: Rel, var: str, as_text: tuple[bool, bool], once: bool, loops_once: bool, carried: dict[str, dict[str, Any]]) -> DataFrame:
    """The edges of a hop: var.id, var.type, properties, and the ids at its left and right. carried: a node in whose table the edges are, with its property map."""
    frames = []
    for e, turned in found:
        if turned and once:
            continue
        a, b = e.end(e.src, e.source, as_text[turned]), e.end(e.dst, e.target, as_text[not turned])
        names = e.props or tuple(c for c in e.df.columns)
        key = F.concat_ws(":", F.lit(e.type), *(F.col(c).cast("string") for c in e.identity))
        stored = e.df
        if turned and loops_once and e.source == e.target:
            stored = stored.filter(reduce(lambda x, y: x | y, [F.col(i) != F.col(j) for i, j in zip(e.src, e.dst)]))
        df = stored.select(key.alias(f"{var}.id"), F.lit(e.type).alias(f"{var}.type"), (b if turned else a).alias(f"{var}.__left"), (a if turned else b).alias(f"{var}.__right"), *(F.col(c).alias(f"{var}.{shown(c, EDGE_OWN)}") for c in names), *(F.col(c).alias(f"{n}.{shown(c, NODE_OWN)}") for n in carried for c in e.df.columns))
        df = df.filter(p(f"{var}.__left").isNotNull() & p(f"{var}.__right").isNotNull()) if carried else df
        for n, wanted in carried.items():
            df = _with_props(df, n, wanted, NODE_OWN)
        frames.append(_with_props(df, var, rel.props, EDGE_OWN))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _owned(graph: Graph, e: EdgeTable, turned: bool, left: bool) -> bool:
    """Whether the edges are rows of the table of the node at this side, under its key."""
    at_source = left != turned
    table = graph.nodes[e.source if at_source else e.target]
    return table.df is e.df and table.key == (e.src if at_source else e.dst)


def _from_left(df: DataFrame, e: EdgeTable, rel: Rel, var: str, left: str, right_key: tuple[str, ...]) -> DataFrame:
    """A hop whose columns the node at its left has already."""
    of = lambda c: p(f"{left}.{shown(c, NODE_OWN)}")
    right = of(right_key[0]) if len(right_key) == 1 else F.struct(*(of(c).alias(f"k{i}") for i, c in enumerate(right_key)))
    names = e.props or tuple(e.df.columns)
    key = F.concat_ws(":", F.lit(e.type), *(of(c).cast("string") for c in e.identity))
    df = df.select("*", key.alias(f"{var}.id"), F.lit(e.type).alias(f"{var}.type"), right.alias(f"{var}.__right"), *(of(c).alias(f"{var}.{shown(c, EDGE_OWN)}") for c in names))
    return _with_props(df.filter(p(f"{var}.__right").isNotNull()), var, rel.props, EDGE_OWN)


def _nothing(graph: Graph, nodes: list[Node], names: list[str], rels: list[Rel]) -> DataFrame:
    """No rows, with the columns that the variables would have, as far as their labels and types are known."""
    fields: dict[str, T.DataType] = {}
    for n, name in zip(nodes, names):
        tables = [graph.nodes[x] for x in n.labels if x in graph.nodes]
        own = {shown(c.name, NODE_OWN): c.dataType for t in tables for c in t.df.schema}
        native = own[shown(tables[0].key[0], NODE_OWN)] if len(tables) == 1 and len(tables[0].key) == 1 else T.StringType()
        for c, kind in {"id": native, "label": T.StringType(), **{shown(k, NODE_OWN): T.StringType() for k in n.props}, **own}.items():
            fields.setdefault(f"{name}.{c}", kind)
    for k, r in enumerate(rels):
        var = r.var or f"__r{k}"
        fields |= {f"{var}.id": T.StringType(), f"{var}.type": T.StringType()}
        for e in graph.edges:
            if e.type in r.types or not r.types:
                fields |= {f"{var}.{shown(c.name, EDGE_OWN)}": c.dataType for c in e.df.schema if not e.props or c.name in e.props}
    visible = [T.StructField(k, kind) for k, kind in fields.items() if not k.startswith("__")]
    spark = next(iter(graph.nodes.values())).df.sparkSession
    return spark.createDataFrame([], T.StructType(visible))


def pattern(graph: Graph | RecordGraph, path: list[Node | Rel], bound: set[str] = frozenset(), held: set[str] = frozenset()) -> DataFrame:
    """All matches of a path. bound: variables that rows already have, which decides how undirected relationships are read. held: their columns, which are not fetched again."""
    if isinstance(graph, RecordGraph):
        return graph.pattern(path, bound)
    nodes, rels = path[::2], path[1::2]
    names = [n.var or f"__n{k}" for k, n in enumerate(nodes)]
    may = [set(n.labels) & set(graph.nodes) if n.labels else set(graph.nodes) for n in nodes]
    for n, m in zip(nodes, may):
        if len(n.labels) > 1:  # tables have one label each
            m.clear()
    for k, n in enumerate(names):  # a repeated variable is the same node
        for j in range(k):
            if names[j] == n:
                may[k] = may[j] = may[k] & may[j]
    changed = True
    while changed:  # labels that no edge supports go
        changed = False
        for k, r in enumerate(rels):
            found = _candidates(graph, r, may[k], may[k + 1])
            left = {e.target if t else e.source for e, t in found}
            right = {e.source if t else e.target for e, t in found}
            if left != may[k] or right != may[k + 1]:
                may[k], may[k + 1], changed = left, right, True
    if not all(may):  # an unknown label or type, or no relationship between these labels
        return _nothing(graph, nodes, names, rels)
    as_text = [len(m) != 1 for m in may]

    def ends(k: int) -> DataFrame:
        n, name = nodes[k], names[k]
        frames = []
        for label in sorted(may[k]):
            t = graph.nodes[label]
            key = t.text_id() if as_text[k] else t.key_column()
            frames.append(t.df.select(key.alias(f"{name}.id"), F.lit(label).alias(f"{name}.label"), *(F.col(c).alias(f"{name}.{shown(c, NODE_OWN)}") for c in t.df.columns)))
        return _with_props(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), name, n.props, NODE_OWN)

    def needed(k: int) -> bool:
        n = nodes[k]
        if not graph.clean or n.props or n.var is None:
            return not graph.clean or bool(n.props)
        # a node that rows have already is joined by them, by its id, and has its columns there
        return as_text[k] or n.var not in bound or not all(f"{n.var}.{shown(c, NODE_OWN)}" in held for c in graph.nodes[min(may[k])].df.columns)

    # one undirected relationship between ends that are neither labelled nor bound is seen once, as stored
    free = len(rels) == 1 and not any(n.props.get("uuid") or n.var in bound for n in nodes)
    unlabelled = free and not any(n.labels for n in nodes)
    if not rels:
        return ends(0)
    df, placed = None, set()
    for k, r in enumerate(rels):
        var, a, b = r.var or f"__r{k}", names[k], names[k + 1]
        found = _candidates(graph, r, may[k], may[k + 1])
        # a foreign key: the relationship is a row of one end's own table, which needs no join with it
        single = found[0] if len(found) == 1 and not (as_text[k] or as_text[k + 1]) else None
        at_left = single is not None and _owned(graph, *single, left=True)
        at_right = single is not None and _owned(graph, *single, left=False) and b not in placed and needed(k + 1)
        right_key = single and (single[0].src if single[1] else single[0].dst)
        if df is not None and at_left and all(f"{a}.{shown(c, NODE_OWN)}" in df.columns for c in single[0].df.columns):
            df = _from_left(df, single[0], r, var, a, right_key)
            at_right = False
        else:
            take_left = df is None and at_left and needed(0)
            carried = {a: nodes[k].props} if take_left else {b: nodes[k + 1].props} if at_right else {}
            hop = _hop(found, r, var, (as_text[k], as_text[k + 1]), once=unlabelled and r.direction == "both", loops_once=free and r.direction == "both", carried=carried)
            at_right = at_right and not take_left
            if df is not None:
                df = df.join(hop, p(f"{a}.id") == p(f"{var}.__left"))
            elif needed(0) and not take_left:
                df = ends(0).join(hop, p(f"{a}.id") == p(f"{var}.__left"))
            else:
                df = hop
                if not take_left:
                    df = df.withColumn(f"{a}.id", p(f"{var}.__left"))
            if take_left:
                df = df.withColumn(f"{a}.id", p(f"{var}.__left")).withColumn(f"{a}.label", F.lit(min(may[0])))
        placed.add(a)
        if b in placed:
            df = df.filter(p(f"{b}.id") == p(f"{var}.__right"))
        elif at_right:
            df = df.withColumn(f"{b}.id", p(f"{var}.__right")).withColumn(f"{b}.label", F.lit(min(may[k + 1])))
        elif needed(k + 1):
            df = df.join(ends(k + 1), p(f"{var}.__right") == p(f"{b}.id"))
        else:
            df = df.filter(p(f"{var}.__right").isNotNull()).withColumn(f"{b}.id", p(f"{var}.__right"))
        placed.add(b)
        df = df.drop(f"{var}.__left", f"{var}.__right")
    hidden = [c for c in df.columns if c.startswith("__")]
    return df.select(*(p(c) for c in df.columns if c not in hidden))


def variables(df: DataFrame) -> set[str]:
    return {c.rpartition(".")[0] for c in df.columns if c.endswith(".id")}


def match(graph: Graph | RecordGraph, *path: Node | Rel, rows: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """Matches of the path, joined with rows on the variables that they share; a product where they share none."""
    got = pattern(graph, list(path), variables(rows) if rows is not None else set(), set(rows.columns) if rows is not None else set())
    if rows is not None:
        shared = sorted(variables(rows) & variables(got))
        got = _join(rows, got, shared, None, "inner") if shared else rows.crossJoin(got)
    return got if where is None else got.filter(where)


def optional(graph: Graph | RecordGraph, rows: DataFrame, *path: Node | Rel, where: Column | None = None) -> DataFrame:
    """Every row with its matches, or once with nulls; where is part of the match."""
    got = pattern(graph, list(path), variables(rows), set(rows.columns))
    return _join(rows, got, sorted(variables(rows) & variables(got)), where, "left")


def _join(rows: DataFrame, got: DataFrame, shared: list[str], where: Column | None, how: str) -> DataFrame:
    renamed = got.select(*(p(c).alias(f"__{c}") if c.rpartition(".")[0] in shared else p(c) for c in got.columns))
    on = [p(f"{v}.id") == p(f"__{v}.id") for v in shared]
    if where is not None:
        on.append(where)
    joined = rows.join(renamed, reduce(lambda a, b: a & b, on) if on else F.lit(True), how)
    extra = [c for c in got.columns if c.rpartition(".")[0] in shared and c not in rows.columns]
    return joined.select(*(p(c) for c in rows.columns), *(p(f"__{c}").alias(c) for c in extra), *(p(c) for c in got.columns if c.rpartition(".")[0] not in shared))
