"""Versioned records: last write wins, liveness, dangling edges, compaction and checks.

A version is a row kind, id, property, updated_at, counter, writer, tombstone, v, record (the JSON line), with labels, type,
src, dst and props parsed. The winner of an id has the largest (updated_at, counter, writer, tombstone, v, record); the whole
record wins. It is one hash aggregation with partial combining, so hot ids cost no skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOCK = ("updated_at", "counter", "writer", "tombstone", "v", "record")


def last_write(df: DataFrame, keys: list[str], clock: list[str | Column]) -> DataFrame:
    """One row per key: the one with the largest clock, all of its columns."""
    names = df.columns
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*clock)).alias("__best"))
    return best.select(*(F.col(f"__best.{n}").alias(n) for n in names))


def winners(versions: DataFrame) -> DataFrame:
    return last_write(versions, ["kind", "id", "property"], list(CLOCK))


def live_nodes(won: DataFrame) -> DataFrame:
    return won.filter("kind = 'node' and not tombstone")


def live_edges(won: DataFrame) -> DataFrame:
    """Edges whose ends are both live."""
    edges, ids = won.filter("kind = 'edge' and not tombstone"), live_nodes(won).select("id")
    at_source = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return at_source.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def dangling_edges(won: DataFrame) -> DataFrame:
    edges, ids = won.filter("kind = 'edge' and not tombstone"), live_nodes(won).select("id")
    no_source = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti")
    rest = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return no_source.unionByName(rest.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti"))


def live_vectors(won: DataFrame) -> DataFrame:
    """Vectors whose owner, a node or an edge, is live."""
    owners = live_nodes(won).select("id").unionAll(live_edges(won).select("id"))
    return won.filter("kind = 'vector' and not tombstone").join(owners, "id", "left_semi")


def compacted(versions: DataFrame, writer: str) -> DataFrame:
    """What this writer's files need to hold: its own winners; its edges only if not dangling; tombstones stay for ever."""
    won = winners(versions)
    mine = F.col("writer").isin(writer, "")
    kept = live_nodes(won).unionByName(live_edges(won).select(won.columns)).unionByName(won.filter("kind = 'vector' and not tombstone"))
    return kept.filter(mine).unionByName(won.filter(F.col("tombstone") & mine))


def label_catalogue(won: DataFrame) -> DataFrame:
    """what, name, n: node labels, relationship types and vector properties."""
    labels = live_nodes(won).select(F.lit("label").alias("what"), F.explode("labels").alias("name"))
    types = live_edges(won).select(F.lit("type").alias("what"), F.col("type").alias("name"))
    vectors = live_vectors(won).select(F.lit("vector").alias("what"), F.col("property").alias("name"))
    return labels.unionAll(types).unionAll(vectors).groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"))


def report(versions: DataFrame, skipped: DataFrame, torn: DataFrame) -> DataFrame:
    """check, n: what a doctor would look at."""
    won = winners(versions)
    count = lambda df, name: df.select(F.lit(name).alias("check")).groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    parts = [count(live_nodes(won), "nodes"), count(live_edges(won), "edges"), count(live_vectors(won), "vectors"), count(dangling_edges(won), "dangling"), count(won.filter("tombstone"), "tombstones"), count(skipped, "skipped"), count(torn, "torn")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out


def out_neighbors(won: DataFrame, node_id: str) -> DataFrame:
    return live_edges(won).filter(F.col("src") == node_id).select(F.col("dst").alias("id")).distinct()
