"""The driver's star schema as a property graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph

#: label -> table and key
LABELS = {
    "Region": ("region", "r_regionkey"),
    "Nation": ("nation", "n_nationkey"),
    "Customer": ("customer", "c_custkey"),
    "Supplier": ("supplier", "s_suppkey"),
    "Part": ("part", "p_partkey"),
    "Purchase": ("orders", "o_orderkey"),
    "Event": ("events", "event_id"),
    "Document": ("documents", "doc_id"),
    "DocLabel": ("labels", "doc_id"),
    "Item": ("embeddings", "vec_id"),
    "Page": ("pages", "page_id"),
    "BenchItem": ("benchmark", "item_id"),
}
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """All labels and relationship types over the tables of a folder; no table is opened, not even for its columns, before a query asks for it."""

    def read(name: str) -> Callable[[], DataFrame]:
        return lambda: known(name)

    @cache
    def known(name: str) -> DataFrame:  # the same object each time: foreign keys are found by it
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @cache
    def users() -> DataFrame:
        return known("events").select("user_id").distinct()

    @cache
    def following() -> DataFrame:
        turns = known("conversations")
        after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("next_turn"))
        return turns.select("conv_id", "turn").join(after, ["conv_id", "turn"]).select("conv_id", "turn", "next_turn")

    g = Graph()
    for label, (name, key) in LABELS.items():
        g.add_nodes(label, read(name), key)
    g.add_nodes("User", users, "user_id")
    g.add_nodes("Turn", read("conversations"), "conv_id", "turn")
    g.add_edges("IN_REGION", read("nation"), "Nation", "Region", "n_nationkey", "n_regionkey")
    g.add_edges("IN_NATION", read("customer"), "Customer", "Nation", "c_custkey", "c_nationkey")
    g.add_edges("IN_NATION", read("supplier"), "Supplier", "Nation", "s_suppkey", "s_nationkey")
    g.add_edges("PLACED", read("orders"), "Customer", "Purchase", "o_custkey", "o_orderkey")
    g.add_edges("CONTAINS", read("lineitem"), "Purchase", "Part", "l_orderkey", "l_partkey", LINE)
    g.add_edges("SUPPLIED", read("lineitem"), "Supplier", "Part", "l_suppkey", "l_partkey", LINE)
    g.add_edges("DID", read("events"), "User", "Event", "user_id", "event_id", props=("ts",))
    g.add_edges("LABELLED", read("labels"), "Document", "DocLabel", "doc_id", "doc_id")
    g.add_edges("NEXT", following, "Turn", "Turn", ("conv_id", "turn"), ("conv_id", "next_turn"))
    return g
