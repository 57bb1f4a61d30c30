"""Graph updates as appended versions, set at a time, in atomic commits.

A statement turns rows into new versions; later statements of the commit see them. Nothing is visible to others until
commit(), which writes one staged folder and renames it: all or nothing. Every statement gets the next counter, so its versions
win over what it has read; of several rows for one id a statement makes one version, later rows (by ordinal, then text) over
earlier ones, and what is created has ids of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import records
from . import versions as V

JSON_FIELDS = {
    "node": ["id", "v", "updated_at", "updated_by", "writer", "counter", "labels", "props"],
    "edge": ["id", "v", "updated_at", "updated_by", "writer", "counter", "type", ("src", "from"), ("dst", "to"), "props"],
    "vector": ["id", "v", "updated_at", "updated_by", "writer", "counter", "dim", "dtype", "vec"],
    "tombstone": ["id", "v", "kind", "updated_at", "updated_by", "writer", "counter", "property"],
}


class Store:
    """A folder of records and a writer's uncommitted statements."""

    def __init__(self, spark: SparkSession, folder: str, writer: str) -> None:
        self.spark, self.folder, self.writer = spark, folder, writer
        self.pending: DataFrame | None = None
        self.counter = 0

    # -- reading

    def versions(self) -> DataFrame:
        """Committed and own pending versions."""
        try:
            committed = records.read(self.spark, self.folder)[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            committed = self.spark.createDataFrame([], records.version_schema())
        return committed if self.pending is None else committed.unionByName(self.pending)

    def winners(self) -> DataFrame:
        return V.winners(self.versions())

    def nodes(self) -> DataFrame:
        return V.live_nodes(self.winners())

    def edges(self) -> DataFrame:
        return V.live_edges(self.winners())

    def vectors(self) -> DataFrame:
        return V.live_vectors(self.winners())

    # -- versions

    def _add(self, rows: DataFrame, kind: Column | str, tombstone: bool = False, by: str | None = None) -> DataFrame:
        last = self.versions().agg(F.max("counter")).first()[0] or 0 if not self.counter else self.counter
        self.counter = last + 1
        kind = F.lit(kind) if isinstance(kind, str) else kind
        have = set(rows.columns)
        get = lambda name, t: F.col(name).cast(t) if name in have else F.lit(None).cast(t)
        props = F.col("props") if "props" in have else F.lit(None).cast("map<string,variant>")
        made = rows.select(
            kind.alias("kind"), F.col("id"), F.coalesce(get("property", "string"), F.lit("")).alias("property"), F.current_timestamp().alias("updated_at"), F.lit(self.counter).cast("bigint").alias("counter"),
            F.lit(self.writer).alias("writer"), F.lit(tombstone).alias("tombstone"), F.lit(1).alias("v"), F.lit(by).cast("string").alias("updated_by"), get("labels", "array<string>").alias("labels"),
            get("type", "string").alias("type"), get("src", "string").alias("src"), get("dst", "string").alias("dst"), props.alias("props"), get("vec", "string").alias("vec"), get("dim", "int").alias("dim"), F.lit("f32le").alias("dtype"),
        )
        line = F.lit(None).cast("string")
        for name, fields in JSON_FIELDS.items():
            here = F.lit(tombstone) if name == "tombstone" else (~F.lit(tombstone) & (F.col("kind") == name))
            cols = [F.col(f).alias(f) if isinstance(f, str) else F.col(f[0]).alias(f[1]) for f in fields]
            line = F.when(here, F.to_json(F.struct(*cols))).otherwise(line)
        # a statement's versions are computed once: ids and times must not change when the plan runs again
        made = self._fixed(made.withColumn("record", line).select(*records.VERSION))
        self.pending = made if self.pending is None else self.pending.unionByName(made)
        return made

    def _fixed(self, made: DataFrame) -> DataFrame:
        """The same rows as a written table beside the records, so that later plans neither grow nor compute them anew."""
        path = f"{self.folder}/.pending/{uuid.uuid4().hex}"
        made.write.parquet(path)
        return self.spark.read.schema(made.schema).parquet(path)

    # -- statements

    def create_nodes(self, rows: DataFrame, by: str | None = None) -> DataFrame:
        """rows: labels, props and optionally id, all different."""
        if "id" in rows.columns:
            rows = self._fixed(rows)
            if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
                raise ValueError("two created nodes have one id")
            return self._add(rows, "node", by=by)
        return self._add(rows.withColumn("id", F.uuid()), "node", by=by)

    def create_edges(self, rows: DataFrame, by: str | None = None) -> DataFrame:
        """rows: type, src, dst, props and optionally id; both ends must be live."""
        rows = self._fixed(rows if "id" in rows.columns else rows.withColumn("id", F.uuid()))
        ids = self.nodes().select("id")
        lost = rows.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_anti").limit(1).count()
        if lost:
            raise ValueError("an edge needs both of its ends")
        return self._add(rows, "edge", by=by)

    def merge_nodes(self, rows: DataFrame, by: str | None = None) -> DataFrame:
        """rows: id, labels, props and optionally ordinal: live nodes get labels and properties added, others are made. Of rows with one id all are folded, later properties over earlier ones."""
        rows = rows if "ordinal" in rows.columns else rows.withColumn("ordinal", F.lit(0))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.to_json("props").alias("props"), "labels"))), lambda x: F.struct(F.from_json(x["props"], "map<string,variant>").alias("props"), x["labels"].alias("labels")))
        folded = rows.groupBy("id").agg(listed.alias("all"))
        no_props = F.create_map().cast("map<string,variant>")
        props = F.aggregate("all", no_props, lambda a, x: over(a, x["props"]))
        labels = F.array_distinct(F.flatten(F.transform("all", lambda x: F.coalesce(x["labels"], F.array().cast("array<string>")))))
        new = folded.select("id", props.alias("new_props"), labels.alias("new_labels"))
        old = self.nodes().select("id", F.col("props").alias("old_props"), F.col("labels").alias("old_labels"))
        merged = new.join(old, "id", "left")
        return self._add(merged.select("id", over(F.coalesce("old_props", no_props), F.col("new_props")).alias("props"), F.array_union(F.coalesce("old_labels", F.array().cast("array<string>")), F.col("new_labels")).alias("labels")), "node", by=by)

    def merge_edges(self, rows: DataFrame, by: str | None = None) -> DataFrame:
        """rows: type, src, dst, props and optionally id: made where no live edge has that id, or that type, these ends and all of these properties ({k: null} is also what lacks k). Rows that agree in all of it make one edge."""
        rows = self._fixed(rows)
        old = self.edges().select("id", "type", "src", "dst", _texts(F.col("props")).alias("old_texts"))
        new = rows.withColumn("__texts", _texts(F.col("props"))).withColumn("__all", F.to_json(F.array_sort(F.map_entries("__texts"))))
        if "id" in rows.columns:
            new = new.join(old.select("id"), "id", "left_anti").dropDuplicates(["id"])
        new = new.dropDuplicates(["type", "src", "dst", "__all"]).withColumnsRenamed({x: f"__{x}" for x in ("type", "src", "dst")})
        contained = F.forall(F.map_entries("__texts"), lambda e: F.coalesce(F.element_at("old_texts", e["key"]), F.lit("null")) == e["value"])
        same = (F.col("__type") == F.col("type")) & (F.col("__src") == F.col("src")) & (F.col("__dst") == F.col("dst"))
        left = new.join(old.drop("id"), same & contained, "left_anti").withColumnsRenamed({f"__{x}": x for x in ("type", "src", "dst")})
        return self.create_edges(left.select(*rows.columns), by=by)

    def set_props(self, kind: str, rows: DataFrame, replace: bool = False, by: str | None = None) -> DataFrame:
        """rows: id, props and optionally ordinal; merged over the live record's (null is stored), or in their place. Of rows with one id all count in order: later properties over earlier ones, or the last map."""
        live = self.nodes() if kind == "node" else self.edges()
        rows = rows if "ordinal" in rows.columns else rows.withColumn("ordinal", F.lit(0))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.to_json("props").alias("props")))), lambda x: F.from_json(x["props"], "map<string,variant>"))
        each = rows.groupBy("id").agg(listed.alias("all"))
        no_props = F.create_map().cast("map<string,variant>")
        new = F.element_at("all", -1) if replace else F.aggregate("all", no_props, lambda a, x: over(a, x))
        both = live.join(each.select("id", new.alias("new_props")), "id")
        props = F.col("new_props") if replace else over(F.coalesce("props", no_props), F.col("new_props"))
        return self._add(both.select("id", props.alias("props"), "labels", "type", "src", "dst"), kind, by=by)

    def add_labels(self, rows: DataFrame, by: str | None = None) -> DataFrame:
        """rows: id, labels."""
        both = self.nodes().join(rows.select("id", F.col("labels").alias("more")), "id")
        return self._add(both.select("id", "props", F.array_union("labels", "more").alias("labels")), "node", by=by)

    def set_vectors(self, rows: DataFrame, by: str | None = None) -> DataFrame:
        """rows: id, property, vec (base64 of little-endian float32), dim; the owner must be live."""
        owners = self.nodes().select("id").unionAll(self.edges().select("id"))
        return self._add(rows.filter(F.col("property").rlike("^[a-z][a-z0-9_]*$") & (F.col("dim") > 0)).join(owners, "id", "left_semi"), "vector", by=by)

    def delete_nodes(self, ids: DataFrame, by: str | None = None) -> DataFrame:
        """Tombstones for nodes, their relationships, and the vectors of both."""
        won = self._fixed(self.winners())
        nodes = V.live_nodes(won).join(ids.select("id"), "id", "left_semi").select("id")
        edges = won.filter("kind = 'edge' and not tombstone")
        hit = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select("id").union(edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("id")).distinct()
        return self._tombstones(won, nodes, hit, by)

    def delete_edges(self, ids: DataFrame, by: str | None = None) -> DataFrame:
        won = self._fixed(self.winners())
        hit = won.filter("kind = 'edge' and not tombstone").join(ids.select("id"), "id", "left_semi").select("id")
        return self._tombstones(won, hit.limit(0), hit, by)

    def _tombstones(self, won: DataFrame, nodes: DataFrame, edges: DataFrame, by: str | None) -> DataFrame:
        gone = nodes.select(F.lit("node").alias("kind"), "id", F.lit("").alias("property")).unionAll(edges.select(F.lit("edge"), "id", F.lit("")))
        vectors = won.filter("kind = 'vector' and not tombstone").join(gone.select("id"), "id", "left_semi").select("kind", "id", "property")
        return self._add(gone.unionAll(vectors), F.col("kind"), tombstone=True, by=by)

    # -- commits

    def commit(self) -> str | None:
        """Publishes the pending versions: one file per folder in a staged commit, then one rename."""
        if self.pending is None:
            return None
        name = f"{self.writer}-{uuid.uuid4().hex}"
        stage = f"{self.folder}/.stage-{name}"
        folder = F.when(F.col("tombstone"), F.lit("meta/deleted")).when(F.col("kind") == "vector", F.concat(F.lit("vectors/"), F.col("property"))).otherwise(F.concat(F.col("kind"), F.lit("s")))
        rows = self._fixed(self.pending.select(folder.alias("folder"), "record"))
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for r in rows.select("folder").distinct().collect():  # nodes, edges, meta/deleted and one per vector property
            rows.filter(F.col("folder") == r.folder).select("record").coalesce(1).write.text(f"{stage}/raw/{r.folder}")
            fs.mkdirs(path(f"{stage}/{r.folder}"))
            for k, status in enumerate(fs.listStatus(path(f"{stage}/raw/{r.folder}"))):
                if status.getPath().getName().startswith("part-"):
                    fs.rename(status.getPath(), path(f"{stage}/{r.folder}/{self.writer}.{k:08d}.jsonl"))
        fs.delete(path(f"{stage}/raw"), True)
        fs.mkdirs(path(f"{self.folder}/commits"))
        if not fs.rename(path(stage), path(f"{self.folder}/commits/{name}")):
            raise OSError(f"commit {name} could not be published")
        self.pending = None
        return name

    def rollback(self) -> None:
        self.pending = None


def _texts(props: Column) -> Column:
    """A property map with each value as JSON text, which tells text from number; null is an empty map."""
    return F.coalesce(F.transform_values(props, lambda k, v: F.coalesce(F.to_json(v), F.lit("null"))), F.create_map().cast("map<string,string>"))


def over(old: Column, new: Column) -> Column:
    """new's entries over old's."""
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(new), k), F.lit(False)))
    return F.when(new.isNull(), old).otherwise(F.map_concat(kept, new))
