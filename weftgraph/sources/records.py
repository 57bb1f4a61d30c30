"""Record folders: JSON lines of node, edge, vector and tombstone versions; readers, export and import.

nodes/, edges/, vectors/<property>/ and meta/deleted* hold immutable bundles, one JSON object a line. A last line without
its line end is not data yet. Lines that aren't valid records are set aside, never fatal. Writers' temporary and hidden
files are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = "id string, v int, updated_at timestamp, updated_by string, writer string, counter bigint, labels array<string>, type string, `from` string, `to` string, props map<string,variant>, dim int, dtype string, vec string, kind string, property string"
VERSION = ["kind", "id", "property", "updated_at", "counter", "writer", "tombstone", "v", "record", "updated_by", "labels", "type", "src", "dst", "props", "vec", "dim"]


def lines(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """path, line of the complete lines, and the torn last lines. Bundles are small by construction, so a file is one row."""
    files = spark.read.text(list(paths), wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_path").alias("path"), "value")
    parts = files.select("path", F.posexplode(F.split("value", "\n")).alias("at", "line"), (F.size(F.split("value", "\n")) - 1).alias("last"))
    whole = parts.filter((F.col("at") < F.col("last")) & (F.trim("line") != "")).select("path", "line")
    torn = parts.filter((F.col("at") == F.col("last")) & (F.col("line") != "")).select("path", "line")
    return whole, torn


def decode_vector(vec: Column) -> Column:
    """base64 of little-endian float32 as a list of doubles, from the bits: sign, exponent, fraction."""
    h = F.hex(F.unbase64(vec))
    n = (F.char_length(h) / 8).cast("int")
    byte = lambda i, k: F.conv(F.substring(h, i * 8 + 2 * k + 1, F.lit(2)), 16, 10).cast("long")

    def value(i: Column) -> Column:
        bits = byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216
        sign = F.when(bits >= 2147483648, F.lit(-1.0)).otherwise(F.lit(1.0))
        exponent, fraction = F.pmod(F.floor(bits / 8388608), F.lit(256)), F.pmod(bits, F.lit(8388608))
        normal = (1 + fraction / 8388608.0) * F.pow(F.lit(2.0), (exponent - 127).cast("double"))
        return sign * F.when(exponent == 0, fraction / 8388608.0 * F.pow(F.lit(2.0), F.lit(-126.0))).otherwise(normal)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value))


def versions(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Versions, and the lines that are none. The kind is told by the folder, or for tombstones by the record."""
    parsed = whole.select("path", F.col("line").alias("record"), F.from_json("line", ENVELOPE).alias("r"))
    folder = F.when(F.col("path").rlike("/meta/deleted"), F.lit("tombstone")).when(F.col("path").rlike("/nodes/"), F.lit("node")).when(F.col("path").rlike("/edges/"), F.lit("edge")).when(F.col("path").rlike("/vectors/"), F.lit("vector"))
    flat = parsed.select(
        folder.alias("folder"),
        "path",
        "record",
        F.when(folder == "tombstone", F.col("r.kind")).otherwise(folder).alias("kind"),
        F.col("r.id").alias("id"),
        F.when(folder == "vector", F.regexp_extract("path", "/vectors/([a-z][a-z0-9_]*)/", 1)).otherwise(F.coalesce("r.property", F.lit(""))).alias("property"),
        F.col("r.updated_at").alias("updated_at"),
        F.coalesce("r.counter", F.lit(0)).alias("counter"),
        F.coalesce("r.writer", F.lit("")).alias("writer"),
        (folder == "tombstone").alias("tombstone"),
        F.coalesce("r.v", F.lit(1)).alias("v"),
        F.col("r.updated_by").alias("updated_by"),
        F.col("r.labels").alias("labels"),
        F.col("r.type").alias("type"),
        F.col("r.from").alias("src"),
        F.col("r.to").alias("dst"),
        F.col("r.props").alias("props"),
        F.col("r.vec").alias("vec"),
        F.col("r.dim").alias("dim"),
    )
    signature = F.get_json_object("record", "$.signature").isNotNull()
    good = F.col("id").isNotNull() & F.col("updated_at").isNotNull() & F.col("kind").isin("node", "edge", "vector")
    good = good & ((F.col("folder") != "edge") | (F.col("type").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()))
    good = F.coalesce(good & ((F.col("folder") != "vector") | F.col("vec").isNotNull()), F.lit(False))
    return flat.filter(good).select(*VERSION), flat.filter(~good & ~signature).select("path", "record")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Versions, skipped lines and torn lines of a folder."""
    whole, torn = lines(spark, folder)
    good, skipped = versions(whole)
    return good, skipped, torn


def export(won: DataFrame, name: str) -> DataFrame:
    """value: a header line, then {"type", "record"} lines of live winners; write it with coalesce(1).write.text."""
    head = won.sparkSession.range(1).select(F.to_json(F.struct(F.lit(1).alias("export"), F.lit(name).alias("name"))).alias("value"), F.lit(0).alias("at"))
    body = won.filter("not tombstone").select(F.concat(F.lit('{"type":"'), F.col("kind"), F.lit('","property":"'), F.col("property"), F.lit('","record":'), F.col("record"), F.lit("}")).alias("value"), F.lit(1).alias("at"))
    return head.unionAll(body).orderBy("at", "value").select("value")


def load_export(spark: SparkSession, path: str) -> DataFrame:
    """Versions from an export; ids and times stay."""
    rows = spark.read.text(path).filter(F.get_json_object("value", "$.type").isNotNull())
    kind = F.get_json_object("value", "$.type")
    folder = F.when(kind == "vector", F.concat(F.lit("/vectors/"), F.get_json_object("value", "$.property"), F.lit("/x"))).otherwise(F.concat(F.lit("/"), kind, F.lit("s/x")))
    return versions(rows.select(folder.alias("path"), F.get_json_object("value", "$.record").alias("line")))[0]


def version_schema() -> T.StructType:
    return T._parse_datatype_string("kind string, id string, property string, updated_at timestamp, counter bigint, writer string, tombstone boolean, v int, record string, updated_by string, labels array<string>, type string, src string, dst string, props map<string,variant>, vec string, dim int")
