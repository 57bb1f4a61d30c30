"""Live record folders: immutable bundles are read as a stream, and winners are kept up to date batch by batch.

Nothing is dropped for being late: a version loses by its clock only, never by arrival, so there is no watermark; the
state is the table of winners, and a batch that runs twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import last_write


def bundles(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """New JSON-lines files under a path as a stream of rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def keep_winners(stream: DataFrame, table: str, keys: list[str], clock: list[str], checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Keeps the winners of a stream as Parquet under table/<epoch>, merging each batch into the buckets of keys that it touches."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = last_write(batch, keys, clock).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        old = _latest(spark, table, epoch)
        both = new if old is None else old.unionByName(new)
        last_write(both, keys, clock).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/epoch={epoch:012d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def _latest(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The winners after the last epoch (before the given one) that was written whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(table)):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(path(table)) if s.getPath().getName().startswith("epoch=") and fs.exists(path(f"{s.getPath()}/_SUCCESS")))
    names = [n for n in names if before is None or int(n[6:]) < before]
    return spark.read.parquet(f"{table}/{names[-1]}") if names else None


def winners_table(spark: SparkSession, table: str) -> DataFrame | None:
    found = _latest(spark, table)
    return None if found is None else found.drop("bucket")
