"""What several operators share: table access, word splitting, checkpoints."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it's a temporary one where all runs on this machine (tests), an error elsewhere."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = "file://" + tempfile.mkdtemp(prefix="weft-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(given)
    return given


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of a few hundred documents keep Python's memory bounded by batch, not by partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: a lambda variable is never inlined into the lambdas below it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
SLICE = 1 << 22  # bytes that are hashed at a time


def _slices(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about SLICE bytes that end at white space."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + SLICE)
        while end < len(raw) and not _BLANK[raw[end : end + 4096]].any():
            end = min(len(raw), end + 4096)
        if end < len(raw):
            end += int(np.argmax(_BLANK[raw[end : end + 4096]]))
        yield at, end
        at = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of all texts (null: none), one text after another, and how many words each has."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    edges = offsets - offsets[0]
    hashes, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    power = np.empty(0, np.uint64)
    for a, b in _slices(raw):
        part = raw[a:b]
        inside = ~_BLANK[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = edges[(edges > a) & (edges < b)] - a
        begins[cuts] = inside[cuts]
        first = np.flatnonzero(begins[inside])
        if not len(first):
            continue
        size = np.diff(np.append(first, int(inside.sum())))
        if len(power) < size.max():
            power = np.cumprod(np.full(int(size.max()), 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)
        letter = _LETTER[part[inside]] * power[np.arange(int(size.sum())) - np.repeat(first, size)]
        hashes.append(mix(np.add.reduceat(letter, first) + size.astype(np.uint64)))
        places.append(a + np.flatnonzero(begins))
    place = np.concatenate(places)
    return np.concatenate(hashes), np.diff(np.searchsorted(place, edges))
