"""Operator 7: token ids in files, under one canonical length-limited Huffman code from the counts of the whole corpus.

1. Every text is encoded once; a document's ids go, compressed, to the shared folder.
2. Each task counts the ids it has written; these counts are added up (a row per id and task at most), and package-merge gives
   each id a code of at most MAX_BITS bits, or as many as the number of used ids needs; canonical codes follow from the
   lengths alone.
3. Each document becomes a bit string, with the bit offset of every CHECKPOINT-th id; these rows, at their entropy, are
   what is range-partitioned by doc_id. Each partition writes one file of independent blocks.
4. The files are read back block by block, decoded by table look-up from all bit-offset checkpoints of a block at once.

File: the magic, then blocks; a block: its header (lengths), the arrays named in BLOCK and the documents' bits. The
code lengths are in a file of their own, `lengths.bin`, one byte per id. A file is written under a temporary name and renamed, so
a task that runs again or twice leaves one whole file.

Defined results: null text is an empty text (only the end id); rows with equal or null doc_ids stay separate (nulls
first); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stored
from .tokens import crc32, encoder

MAX_BITS = 16
WIDEST = 25  # bits that are read at any bit offset in four bytes
CHECKPOINT = 256
BLOCK_IDS = 1 << 16
MAGIC = b"WEFTHUF1"


# -- the code ---------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Package-merge: the best prefix-code lengths of at most limit bits (more if there are more ids than such codes); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    limit = max(limit, (len(used) - 1).bit_length())
    if limit > WIDEST:
        raise ValueError(f"{len(used)} ids don't fit codes of {WIDEST} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    levels = []  # of each level, from the deepest: whether the k-th smallest entry is an id (else a package)
    packages = np.empty(0)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_id in reversed(levels):
        ids = int(is_id[:take].sum())
        depth[:ids] += 1
        take = 2 * (take - ids)
    lengths[order] = depth
    return lengths


def _width(lengths: np.ndarray) -> int:
    return max(1, int(lengths.max(initial=0)))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        short = _width(lengths) - lengths[order].astype(np.int64)
        width = 1 << short
        first = np.cumsum(width) - width
        codes[order] = first >> short
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the next bits, as many as the longest code has: the id and its code's length."""
    longest = _width(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    width = 1 << (longest - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.uint8)
    ids[: width.sum()] = np.repeat(order, width)
    bits[: width.sum()] = np.repeat(lengths[order], width)
    return ids, bits


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bits of several documents, each from a whole byte on; each one's first byte; each id's bit offset in its document."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(bits)])
    size = (total[ends] - total[ends - counts] + 7) // 8
    first = np.cumsum(size) - size
    inside = total[:-1] - np.repeat(total[ends - counts], counts)
    at = inside + np.repeat(first * 8, counts)
    word, room = at >> 5, 64 - (at & 31) - bits
    value = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    n = int(size.sum()) // 4 + 3
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)  # sums of separate bits, below 2 ** 32
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return (high.astype(np.uint64) + low.astype(np.uint64)).astype(">u4").tobytes()[: int(size.sum())], first, inside


def decode_bits(data: bytes, at: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """From each bit offset so many ids, all offsets in step; the ids one after another."""
    ids, bits = table
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte on
    room, mask = 32 - (len(ids).bit_length() - 1), np.uint32(len(ids) - 1)
    order = np.argsort(-counts, kind="stable")
    at, left = at[order].copy(), counts[order]
    out = np.zeros((int(left[0]) if len(left) else 0, len(left)), np.uint32)
    for step in range(len(out)):
        live = int(np.searchsorted(-left, -step, "left"))  # counts above step come first
        here = at[:live]
        key = (window[here >> 3] >> (room - (here & 7)).astype(np.uint32)) & mask
        out[step, :live] = ids[key]
        here += bits[key]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    grid = out.T[back]
    return grid[np.arange(grid.shape[1])[None, :] < counts[:, None]]


# -- the jobs ---------------------------------------------------------------------------------------------------------


def _encoded(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """doc_ids, counts, ids of some documents at a time: arrays in a row a batch; in a task's last row tally, how often it has met each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, tool = zstandard.ZstdCompressor(level=1), encoder(tokenizer)
        tally = np.zeros(tool.size, np.int64)

        def row(docs_in: list, counts: list, ids: bytes, tally: bytes | None) -> pa.RecordBatch:
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (docs_in, counts)]
            return pa.RecordBatch.from_arrays([*lists, pa.array([ids], pa.binary()), pa.array([tally], pa.binary())], ["doc_ids", "counts", "ids", "tally"])

        for b in batches:
            ids, counts = tool.encode([x or "" for x in b.column(1).to_pylist()], end)
            tally += np.bincount(ids, minlength=tool.size)
            yield row(b.column(0).to_pylist(), counts.tolist(), press.compress(ids.tobytes()), None)
        yield row([], [], press.compress(b""), tally.tobytes())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_ids array<long>, counts array<long>, ids binary, tally binary")


def _open(data: bytes, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def _counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; at most a row per id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = tokens.filter("tally is not null").select("tally").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = 0) -> DataFrame:
    """Writes the files under folder (a URI that all executors reach); a row per block: part, path, block, at, size, n_docs, n_tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    tool = encoder(tokenizer)
    dtype = np.dtype(tool.dtype)
    draft = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    _encoded(docs, tokenizer, end).write.option("compression", "none").parquet(draft)  # a table: the counts are read without the ids
    tokens = spark.read.parquet(draft)
    lengths = code_lengths(_counts(tokens, tool.size))
    system, root = _file_system(folder)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/lengths.bin") as out:
        out.write(lengths.tobytes())
    codes = canonical(lengths)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_ids, counts, data in zip(*(c.to_pylist() for c in b.columns)):
                counts = np.array(counts, np.int64)
                ids = _open(data, dtype)
                packed, first, inside = encode_bits(ids, codes, lengths, counts)
                size = np.diff(np.append(first, len(packed)))
                starts = np.cumsum(counts) - counts
                marks = [inside[s : s + n : CHECKPOINT][1:].astype("<u4").tobytes() for s, n in zip(starts.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(marks, pa.binary()), pa.array([packed[f : f + s] for f, s in zip(first.tolist(), size.tolist())], pa.binary())], ["doc_id", "n", "marks", "bits"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, root = _file_system(folder)
        name, draft = f"{root}/part-{part:06d}.huf", f"{root}/.part-{part:06d}-{uuid.uuid4().hex}"
        rows, at, waiting, n = [], len(MAGIC), [], 0
        out = system.open_output_stream(draft)
        out.write(MAGIC)

        def flush() -> None:
            nonlocal at, waiting, n
            ids, counts, marks, data = zip(*waiting)
            known = np.array([i is not None for i in ids], np.uint8)
            body = b"".join([struct.pack("<q", len(ids)), known.tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(counts, "<i8").tobytes(), np.array([len(x) for x in data], "<i8").tobytes(), *marks, *data])
            out.write(body)
            rows.append((part, name, len(rows), at, len(body), len(ids), n))
            at, waiting, n = at + len(body), [], 0

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                waiting.append(row)
                n += row[1]
                if n >= BLOCK_IDS:
                    flush()
        if waiting:
            flush()
        out.close()
        system.move(draft, name)
        if rows:
            part_, path, block, at_, size, docs_, tokens_ = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(part_, pa.int32()), pa.array(path), pa.array(block, pa.int32()), *(pa.array(x, pa.int64()) for x in (at_, size, docs_, tokens_))], ["part", "path", "block", "at", "size", "n_docs", "n_tokens"])

    rows = tokens.filter("tally is null").select("doc_ids", "counts", "ids").mapInArrow(bits, "doc_id long, n long, marks binary, bits binary")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return stored(ordered.mapInArrow(files, "part int, path string, block int, at long, size long, n_docs long, n_tokens long"))


def read(spark: SparkSession, folder: str, blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of the files' blocks: doc_id, start, n_tokens, ids_crc32 and, if with_ids, ids."""
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row per file
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("n_tokens")
    placed = blocks.withColumn("inside", inside).join(before, "part")
    # blocks are independent: they are dealt out evenly, whatever file they are in
    dealt = placed.select("path", "at", "size", (F.col("before") + F.col("inside")).alias("start")).repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        with system.open_input_file(f"{root}/lengths.bin") as source:
            table = decode_table(np.frombuffer(source.read(), np.uint8))
        for b in batches:
            for path, at, size, start in zip(*(c.to_pylist() for c in b.columns)):
                with system.open_input_file(path) as source:
                    source.seek(at)
                    body = source.read(size)
                (n,) = struct.unpack_from("<q", body)
                known = np.frombuffer(body, np.uint8, n, 8)
                doc_ids, counts, sizes = (np.frombuffer(body, "<i8", n, 8 + n + 8 * n * k) for k in range(3))
                place = 8 + 25 * n
                pieces = -(-counts // CHECKPOINT)
                marks = np.frombuffer(body, "<u4", int((pieces - 1).sum()), place).astype(np.int64)
                data = body[place + 4 * len(marks) :]
                first = np.cumsum(pieces) - pieces
                offset = np.zeros(int(pieces.sum()), np.int64)
                later = np.ones(len(offset), bool)
                later[first] = False
                offset[later] = marks
                offset += np.repeat((np.cumsum(sizes) - sizes) * 8, pieces)
                each = np.full(len(offset), CHECKPOINT, np.int64)
                each[first + pieces - 1] = counts - (pieces - 1) * CHECKPOINT
                ids = decode_bits(data, offset, each, table)
                ends = np.cumsum(counts)
                own = [ids[e - c : e] for e, c in zip(ends.tolist(), counts.tolist())]
                columns = [pa.array(doc_ids, pa.int64(), mask=known == 0), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([crc32(x) for x in own], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def write_and_read(docs: DataFrame, tokenizer: str, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Both, in a new folder of the shared one."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/huffman-{uuid.uuid4().hex}"
    return read(spark, folder, write(docs, tokenizer, folder, end), with_ids)
