"""Operator 4: an exact n-gram Jaccard join by a blocked sparse matrix product, and the groups that its links make.

The incidence matrix has a row per distinct shingle set and a column per shingle (HASH_BITS-bit hashes of word n-grams). Columns
have one global order, the more frequent the later, and of each row only the first size - ceil(t * size) + 1 columns can decide: a
pair with Jaccard t shares one of them. The product of this part with its transpose is taken column by column in two
steps, adding up each pair's shared columns. Columns with one row are dropped before.

A pair counts in a column only if its sizes allow t and if its signatures do: a signature has SIGNATURE bits, each the parity of
the columns hashed to it, so two signatures differ in no more bits than the sets differ in columns, which bounds the overlap
from above. A pair of larger sets (above WIDE columns) is then tested with wide signatures, of about a bit per column,
which are kept once per set. Of the pairs added up those go on whose shared columns + the larger rest reach ceil(t / (1 + t) * (size +
size)), below which no overlap can give t. What is left is verified on the whole sets.

Equal sets are one row (so copies are no pairs). The first product pairs the rows of a column with the row whose signature is
nearest to their majority, LEADERS times over with the rows left, and each row goes on with the one leader that it shares
most with. The second, for which the bound holds, takes all pairs of rows that are not yet in one group; no link between groups is lost. A column of more than
BLOCK rows is dealt to tasks as pairs of blocks there.

Which columns are frequent is counted over all documents (each task reports what it has seen LOCAL times or more); the
broadcast table has HOT columns at most. The order only decides speed; any order gives the same links.

Defined results: null text, and a text without words, has an empty set, is linked with nothing and is its own component; rows with
equal doc_ids are rows of their own; a component whose doc_ids are all null has a null id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, small_batches, stored, word_hashes

LOCAL = 4
HOT = 1 << 16
BITMAP = 1 << 25
HASH_BITS = 54
SIGNATURE = 256
WIDE = 256
LEADERS = 4
BLOCK = 4096
GATHERED = 50_000  # rows of columns that a task takes at a time
WORDS, PERCENT = 5, 80


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes (HASH_BITS bits) of all texts, sorted within each text, and how many each text has."""
    if len(texts) > 1 << 64 - HASH_BITS:
        half = len(texts) // 2
        parts = [shingle_sets(x, n) for x in (texts.slice(0, half), texts.slice(half))]
        return tuple(np.concatenate(x) for x in zip(*parts))
    word, sizes = word_hashes(texts)
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    many = max(0, len(word) - n + 1)
    value = np.zeros(many, np.uint64)
    for k in range(n):
        value = mix(value + word[k : k + many] * np.uint64(2 * k + 3))
    whole = text[:many] == text[n - 1 : n - 1 + many] if many else np.zeros(0, bool)
    value, owner = value[whole], text[:many][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):  # the whole sequence as one shingle
        starts = np.cumsum(sizes) - sizes
        own = []
        for t in short.tolist():
            x = np.zeros(1, np.uint64)
            for w in word[starts[t] : starts[t] + sizes[t]]:
                x = mix(x * np.uint64(5) + w + np.uint64(1))
            own.append(x[0])
        value, owner = np.concatenate([value, np.array(own, np.uint64)]), np.concatenate([owner, short.astype(np.uint64)])
    # one number holds text and hash, so that one sort does
    both = np.sort(owner << np.uint64(HASH_BITS) | value >> np.uint64(64 - HASH_BITS))
    if len(both):
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
    counts = np.bincount((both >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(texts))
    return both & np.uint64((1 << HASH_BITS) - 1), counts.astype(np.int64)


def _key(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for empty ones."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(0x9E3779B9)), dtype=np.uint64)])
    ends = np.cumsum(counts)
    return np.where(counts > 0, mix((sums[ends] - sums[ends - counts]) ^ counts.astype(np.uint64)), np.uint64(0)).view(np.int64)


def _hot(docs: DataFrame, n: int) -> np.ndarray:
    """The most frequent columns in order of frequency, at most HOT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            value, _ = shingle_sets(b.column(0), n)
            seen.append(value)
            if sum(map(len, seen)) > 4_000_000:
                yield report(seen)
                seen = []
        if seen:
            yield report(seen)

    def report(seen: list[np.ndarray]) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(seen), return_counts=True)
        often = count >= LOCAL
        return pa.RecordBatch.from_arrays([pa.array(value[often].view(np.int64)), pa.array(count[often])], ["col", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "col long, n long").groupBy("col").agg(F.sum("n").alias("n"))
    return np.array([r.col for r in rows.orderBy(F.col("n").desc(), "col").limit(HOT).collect()][::-1], np.int64).view(np.uint64)


def signatures(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each set SIGNATURE bits, packed: bit k is the parity of its columns with hash k."""
    out = np.empty((len(counts), SIGNATURE // 8), np.uint8)
    bit = (mix(value) >> np.uint64(64 - (SIGNATURE - 1).bit_length())).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(counts)])
    for k in range(0, len(counts), 256):
        part = counts[k : k + 256]
        place = np.repeat(np.arange(len(part)) * SIGNATURE, part) + bit[edges[k] : edges[k + len(part)]]
        odd = (np.bincount(place, minlength=len(part) * SIGNATURE) & 1).astype(np.uint8)
        out[k : k + len(part)] = np.packbits(odd.reshape(len(part), SIGNATURE), axis=1)
    return out


def wide_signature(value: np.ndarray) -> bytes:
    """The same of one large set, with as many bits as a power of two not below its size; none for small sets."""
    if len(value) <= WIDE:
        return b""
    width = (len(value) - 1).bit_length()
    bit = (mix(value ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - width)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=1 << width) & 1).astype(np.uint8)).tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """In how many columns two sets with these wide signatures differ at least."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8)) for s in (a, b))
    while len(x) != len(y):  # a wider one is folded: the hash's last bit goes
        if len(x) < len(y):
            x, y = y, x
        x = x[::2] ^ x[1::2]
    return int((x ^ y).sum())


def _narrowed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose wide signatures allow the threshold. sets: key, size, wide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, v, w = (b.column(k).to_pylist() for k in (2, 3, 4, 5))
            good = [not p or not q or (m + n - _differ(p, q)) // 2 >= -(-percent * (m + n) // (100 + percent)) for m, n, p, q in zip(x, y, v, w)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    of = lambda side: sets.select(F.col("key").alias(side), F.col("size").alias(f"size_{side}"), F.col("wide").alias(f"wide_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "size_a", "size_b", "wide_a", "wide_b")
    return both.mapInArrow(run, "a long, b long")


def _prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_key, size, key, signatures and the deciding columns of each document."""
    hot = _hot(docs, n)
    by_value = np.argsort(hot)
    sorted_hot = hot[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, counts = shingle_sets(b.column(2), n)
            owner = np.repeat(np.arange(len(counts)), counts)
            rank = np.zeros(len(value), np.int64)
            if len(sorted_hot) and len(value):
                at = np.minimum(np.searchsorted(sorted_hot, value), len(sorted_hot) - 1)
                rank = np.where(sorted_hot[at] == value, by_value[at] + 1, 0)
            take = counts - -(-percent * counts // 100) + (counts > 0)
            # the columns that aren't frequent come first, as they lie
            cold = np.flatnonzero(rank == 0)
            n_cold = np.bincount(owner[cold], minlength=len(counts))
            place = np.arange(len(cold)) - np.repeat(np.cumsum(n_cold) - n_cold, n_cold)
            kept = cold[place < np.repeat(take, n_cold)]
            more = np.flatnonzero((rank > 0) & np.repeat(n_cold < take, counts))
            if len(more):
                more = more[np.lexsort((rank[more], owner[more]))]
                n_hot = np.bincount(owner[more], minlength=len(counts))
                place = np.arange(len(more)) - np.repeat(np.cumsum(n_hot) - n_hot, n_hot)
                more = more[place < np.repeat(take - n_cold, n_hot)]
                kept = np.concatenate([kept, more])
                kept = kept[np.argsort(owner[kept], kind="stable")]
            columns = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(value[kept].view(np.int64)))
            signature = pa.array([x.tobytes() for x in signatures(value, counts)], pa.binary())
            ends = np.cumsum(counts)
            wide = pa.array([wide_signature(value[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts), pa.array(_key(value, counts)), signature, wide, columns], ["doc_id", "text_key", "size", "key", "signature", "wide", "cols"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, size long, key long, signature binary, wide binary, cols array<long>")


def _least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _shared(sets: DataFrame) -> DataFrame:
    """key, col, n: the deciding columns that n > 1 rows have."""
    exploded = sets.select("key", F.explode("cols").alias("col"))
    return exploded.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("col"))).filter("n > 1")


class _Columns:
    """Some columns of the matrix: their rows (key, size, group, block and signature), column after column."""

    def __init__(self, start: np.ndarray, key: np.ndarray, size: np.ndarray, part: np.ndarray, own: np.ndarray, signature: np.ndarray) -> None:
        #: start: where each column begins, and the end of the last one.
        self.start, self.key, self.size, self.part, self.own, self.signature = start, key, size, part, own, signature

    def may_link(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sizes and signatures of these rows allow the threshold."""
        x, y = self.size[a], self.size[b]
        good = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
        at = np.flatnonzero(good)
        differ = np.bitwise_count(self.signature[a[at]] ^ self.signature[b[at]]).sum(axis=1).astype(np.int64)
        good[at] = (x[at] + y[at] - differ) // 2 >= _least_overlap(x[at], y[at], percent)
        return good

    def leaders(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows with the leader of their column that they may be linked with, LEADERS times over with the rows left."""
        rows = np.arange(len(self.key))
        column = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        for _ in range(LEADERS):
            of = column[rows]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(rows) else rows
            many = np.diff(np.append(first, len(rows)))
            rows, many = rows[np.repeat(many > 1, many)], many[many > 1]
            if not len(rows):
                return
            first = np.cumsum(many) - many
            bits = self.signature[rows].view(np.uint8)
            ones = np.stack([np.add.reduceat(np.unpackbits(bits[:, k], bitorder="big").reshape(-1, 8), first, axis=0, dtype=np.int32) for k in range(bits.shape[1])], axis=1)
            major = np.packbits(ones.reshape(len(many), -1) * 2 > many[:, None], axis=1).view(np.uint64)
            far = np.bitwise_count(self.signature[rows] ^ np.repeat(major, many, axis=0)).sum(axis=1).astype(np.int64)
            nearest = np.minimum.reduceat(far * len(rows) + np.arange(len(rows)), first) % len(rows)
            leader = np.repeat(nearest, many)
            others = np.flatnonzero(np.arange(len(rows)) != leader)
            good = self.may_link(rows[others], rows[leader[others]], percent)
            yield rows[others[good]], rows[leader[others[good]]]
            rows = rows[others[~good]]

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of rows of a column that are in different groups (and, of two blocks, not in the same one) and may be linked."""
        many = np.diff(self.start)
        low, high = (f.reduceat(self.part, self.start[:-1]) for f in (np.minimum, np.maximum)) if len(many) else (many, many)
        for m in np.unique(many[(low < high) & (many <= 64)]).tolist():
            columns = self.start[:-1][(low < high) & (many == m)]
            i, j = np.triu_indices(m, 1)
            step = max(1, 200_000 // len(i))
            for k in range(0, len(columns), step):
                yield self._allowed((columns[k : k + step, None] + i).ravel(), (columns[k : k + step, None] + j).ravel(), percent)
        for k in np.flatnonzero((low < high) & (many > 64)).tolist():
            rows = np.arange(self.start[k], self.start[k + 1])
            group, count = np.unique(self.part[rows], return_counts=True)
            main = self.part[rows] == group[np.argmax(count)]
            single = rows[~main]
            for i in range(0, len(single), max(1, 200_000 // len(rows))):  # rows outside of the largest group with all others
                some = single[i : i + max(1, 200_000 // len(rows))]
                yield self._allowed(np.repeat(some, len(rows)), np.tile(rows, len(some)), percent, main[np.tile(rows, len(some)) - rows[0]])

    def _allowed(self, a: np.ndarray, b: np.ndarray, percent: int, in_main: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        good = (self.part[a] != self.part[b]) & ((self.own[a] != self.own[b]) | (self.own[a] < 0))
        if in_main is not None:  # pairs outside of the largest group come twice
            good &= in_main | (a < b)
        a, b = a[good], b[good]
        good = self.may_link(a, b, percent)
        return a[good], b[good]


def _products(shared: DataFrame, rows: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """Pairs a, b of keys whose shared deciding columns are enough, from the columns (key, col, n) and rows (key, size, signature, part); part: a group already linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting: list[list[np.ndarray]] = []
        found: list[tuple] = []

        def report() -> pa.RecordBatch:
            a, b, x, y = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((b, a))
            a, b, x, y = a[order], b[order], x[order], y[order]
            at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(v) for v in (a[at], b[at], x[at], y[at], np.diff(np.append(at, len(a))))], ["a", "b", "size_a", "size_b", "n"])

        def finished(last: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            nonlocal held
            held, waiting[:] = [np.concatenate(x) for x in zip(*([held] if held else []), *waiting)], []
            col, block = held[0], held[1]
            edge = np.flatnonzero(np.concatenate([[True], (col[1:] != col[:-1]) | (block[1:] != block[:-1])]))
            # the last column may go on; of leaders, which need no whole columns, more than GATHERED rows don't wait
            end = len(col) if last or (not all_pairs and len(col) - edge[-1] > GATHERED) else int(edge[-1])
            start = np.append(edge[edge < end], end)
            if len(start) > 1:
                columns = _Columns(start, *(x[:end] for x in held[2:]))
                for a, b in columns.pairs(percent) if all_pairs else columns.leaders(percent):
                    if all_pairs:
                        swap = columns.key[a] > columns.key[b]
                        a, b = np.where(swap, b, a), np.where(swap, a, b)
                    yield columns.key[a], columns.key[b], columns.size[a], columns.size[b]
            held = [x[end:] for x in held]

        n = 0
        for b in _with_end(batches):
            if b is not None:
                if not b.num_rows:
                    continue
                signature = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint64).reshape(b.num_rows, -1)
                waiting.append([c.to_numpy(zero_copy_only=False) for c in b.columns[:6]] + [signature])
                n += b.num_rows
                if n < GATHERED:
                    continue
            elif not (waiting or (held and len(held[0]))):
                break
            if not waiting:
                waiting.append([x[:0] for x in held])
            n = 0
            for got in finished(b is None):
                if len(got[0]):
                    found.append(got)
                if sum(len(x[0]) for x in found) > 500_000:
                    yield report()
        if found:
            yield report()

    of = shared.join(rows, "key")
    none = F.lit(-1).cast("long")
    if all_pairs:
        blocks = F.ceil(F.col("n") / BLOCK).cast("long")
        own = F.when(blocks > 1, F.pmod(F.xxhash64("key"), blocks)).otherwise(none)
        # block q of a pair p <= q: p * blocks + q; a row goes to all pairs of its block
        pairs = F.when(own >= 0, F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda x: F.least(F.col("own"), x) * blocks + F.greatest(F.col("own"), x))).otherwise(F.array(none))
        of = of.withColumn("own", own).withColumn("block", F.explode(pairs))
        inside = F.floor(F.col("block") / blocks) == F.col("block") % blocks  # a block with itself: all pairs
        of = of.withColumn("own", F.when(inside, none).otherwise(F.col("own")))
    else:
        of = of.withColumn("own", none).withColumn("block", none)
    dealt = of.select("col", "block", "key", "size", "part", "own", "signature").repartition("col", "block").sortWithinPartitions("col", "block", "key")
    counted = dealt.mapInArrow(run, "a long, b long, size_a long, size_b long, n long").groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
    if not all_pairs:  # not all shared columns are counted, so there is no bound
        return counted.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    rest = F.ceil(F.greatest("size_a", "size_b") * percent / 100) - 1
    need = F.ceil((F.col("size_a") + F.col("size_b")) * percent / (100 + percent))
    return counted.filter(F.col("n") + rest >= need).select("a", "b")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _bitmap(keys: DataFrame) -> np.ndarray:
    """BITMAP bits, whatever the number of keys: those of the keys are set. It spares rows that are not asked for; others still get through."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for places in b.column(1).to_pylist():
                bits = np.zeros(1 << 16, np.uint8)
                bits[places] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["part", "bits"])

    place = F.pmod(F.col("key"), F.lit(BITMAP)).cast("int")
    parts = keys.select(F.shiftright(place, 16).alias("part"), place.bitwiseAND(F.lit(0xFFFF)).alias("at")).groupBy("part").agg(F.collect_set("at").alias("at"))
    whole = np.zeros(BITMAP // 8, np.uint8)
    for r in parts.mapInArrow(packed, "part int, bits binary").collect():
        whole[r.part * 8192 : (r.part + 1) * 8192] = np.frombuffer(r.bits, np.uint8)
    return whole


def _verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of the pairs those whose whole sets reach the threshold. texts: key, text_key of a text with that set."""
    asked = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    bitmap = _bitmap(asked.join(texts, "key").select(F.col("text_key").alias("key")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            text_key = b.column(0).to_numpy()
            place = np.mod(text_key, BITMAP)
            asked = np.flatnonzero(bitmap[place >> 3] >> (7 - (place & 7)) & 1)
            new = [k for k, x in zip(asked.tolist(), text_key[asked].tolist()) if x not in seen]  # of equal texts a task sends one
            if not new:
                continue
            seen.update(text_key[new].tolist())
            value, counts = shingle_sets(b.column(1).take(pa.array(new)), n)
            ends, keys = np.cumsum(counts), _key(value, counts)
            rows = [(keys[k], value[ends[k] - counts[k] : ends[k]].tobytes()) for k in np.flatnonzero(counts).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["key", "items"])

    found = docs.select(F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text")).mapInArrow(sets, "key long, items binary").repartition("key").dropDuplicates(["key"])
    both = pairs.join(found.select(F.col("key").alias("b"), F.col("items").alias("y")), "b").join(found.select(F.col("key").alias("a"), F.col("items").alias("x")), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                overlap = int((y[at] == x).sum())
                good.append(100 * overlap >= percent * (len(x) + len(y) - overlap))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """key, root for every key with an edge: the least key that it is connected with. Labels go along edges and jump to their root's label, so rounds grow with the logarithm of the longest path."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("key").alias("b"), "root"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "key").select("key", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        up = labels.select(F.col("key").alias("root"), F.col("root").alias("above"))
        new = stored(lower.join(up, "root").select("key", F.least("root", "above").alias("root"), "old"))
        changed = new.filter("root < old").limit(1).count()
        labels = new.select("key", "root")
        if not changed:
            return labels


def _members(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_key, size, key and the least key that its set is connected with, root, of every row."""
    small_batches(docs.sparkSession)
    members = stored(_prefixes(docs, n, percent))
    sets = members.filter("size > 0").groupBy("key", "size").agg(F.first("cols").alias("cols"), F.first("signature").alias("signature"), F.first("wide").alias("wide"), F.min("text_key").alias("text_key"))
    shared = stored(_shared(sets))
    found = stored(sets.join(shared.select("key").distinct(), "key", "left_semi").drop("cols"))
    rows = found.select("key", "size", "signature", F.col("key").alias("part"))
    first = stored(_narrowed(_products(shared, rows, percent, all_pairs=False), found, percent))
    edges = stored(_verified(first, found, docs, n, percent))
    roots = components(edges)
    parted = rows.join(roots, "key", "left").select("key", "size", "signature", F.coalesce("root", "part").alias("part"))
    second = stored(_narrowed(_products(shared, parted, percent, all_pairs=True), found, percent))
    if second.limit(1).count():
        edges = stored(edges.union(_verified(second, found, docs, n, percent)).distinct())
        roots = components(edges)
    return members.select("doc_id", "text_key", "size", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def groups(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row."""
    rooted = _members(docs, n, percent)
    least = rooted.filter("size > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = rooted.join(least, "root", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they are: of the rows of a component one stays, that with the smallest doc_id (null last), then text hash; rows without words stay.

    Rows that are told apart by neither doc_id nor text are copies; one of them stays."""
    rooted = stored(_members(docs, n, percent).filter("size > 0"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    each = rooted.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).join(best, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    marked = stored(each.filter(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text"), stays.alias("__stays")))

    def rows(marks: DataFrame, how: str) -> DataFrame:
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__text"))
        return docs.join(marks, same, how)

    once = rows(marked, "left_anti")
    copies = marked.filter("__stays")
    if not copies.limit(1).count():
        return once
    return once.unionByName(rows(copies, "left_semi").dropDuplicates(["doc_id", "text"]))
