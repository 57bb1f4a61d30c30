"""Operator 5: document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, cut after sentence ends; one of more than `longest` words is cut further after each word
whose hash names a boundary, and every `longest` words from there, so that an edit changes only the pieces near it. Their
64-bit digests are a set. A sketch has blocks of CELLS
cells in three groups; a digest goes to the block and to one cell of each group that its bits name, and a cell holds a
count, the xor of its digests and the xor of their check hashes. Sketches of two versions subtract cell by cell: what they share
cancels. Peeling takes digests out of cells that hold one only, until all cells are empty; then the differing digests
are known, with their side. On failure larger sketches are compared, of more blocks; a block that fails is doubled by a further
bit of the digests, up to DOUBLINGS times.

The fingerprint is the one-block sketch, as text, after the number and hash of the characters. The likeness of two texts
is the Jaccard coefficient of their digests, from the peeled difference: (a + b - d) / (a + b + d).

The next document is found without a global sort: quantiles of doc_id (at most MAX_RANGES, on the driver) cut ids into ranges,
each range's first document is also sent to the range before, and a window inside the range does the rest: one
shuffle of the texts, in parts of about RANGE documents, whatever their keys.

Defined results: null text is an empty text; two empty texts have likeness 1, an empty and a full one 0; documents are in order of
doc_id (null first), then text, so rows with equal ids follow each other; a single document is its own next; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

CELLS, GROUP = 24, 8
PER_BLOCK = 6  # digests of both sides for which a block of the retry is made
ROUNDS = 6
DOUBLINGS = 8  # bits 48 to 55 of the digests
LONGEST, EVERY = 64, 16  # words of a piece at most; of so many words one is a boundary
RANGE, MAX_RANGES = 500, 16384


def _cut(w: Column, longest: int) -> Column:
    """The pieces of a paragraph of these words."""
    ends = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: (i == F.size(w)) | (F.pmod(F.xxhash64(F.get(w, i - 1)), F.lit(EVERY)) == 0))

    def piece(start: Column, end: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor((end - start - 1) / longest).cast("int"))
        return F.transform(steps, lambda k: F.array_join(F.slice(w, start + k * longest + 1, F.least(F.lit(longest), end - start - k * longest)), " "))

    return let(ends, lambda e: F.flatten(F.transform(e, lambda end, j: let(F.coalesce(F.get(e, j - 1), F.lit(0)), lambda start: piece(start, end)))))


def digests(text: Column, longest: int | None = None) -> Column:
    """The set of paragraph digests; paragraphs of more than longest words in pieces."""
    parts = F.filter(F.split(text, "\\n|(?<=[.!?]) "), lambda x: x != "")
    if longest is not None:
        parts = F.flatten(F.transform(parts, lambda x: let(F.split(x, " "), lambda w: F.when(F.size(w) <= longest, F.array(x)).otherwise(_cut(w, longest)))))
    return F.array_distinct(F.transform(parts, lambda x: F.xxhash64(x)))


def _cell(c: Column, k: Column, h: Column) -> Column:
    return F.struct(c.alias("c"), k.alias("k"), h.alias("h"))


def _per_group(make: Callable[[int], Callable[[Column], Column]]) -> Column:
    """The cells of all groups; make(group) gives a cell from its place there."""
    places = F.array(*(F.lit(j).cast("long") for j in range(GROUP)))
    return F.concat(*(F.transform(places, make(g)) for g in range(CELLS // GROUP)))


def _in_cell(digest: Column, group: int, place: Column) -> Column:
    return F.shiftrightunsigned(digest, 3 * group).bitwiseAND(F.lit(GROUP - 1).cast("long")) == place


def _block(mine: Column) -> Column:
    """The cells of some digests."""
    zero = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def add(a: Column, x: Column) -> Column:
        return _cell(a["c"] + 1, a["k"].bitwiseXOR(x), a["h"].bitwiseXOR(F.xxhash64(x)))

    def make(group: int) -> Callable[[Column], Column]:
        return lambda j: F.aggregate(F.filter(mine, lambda x: _in_cell(x, group, j)), zero, add)

    none = F.array_repeat(zero, CELLS)
    return F.when(F.size(mine) == 0, none).otherwise(_per_group(make))


def _power(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def minus(a: Column, b: Column) -> Column:
    """The cells of the difference: what both hold cancels."""
    return F.zip_with(a, b, lambda p, q: _cell(p["c"] - q["c"], p["k"].bitwiseXOR(q["k"]), p["h"].bitwiseXOR(q["h"])))


def _peel_block(cells: Column) -> Column:
    """struct(cells, found, live): what is left, and the digests taken out with their side (1: the first sketch's, -1: the second's)."""

    def taken(cells: Column, pure: Column) -> Column:
        def less(a: Column, p: Column) -> Column:
            return _cell(a["c"] - p["c"], a["k"].bitwiseXOR(p["k"]), a["h"].bitwiseXOR(p["h"]))

        def make(group: int) -> Callable[[Column], Column]:
            at = lambda j: F.get(cells, (j + GROUP * group).cast("int"))
            return lambda j: F.aggregate(F.filter(pure, lambda p: _in_cell(p["k"], group, j)), at(j), less)

        return _per_group(make)

    def round_(state: Column, _: Column) -> Column:
        pure = F.array_distinct(F.filter(state["cells"], lambda c: (F.abs(c["c"]) == 1) & (F.xxhash64(c["k"]) == c["h"])))
        found = lambda p: F.concat(state["found"], F.transform(p, lambda x: F.struct(x["k"].alias("k"), x["c"].alias("c"))))
        more = lambda p: F.struct(taken(state["cells"], p).alias("cells"), found(p).alias("found"), F.lit(True).alias("live"))
        end = F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("live"))
        return F.when(state["live"], let(pure, lambda p: F.when(F.size(p) == 0, end).otherwise(more(p)))).otherwise(state)

    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<k:bigint,c:int>>").alias("found"), F.lit(True).alias("live"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)


def peel(cells: Column) -> Column:
    """The differing digests with their side; null if they can't all be taken out."""
    empty = lambda c: (c["c"] == 0) & (c["k"] == 0) & (c["h"] == 0)
    return let(_peel_block(cells), lambda x: F.when(F.forall(x["cells"], empty), x["found"]))


def _dealt(a: Column, b: Column, shift: int, mask: Column, solve: Callable[[Column, Column], Column]) -> Column:
    """solve(part of a, part of b) for each value of some bits of the digests."""
    part = lambda x, value: F.filter(x, lambda d: F.shiftrightunsigned(d, shift).bitwiseAND(mask) == value)
    return F.transform(F.sequence(F.lit(0).cast("long"), mask), lambda v: let(part(a, v), lambda p: let(part(b, v), lambda q: solve(p, q))))


def difference(a: Column, b: Column, small_a: Column, small_b: Column) -> Column:
    """The digests in which the sets a and b differ, with their side; small_*: their one-block sketches.

    If these don't peel, sketches of enough blocks do; a block that fails is doubled and doubled again, and only after the last time sorted out by its digests."""
    nothing = F.array().cast("array<struct<k:bigint,c:int>>")

    def exact(p: Column, q: Column) -> Column:
        side = lambda x, y, c: F.transform(F.array_except(x, y), lambda k: F.struct(k.alias("k"), F.lit(c).alias("c")))
        return F.concat(side(p, q, 1), side(q, p, -1))

    def once(p: Column, q: Column) -> Column:
        return F.when(F.size(p) + F.size(q) == 0, nothing).otherwise(peel(minus(_block(p), _block(q))))

    def solve(p: Column, q: Column) -> Column:
        def step(got: Column, mask: Column) -> Column:
            return F.coalesce(got, let(_dealt(p, q, 48, mask, once), lambda x: F.when(F.forall(x, lambda y: y.isNotNull()), F.flatten(x))))

        masks = F.array(*(F.lit((1 << k) - 1).cast("long") for k in range(DOUBLINGS + 1)))
        return F.coalesce(F.aggregate(masks, F.lit(None).cast("array<struct<k:bigint,c:int>>"), step), exact(p, q))

    def larger(outer: Column, inner: Column) -> Column:
        # dealt out in two steps, so that the work grows with size * 2^(bits / 2)
        return F.flatten(_dealt(a, b, 16, outer, lambda p, q: F.flatten(_dealt(p, q, 32, inner, solve))))

    bits = F.ceil(F.log2(F.greatest((F.size(a) + F.size(b)) / F.lit(float(PER_BLOCK)), F.lit(1.0)))).cast("int")
    masks = lambda n, half: let(_power(half) - 1, lambda outer: let(_power(n - half) - 1, lambda inner: larger(outer, inner)))
    return F.coalesce(peel(minus(small_a, small_b)), let(bits, lambda n: masks(n, F.floor(n / 2).cast("int"))))


def likeness(a: Column, b: Column, d: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when(n == 0, F.lit(1.0)).otherwise((n - F.size(d)) / (n + F.size(d)).cast("double"))


def fingerprint(text: Column, small: Column) -> Column:
    cells = F.transform(small, lambda c: F.when((c["c"] == 0) & (c["k"] == 0), F.lit("")).otherwise(F.concat_ws(":", F.hex(c["c"]), F.hex(c["k"]), F.hex(c["h"]))))
    return F.concat_ws(";", F.char_length(text), F.hex(F.xxhash64(text)), F.array_join(cells, ","))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next: the text of the next document by doc_id; of the last, that of the first."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set(rows.agg(F.percentile_approx("doc_id", shares, 8 * ranges + 1000)).first()[0] or [])) if shares else []
    steps = len(bounds).bit_length()

    def found(known: Column) -> Column:  # how many bounds are at most doc_id, by bisection
        def step(width: int):
            return lambda a: F.when(F.coalesce(F.get(known, a + width - 1) <= F.col("doc_id"), F.lit(False)), a + width).otherwise(a)

        at = F.lit(0)
        for s in reversed(range(steps)):
            at = let(at, step(1 << s))
        return at

    ranged = rows.withColumn("range", let(F.lit(bounds), found) if bounds else F.lit(0))
    first = ranged.groupBy("range").agg(F.min(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).alias("first")).orderBy("range").collect()  # a row per range
    heads = [(r.first, first[k - 1].range) for k, r in enumerate(first)]
    also = F.broadcast(spark.createDataFrame(heads, "first long, before int"))  # at most MAX_RANGES rows
    sent = rows.join(also, F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == F.col("first")).select("doc_id", "text", F.col("before").cast("int").alias("range"), F.lit(True).alias("sent"), F.col("before").alias("b"))
    both = ranged.select("doc_id", "text", F.col("range").cast("int").alias("range"), F.lit(False).alias("sent")).unionByName(sent.drop("b"))
    order = Window.partitionBy("range").orderBy("sent", F.col("doc_id").asc_nulls_first(), "text")
    return both.withColumn("next", F.lead("text").over(order)).filter(~F.col("sent")).select("doc_id", "text", "next")


def compare_edits(docs: DataFrame, longest: int | None = None) -> DataFrame:
    """Every text against its edited form (last quarter from the next text) and against the next text."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    pairs = with_next(docs).withColumn("n", n).withColumn("quarter", quarter)
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n") - F.col("quarter")), F.substring("next", F.lit(1), F.col("quarter"))))
    sets = pairs.withColumn("a", digests(F.col("text"), longest)).withColumn("e", digests(F.col("edited"), longest)).withColumn("x", digests(F.col("next"), longest))
    small = sets
    for name in ("a", "e", "x"):
        small = small.withColumn(f"{name}1", _block(F.col(name)))
    c = F.col
    out = small.withColumn("de", difference(c("a"), c("e"), c("a1"), c("e1"))).withColumn("dx", difference(c("a"), c("x"), c("a1"), c("x1")))
    return out.select(
        "doc_id",
        c("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(c("text"), c("a1")).alias("fingerprint"),
        fingerprint(c("edited"), c("e1")).alias("edited_fingerprint"),
        likeness(c("a"), c("e"), c("de")).alias("near_edited"),
        likeness(c("a"), c("x"), c("dx")).alias("near_next"),
    )
