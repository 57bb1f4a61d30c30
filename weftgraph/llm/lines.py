"""Operator 1: deletes later copies of repeated line runs, found on a suffix array over line ids.

The corpus is a sequence of lines, cut at document ends. A suffix's rank at depth h names its first h lines: two suffixes have
equal ranks exactly if these lines are equal. Prefix doubling makes ranks of depth 2h from pairs of ranks of depth h, in a
window and a grouping per round; a rank is named by the place of its first suffix (only the equality of ranks is used,
so no global sort is needed). The suffixes of equal rank are a longest-common-prefix interval of that depth.

A run counts from `min_words` words on. From each line on, and up to each line, the shortest stretch with so many words
has a depth d; its interval is named by the ranks of its first and its last 2^k lines (2^k <= d < 2^(k+1)). A stretch
whose interval has an earlier member is a copy. These stretches cover every maximal repeated run whole: a line whose own
stretch leaves the run lies in the stretch that ends where the run ends.

Only lines that occur twice or more, in unbroken islands of min_words words, take part: a few hundredths of a corpus. Doubling
stops at the depth that is needed (at most min_words lines, as lines without a word are left out of the sequence).
A frequent line is one group in a partial aggregation, and its join is a skew join that AQE splits.

Defined results: null text is an empty text without lines; a line without a word is never deleted on its own and lies in
no run, but goes where both its neighbours in the text go; of equal doc_ids with different texts each is a
document of its own (in hash order), rows equal in both are one document and share its result; rows with a null doc_id are first; empty tables give no rows; other columns pass through `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored, words

MIN_WORDS = 50


def _sequence(docs: DataFrame) -> DataFrame:
    """A row per line with a word: doc_id, copy (the row among those of its doc_id), at (in the text), two hashes, number of words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.posexplode(F.split(text, "\n")).alias("at", "line")
    all_lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), lines)
    counted = all_lines.withColumn("n_words", F.size(words(F.col("line"))))
    return counted.filter(F.col("n_words") > 0).select("doc_id", "copy", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), "n_words")


def copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per maximal stretch of deleted lines: doc_id, copy, first, last (line numbers in the text), n_words."""
    spark = docs.sparkSession
    doc = ["doc_id", "copy"]
    # depth 1: equal lines; lines that occur once end every run
    seq = _sequence(docs)
    often = seq.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # a document's lines are numbered before the others go, so that islands stay apart
    by_line = Window.partitionBy(*doc).orderBy("at")
    numbered = seq.withColumn("i", F.dense_rank().over(by_line)).withColumn("before", F.lag("at").over(by_line)).filter("before is null or before < at").drop("before")
    repeated = numbered.join(often, ["h1", "h2"], "left_semi")
    in_doc = Window.partitionBy(*doc).orderBy("i")
    islands = repeated.withColumn("island", F.col("i") - F.row_number().over(in_doc))
    key = [*doc, "island"]
    whole = Window.partitionBy(*key)
    islands = islands.withColumn("w", F.sum("n_words").over(whole)).filter(F.col("w") >= min_words)
    # words up to and with each line; the shortest stretches of min_words words from a line on, and up to a line
    order = whole.orderBy("i")
    line = islands.select(*key, "i", "at", "n_words", F.xxhash64("h1", "h2").alias("rank"), F.sum("n_words").over(order).alias("to"))
    line = line.withColumn("lines", F.collect_list(F.struct("i", "to")).over(order.rowsBetween(0, min_words - 1)))
    line = line.withColumn("back", F.collect_list(F.struct(F.col("i"), (F.col("to") - F.col("n_words")).alias("before"))).over(order.rowsBetween(1 - min_words, 0)))
    ahead = F.filter("lines", lambda x: x["to"] - F.col("to") + F.col("n_words") >= min_words)
    behind = F.filter("back", lambda x: F.col("to") - x["before"] >= min_words)
    line = stored(line.select(*key, "i", "at", "n_words", "rank", F.get(ahead, F.lit(0))["i"].alias("until"), F.element_at(F.when(F.size(behind) > 0, behind), -1)["i"].alias("since")))
    place = lambda *x: F.struct(*(F.col(c) for c in x))
    stretch = F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("until").alias("b")), F.struct(F.col("since").alias("a"), F.col("i").alias("b")))).alias("s")
    stretches = line.select(*key, stretch).select(*key, "s.a", "s.b").filter("a is not null and b is not null").distinct()
    stretches = stretches.withColumn("depth", (F.col("b") - F.col("a") + 1).cast("int"))
    stretches = stored(stretches.withColumn("k", F.floor(F.log2(F.col("depth").cast("double")) + 1e-9).cast("int")))
    top = stretches.agg(F.max("k")).first()[0]
    found = None
    ranks = line.select(*key, "i", "rank")
    for k in range(0 if top is None else top + 1):
        if k:  # ranks of depth 2^k from those of depth 2^(k-1)
            h = 1 << (k - 1)
            paired = ranks.withColumn("next", F.lead("rank", h).over(order)).filter(F.col("next").isNotNull())
            names = paired.groupBy("rank", "next").agg(F.min(F.xxhash64(*key, "i")).alias("name"))
            ranks = stored(paired.join(names, ["rank", "next"]).select(*key, "i", F.col("name").alias("rank")))
        mine = stretches.filter(F.col("k") == k)
        first = mine.join(ranks.withColumnRenamed("i", "a").withColumnRenamed("rank", "r1"), [*key, "a"])
        both = first.withColumn("c", F.col("b") - (1 << k) + 1).join(ranks.withColumnRenamed("i", "c").withColumnRenamed("rank", "r2"), [*key, "c"])
        both = both.select(*key, "a", "b", "depth", "r1", "r2")
        found = both if found is None else found.unionByName(both)
    if found is None:
        return spark.createDataFrame([], "doc_id long, copy long, first int, last int, n_words long")
    found = stored(found)
    # the interval's earliest member stays; all others are copies
    interval = ["depth", "r1", "r2"]
    at = place("doc_id", "copy", "island", "a")
    earliest = found.groupBy(*interval).agg(F.min(at).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = found.join(earliest, interval).filter(F.coalesce(at != F.col("earliest"), F.lit(True)) & ~at.eqNullSafe(F.col("earliest"))).select(*key, "a", "b")
    deleted = later.select(*key, F.explode(F.sequence("a", "b")).alias("i")).distinct()
    gone = line.join(deleted, [*key, "i"], "left_semi")
    runs = gone.withColumn("run", F.col("i") - F.row_number().over(order))
    return runs.groupBy(*key, "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("n_words").alias("n_words")).select(*doc, "first", "last", "n_words")


def _without(text: Column, runs: Column) -> Column:
    """The text without these stretches of lines (first, last)."""
    kept = lambda lines, spans: F.filter(lines, lambda x, i: ~F.exists(spans, lambda r: (r["first"] <= i) & (i <= r["last"])))
    return let(F.split(text, "\n"), lambda lines: let(runs, lambda spans: F.array_join(kept(lines, spans), "\n")))


def _joined(docs: DataFrame, min_words: int) -> DataFrame:
    """docs with __runs: the stretches to delete, null for none."""
    runs = copies(docs, min_words).groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("first", "last", "n_words"))).alias("__runs"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    runs = runs.select(F.col("doc_id").alias("__doc"), F.col("copy").alias("__copy"), "__runs")
    return docs.join(runs, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(text) == F.col("__copy")), "left").drop("__doc", "__copy")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted_lines, n_deleted_words, deleted (stretches first, last, n_words) and what is left of the text."""
    joined = _joined(docs.select("doc_id", "text"), min_words)
    n_lines = F.size(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"))
    runs = F.coalesce(F.col("__runs"), F.array().cast("array<struct<first:int,last:int,n_words:bigint>>"))
    left = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__runs")))
    return joined.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        n_lines.cast("long").alias("n_lines"),
        F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1).alias("n_deleted_lines"),
        F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["n_words"]).alias("n_deleted_words"),
        runs.alias("deleted"),
        left.alias("text"),
    )


def keep(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, all columns as they are, with the copies gone from their texts."""
    left = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__runs")))
    out = _joined(docs, min_words)
    if "n_chars" in docs.columns:  # it counts the text's characters
        n_chars = F.when(F.col("__runs").isNull(), F.col("n_chars")).otherwise(F.char_length(left).cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", n_chars)
    return out.withColumn("text", left).select(*docs.columns)
