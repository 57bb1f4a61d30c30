"""Operator 3: quality rules whose cutoffs carry a risk guarantee.

Each rule is a number per text, larger for worse texts. Labelled documents (crc32 folds play no part: the bound is exact
for any fixed cutoff) that pass the base rules are the holdout. In each stratum (language) and for each rule the candidate
cutoffs are tested from the mildest on, at each share of the risk (risk * k / SHARES): P(Binomial(n, share) <= false rejections
seen) must stay at or below delta / (rules * strata * SHARES), and testing stops at the first failure. That is fixed-sequence
testing within a rule and share and Bonferroni over rules, shares and strata: with probability 1 - delta, no cutoff that passes
rejects more than its share of a stratum's good documents. Of those, the cutoff that rejects most bad documents per good one
is taken for each rule and share, and the shares are dealt to the rules for the largest gain, so that they add up to `risk` at most:
all rules of a stratum together reject no more than `risk` of its good documents. Without a gain a rule stays off.

All of it is DataFrame expressions. Documents are read twice and never shuffled; what is gathered is a table of at most
strata x rules x BINS x SHARES counts, whose size is fixed by parameters.

Defined results: null text has no words (base_failed); languages beyond `strata`, and null, are the stratum "other"; a null
label is no label, of repeated labels of one doc_id the best holds; rows are kept as they are; columns of `docs` with the same
names as results are not read; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, stored, words

BINS = 100
STRATA = ("en", "de", "fr", "es")
#: Rule -> the value at its last cutoff; cutoffs are this, in BINS equal steps from 0.
RULES = {"symbols": 1.0, "capitals": 1.0, "bangs": 1.0, "repeats": 1.0, "same_lines": 1.0, "word_length": 40.0}
RISK, DELTA = 0.02, 0.05
SHARES = 6  # equal parts of the risk that are dealt to the rules of a stratum


def repeated_words(w: Column) -> Column:
    """How many words lie in 3-word windows that are found twice or more in the list w."""

    def covered(hashes: Column) -> Column:
        # windows in order of their hash, ties by position: equal ones are neighbours
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            return F.filter(F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"])), lambda i: i.isNotNull())

        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(F.sort_array(let(pairs, positions)), start, step, lambda a: a["n"])

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    def windows(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))

    return let(w, lambda v: F.when(F.size(v) < 4, F.lit(0).cast("long")).otherwise(let(windows(v), count)))


def measure(docs: DataFrame, into: str) -> DataFrame:
    """docs with a struct of the base statistics, the rules and the stratum."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    chars = lambda keep: F.char_length(F.regexp_replace(text, keep, "")).cast("long")  # noqa: E731  what is left of the text

    def of(w: Column, found: Column) -> Column:
        n_words = F.size(w).cast("long")
        return F.struct(
            n_words.alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            chars("[^#*$%&|<>]+").alias("n_symbols"),
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            chars("\\P{Lu}+").alias("n_capitals"),
            chars("[^!]+").alias("n_bangs"),
        )

    def rules(s: Column) -> Column:
        per = lambda a, b: s[a] / F.greatest(s[b], F.lit(1))
        return F.struct(
            *(s[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            ((s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])).alias("base_failed"),
            F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise("other").alias("stratum"),
            F.struct(
                per("n_symbols", "word_chars").alias("symbols"),
                per("n_capitals", "word_chars").alias("capitals"),
                per("n_bangs", "word_chars").alias("bangs"),
                per("n_repeat_words", "n_words").alias("repeats"),
                per("n_dup_lines", "n_lines").alias("same_lines"),
                per("word_chars", "n_words").alias("word_length"),
            ).alias("rules"),
        )

    return docs.withColumn(into, let(words(F.col("text").cast("string")), lambda w: let(lines, lambda found: let(of(w, found), rules))))


def _log_factorial(n: Column) -> Column:
    """ln n!: exact up to 20, then Stirling's series, whose error is below 1e-12."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n: Column, k: Column, p: float | Column) -> Column:
    """P(Binomial(n, p) <= k), summed from k down; terms further than 12 deviations below k are below 1e-30 of the sum. 1 where k is above n * p."""
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    terms = F.least(k, F.ceil(50 + 12 * F.sqrt(n * p))).cast("int")
    down = F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] * (k - i) / (n - k + i + 1) * ((1 - p) / p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(down, start, add, lambda a: a["sum"])
    return F.when(n == 0, F.lit(1.0)).when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), first * total))


def cutoffs(measured: DataFrame, into: str, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """A row per stratum, of at most len(STRATA) + 1: stratum and a cutoff per rule, null where the rule is off."""
    known = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col("quality").cast("int")).alias("__good"))
    of = measured.select(F.col("doc_id").cast("long").alias("__id"), F.col(f"{into}.stratum").alias("stratum"), F.col(f"{into}.base_failed").alias("failed"), F.col(f"{into}.rules").alias("rules"))
    held = of.join(known, "__id").filter(~F.col("failed"))
    bins = F.array(*(F.struct(F.lit(r).alias("rule"), F.least(F.lit(BINS), F.floor(F.col("rules")[r] / top * BINS)).cast("int").alias("bin")) for r, top in RULES.items()))
    counts = held.select("stratum", "__good", F.explode(bins).alias("x")).groupBy("stratum", "x.rule", "x.bin").agg(F.sum("__good").alias("good"), F.sum(1 - F.col("__good")).alias("bad"))
    each = Window.partitionBy("stratum", "rule")
    from_top = each.orderBy(F.col("bin").desc())
    level = delta / (len(RULES) * (len(STRATA) + 1) * SHARES)
    tested = counts.select("stratum", "rule", "bin", F.sum("good").over(each).alias("n"), F.sum("good").over(from_top).alias("k"), F.sum("bad").over(from_top).alias("rejected"))
    tested = tested.withColumn("share", F.explode(F.array(*(F.lit(x) for x in range(1, SHARES + 1)))))
    milder = Window.partitionBy("stratum", "rule", "share").orderBy(F.col("bin").desc())
    tested = tested.withColumn("p", F.max(binomial_tail(F.col("n"), F.col("k"), F.col("share") * risk / SHARES)).over(milder))
    gain = F.col("rejected") - 5 * F.col("k")
    passing = tested.filter((F.col("p") <= level) & (F.col("bin") > 0) & (gain > 0))
    options = passing.groupBy("stratum", "rule", "share").agg(F.max_by("bin", F.struct(gain, "bin")).alias("bin"), F.max(gain).alias("gain"))
    ways = [w for w in product(range(SHARES + 1), repeat=len(RULES)) if 0 < sum(w) <= SHARES]
    dealt = measured.sparkSession.createDataFrame([(i, r, x) for i, w in enumerate(ways) for r, x in zip(RULES, w) if x], "way int, rule string, share int")
    taken = options.join(F.broadcast(dealt), ["rule", "share"])  # of a fixed size, as are the options
    ranked = taken.groupBy("stratum", "way").agg(F.sum("gain").alias("gain"), F.collect_list(F.struct("rule", "bin")).alias("cutoffs"))
    best = ranked.groupBy("stratum").agg(F.max_by("cutoffs", F.struct("gain", "way")).alias("cutoffs")).select("stratum", F.explode("cutoffs").alias("x")).select("stratum", "x.rule", "x.bin")
    return best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("bin") * top / BINS)).alias(r) for r, top in RULES.items()))


def judged(measured: DataFrame, into: str, limits: DataFrame) -> DataFrame:
    """measured with a column kept."""
    found = F.broadcast(limits.select(F.col("stratum").alias("__stratum"), F.struct(*RULES).alias("__limits")))  # at most len(STRATA) + 1 rows
    joined = measured.join(found, F.col(f"{into}.stratum") == F.col("__stratum"), "left")
    # a cutoff is the lower end of a bin, so a text is rejected from its bin on
    over = [F.coalesce(F.floor(F.col(f"{into}.rules")[r] / top * BINS) >= F.round(F.col("__limits")[r] / top * BINS), F.lit(False)) for r, top in RULES.items()]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return joined.withColumn("__kept", ~F.col(f"{into}.base_failed") & ~rejected).drop("__stratum", "__limits")


def rate(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and the rules' values of every document."""
    measured = stored(measure(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")), "q").drop("text", "lang"))
    base = [F.col(f"q.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return judged(measured, "q", cutoffs(measured, "q", labels, risk, delta)).select("doc_id", *base, F.col("__kept").alias("kept"), F.col("q.stratum").alias("stratum"), *(F.col(f"q.rules.{r}").alias(r) for r in RULES))


def keep(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The documents that are kept, all columns as they are."""
    limits = stored(cutoffs(measure(docs, "__quality"), "__quality", labels, risk, delta))
    return judged(measure(docs, "__quality"), "__quality", limits).filter("__kept").select(*docs.columns)
