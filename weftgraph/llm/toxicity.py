"""Operator 8: toxicity by a counterfactual-regularised linear classifier.

A text's features are its distinct words and the words' beginnings, hashed. A logistic regression over the features that
tell the labels apart best is fitted with one more penalty: in each labelled text that names a group of people, the
identity terms are swapped for others, and the squared change of the score is added to the loss. So the model can't use
the mention of a group as evidence.

The fit uses a bounded sample of the labelled rows (SAMPLE, chosen by a hash of the doc_id); feature counts are summed on
the executors, and the driver sees FEATURES rows and the sample's selected features only. Scores are computed where the
texts are: no shuffle of documents. Labels are joined by broadcast, as the sample's bound holds for them.

Defined results: null and empty texts get the score of a text without features; a null label is no label; of repeated
labels of one doc_id the larger holds; without labels of both kinds every score is the share of toxic labels (0 without
any); rows are kept as they are; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches

SAMPLE = 20_000
FEATURES = 4096
BUCKETS = 1 << 18
RIDGE = 0.3  # of a single row; the penalty falls as rows come in
PREFIXES = (3, 4, 5, 6, 7)
#: Groups of terms that may stand for each other in a sentence; each group is of one language, and no term is in two.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    # English
    ("women", "men"),
    ("woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender"),
    ("immigrants", "citizens", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "sighted"),
    # German
    ("frauen", "männer"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("muslimische", "christliche", "jüdische", "buddhistische", "atheistische"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische"),
    ("schwule", "lesbische", "bisexuelle", "heterosexuelle"),
    ("einwanderer", "bürger", "flüchtlinge", "ausländer", "einheimische"),
    ("alte", "junge", "ältere", "jugendliche"),
    ("blinde", "gehörlose", "behinderte", "sehende"),
    # French
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("immigrés", "citoyens", "réfugiés", "étrangers", "autochtones"),
    ("vieux", "jeunes", "âgés", "adolescents"),
    ("aveugles", "sourds", "handicapés", "voyants"),
    # Spanish
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "bisexuales", "heterosexuales"),
    ("inmigrantes", "ciudadanos", "refugiados", "extranjeros", "nativos"),
    ("viejos", "jóvenes", "ancianos", "adolescentes"),
    ("ciegos", "sordos", "discapacitados", "videntes"),
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…¡¿"


def _word_features(word: str) -> list[int]:
    raw = [f"w{word}"] + [f"p{word[:n]}" for n in PREFIXES if len(word) >= n]
    return [zlib.crc32(x.encode()) % BUCKETS for x in raw]


def _words(text: str | None) -> set[str]:
    return {w.strip(PUNCTUATION) for w in (text or "").lower().split()} - {""}


class _Features(dict):
    """Word -> its features among the wanted ones."""

    def __init__(self, wanted: dict[int, int] | None) -> None:
        super().__init__()
        self.wanted = wanted

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        got = _word_features(word)
        if self.wanted is not None:
            got = [self.wanted[f] for f in got if f in self.wanted]
        self[word] = got = tuple(got)
        return got

    def of(self, words: set[str]) -> set[int]:
        return {f for w in words for f in self[w]}


def _swapped(words: set[str], groups: tuple[tuple[str, ...], ...], by: int) -> set[str] | None:
    """The words with each identity term replaced by the one so many places on in its group; None without such terms."""
    on = {w: g[(k + by) % len(g)] for g in groups for k, w in enumerate(g)}
    return {on.get(w, w) for w in words} if any(w in on for w in words) else None


class Model:
    """Weights by feature, the intercept, and the number of fitted texts that name a group (so the penalty is idle at 0)."""

    def __init__(self, wanted: list[int], weights: np.ndarray, intercept: float, swapped: int = 0) -> None:
        self.swapped = swapped
        self.wanted = {f: k for k, f in enumerate(wanted)}
        self.weights, self.intercept = weights, float(intercept)

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, score: the probability of the label, from 0 to 1."""
        small_batches(docs.sparkSession)
        wanted, weights, intercept = self.wanted, self.weights.tolist(), self.intercept

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = _Features(wanted)
            for b in batches:
                raw = [intercept + sum(weights[f] for f in sorted(features.of(_words(t)))) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(raw, float), -500, 500))))], ["doc_id", "score"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")

    def keep(self, docs: DataFrame, below: float) -> DataFrame:
        """The documents, all columns as they are, whose score is below the threshold."""
        small_batches(docs.sparkSession)
        wanted, weights, intercept, at = self.wanted, self.weights.tolist(), self.intercept, docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            features = _Features(wanted)
            for b in batches:
                raw = [intercept + sum(weights[f] for f in sorted(features.of(_words(t)))) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(np.array(raw, float), -500, 500))) < below))

        return docs.mapInArrow(run, docs.schema)


def minimise(rows: list[np.ndarray], labels: np.ndarray, swaps: list[tuple[int, np.ndarray]], n: int, strength: float, ridge: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of least mean log loss + ridge |w|^2 + strength * mean squared change by swaps (full-batch Adam)."""
    flat = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # of each swap only the features that change: +1 for those that come, -1 for those that go
    change = [(k, np.setdiff1d(new, rows[i]), np.setdiff1d(rows[i], new)) for k, (i, new) in enumerate(swaps)]
    c_flat = np.concatenate([np.concatenate([a, d]) for _, a, d in change]).astype(np.int64) if change else np.empty(0, np.int64)
    c_sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(d))]) for _, a, d in change]) if change else np.empty(0)
    c_at = np.concatenate([np.full(len(a) + len(d), k) for k, a, d in change]).astype(np.int64) if change else np.empty(0, np.int64)
    share = labels.mean()
    w, b = np.zeros(n), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for step in range(1, steps + 1):
        z = b + np.bincount(at, w[flat], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / len(rows)
        gradient = np.bincount(flat, error[at], n) + 2 * ridge * w
        if change:
            moved = np.bincount(c_at, c_sign * w[c_flat], len(change))
            gradient += 2 * strength / len(change) * np.bincount(c_flat, c_sign * moved[c_at], n)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        rate, one, two = 0.1 * (1 - step / (steps + 1)), 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / one) / (np.sqrt(v / two) + 1e-12)
        b -= rate * (mb / one) / (np.sqrt(vb / two) + 1e-12)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES, strength: float = 1.0, groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> Model:
    """The model from the labelled documents (doc_id, toxic) whose crc32(doc_id) mod 4 isn't 2."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 4) != 2)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < total:
        return Model([], np.empty(0), 500.0 if total and toxic == total else -500.0)
    if total > sample:  # on average so many rows; never above twice that
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007)) < int(1_000_000_007 * sample / total))
    chosen = F.broadcast(known.limit(2 * sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, totals = _Features(None), np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            for text, toxic in zip(*(c.to_pylist() for c in b.columns)):
                totals[toxic, sorted(by_word.of(_words(text)))] += 1
                totals[toxic, BUCKETS] += 1
        used = np.flatnonzero(totals.sum(0) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[1, used], pa.int64()), pa.array(totals[0, used], pa.int64())], ["feature", "toxic", "clean"])

    counts = rows.mapInArrow(count, "feature int, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).persist()
    try:
        sums = counts.filter(F.col("feature") == BUCKETS).first()
        if sums is None or not sums.a or not sums.b:
            return Model([], np.empty(0), 500.0 if sums and sums.a else -500.0)
        c, d = F.lit(float(sums.a)) - F.col("a"), F.lit(float(sums.b)) - F.col("b")
        chi = F.pow(F.col("a") * d - F.col("b") * c, F.lit(2.0)) / ((F.col("a") + F.col("b")).cast("double") * (c + d) + 1e-9)
        best = counts.filter((F.col("feature") < BUCKETS) & (F.col("a") + F.col("b") >= 3)).orderBy(chi.desc(), "feature").limit(min(features, max(64, int(sums.a + sums.b) // 4)))  # few rows tell few features
        wanted = sorted(r.feature for r in best.select("feature").collect())
    finally:
        counts.unpersist()
    index = {f: k for k, f in enumerate(wanted)}

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = _Features(index)
        for b in batches:
            own, swapped = [], []
            for text in b.column(0).to_pylist():
                words = _words(text)
                own.append(sorted(by_word.of(words)))
                swapped.append([sorted(by_word.of(x)) for by in (1, 2) if (x := _swapped(words, groups, by)) is not None])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32())))], ["toxic", "own", "swapped"])

    got = sorted((r.toxic, r.own, r.swapped) for r in rows.mapInArrow(select, "toxic int, own array<int>, swapped array<array<int>>").collect())  # at most 2 * sample rows
    swaps = [(k, np.array(s, np.int64)) for k, (_, _, swapped) in enumerate(got) for s in swapped]
    weights, intercept = minimise([np.array(own, np.int64) for _, own, _ in got], np.array([t for t, _, _ in got], float), swaps, len(wanted), strength, RIDGE / len(got))
    return Model(wanted, weights, intercept, sum(1 for _, _, x in got if x))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = fit(docs, labels).score(docs)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
