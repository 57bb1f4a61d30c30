"""Vector and full-text search over all rows, with pushed-down projections."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Of two float lists, in double arithmetic; null for null, 0 for an empty list or a zero norm, an error for different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    score = F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).otherwise(score)


def query_tokens(query: str) -> list[str]:
    return [t for t in re.findall(r"[A-Za-z0-9_]+", query.lower()) if t not in ("and", "or", "not")]


def text_score(query: str, *fields: Column) -> Column:
    """The share of the query's tokens that the fields, joined by blanks, contain as substrings."""
    tokens = query_tokens(query)
    if not tokens:
        return F.lit(0.0)
    blob = F.lower(F.concat_ws(" ", *fields))
    return sum((F.contains(blob, F.lit(t)).cast("int") for t in tokens[1:]), F.contains(blob, F.lit(tokens[0])).cast("int")) / F.lit(float(len(tokens)))


def full_text(df: DataFrame, query: str, fields: list[str], limit: int | None = None, tie: str | None = None) -> DataFrame:
    """Rows with a positive score, best first, as column score."""
    found = df.withColumn("score", text_score(query, *(F.col(f"`{f}`") for f in fields))).filter("score > 0")
    if limit is not None:
        found = found.orderBy(F.col("score").desc(), *([F.col(f"`{tie}`")] if tie else [])).limit(limit)
    return found


def nearest(rows: DataFrame, wanted: DataFrame, k: int, above: float = float("-inf"), floats: int = 1 << 22) -> DataFrame:
    """query, id, score, place: for each wanted (id, vector) the k rows (id, vector) of highest cosine above a bound, exactly; equal scores go by id.

    Both sides are cut into blocks of about so many floats; a task multiplies one block by another and keeps k rows a query,
    so only those are sorted over all blocks. Scores are rounded to 9 digits. Null vectors have no score, the zero vector has 0,
    vectors of different lengths are an error.
    """

    def blocks(df: DataFrame) -> int:
        n = df.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
        return -(-n // floats) or 1

    rows, wanted = (df.select("id", "vector").filter("id is not null and vector is not null") for df in (rows, wanted))
    n_rows, n_wanted = blocks(rows), blocks(wanted)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # dealt by place, not by id or content, so that repeated rows fill no block
    by_place = lambda n: (F.monotonically_increasing_id() % n).cast("int")
    left = rows.withColumn("a", by_place(n_rows)).withColumn("b", spread(n_wanted))
    right = wanted.withColumn("b", by_place(n_wanted)).withColumn("a", spread(n_rows))

    def unit(x: pd.Series) -> np.ndarray:
        m = np.stack(x.to_numpy()).astype(float)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)

    def product(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = {"query": [], "id": [], "score": []}
        if len(rows) and len(wanted):
            ids, table = rows["id"].to_numpy(), unit(rows["vector"])
            queries, asked = wanted["id"].to_numpy(), unit(wanted["vector"])
            for begin in range(0, len(queries), 64):
                for query, score in zip(queries[begin:], np.round(asked[begin : begin + 64] @ table.T, 9)):
                    least = np.partition(score, -k)[-k] if len(score) > k else -np.inf
                    at = np.flatnonzero((score >= least) & (score > above))
                    at = at[np.lexsort((ids[at], -score[at]))][:k]
                    found["query"].append(np.full(len(at), query))
                    found["id"].append(ids[at])
                    found["score"].append(score[at])
        return pd.DataFrame({c: np.concatenate(x) if x else [] for c, x in found.items()})

    kind = rows.schema["id"].dataType.simpleString()
    some = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(product, f"query {wanted.schema['id'].dataType.simpleString()}, id {kind}, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return some.withColumn("place", F.row_number().over(best).cast("long")).filter(F.col("place") <= k)
