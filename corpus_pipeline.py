"""From raw documents to packed training sequences, in stages that are each written and read again.

Every stage but the last returns the columns of documents. Labels for the rules and the classifier come from sf_dir.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import lines, packing, quality, shingles, toxicity
from weftgraph.llm.common import shared_dir, table, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the risk-controlled quality rules reject."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score as toxic."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels")).keep(docs, below=0.3)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more leave the texts."""
    return lines.keep(docs, min_words=50)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, Jaccard 0.8 or more) the one with the smallest doc_id stays."""
    return shingles.keep(docs, n=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), window=1024, end=0, with_ids=False)


STAGES = [
    ("quality rules", good_quality),
    ("toxicity", not_toxic),
    ("line dedup", lines_once),
    ("n-gram Jaccard join", one_of_each),
    ("packing", packed),
]

#: Tokenisation and a fitted classifier are beyond SQL; tests compare with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{root}/{k}")
            docs = spark.read.parquet(f"{root}/{k}")
    return docs
