"""The registered query of each operator: production parameters over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, huffman, lines, packing, pieces, quality, shingles, sketches, toxicity, trie
from .common import table, tokenizer_path

BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"), min_words=50)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.groups(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_edits(table(spark, sf_dir, "documents"), longest=sketches.LONGEST)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.train_and_score(table(spark, sf_dir, "documents"), parts=7, held=2, order=3)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path(BPE), end=0, with_ids=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(PIECES), end=2, with_ids=False)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BPE), window=1024, end=0, with_ids=False)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_fingerprints": op5_fingerprints,
    "op6_language_model": op6_language_model,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_pieces": op9_pieces,
    "op10_packing": op10_packing,
}

ORACLE_SQL: dict[str, str] = {"op2_chat": chat.ORACLE_SQL}
