"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All
but the last return the columns that they were given. Null and empty texts go in the first
stage; ids may be null or repeat, and other columns may have any names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, common, decontaminate, langid, line_dedup, minhash

#: Documents whose best language has a lower posterior are rejected.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    pieces = langid.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    lang, score = common.unused(docs, "lang_pred", "score")
    return langid.label(docs, pieces).where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; documents of which nothing is left go too."""
    left = line_dedup.dedup_lines(docs).where(F.col("text").rlike(common.NOT_BLANK))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id. The threshold is op2's own: 85 percent of five-word shingles.

    Rows equal in doc_id and shingles are one; rows without doc_id or without words stay.
    """
    return minhash.keep_one(docs).select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Other rows of their doc_id, or without one, stay."""
    hits, _ = decontaminate.find_windows(docs, common.table(spark, sf_dir, "benchmark"))
    id_, text = common.unused(docs, "hit", "hit_text")
    hit = hits.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(text)).distinct()
    own = docs["doc_id"].eqNullSafe(hit[id_]) & (F.xxhash64(docs["text"]) == hit[text])
    return docs.join(hit, own, "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, and the digests of the ids and of the text that they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return bpe.digests(decoded, "token_ids")


STAGES = [("language_id", language_id), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontaminate", benchmarks), ("byte_bpe", tokens)]

#: SQL expresses neither the learned languages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
