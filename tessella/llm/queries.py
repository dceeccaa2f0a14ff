"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .bpe import decode, digests, encode, load_ranks
from .clustering import cluster
from .common import new_path, table
from .decontaminate import decontaminate
from .licenses import scan
from .html_text import extract
from .langid import identify, load_pieces
from .line_dedup import line_report
from .minhash import link
from .quality import judge
from .search_index import build, search
from .token_counts import count_tokens, load_tokenizer
from .url_filters import filter_urls, sample_entries
from .warc import read_archives, write_archives


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return digests(decode(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).drop("digest")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("url")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch time: page n counts as fetched on day n mod 366 of 2024."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).cast("timestamp")
    found = filter_urls(pages.select("page_id", "url", fetched.alias("fetched_at")), sample_entries(spark))
    return found.select("page_id", "url", F.to_date("fetched_at").cast("string").alias("fetched"), "host", F.array_join("lists", ",").alias("lists"), "blocked")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "n_links", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), load_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "digest", "license", F.array_join("line_licenses", ",").alias("line_licenses"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_tokenizer(public_tokenizers.path("word_bpe_49k.json")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_minhash_dedup, op3_warc, op4_quality_rules, op5_url_filters, op6_html_text, op7_line_dedup, op8_decontaminate, op9_language_id, op10_license_scan, op11_centroid_clustering, op12_token_counts, op13_ranked_search)}
SQL = {k: v for k, v in sql.SQL.items() if k in QUERIES}
