"""Quality of answers against expected answers, keywords and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import contains_ci, eval_tokens, rounded

PASS_MARK = 30.0


def keyword_recall(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that the answer holds; 1 without keywords."""
    found = F.size(F.filter(keywords, lambda k: contains_ci(answer, k)))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(found / F.size(keywords))


def token_f1(answer: Column, expected: Column) -> Column:
    """Distinct common tokens over the token counts, repeats included, of both sides."""
    return _f1(eval_tokens(answer), eval_tokens(expected))


def _f1(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    precision, recall = common / F.size(a), common / F.size(b)
    f1 = F.when(common > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(f1)


def factual_overlap(answer: Column, expected: Column) -> Column:
    """Share of the distinct expected tokens that the answer has."""
    return _overlap(eval_tokens(answer), eval_tokens(expected))


def _overlap(a: Column, b: Column) -> Column:
    b = F.array_distinct(b)
    return F.when(F.size(b) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(b))


def _relevant(sources: Column, keywords: Column) -> Column:
    return F.filter(sources, lambda s: F.exists(keywords, lambda k: contains_ci(s, k)))


def retrieval_precision(sources: Column, keywords: Column) -> Column:
    """Share of the sources (texts) that hold a keyword."""
    return F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, 0.0).otherwise(F.size(_relevant(sources, keywords)) / F.size(sources))


def retrieval_hit(sources: Column, keywords: Column) -> Column:
    return F.coalesce(F.size(_relevant(sources, keywords)) > 0, F.lit(False))


def overall(recall: Column, f1: Column, overlap: Column, sources: Column, precision: Column) -> Column:
    """0 to 100. With sources, their precision makes a fifth of it."""
    score = recall * 40 + f1 * 30 + overlap * 30
    return rounded(F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, score * 0.8 + precision * 20).otherwise(score), 1)


def _final(k: Column, f: Column, o: Column, p: Column, hit: Column, score: Column, pass_mark: float) -> list[Column]:
    return [
        rounded(k, 6).alias("keyword_recall"), rounded(f, 6).alias("token_f1"), rounded(o, 6).alias("factual_overlap"), rounded(p, 6).alias("retrieval_precision"),
        hit.alias("retrieval_hit"), score.alias("overall_score"), (score >= pass_mark).alias("passed"),
    ]


def all_metrics(answer: Column, expected: Column, keywords: Column, sources: Column, pass_mark: float = PASS_MARK) -> list[Column]:
    k, f, o, p = keyword_recall(answer, keywords), token_f1(answer, expected), factual_overlap(answer, expected), retrieval_precision(sources, keywords)
    return _final(k, f, o, p, retrieval_hit(sources, keywords), overall(k, f, o, sources, p), pass_mark)


def with_metrics(rows: DataFrame, answer: str, expected: str, keywords: str, sources: str, pass_mark: float = PASS_MARK) -> tuple[DataFrame, list[Column]]:
    """rows with columns for what the metrics share, and all_metrics() of them: texts are cut into tokens once a row."""
    own = F.col(sources)
    cut = rows.withColumns({"_ta": eval_tokens(F.col(answer)), "_te": eval_tokens(F.col(expected))})
    met = cut.withColumns({"_k": keyword_recall(F.col(answer), F.col(keywords)), "_f": _f1(F.col("_ta"), F.col("_te")), "_o": _overlap(F.col("_ta"), F.col("_te")), "_p": retrieval_precision(own, F.col(keywords))})
    met = met.withColumn("_score", overall(F.col("_k"), F.col("_f"), F.col("_o"), own, F.col("_p")))
    return met, _final(*(F.col(c) for c in ("_k", "_f", "_o", "_p")), retrieval_hit(own, F.col(keywords)), F.col("_score"), pass_mark)
