"""Okapi BM25."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import STOP_WORDS, index_tokens
from tessella.session import stored

K1, B = 1.5, 0.75


def query_terms(query: str | None) -> list[str]:
    """The distinct index tokens of a query, in order."""
    found = re.sub(r"[^a-z0-9\s]", " ", (query or "").lower()).split()
    return list(dict.fromkeys(t for t in found if len(t) >= 2 and t not in STOP_WORDS))


class Bm25Index:
    """BM25 over (id, text), counted when it is asked. Posting lists that are kept are in tessella.operators.postings."""

    def __init__(self, corpus: DataFrame):
        self.tokens = corpus.select("id", index_tokens(F.col("text")).alias("tokens"))

    @classmethod
    def load(cls, spark, path: str) -> Bm25Index:
        return cls.of(spark.read.parquet(path))

    @classmethod
    def of(cls, tokens: DataFrame) -> Bm25Index:
        """An index over texts that are tokens (id, tokens) already."""
        index = cls.__new__(cls)
        index.tokens = tokens
        return index

    def save(self, path: str) -> None:
        self.tokens.write.mode("overwrite").parquet(path)

    def size(self) -> int:
        return self.tokens.count()

    def lengths(self) -> DataFrame:
        return self.tokens.select("id", F.size("tokens").alias("dl"))

    def stats(self) -> DataFrame:
        """One row: n, avgdl (over all texts, empty ones too; 1 for no text)."""
        return self.tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("tokens")), F.lit(1.0)).alias("avgdl"))

    def frequencies(self, terms: list[str] | None = None) -> DataFrame:
        """(id, dl, term, tf), of these terms only if given."""
        kept = F.col("tokens") if terms is None else F.filter("tokens", lambda t: t.isin(terms))
        return self.tokens.select("id", F.size("tokens").alias("dl"), F.explode(kept).alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))

    def term_stats(self, terms: list[str] | None = None) -> DataFrame:
        """(term, df, idf)."""
        kept = F.array_distinct(F.col("tokens") if terms is None else F.filter("tokens", lambda t: t.isin(terms)))
        df = self.tokens.select(F.explode(kept).alias("term")).groupBy("term").agg(F.count("*").alias("df"))  # combines before the shuffle
        return df.crossJoin(F.broadcast(self.stats())).select("term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))

    def score(self, query: str, top: int | None = None) -> DataFrame:
        """(id, score) of the texts with a term of the query; the best ``top`` in order if given.

        One scan of the texts and no shuffle: it writes a text's length and those of its tokens that
        are terms. One row of counts comes to the driver (texts, average length, a document
        frequency a term); then each text is scored by itself.
        """
        terms = query_terms(query)
        slim = stored(self.tokens.select("id", *matches(F.col("tokens"), terms)), "matches")
        out = slim.where(F.size("hits") > 0).select("id", term_scores(terms, slim.agg(*term_counts(terms)).first()).alias("score"))
        return out if top is None else out.orderBy(F.desc("score"), "id").limit(top)

    def score_all(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, score) for queries (query_id, query)."""
        asked = queries.select("query_id", F.explode(F.array_distinct(index_tokens(F.col("query")))).alias("term"))
        few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        tf, df = self.asked_frequencies(asked, few)
        part = idf(F.col("n"), F.col("df")) * saturated(F.col("tf"), F.col("dl"), F.col("avgdl"))
        weighed = asked.join(df, "term").crossJoin(F.broadcast(self.stats()))  # one row
        return tf.join(F.broadcast(weighed) if few else weighed, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))

    def asked_frequencies(self, asked: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
        """(id, dl, term, tf) and (term, df) for the terms of asked (term, ...).

        With few terms the tokens of a text meet them, and are counted, where the text is read;
        the counts are written once and read for df and for the scores.
        """
        terms = asked.select("term").distinct()
        each = self.tokens.select("id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term"))  # explode() adds a filter that cuts the texts into tokens again; the join drops nulls
        tf = stored(each.join(F.broadcast(terms) if few else terms, "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), "term-frequencies")
        return tf, tf.groupBy("term").agg(F.count("*").alias("df"))


#: More distinct (query, term) pairs than these meet the texts by a shuffle and not by a broadcast.
BROADCAST_TERMS = 200_000


def idf(n, df):
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def saturated(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def matches(tokens: Column, terms: list[str]) -> list[Column]:
    """dl, the number of tokens, and hits, those that are among the terms."""
    both = F.transform(F.array(tokens), lambda t: F.struct(F.size(t).alias("dl"), F.filter(t, lambda x: x.isin(terms)).alias("hits")))[0]
    return [both["dl"].alias("dl"), both["hits"].alias("hits")]


def term_counts(terms: list[str]) -> list[Column]:
    """Aggregates over (dl, hits): texts, average length, document frequencies."""
    return [F.count("*"), F.coalesce(F.avg("dl"), F.lit(1.0)), *[F.count_if(F.array_contains("hits", t)) for t in terms]]


def term_scores(terms: list[str], counts: Sequence) -> Column:
    """The score of a text (dl, hits), given the row of term_counts()."""
    n, avgdl = counts[0], counts[1]
    score = F.lit(0.0)
    for t, df in zip(terms, counts[2 : 2 + len(terms)], strict=True):
        if df:
            tf = F.size("hits") - F.size(F.array_remove("hits", t))
            score = score + math.log((n - df + 0.5) / (df + 0.5) + 1) * saturated(tf, F.col("dl"), F.lit(avgdl))
    return score
