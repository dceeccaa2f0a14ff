"""Retrieval: score, threshold, one row a content, top-k.

Ties go to the smaller id. Scores come from all vectors; nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import fingerprint, index_tokens, span, with_context
from tessella.functions.vector import cosine, literal, metric
from tessella.session import stored

from .blocked import best_distinct, best_each
from .bm25 import BROADCAST_TERMS, Bm25Index, idf, matches, query_terms, term_counts, term_scores
from .postings import counted

DOCUMENT_THRESHOLD, CHUNK_THRESHOLD, HYBRID_THRESHOLD, TOP, ALPHA = 0.6, 0.4, 0.0, 5, 0.7
#: More hits than these meet their chunks by a shuffle and not by a broadcast.
FEW_HITS = 10_000
#: Distinct terms of a batch of queries up to which texts are met by a list of them, and not by a join.
LISTED_TERMS = 20_000


def deduplicate(rows: DataFrame, content: Column, *order: Column, by: Sequence[str] = ()) -> DataFrame:
    """The first row, in this order, of each normalised content (within ``by``)."""
    w = W.partitionBy(*by, "_fp").orderBy(*order)
    return rows.withColumn("_fp", fingerprint(content)).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_fp", "_rn")


def best(rows: DataFrame, content: Column, threshold: float, top: int | None, key: str) -> DataFrame:
    """Above the threshold, one row a content, the ``top`` best, as (key, score). Contents stay where they are read."""
    scored = rows.where(F.col("score") > threshold).select(F.col(key).cast("bigint").alias("id"), fingerprint(content).alias("_fp"), "score")
    return best_distinct(scored, top).withColumnRenamed("id", key)


def document_search(docs: DataFrame, vector: list[float], search_type: object = "cosine", top: int | None = TOP, threshold: float = DOCUMENT_THRESHOLD) -> DataFrame:
    """(content, score, id) from docs (id, content, embedding). Unknown types mean cosine.

    No more than ``top`` rows a task are shuffled, without contents; those are fetched for the hits.
    """
    scored = docs.where("embedding is not null").select("id", "content", metric(search_type)(F.col("embedding"), literal(vector)).alias("score"))
    hits = best(scored, F.col("content"), threshold, top, "id")
    met = docs.select("id", "content").join(F.broadcast(hits) if top is not None and top <= FEW_HITS else hits, "id")
    return met.select("content", "score", "id").orderBy(F.desc("score"), "id")


def chunk_texts(chunks: DataFrame, docs: DataFrame, vectors: bool = True) -> DataFrame:
    """Chunks (id, document_id, start_char, end_char, embedding, context), with ``vectors`` those that have one, with raw and text.

    raw is the document's slice, text the same after the chunk's context.
    """
    own = docs.select(F.col("id").alias("document_id"), F.col("content").alias("_whole"))
    met = (chunks.where("embedding is not null") if vectors else chunks).join(own, "document_id").withColumn("raw", span(F.col("_whole"), F.col("start_char"), F.col("end_char"))).drop("_whole")
    return met.withColumn("text", with_context(F.col("context"), F.col("raw"))).withColumnRenamed("id", "chunk_id")


_HIT = ["content", "score", "document_id", "chunk_id", "start_char", "end_char"]


def _fetched(best_: DataFrame, chunks: DataFrame, docs: DataFrame, few: bool, *more: str) -> DataFrame:
    """best_ (chunk_id, score, ...) as hits with their contents, which are read for these chunks alone. ``few`` hits go to the documents, which stay where they are."""
    sent = F.broadcast if few else lambda df: df
    met = chunks.drop("embedding").join(sent(best_.withColumnRenamed("chunk_id", "id")), "id")
    return chunk_texts(sent(met), docs, vectors=False).withColumn("content", F.col("text")).select(*more, *_HIT)


def chunk_search(chunks: DataFrame, docs: DataFrame, vector: list[float], search_type: object = "cosine", top: int | None = TOP, threshold: float = CHUNK_THRESHOLD) -> DataFrame:
    """Hits (content, score, document_id, chunk_id, start_char, end_char). Equal raw slices count once.

    Chunks are scored before they meet their documents, of which only the slices' fingerprints are kept.
    """
    score = metric(search_type)(F.col("embedding"), literal(vector))
    above = chunks.where("embedding is not null").withColumn("score", score).where(F.col("score") > threshold)
    hits = best(chunk_texts(above, docs), F.col("raw"), threshold, top, "chunk_id")
    return _fetched(hits, chunks, docs, top is not None and top <= FEW_HITS).orderBy(F.desc("score"), "chunk_id")


def fuse(scored: DataFrame, alpha: float = ALPHA) -> Column:
    """Weighted sum of semantic and lexical scores, each divided by its maximum (0 if that isn't positive)."""
    a = min(max(alpha, 0.0), 1.0)
    part = lambda c, m: F.when(F.col(m) > 0, F.col(c) / F.col(m)).otherwise(0.0)
    return a * part("semantic", "semantic_max") + (1 - a) * part("lexical", "lexical_max")


def hybrid_search(chunks: DataFrame, docs: DataFrame, query: str, vector: list[float] | None, top: int | None = TOP, threshold: float = HYBRID_THRESHOLD, alpha: float = ALPHA, index=None) -> DataFrame:
    """Hits as chunk_search(), by cosine and BM25 over the contextualised texts. No rows without a vector.

    With ``index``, a PostingIndex over these texts, no text is tokenised: the postings of the query's terms are read.

    Chunks meet their documents once; what is kept of that are numbers, the query's terms
    and the fingerprint. The contents are fetched for the hits alone.
    """
    texts = chunk_texts(chunks, docs)
    if vector is None:
        return texts.where(F.lit(False)).withColumns({"score": F.lit(0.0), "content": F.col("text")}).select(*_HIT)
    if index is not None and top is not None:
        one = chunks.sparkSession.createDataFrame([(0, query or "", [float(x) for x in vector])], "query_id int, query string, vector array<double>")
        return batch_chunk_search(chunks, docs, one, "hybrid", top, threshold, alpha, index).select(*_HIT).orderBy(F.desc("score"), "chunk_id")
    terms = query_terms(query)
    slim = stored(texts.select("chunk_id", fingerprint(F.col("raw")).alias("_fp"), cosine(F.col("embedding"), literal(vector)).alias("semantic"), *matches(index_tokens(F.col("text")), terms)), "hybrid")
    counts = slim.agg(*term_counts(terms), F.max("semantic")).first()
    scored = slim.withColumns({"lexical": term_scores(terms, counts), "semantic_max": F.lit(counts[-1]).cast("double")})
    most = scored.agg(F.max("lexical")).first()[0]
    scored = scored.withColumn("lexical_max", F.lit(most).cast("double"))
    scored = scored.withColumn("score", fuse(scored, alpha)).where(F.col("score") > threshold)
    first = best_distinct(scored.select(F.col("chunk_id").cast("bigint").alias("id"), "_fp", "score"), top).withColumnRenamed("id", "chunk_id")
    return _fetched(first, chunks, docs, top is not None and top <= FEW_HITS).orderBy(F.desc("score"), "chunk_id")


def _few(best_: DataFrame) -> bool:
    return best_.limit(FEW_HITS + 1).count() <= FEW_HITS


def _listed(texts: DataFrame, terms: list[str]) -> DataFrame:
    """(id, _fp, embedding, dl, terms, tfs) of chunk_texts(): the number of a text's tokens, and its counts of these terms.

    A text is cut, and its terms are counted, where it is read; its tokens are neither written nor shuffled.
    """
    words = F.transform(F.array(index_tokens(F.col("text"))), lambda t: F.struct(F.size(t).alias("dl"), counted(F.filter(t, lambda x: x.isin(terms))).alias("c")))[0]
    rows = stored(texts.select(F.col("chunk_id").alias("id"), fingerprint(F.col("raw")).alias("_fp"), "embedding", words.alias("words")), "hybrid-counts")
    return rows.select("id", "_fp", "embedding", "words.dl", "words.c.terms", "words.c.tfs")


def _joined(texts: DataFrame, terms: DataFrame, few: bool, index) -> tuple[DataFrame, DataFrame, int, float]:
    """The rows of _listed() for any number of terms (query_id, term), their (term, df), the number of texts and their average length."""
    slim = texts.select(F.col("chunk_id").alias("id"), fingerprint(F.col("raw")).alias("_fp"), "embedding", *([] if index is not None else [index_tokens(F.col("text")).alias("tokens")]))
    slim = stored(slim, "hybrid-texts")
    own = index if index is not None else Bm25Index.of(slim.select("id", "tokens"))
    tf, df = own.asked_frequencies(terms, few)
    counts = tf.groupBy("id").agg(F.max("dl").alias("dl"), F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("_t"))  # of one text
    rows = slim.drop("tokens").join(counts, "id", "left").select(
        "id", "_fp", "embedding", F.coalesce("dl", F.lit(0)).alias("dl"), F.col("_t.term").alias("terms"), F.col("_t.tf").alias("tfs"))
    return stored(rows, "hybrid-counts"), df, *own.stats().first()


def batch_chunk_search(chunks: DataFrame, docs: DataFrame, queries: DataFrame, search_type: object = "cosine", top: int = TOP, threshold: float | None = None, alpha: float = ALPHA, index=None) -> DataFrame:
    """Hits with query_id and rank from 0 for queries (query_id, query, vector), as hybrid_search() or chunk_search() finds them.

    Any number of queries: blocks of them are scored where chunks are read, and a task passes on
    no more than ``top`` contents a query. Queries without a vector find nothing. Hybrid
    search takes its postings from ``index``, a PostingIndex over the chunks' texts, or counts the texts' terms.
    """
    asked = queries.where(F.size("vector") > 0).select("query_id", "query", "vector")
    texts = chunk_texts(chunks, docs)
    if search_type != "hybrid":
        least = CHUNK_THRESHOLD if threshold is None else threshold
        slim = texts.select(F.col("chunk_id").alias("id"), fingerprint(F.col("raw")).alias("_fp"), "embedding")
        best_ = stored(best_each(slim, asked, top, str(search_type), least).withColumnRenamed("id", "chunk_id"), "best")
        return _fetched(best_, chunks, docs, _few(best_), "query_id", "rank")
    terms = asked.select("query_id", F.explode(F.array_distinct(index_tokens(F.col("query")))).alias("term"))
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    listed = [] if index is not None else [r["term"] for r in terms.select("term").distinct().limit(LISTED_TERMS + 1).collect()]
    if index is None and len(listed) <= LISTED_TERMS:
        rows = _listed(texts, listed)
        df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        n, avgdl = rows.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(1.0))).first()
    else:
        rows, df, n, avgdl = _joined(texts, terms, few, index)
    weights = stored(terms.join(F.broadcast(df) if few else df, "term").select("query_id", "term", idf(F.lit(n), F.col("df")).alias("w")), "weights")
    best_ = best_each(rows, asked, top, "cosine", HYBRID_THRESHOLD if threshold is None else threshold, weights=weights, avgdl=avgdl, alpha=alpha)
    best_ = stored(best_.withColumnRenamed("id", "chunk_id"), "best")
    return _fetched(best_, chunks, docs, _few(best_), "query_id", "rank")


def batch_topk(queries: DataFrame, corpus: DataFrame, top: int = TOP, search_type: object = "cosine", threshold: float | None = None) -> DataFrame:
    """(query_id, id, score, rank from 1) for queries (query_id, vector) over corpus (id, embedding), of any numbers.

    Each task keeps its own best of each query before anything is shuffled.
    """
    found = best_each(corpus.select("id", "embedding"), queries.select("query_id", "vector"), top, str(search_type), -1e300 if threshold is None else threshold)
    return found.withColumn("rank", F.col("rank") + 1)
