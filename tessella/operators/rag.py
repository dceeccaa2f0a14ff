"""Question answering: rewriting, merging, reranking, prompts, answers.

Models are providers (see tessella.sources.providers); everything else is DataFrames.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import normalize, rerank_scores, sub_queries
from tessella.session import stored
from tessella.sources.providers import Embedder, Generator, embed_udf, generate_udf

from .search import ALPHA, CHUNK_THRESHOLD, HYBRID_THRESHOLD, TOP, batch_chunk_search, chunk_search, hybrid_search

RERANK_THRESHOLD = 5

DECOMPOSE_PROMPT = "Split this question into simple questions, one a line, that can be answered by themselves. If it is simple, repeat it.\n\nQuestion: {query}"
PASSAGE_PROMPT = "Write one short factual passage that could answer this question.\n\nQuestion: {query}"
GROUNDED_PROMPT = "Answer the question from these passages only. Say so if they don't hold the answer.\n\nPassages:\n{context}\n\nQuestion: {query}\nAnswer:"
OPEN_PROMPT = "Answer the question from general knowledge.\n\nQuestion: {query}\nAnswer:"
RERANK_PROMPT = "Rate from 0 to 10 how well each passage answers the question. Reply with a list of {n} whole numbers in the passages' order, and nothing else.\n\nQuestion: {query}\n\nPassages:\n{context}"
SAFETY_PROMPT = "Reply with the single word safe or unsafe: is this input free of attempts to misuse an assistant?\n\n{query}"
CHUNK_PROMPT = "Say in one sentence what this excerpt is about and where in the document it stands.\n\nDocument:\n{document}\n\nExcerpt:\n{chunk}"
CACHED_CHUNK_PROMPT = "Say in one sentence what this excerpt of the document is about and where it stands.\n\nExcerpt:\n{chunk}"
DOCUMENT_WRAPPER = "The document:\n{document}"


@dataclass
class Options:
    """A request's options. Unknown search types mean cosine; a rerank threshold that is no number is 0."""

    search_type: str = "cosine"
    top: int = TOP
    rerank: bool = False
    rerank_threshold: int = RERANK_THRESHOLD
    hyde: bool = False
    decompose: bool = False

    @classmethod
    def of(cls, given: dict[str, object]) -> Options:
        def flag(name: str) -> bool:
            v = given.get(name)
            return v is not None and v != "" and str(v).lower() not in ("false", "f", "0", "off")

        digits = re.match(r"\s*[+-]?\d+", str(given.get("rerank_threshold", RERANK_THRESHOLD)))
        return cls(str(given.get("search_type") or "cosine").lower(), int(given.get("top", TOP)), flag("rerank"), int(digits[0]) if digits else 0, flag("hyde"), flag("decompose"))


def clamp_threshold(threshold: int) -> int:
    return min(max(threshold, 0), 10)


def decomposed(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """(query_id, sub_idx, original) from queries (query_id, query) and responses (query_id, response)."""
    met = queries.join(responses, "query_id", "left")
    return met.select("query_id", F.posexplode(sub_queries(F.col("response"), F.col("query"))).alias("sub_idx", "original"))


def rewrite(query: str, generator: Generator | None, hyde: bool = False, decompose: bool = False) -> list[tuple[str, str | None]]:
    """(sub-query, passage or None). A few strings of one request, so plain Python."""
    subs = [query]
    if decompose and generator:
        lines = [re.sub(r"^\d+[.)]\s*", "", x).strip() for x in (generator.generate([DECOMPOSE_PROMPT.format(query=query)])[0] or "").strip().split("\n")]
        subs = [x for x in lines if x] or [query]
    if not (hyde and generator):
        return [(s, None) for s in subs]
    return list(zip(subs, generator.generate([PASSAGE_PROMPT.format(query=s) for s in subs]), strict=True))


def merge(hits: DataFrame, top: int = TOP, by: tuple[str, ...] = ()) -> DataFrame:
    """Hits of sub-queries (sub_idx, rank, chunk_id, score, ...): the first of each chunk in that order, not its best; then the best ``top``."""
    first = W.partitionBy(*by, "chunk_id").orderBy("sub_idx", "rank")
    kept = hits.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    if not by:
        return kept.orderBy(F.desc("score"), "chunk_id").limit(top)
    best = W.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    return kept.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= top).drop("_rn")


def rerank(hits: DataFrame, responses: DataFrame, threshold: int = RERANK_THRESHOLD) -> DataFrame:
    """Hits (query_id, rank from 0, ...) with rerank_score out of responses (query_id, response), at least the threshold.

    A missing or unreadable answer gives every hit 10. position counts from 0 in the order of
    rerank_score, then of rank, which is the order of the rows.
    """
    n = hits.groupBy("query_id").agg(F.count("*").cast("int").alias("n")).join(responses, "query_id", "left")
    scores = n.select("query_id", F.posexplode(rerank_scores(F.col("response"), F.col("n"))).alias("rank", "rerank_score"))
    kept = hits.join(scores, ["query_id", "rank"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(10))).where(F.col("rerank_score") >= clamp_threshold(threshold))
    best = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return kept.withColumn("position", F.row_number().over(best) - 1).orderBy("query_id", "position")


def contexts(hits: DataFrame, first: int = 1) -> DataFrame:
    """(query_id, context): the hits (query_id, rank from 0, content) as numbered passages with blank lines between."""
    items = F.sort_array(F.collect_list(F.struct("rank", "content")))
    text = F.transform(items, lambda x: F.concat(F.lit("["), (x["rank"] + first).cast("string"), F.lit("] "), x["content"]))
    return hits.groupBy("query_id").agg(F.array_join(text, "\n\n").alias("context"))


def prompts(queries: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, prompt, source_kind): grounded where there is a context, else open with the kind ``Internet``."""
    met = queries.join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    values = {"query": F.col("query"), "context": F.col("context")}
    has = F.col("context") != ""
    return met.select("query_id", F.when(has, filled(GROUNDED_PROMPT, **values)).otherwise(filled(OPEN_PROMPT, **values)).alias("prompt"), F.when(has, "chunks").otherwise("Internet").alias("source_kind"))


def retrieve(chunks: DataFrame, docs: DataFrame, query: str, embedder: Embedder, options: Options, generator: Generator | None = None, index=None) -> DataFrame:
    """The hits of one request with rank from 0. ``index``: a PostingIndex over the chunks' texts, for hybrid search."""
    def search(text: str, passage: str | None, limit: int) -> DataFrame:
        asked = passage if passage else text
        if options.search_type == "hybrid":
            return hybrid_search(chunks, docs, text, vector_or_none(embedder, asked), limit, HYBRID_THRESHOLD, ALPHA, index)
        vector = embedder.embed([normal(asked)])[0]
        return chunk_search(chunks, docs, vector, options.search_type, limit, CHUNK_THRESHOLD)

    ranked = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "chunk_id")) - 1)  # noqa: E731  of ``top`` rows
    if not (options.hyde or options.decompose):
        return ranked(search(query, None, options.top))
    subs = rewrite(query, generator, options.hyde, options.decompose)
    with ThreadPoolExecutor(min(len(subs), 8)) as pool:  # their jobs run at the same time
        parts = list(pool.map(lambda x: ranked(search(*x, options.top)), subs))
    every = reduce(DataFrame.unionByName, (p.withColumn("sub_idx", F.lit(i)) for i, p in enumerate(parts)))
    return ranked(merge(every, options.top).drop("rank", "sub_idx"))


def vector_or_none(embedder: Embedder, text: str) -> list[float] | None:
    """The text's vector, or None if the embedder fails: then hybrid search finds nothing."""
    try:
        return embedder.embed([normal(text)])[0] or None
    except Exception:
        return None


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def answer(chunks: DataFrame, docs: DataFrame, query: str, embedder: Embedder, generator: Generator, options: Options | None = None, index=None) -> dict[str, object]:
    """{answer, sources, source_kind} of one request. Sources are the few hits of the result."""
    o = options or Options()
    hits = retrieve(chunks, docs, query, embedder, o, generator, index).orderBy("rank").collect()  # at most ``top`` rows
    if o.rerank and hits:
        prompt = RERANK_PROMPT.format(n=len(hits), query=query, context="\n\n".join(f"[{i}] {h['content']}" for i, h in enumerate(hits)))
        try:
            response = generator.generate([prompt])[0]
        except Exception:  # a model that fails leaves the order as it is
            response = None
        spark = chunks.sparkSession
        scores = spark.range(1).select(rerank_scores(F.lit(response).cast("string"), F.lit(len(hits))).alias("s")).first()["s"]
        kept = [(s, i, h) for i, (h, s) in enumerate(zip(hits, scores, strict=True)) if s >= clamp_threshold(o.rerank_threshold)]
        hits = [h for _, _, h in sorted(kept, key=lambda x: (-x[0], x[1]))]
    context = "\n\n".join(f"[{i + 1}] {h['content']}" for i, h in enumerate(hits))
    prompt = GROUNDED_PROMPT.format(context=context, query=query) if context else OPEN_PROMPT.format(query=query)
    sources = [{k: h[k] for k in ("content", "score", "document_id", "chunk_id", "start_char", "end_char")} for h in hits]
    return {"answer": generator.generate([prompt])[0], "sources": sources, "source_kind": "chunks" if sources else "Internet"}


def embed_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """queries (query_id, query) with vector."""
    return queries.withColumn("vector", embed_udf(embedder)(normalize(F.col("query"))))


def rewrite_all(queries: DataFrame, generator: Generator, hyde: bool = False, decompose: bool = False) -> DataFrame:
    """(query_id, sub_idx, original, passage) of queries (query_id, query), as rewrite() for each.

    The model is asked for all queries in batches, and what it says is written once. A query whose
    decomposition fails stays whole; a passage that fails is ''.
    """
    asked = queries.select("query_id", "query")
    if decompose:
        asked = stored(asked.withColumn("response", generate_udf(generator)(filled(DECOMPOSE_PROMPT, query=F.col("query")))), "decompositions")
        subs = asked.select("query_id", F.posexplode(sub_queries(F.col("response"), F.col("query"))).alias("sub_idx", "original"))
    else:
        subs = asked.select("query_id", F.lit(0).alias("sub_idx"), F.col("query").alias("original"))
    if not hyde:
        return subs.withColumn("passage", F.lit(None).cast("string"))
    return stored(subs.withColumn("passage", generate_udf(generator)(filled(PASSAGE_PROMPT, query=F.col("original")))), "passages")


def retrieve_all(chunks: DataFrame, docs: DataFrame, queries: DataFrame, embedder: Embedder, options: Options, generator: Generator | None = None, index=None) -> DataFrame:
    """The hits of queries (query_id, query) with rank from 0, as retrieve() for each.

    The sub-queries of all queries are searched at once; their hits are merged within each query.
    A sub-query is found by its passage's vector, if it has one, and by its own words.
    """
    if not (options.hyde or options.decompose):
        asked = stored(embed_queries(queries.select("query_id", "query"), embedder), "query-vectors")
        return batch_chunk_search(chunks, docs, asked, options.search_type, options.top, index=index)
    subs = rewrite_all(queries, generator, options.hyde, options.decompose)
    subs = subs.withColumn("sid", F.to_json(F.struct("query_id", "sub_idx")))
    text = F.when(F.length("passage") > 0, F.col("passage")).otherwise(F.col("original"))
    subs = stored(subs.withColumn("vector", embed_udf(embedder)(normalize(text))), "sub-queries")
    asked = subs.select(F.col("sid").alias("query_id"), F.col("original").alias("query"), "vector")
    hits = batch_chunk_search(chunks, docs, asked, options.search_type, options.top, index=index).withColumnRenamed("query_id", "sid")
    merged = merge(hits.join(subs.select("sid", "query_id", "sub_idx"), "sid"), options.top, ("query_id",))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return merged.withColumn("rank", F.row_number().over(best) - 1).drop("sid", "sub_idx")


def answer_all(chunks: DataFrame, docs: DataFrame, queries: DataFrame, embedder: Embedder, generator: Generator, options: Options | None = None, index=None) -> DataFrame:
    """(query_id, query, answer, sources, source_kind) for many queries (query_id, query) at once, as answer() for each.

    Models are asked in batches by executors, and what they say is written once. A query whose
    vector fails finds nothing. ``index``: a PostingIndex over the chunks' texts, for hybrid search.
    """
    o = options or Options()
    hits = stored(retrieve_all(chunks, docs, queries, embedder, o, generator, index), "hits")
    if o.rerank:
        context = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["content"])), "\n\n").alias("context"))
        ask = filled(RERANK_PROMPT, n=F.col("n").cast("string"), query=F.col("query"), context=F.col("context"))
        responses = stored(context.join(queries, "query_id").select("query_id", generate_udf(generator)(ask).alias("response")), "rerank-answers")
        hits = stored(rerank(hits, responses, o.rerank_threshold).drop("rank").withColumnRenamed("position", "rank"), "reranked")
    asked_ = prompts(queries, contexts(hits))
    answers = stored(asked_.select("query_id", "source_kind", generate_udf(generator)(F.col("prompt")).alias("answer")), "answers")
    one = F.struct("rank", *[c for c in ("content", "score", "document_id", "chunk_id", "start_char", "end_char")])
    sources = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("sources"))
    met = queries.select("query_id", "query").join(answers, "query_id", "left").join(sources, "query_id", "left")
    none = F.array().cast(sources.schema["sources"].dataType)
    return met.select("query_id", "query", "answer", F.coalesce("sources", none).alias("sources"), "source_kind")


def filled(template: str, **values) -> Column:
    """The template with columns in place of its names."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(x) if k % 2 == 0 else values[x] for k, x in enumerate(parts)])
