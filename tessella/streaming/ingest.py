"""Ingestion: documents become vectors and contextualised chunks, in batches or as a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.functions.batches import pieces
from tessella.functions.text import fingerprint, is_blank, normalize, with_context
from tessella.operators.postings import PostingIndex
from tessella.operators.rag import CACHED_CHUNK_PROMPT, CHUNK_PROMPT, DOCUMENT_WRAPPER
from tessella.operators.search import chunk_texts
from tessella.operators.segment import chunks, chunks_with_vectors, sentences, text_chunker
from tessella.session import stored
from tessella.sources.providers import ZERO_DIM, Embedder, Generator, asked, or_zero, try_embed_udf
from tessella.sources.store import Store

THRESHOLD = 0.8


def embed_all_udf(embedder: Embedder) -> Callable[[Column], Column]:
    """array<string> to array<array<double>>; null if any of them fails. All texts of a batch go to the service together."""

    @F.arrow_udf("array<array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (s,) in pieces(batches):
            rows = s.to_pylist()
            got = iter(asked(embedder.embed, [t for texts in rows if texts is not None for t in texts]))
            out: list = []
            for texts in rows:
                own = None if texts is None else [next(got) for _ in texts]
                out.append(None if own is None or any(e for _, e in own) else [v for v, _ in own])
            yield pa.array(out, pa.list_(pa.list_(pa.float64())))

    return run


def contextualize(document: str, parts: list[str], generator: Generator, run=map) -> list[str]:
    """A line of context a part. With a cached document if the generator can, which lives until its last part is done; if anything fails there, all parts anew without; a part that fails then has ''.

    ``run`` maps a function over parts, in order.
    """
    if hasattr(generator, "create_cached"):
        name = None
        try:
            name = generator.create_cached(DOCUMENT_WRAPPER.format(document=document))
            return [x.strip() for x in run(lambda p: generator.generate_cached(name, CACHED_CHUNK_PROMPT.format(chunk=p)), parts)]
        except Exception:
            pass
        finally:
            if name:
                generator.delete_cached(name)

    def alone(p: str) -> str:
        try:
            return generator.generate([CHUNK_PROMPT.format(document=document, chunk=p)])[0].strip()
        except Exception:
            return ""

    return list(run(alone, parts))


def contextualize_all(rows: list[tuple[str, list[str]]], generator: Generator, at_once: int | None = None) -> list[list[str]]:
    """contextualize() for documents and their parts, with no more than ``at_once`` calls for parts in flight over all of them.

    By default as many as the generator says (its ``at_once``), one after another if it doesn't.
    """
    at_once = at_once or getattr(generator, "at_once", 1)
    if at_once == 1:
        return [contextualize(d, parts, generator) for d, parts in rows]
    with ThreadPoolExecutor(at_once) as calls, ThreadPoolExecutor(at_once) as documents:  # a document waits in the second for its calls in the first

        def run(f, items):
            futures = [calls.submit(f, x) for x in items]
            wait(futures)  # none is in flight when a cached document goes
            return [x.result() for x in futures]

        return list(documents.map(lambda r: contextualize(*r, generator, run), rows))


def context_udf(generator: Generator, at_once: int | None = None) -> Callable[[Column, Column], Column]:
    """Document and its parts to the parts' contexts: a document's parts are together in its row."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for docs, parts in pieces(batches):
            rows = [(d or "", p or []) for d, p in zip(docs.to_pylist(), parts.to_pylist(), strict=True)]
            yield pa.array(contextualize_all(rows, generator, at_once), pa.list_(pa.string()))

    return run


def indexed(docs: DataFrame, embedder: Embedder, generator: Generator | None = None, *, size: int = 500, semantic: bool = False, dim: int = ZERO_DIM, splitter: Callable[[Column], Column] = sentences, at_once: int | None = None) -> DataFrame:
    """docs (id, content) with embedding, chunk structs (start_char, end_char, content, context, embedding) and index_status.

    A vector that the service leaves empty becomes zeros. A document whose own vector or any
    of whose chunks' vectors fails has failed: no chunks, and no vector if that failed.
    Blank documents aren't indexed. ``splitter`` makes sentences (see sentence_rules.sentences_by_rules());
    ``at_once`` bounds a task's calls to the generator.
    """
    # a model may say something else when asked again, so filters (an explode adds one) mustn't be pushed below and ask twice
    embed_all, one = embed_all_udf(embedder).asNondeterministic(), try_embed_udf(embedder).asNondeterministic()(normalize(F.col("content")))
    own = docs.where(~is_blank(F.col("content")))
    if semantic:
        own = own.select("id", "content", one.alias("one"), splitter(F.col("content")).alias("spans"))
        own = own.withColumn("sv", embed_all(F.transform("spans", lambda s: normalize(s["content"]))))
        own = own.withColumn("parts", chunks_with_vectors(F.col("spans"), F.col("sv"), size, 0, THRESHOLD)).drop("sv")
    elif splitter is sentences:
        own = own.select("id", "content", one.alias("one"), text_chunker(size, 0).asNondeterministic()(F.col("content")).alias("parts"))
    else:
        own = own.select("id", "content", one.alias("one"), chunks(splitter(F.col("content")), size, 0).alias("parts"))
    texts = F.transform("parts", lambda c: c["content"])
    context = context_udf(generator, at_once).asNondeterministic()(F.col("content"), texts) if generator else F.transform("parts", lambda _: F.lit(""))
    own = own.withColumn("contexts", context)
    full = F.transform("parts", lambda c, i: normalize(with_context(F.get("contexts", i), c["content"])))
    own = own.withColumn("vectors", embed_all(full))
    joined = F.transform("parts", lambda c, i: F.struct(c["start_char"].alias("start_char"), c["end_char"].alias("end_char"), c["content"].alias("content"), F.get("contexts", i).alias("context"), F.get("vectors", i).alias("embedding")))
    done = F.col("one.error").isNull() & F.col("vectors").isNotNull()
    vector = F.when(F.col("one.error").isNull(), or_zero(F.col("one.vector"), dim))
    return own.select("id", "content", vector.alias("embedding"), F.when(done, joined).alias("chunks"), F.when(done, "completed").otherwise("failed").alias("index_status"))


def chunk_table(done: DataFrame) -> DataFrame:
    """The chunks of indexed() as rows with ids made of the document's and the place."""
    each = done.where("chunks is not null").select(F.col("id").alias("document_id"), F.posexplode("chunks").alias("n", "c"))
    return each.select(F.xxhash64("document_id", "n").alias("id"), "document_id", "c.start_char", "c.end_char", "c.embedding", "c.context")


def process(store: Store, docs: DataFrame, batch: object, embedder: Embedder, generator: Generator | None = None, *, index: PostingIndex | None = None, **how) -> None:
    """Indexes docs (id, content) into the store: processing, then completed or failed (blank ones too).

    Vectors, chunks and final states become visible at once. ``batch`` is the batch that added the
    documents, if one did; a repeated one replaces what it wrote. ``index`` gets the chunks' texts, in
    place of those that the documents had before.
    """
    store.set_status(docs.select("id", F.lit("processing").alias("index_status")), f"{batch}-processing", batch)
    done = stored(indexed(docs, embedder, generator, **how), "indexed")  # the models are asked once
    blank = docs.where(is_blank(F.col("content"))).select("id", F.lit("failed").alias("index_status"))
    states, rows = done.select("id", "index_status").unionByName(blank), chunk_table(done)
    store.put(f"{batch}-done", batch, vectors=done.where("embedding is not null"), chunks=rows, status=states)
    if index is not None:
        texts = chunk_texts(rows, docs).select(F.col("chunk_id").alias("id"), F.col("document_id").alias("owner"), "text")
        index.add(texts, f"{batch}-{uuid.uuid4().hex}", docs.select(F.col("id").alias("owner")))


def stream(spark: SparkSession, landing: str, store: Store, checkpoint: str, embedder: Embedder, generator: Generator | None = None, *, source: str = "stream", once: bool = False, interval: str = "1 second", files_per_trigger: int = 500, compact_every: int = 0, retention: float = 86_400, **how) -> StreamingQuery:
    """Indexes JSON lines (id, content) that land in a folder, batch by batch; waiting batches are in the checkpoint.

    Blank and unsafe rows aren't stored. Streams into one store need sources of their own. After
    every ``compact_every`` batches the store is compacted, and what has been out of use for ``retention``
    seconds is deleted.
    """
    rows = spark.readStream.schema("id bigint, content string").option("maxFilesPerTrigger", files_per_trigger).json(landing)

    def work(batch: DataFrame, n: int) -> None:
        name = f"{source}-{n}"
        accepted, _ = store.screened(stored(batch, "epoch"))
        store.add(accepted, name)
        process(store, accepted, name, embedder, generator, **how)
        if compact_every and (n + 1) % compact_every == 0:
            store.compact()
            store.vacuum(retention)

    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def new_queries(queries: DataFrame, ts: str = "ts", text: str = "query", window: str = "1 hour") -> DataFrame:
    """A stream of queries without those that came, as normalised, within the window before."""
    return queries.withColumn("query_fp", fingerprint(F.col(text))).withWatermark(ts, window).dropDuplicatesWithinWatermark(["query_fp"])
