"""Documents and their chunks as tables: validity, status, listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import is_blank, span

#: With more distinct beginnings of short samples than these, all beginnings are counted.
BROADCAST_HEADS = 200_000
STATUSES = ["pending", "processing", "completed", "failed"]


def valid_documents(docs: DataFrame) -> DataFrame:
    """Content that isn't blank, and a known status."""
    return docs.where(~is_blank(F.col("content")) & F.col("index_status").isin(STATUSES))


def valid_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char")))


def orphans(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks without a document."""
    return chunks.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def pending_or_processing(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("index_status").isin("pending", "processing"))


def completed(docs: DataFrame) -> DataFrame:
    return docs.where("index_status = 'completed'")


def failed(docs: DataFrame) -> DataFrame:
    return docs.where("index_status = 'failed'")


def status_counts(docs: DataFrame) -> DataFrame:
    """One row: total, a count a status, in_progress (pending and processing)."""
    counts = [F.count_if(F.coalesce(F.col("index_status") == s, F.lit(False))).alias(s) for s in STATUSES]
    return docs.agg(F.count("*").alias("total"), *counts).withColumn("in_progress", F.col("pending") + F.col("processing")).select("total", "pending", "processing", "in_progress", "completed", "failed")


def starting_like(docs: DataFrame, sample: str, length: int = 101) -> DataFrame:
    """Documents that begin with the first ``length`` characters of a sample."""
    return docs.where(F.col("content").startswith(sample[:length]))


def with_prefix(docs: DataFrame, samples: DataFrame, length: int = 101) -> DataFrame:
    """(sample_id, first_id, n): the documents (id, content[, head]) that begin with the first ``length`` characters of each of samples (sample_id, text): the smallest id and how many. No row for none.

    By equality of the beginnings' digests: documents need one for the full length (head, where it is
    stored) and one for each length of a shorter sample, of which there are no more than ``length``. They
    are counted before they meet the samples. Null samples and contents match nothing.
    """
    begun = lambda text, n: F.sha2(F.substring(text, F.lit(1), n), 256)
    n = F.least(F.length("text"), F.lit(length))
    asked = samples.where("text is not null").select("sample_id", n.alias("_n"), begun(F.col("text"), n).alias("_head"))
    short = sorted(r[0] for r in asked.where(F.col("_n") < length).select("_n").distinct().collect())  # lengths below the full one
    whole = F.col("head") if "head" in docs.columns else begun(F.col("content"), F.lit(length))
    count = lambda rows: rows.groupBy("_n", "_head").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    kept = docs.where("content is not null")
    found = count(kept.where(F.length("content") >= length).select("id", F.lit(length).alias("_n"), whole.alias("_head")))
    if short:
        classes = [F.when(F.length("content") >= k, F.struct(F.lit(k).alias("_n"), begun(F.col("content"), F.lit(k)).alias("_head"))) for k in short]
        each = kept.select("id", F.explode(F.filter(F.array(*classes), lambda x: x.isNotNull())).alias("c")).select("id", "c._n", "c._head")
        heads = asked.where(F.col("_n") < length).select("_n", "_head").distinct()
        if heads.limit(BROADCAST_HEADS + 1).count() <= BROADCAST_HEADS:  # of all beginnings only those asked for are counted
            each = each.join(F.broadcast(heads), ["_n", "_head"], "left_semi")
        found = found.unionByName(count(each))
    return asked.join(found, ["_n", "_head"]).select("sample_id", "first_id", "n")


def listing(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, content, index_status, chunks): chunks in the order of their ids, [] for none. Their context is also named content_hash."""
    own = docs.select(F.col("id").alias("document_id"), F.col("content").alias("_whole"))
    one = F.struct("id", span(F.col("_whole"), F.col("start_char"), F.col("end_char")).alias("content"), "context", F.col("context").alias("content_hash"), "start_char", "end_char")
    grouped = chunks.join(own, "document_id").groupBy("document_id").agg(F.sort_array(F.collect_list(one)).alias("chunks"))
    met = docs.select("id", "content", "index_status").join(grouped, F.col("id") == F.col("document_id"), "left")
    kind = grouped.schema["chunks"].dataType.simpleString()
    return met.select("id", "content", "index_status", F.coalesce("chunks", F.array().cast(kind)).alias("chunks"))
