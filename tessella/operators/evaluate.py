"""Evaluation of answers: metrics a question, a summary, a report, a gate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.metrics import PASS_MARK, with_metrics
from tessella.functions.text import percent, rounded, truncate
from tessella.session import stored
from tessella.sources import dataset
from tessella.sources.providers import Embedder, Generator
from tessella.sources.store import HEAD, Store
from tessella.streaming.ingest import process

from . import catalog, rag
from .postings import PostingIndex

GATE = 50.0


def evaluate(questions: DataFrame, answers: DataFrame, pass_mark: float = PASS_MARK) -> DataFrame:
    """questions (lecture_id, question, expected_answer, expected_keywords) met with answers (lecture_id, question, rag_answer, sources array<string>)."""
    met, cols = with_metrics(questions.join(answers, ["lecture_id", "question"], "left"), "rag_answer", "expected_answer", "expected_keywords", "sources", pass_mark)
    return met.select("lecture_id", "question", "expected_answer", "rag_answer", F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"), *cols)


def answers_to(questions: DataFrame, chunks: DataFrame, docs: DataFrame, embedder: Embedder, generator: Generator, search_type: str = "cosine", rerank: bool = False, index: PostingIndex | None = None) -> DataFrame:
    """(lecture_id, question, rag_answer, sources): every question answered from the chunks."""
    asked = questions.select(F.xxhash64("lecture_id", "question").alias("query_id"), "lecture_id", "question").dropDuplicates(["query_id"])
    found = rag.answer_all(chunks, docs, asked.select("query_id", F.col("question").alias("query")), embedder, generator, rag.Options(search_type, rerank=rerank), index)
    return asked.join(found, "query_id").select("lecture_id", "question", F.col("answer").alias("rag_answer"), F.transform("sources", lambda s: s["content"]).alias("sources"))


def ingest_lectures(store: Store, lectures: DataFrame, embedder: Embedder, generator: Generator | None = None, seconds: float = 60, **how) -> int:
    """Stores and indexes the lectures (id, content) whose beginning no document has, and waits; how many are still in progress."""
    known = catalog.with_prefix(store.heads(), lectures.select(F.col("id").alias("sample_id"), F.col("content").alias("text")), HEAD)
    new = lectures.where("content is not null").join(known.select(F.col("sample_id").alias("_known")), F.col("id") == F.col("_known"), "left_anti")
    accepted, _ = store.insert(new, source="lectures")
    if not accepted.isEmpty():
        process(store, accepted, f"lectures-{uuid.uuid4().hex}", embedder, generator, **how)
    return store.wait(seconds)


def run(store: Store, lectures: DataFrame, embedder: Embedder, generator: Generator, search_type: str = "hybrid", rerank: bool = False, report_path: str | None = None, seconds: float = 60, index: PostingIndex | None = None, **how) -> DataFrame:
    """The whole evaluation of lectures (as sources.dataset.LECTURE): ingestion, waiting, an answer a question, metrics, a report file.

    ``index``, over all chunks of the store, gets those of new lectures and serves hybrid search.
    """
    ingest_lectures(store, lectures, embedder, generator, seconds, semantic=True, index=index, **how)
    questions = dataset.questions(lectures)
    results = stored(evaluate(questions, answers_to(questions, store.chunks(), store.documents(), embedder, generator, search_type, rerank, index)), "results")
    if report_path:
        write_report(results, report_path)
    return results


def summary(results: DataFrame) -> DataFrame:
    """One row: counts, averages to three digits (0 for no question), pass rate in percent."""
    mean = lambda c: rounded(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    rate = F.when(F.count("*") == 0, 0.0).otherwise(rounded(100.0 * F.count_if("passed") / F.count("*"), 1))
    return results.agg(
        F.count("*").alias("total_questions"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        *[mean(c).alias(f"avg_{c}") for c in ("keyword_recall", "token_f1", "factual_overlap", "retrieval_precision")],
        mean(F.col("retrieval_hit").cast("int")).alias("retrieval_hit_rate"), mean("overall_score").alias("avg_overall_score"), rate.alias("pass_rate"))


def report_lines(results: DataFrame) -> DataFrame:
    """(lecture_id, question, text): a paragraph a question."""
    part = lambda c: percent(F.col(c))
    lines = [
        F.concat(F.lit("["), F.col("lecture_id").cast("string"), F.lit("] "), F.col("question")),
        F.concat(F.lit("   Expected: "), truncate(F.coalesce("expected_answer", F.lit("")), 100)),
        F.concat(F.lit("   RAG answer: "), truncate(F.coalesce("rag_answer", F.lit("")), 100)),
        F.concat(F.lit("   Keyword recall: "), part("keyword_recall"), F.lit(" | F1: "), part("token_f1"), F.lit(" | Overlap: "), part("factual_overlap")),
        F.concat(F.lit("   Retrieval precision: "), part("retrieval_precision"), F.lit(" | Hit: "), F.when(F.col("retrieval_hit"), "YES").otherwise("NO")),
        F.concat(F.lit("   Overall: "), F.col("overall_score").cast("string"), F.lit("/100 "), F.when(F.col("passed"), "PASS").otherwise("FAIL")),
        F.concat(F.lit("   Sources: "), F.col("n_sources").cast("string"), F.lit(" chunks")),
    ]
    return results.select("lecture_id", "question", F.concat_ws("\n", *lines).alias("text"))


# The report's layout.
WIDTH, TITLE, TOTALS, AVERAGES, DETAILS = 80, "RAG EVALUATION REPORT", "Overall Results:", "Average Metrics:", "Detailed Results:"
AVERAGE_ROWS = [("Keyword recall", "avg_keyword_recall"), ("Token F1", "avg_token_f1"), ("Factual overlap", "avg_factual_overlap"), ("Retrieval precision", "avg_retrieval_precision"), ("Retrieval hit rate", "retrieval_hit_rate")]


def labelled(label: str, value: object) -> str:
    return f"  {label + ':':<24}{value}"


def report(results: DataFrame) -> str:
    """The whole report, questions in the order of lectures and their texts. Question sets are small: their paragraphs meet on the driver."""
    s, double, single = summary(results).first(), "=" * WIDTH, "-" * WIDTH
    rate = s["pass_rate"] if s["total_questions"] else 0
    out = [double, TITLE, double, "", TOTALS]
    out += [labelled("Total questions", s["total_questions"]), labelled("Passed", s["passed"]), labelled("Failed", s["failed"]), labelled("Pass rate", f"{rate}%"), "", AVERAGES]
    out += [labelled(label, f"{round(s[c] * 100, 1)}%") for label, c in AVERAGE_ROWS]
    out += [labelled("Overall score", f"{s['avg_overall_score']}/100"), "", single, DETAILS, single]
    for i, r in enumerate(report_lines(results).orderBy("lecture_id", "question").toLocalIterator(), 1):
        out += ["", f"{i}. {r['text']}"]
    return "\n".join([*out, "", double])


def write_report(results: DataFrame, path: str) -> None:
    """The report as a text file in ``path``, a folder of any file system that Spark knows."""
    spark = results.sparkSession
    spark.createDataFrame([(report(results),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def gate(results: DataFrame, least: float = GATE) -> bool:
    return summary(results).first()["pass_rate"] >= least
