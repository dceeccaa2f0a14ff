import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.vector import metric
from tessella.operators import blocked, search
from tessella.operators.bm25 import Bm25Index
from tessella.operators.postings import PostingIndex
from tessella.sources.providers import HashEmbedder


def native(queries, corpus, top, kind, threshold):
    """Every pair scored by the column functions."""
    pairs = corpus.where("embedding is not null").crossJoin(queries).select("query_id", "id", metric(kind)(F.col("embedding"), F.col("vector")).alias("score")).where(F.col("score") > threshold)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).collect()}


@pytest.fixture(scope="module")
def tables(spark):
    """Copies, multiples of a vector, zeros, other widths, empty and null ones."""
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=6).tolist() for _ in range(150)] + [[0.0] * 6, [1.0] * 6, [1.0] * 6, [2.0] * 6, [3.0] * 6, [1.0, 2.0], [], None, [1.0]]
    vectors += [vectors[3]] * 5 + [[x * 3 for x in vectors[4]]] * 3
    corpus = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, vectors[i * 7]) for i in range(15)] + [(50, [1.0] * 6), (51, [0.0] * 6), (52, [2.0, 1.0]), (53, []), (54, [1.0] * 9)], "query_id int, vector array<double>")
    return queries, corpus


@pytest.mark.parametrize("kind, threshold, at_once", [("cosine", -1e300, 4096), ("euclidean", -1e300, 4096), ("cosine", 0.4, 3), ("euclidean", 0.3, 4096), ("odd", 0.0, 7)])
def test_as_native(tables, kind, threshold, at_once):
    queries, corpus = tables
    want = native(queries, corpus, 6, kind, threshold)
    got = blocked.best_each(corpus, queries, 6, kind, threshold, at_once=at_once).collect()
    assert {(r["query_id"], r["rank"] + 1): (r["id"], r["score"]) for r in got} == want


def test_small_tiles(tables, monkeypatch):
    queries, corpus = tables
    monkeypatch.setattr(blocked, "ROWS", 4)
    monkeypatch.setattr(blocked, "COLUMNS", 2)
    x = corpus.where("embedding is not null").toArrow().combine_chunks().to_batches()
    asked = queries.collect()
    rows = [r for b in blocked._best([np.array(q["vector"], float) for q in asked], 200, "cosine", -np.inf, None, None)(iter(x)) for r in b.to_pylist()]
    want = native(queries, corpus, 200, "cosine", -1e300)
    assert {(asked[r["j"]]["query_id"], r["id"], r["score"]) for r in rows} == {(q, i, s) for (q, _), (i, s) in want.items()}


def test_many_queries(spark):
    """More than one block, and more than were once accepted."""
    rng = np.random.default_rng(1)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 8)))], "id long, embedding array<double>")
    vectors = rng.normal(size=(20_000, 8))
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "query_id int, vector array<double>")
    x = np.array([r["embedding"] for r in corpus.orderBy("id").collect()])
    best = ((x / np.linalg.norm(x, axis=1)[:, None]) @ vectors.T).argmax(0)
    got = search.batch_topk(queries, corpus, 1).collect()
    assert len(got) == 20_000 and all(best[r["query_id"]] == r["id"] for r in got)


def test_equal_contents_count_once_before_the_shuffle(spark):
    """A third of the rows are copies: the best of them stays, and a task passes on no more than ``top``."""
    rng = random.Random(2)
    rows = [(i, "copy" if i % 3 == 0 else f"own{i % 40}", rng.random() if i % 3 else 0.9) for i in range(900)]
    scored = spark.createDataFrame(rows, "id long, _fp string, score double").repartition(4)
    best = {}
    for i, f, s in rows:
        best[f] = min(best.get(f, (0, 0)), (-s, i))
    want = [(i, -s) for s, i in sorted(best.values())]
    assert [tuple(r) for r in blocked.best_distinct(scored, 10).collect()] == want[:10]
    assert sorted(tuple(r) for r in blocked.best_distinct(scored, None).collect()) == sorted(want)
    assert scored.mapInArrow(blocked._task_best(10), "id bigint, _fp string, score double").count() <= 40
    assert blocked.best_distinct(scored.limit(0), 3).collect() == []


def test_shuffles_hold_no_contents(spark):
    docs = spark.createDataFrame([(1, "Alpha", [1.0])], "id long, content string, embedding array<double>")
    plan = search.document_search(docs, [1.0])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_hybrid_batch_as_one_by_one(spark, tmp_path):
    """With counted terms and with a posting index; copies of texts, queries without a vector or known terms."""
    rng = random.Random(4)
    embedder = HashEmbedder(16)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega", "kappa"], k=rng.randint(1, 8))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "id long, content string, embedding array<double>")
    chunks = spark.createDataFrame([(100 + i, i, 0, len(t), embedder.embed([t])[0] if i % 9 else None, None) for i, t in enumerate(texts)], "id long, document_id long, start_char int, end_char int, embedding array<double>, context string")
    queries = [(1, "alpha beta"), (2, "omega omega kappa"), (3, "unknown"), (4, "the of"), (5, "gamma")]
    asked = spark.createDataFrame([(i, q, embedder.embed([q])[0] if i != 5 else None) for i, q in queries], "query_id int, query string, vector array<double>")
    index = PostingIndex(spark, str(tmp_path / "i"))
    index.add(search.chunk_texts(chunks, docs).select(F.col("chunk_id").alias("id"), "text"), "a")
    want = {(i, k): (r["chunk_id"], round(r["score"], 9), r["content"]) for i, q in queries if i != 5 for k, r in enumerate(search.hybrid_search(chunks, docs, q, embedder.embed([q])[0], 7).collect())}
    for own in (None, index):
        got = search.batch_chunk_search(chunks, docs, asked, "hybrid", 7, index=own).collect()
        assert {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["score"], 9), r["content"]) for r in got} == want
    assert Bm25Index(docs.selectExpr("id", "content as text")).size() == 60


def test_listed_terms_as_joined_ones(spark, monkeypatch):
    """Terms of queries are counted where texts are read, whatever their number, and rows are the same either way; no query, no text, no known term."""
    rng = random.Random(6)
    embedder = HashEmbedder(16)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega", "the", "x"], k=rng.randint(0, 30))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate([*texts, "", None])), "id long, content string")
    chunks = spark.createDataFrame([(100 + i, i, 0, len(t or ""), embedder.embed([t])[0], "alpha" if i % 5 == 0 else None) for i, t in enumerate([*texts, "", None])], "id long, document_id long, start_char int, end_char int, embedding array<double>, context string")
    asked = spark.createDataFrame([(i, q, embedder.embed([q])[0]) for i, q in enumerate(["alpha beta", "omega omega", "unknown", "the", ""])], "query_id int, query string, vector array<double>")

    def found(chunks, asked):
        return sorted(map(tuple, search.batch_chunk_search(chunks, docs, asked, "hybrid", 7).collect()))

    seen = []
    monkeypatch.setattr(search, "stored", lambda df, name, real=search.stored: seen.append((name, df.schema.simpleString())) or real(df, name))
    listed = [found(chunks, asked), found(chunks.limit(0), asked), found(chunks, asked.limit(0)), found(chunks, asked.where("query_id = 2"))]
    assert "hybrid-counts" in dict(seen) and not any("tokens" in kinds for _, kinds in seen)
    monkeypatch.setattr(search, "LISTED_TERMS", -1)
    assert listed == [found(chunks, asked), found(chunks.limit(0), asked), found(chunks, asked.limit(0)), found(chunks, asked.where("query_id = 2"))] and len(listed[0]) > 10


def test_few_hits_go_to_the_documents(spark):
    """Before, every document's text was shuffled to fetch a few."""
    docs = spark.createDataFrame([(1, "Alpha"), (2, "Beta")], "id long, content string")
    chunks = spark.createDataFrame([(7, 1, 0, 5, [1.0], None)], "id long, document_id long, start_char int, end_char int, embedding array<double>, context string")
    hits = search._fetched(spark.createDataFrame([(7, 0.5)], "chunk_id long, score double"), chunks, docs, True)
    assert "Exchange hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in hits.collect()] == [("Alpha", 0.5, 1, 7, 0, 5)]
