import pytest

from tessella.operators import catalog, rag, search
from tessella.operators.bm25 import Bm25Index, query_terms
from tessella.sources.providers import EchoGenerator, HashEmbedder

CORPUS = [(1, "Binary search trees keep keys sorted"), (2, "Hash tables give constant time search"), (3, "Cooking pasta with tomato sauce"), (4, None)]


@pytest.fixture(scope="module")
def index(spark):
    return Bm25Index(spark.createDataFrame(CORPUS, "id int, text string"))


def plain_bm25(query):
    import math

    docs = {i: query_terms_all(t) for i, t in CORPUS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for term in query_terms(query):
        df = sum(term in d for d in docs.values())
        for i, d in docs.items():
            if term in d:
                tf = d.count(term)
                out[i] = out.get(i, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
    return out


def query_terms_all(text):
    import re

    from tessella.functions.text import STOP_WORDS

    return [t for t in re.sub(r"[^a-z0-9\s]", " ", (text or "").lower()).split() if len(t) >= 2 and t not in STOP_WORDS]


@pytest.mark.parametrize("query", ["search trees", "search search sorted", "the of", "", "unknown"])
def test_bm25(index, spark, query):
    got = {r["id"]: r["score"] for r in index.score(query).collect()}
    assert got == pytest.approx(plain_bm25(query))
    batch = index.score_all(spark.createDataFrame([(7, query)], "query_id int, query string")).collect()
    assert {r["id"]: r["score"] for r in batch} == pytest.approx(got)


def test_bm25_top_and_empty(index, spark, tmp_path):
    top = index.score("search trees", 1).collect()
    assert [r["id"] for r in top] == [1] and index.size() == 4
    assert Bm25Index(spark.createDataFrame([], "id int, text string")).score("search").collect() == []
    index.save(str(tmp_path / "i"))
    assert Bm25Index.load(spark, str(tmp_path / "i")).score("search trees", 1).first()["id"] == 1


DOCS = [(1, "Alpha text", [1.0, 0.0]), (2, "alpha  TEXT", [0.9, 0.1]), (3, "Beta", [0.0, 1.0]), (4, "Gamma", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, content string, embedding array<double>")


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(10, 1, 0, 5, [1.0, 0.0], "ctx"), (11, 1, 6, 10, [0.8, 0.2], None), (12, 3, 0, 4, [0.0, 1.0], ""), (13, 2, 0, 5, [0.95, 0.0], None), (14, 9, 0, 1, [1.0, 0.0], None)]
    return spark.createDataFrame(rows, "id long, document_id long, start_char int, end_char int, embedding array<double>, context string")


def test_document_search(docs):
    assert [(r["id"], r["content"]) for r in search.document_search(docs, [1.0, 0.0]).collect()] == [(1, "Alpha text")]
    assert search.document_search(docs, [0.0, 0.0]).collect() == []
    assert [r["id"] for r in search.document_search(docs, [1.0, 0.0], "euclidean", 5, 0.0).collect()] == [1, 3]


def test_chunk_search(chunks, docs):
    hits = search.chunk_search(chunks, docs, [1.0, 0.0]).collect()
    assert [(r["chunk_id"], r["content"], r["start_char"]) for r in hits] == [(10, "ctx Alpha", 0), (11, "text", 6)]
    assert len(search.chunk_search(chunks, docs, [1.0, 0.0], top=1).collect()) == 1


def test_hybrid_search(chunks, docs):
    vector = [1.0, 0.0]
    a1 = [r["chunk_id"] for r in search.hybrid_search(chunks, docs, "beta", vector, alpha=1.0).collect()]
    a0 = [r["chunk_id"] for r in search.hybrid_search(chunks, docs, "beta", vector, alpha=0.0).collect()]
    assert a1[0] == 10 and a0 == [12]
    assert search.hybrid_search(chunks, docs, "beta", None).collect() == []
    over = [r["chunk_id"] for r in search.hybrid_search(chunks, docs, "beta", vector, alpha=7).collect()]
    assert over == a1


def test_batch_topk(spark, docs):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id int, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in search.batch_topk(q, docs, 2).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 1): 3, (1, 2): 2}


def test_merge_keeps_the_first_not_the_best(spark):
    hits = spark.createDataFrame([(0, 0, 5, 0.3), (0, 1, 6, 0.2), (1, 0, 5, 0.9), (1, 1, 7, 0.25)], "sub_idx int, rank int, chunk_id long, score double")
    assert [(r["chunk_id"], r["score"]) for r in rag.merge(hits, 2).collect()] == [(5, 0.3), (7, 0.25)]


def test_rerank(spark):
    hits = spark.createDataFrame([("a", i, f"c{i}") for i in range(3)] + [("b", 0, "x")], "query_id string, rank int, content string")
    answers = spark.createDataFrame([("a", "[9, 3, 6]")], "query_id string, response string")
    got = {(r["query_id"], r["rank"]): r["rerank_score"] for r in rag.rerank(hits, answers).collect()}
    assert got == {("a", 0): 9, ("a", 2): 6, ("b", 0): 10}
    assert len(rag.rerank(hits, answers, 15).collect()) == 1


def test_prompts(spark):
    hits = spark.createDataFrame([(1, 0, "first"), (1, 1, "second")], "query_id int, rank int, content string")
    queries = spark.createDataFrame([(1, "q?"), (2, "r?")], "query_id int, query string")
    got = {r["query_id"]: r for r in rag.prompts(queries, rag.contexts(hits)).collect()}
    assert "[1] first\n\n[2] second" in got[1]["prompt"] and "q?" in got[1]["prompt"] and got[1]["source_kind"] == "chunks"
    assert got[2]["source_kind"] == "Internet" and "r?" in got[2]["prompt"]


def test_options():
    o = rag.Options.of({"search_type": "HYBRID", "rerank": "true", "rerank_threshold": "abc", "hyde": "0"})
    assert (o.search_type, o.rerank, o.rerank_threshold, o.hyde, o.decompose) == ("hybrid", True, 0, False, False)


def test_rewrite():
    g = EchoGenerator(lambda p: "1. a\n2. b" if "Split" in p else "passage")
    assert rag.rewrite("q", g) == [("q", None)]
    assert rag.rewrite("q", g, hyde=True) == [("q", "passage")]
    assert rag.rewrite("q", g, decompose=True) == [("a", None), ("b", None)]
    assert rag.rewrite("q", g, True, True) == [("a", "passage"), ("b", "passage")]


def test_answer(spark, docs):
    emb = HashEmbedder(8)
    rows = [(1, 1, 0, 10, emb.embed(["alpha text"])[0], None), (2, 3, 0, 4, emb.embed(["beta"])[0], None)]
    chunks = spark.createDataFrame(rows, "id long, document_id long, start_char int, end_char int, embedding array<double>, context string")
    got = rag.answer(chunks, docs, "alpha text", emb, EchoGenerator(lambda p: p))
    assert got["source_kind"] == "chunks" and [s["chunk_id"] for s in got["sources"]] == [1] and "[1] Alpha text" in got["answer"]
    none = rag.answer(chunks, docs, "the of", emb, EchoGenerator(lambda p: p))
    assert none["source_kind"] == "Internet" and none["sources"] == []
    both = rag.answer(chunks, docs, "q", emb, EchoGenerator(lambda p: "alpha text\nbeta" if "Split" in p else ("[3, 9]" if "Rate" in p else p)), rag.Options("hybrid", rerank=True, decompose=True))
    assert [s["chunk_id"] for s in both["sources"]] == [2]


def test_catalog(spark):
    d = spark.createDataFrame([(1, "text one", "pending"), (2, "two", "completed"), (3, " ", "failed"), (4, "x", "odd")], "id long, content string, index_status string")
    c = spark.createDataFrame([(7, 1, 5, 8, "ctx"), (6, 1, 0, 4, None), (8, 99, 0, 1, None), (9, 2, 3, 3, None)], "id long, document_id long, start_char int, end_char int, context string")
    s = catalog.status_counts(d).first()
    assert (s["total"], s["pending"], s["in_progress"], s["completed"], s["failed"]) == (4, 1, 1, 1, 1)
    assert [r["id"] for r in catalog.valid_documents(d).collect()] == [1, 2]
    assert [r["id"] for r in catalog.orphans(c, d).collect()] == [8]
    assert {r["id"] for r in catalog.valid_chunks(c).collect()} == {7, 6, 8}
    rows = {r["id"]: r["chunks"] for r in catalog.listing(d, c.where("id < 9")).collect()}
    assert [x["content"] for x in rows[1]] == ["text", "one"] and rows[3] == [] and len(rows) == 4


def test_answer_all_as_answer(spark, docs):
    """Rewritten, merged and reranked for many queries at once as for each; failing models leave queries whole."""
    emb = HashEmbedder(16)
    rows = [(i, d, s, e, emb.embed([t[s:e].lower()])[0], None) for i, (d, s, e, t) in enumerate([(1, 0, 5, "Alpha text"), (1, 6, 10, "Alpha text"), (2, 0, 11, "alpha  TEXT"), (3, 0, 4, "Beta")])]
    chunks = spark.createDataFrame(rows, "id long, document_id long, start_char int, end_char int, embedding array<double>, context string")

    def model(p):
        if "Split" in p:
            if "fails" in p:
                raise RuntimeError("no")
            return "1. alpha\n2) beta\n\n 3. text" if "both" in p else ""
        if "passage that" in p:
            return p.rsplit(": ", 1)[1] + " alpha"
        return "[3, 9, 7]" if "Rate" in p else p

    g = EchoGenerator(model)
    queries = [(1, "both"), (2, "beta text"), (3, "the of"), (4, "alpha fails"), (5, "both")]
    asked = spark.createDataFrame(queries, "query_id int, query string")
    subs = [(r["query_id"], r["original"], r["passage"]) for r in rag.rewrite_all(asked, g, True, True).orderBy("query_id", "sub_idx").collect()]
    assert subs[:4] == [(1, "alpha", "alpha alpha"), (1, "beta", "beta alpha"), (1, "3. text", "3. text alpha"), (2, "beta text", "beta text alpha")] and (4, "alpha fails", "alpha fails alpha") in subs
    for o in (rag.Options("hybrid", decompose=True, hyde=True), rag.Options("cosine", decompose=True), rag.Options("hybrid", hyde=True, rerank=True), rag.Options("euclidean", top=2)):
        got = {r["query_id"]: r for r in rag.answer_all(chunks, docs, asked, emb, g, o).collect()}
        for i, q in queries:
            if "fails" not in q or not o.decompose:
                one = rag.answer(chunks, docs, q, emb, g, o)
                assert [(s["chunk_id"], round(s["score"], 9)) for s in got[i]["sources"]] == [(s["chunk_id"], round(s["score"], 9)) for s in one["sources"]]
                assert got[i]["source_kind"] == one["source_kind"] and got[i]["answer"] == one["answer"].strip()


def test_with_prefix(spark):
    """Samples longer and shorter than the length, empty, null, repeated; copies; a stored digest; no nested loop in the plan."""
    from pyspark.sql import functions as F

    from tessella.sources.store import head

    long = "x" * 150
    docs = [(1, long + "a"), (2, long + "b"), (3, "short"), (4, "shortest"), (5, ""), (6, None), (7, "x" * 101), (8, "x" * 100)]
    samples = [(1, long), (2, "short"), (3, "shor"), (4, ""), (5, None), (6, "none"), (7, "x" * 100), (2, "shortest of all")]
    df, asked = spark.createDataFrame(docs, "id long, content string"), spark.createDataFrame(samples, "sample_id long, text string")
    want = sorted((i, min(m), len(m)) for i, t in samples if t is not None and (m := [k for k, c in docs if c is not None and c.startswith(t[:101])]))
    for own in (df, df.withColumn("head", head(F.col("content")))):
        out = catalog.with_prefix(own, asked)
        assert sorted(tuple(r) for r in out.collect()) == want
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_texts_are_cut_into_tokens_once_for_a_score(spark):
    """Before, the counts and the scores cut every text anew, and their filters once more."""
    from tessella.operators.bm25 import Bm25Index

    texts = spark.createDataFrame([(1, "Zebra, zebra lion"), (2, "lion"), (3, None), (4, "the of")], "id long, text string")
    scored = Bm25Index(texts).score("zebra lion")
    assert "regexp" not in scored._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in scored.collect()) == [1, 2]
