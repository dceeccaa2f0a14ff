import pyarrow as pa

from tessella.functions.batches import pieces
from tessella.operators import segment


def test_pieces_keep_rows_and_bound_bytes():
    texts = pa.array(["x" * (i % 700) if i % 13 else None for i in range(5_000)])
    lists = pa.array([[i, i + 1] for i in range(5_000)])
    got = list(pieces(iter([(texts, lists), (texts.slice(0, 0), lists.slice(0, 0)), (texts.slice(7, 1), lists.slice(7, 1))]), 20_000))
    assert all(a.nbytes + b.nbytes <= 20_000 for a, b in got) and len(got) > 50
    assert [x for a, _ in got for x in a.to_pylist()] == [*texts.to_pylist(), texts[7].as_py()]
    assert [x for _, b in got for x in b.to_pylist()] == [*lists.to_pylist(), [7, 8]]
    assert [len(a) for (a,) in pieces(iter([pa.array(["y" * 50, "z" * 50])]), 10)] == [1, 1]


def test_sentences_and_chunks_of_a_batch_come_in_pieces():
    """A batch of 4 MB isn't held as Python objects at once."""
    texts = pa.array(["One here. Two there!\nThree " + "w" * 2_000] * 2_000)
    for column in (segment.sentences, segment.rule_sentences, segment.text_chunks):
        seen = []
        segment_run = column.__globals__["F"].arrow_udf
        try:
            column.__globals__["F"].arrow_udf = lambda kind: lambda run: lambda _: seen.append(list(run(iter([texts]))))
            column(None)
        finally:
            column.__globals__["F"].arrow_udf = segment_run
        assert len(seen[0]) > 3 and sum(len(a) for a in seen[0]) == 2_000


def test_text_chunks_equal_chunks_of_sentences(spark):
    from pyspark.sql import functions as F

    rows = [(i, ("One sentence here. " * (i % 40) + "\n" + "long" * (i % 200) + " end") if i % 11 else (None if i % 2 else " \n ")) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, t string")
    for overlap in (0, 1):
        got = df.select(segment.text_chunks(F.col("t"), 120, overlap).alias("a"), segment.chunks(segment.sentences(F.col("t")), 120, overlap).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]


def test_models_are_asked_once_when_chunks_are_exploded(spark):
    from pyspark.sql import functions as F

    from tessella.sources.providers import EchoGenerator, HashEmbedder
    from tessella.streaming.ingest import indexed

    docs = spark.createDataFrame([(1, "One. Two."), (2, "Three.")], "id long, content string")
    each = indexed(docs, HashEmbedder(4), EchoGenerator(lambda p: "c"), dim=4).select("id", "embedding", F.explode("chunks").alias("c"))
    plan = each._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 4 and each.count() == 2


def test_only_beginnings_that_are_asked_for_are_counted(spark):
    """Before, every document's beginnings of each short sample's length were grouped."""
    from pyspark.sql import functions as F

    from tessella.operators import catalog

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "abc", "x" * 120, "x" * 101, "", None, "abcd" * 40])], "id long, content string")
    got = catalog.with_prefix(docs, docs.select(F.col("id").alias("sample_id"), F.col("content").alias("text")))
    assert sorted(map(tuple, got.collect())) == [(0, 0, 3), (1, 1, 2), (2, 2, 2), (3, 2, 2), (4, 0, 6), (6, 6, 1)]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_an_embedder_is_asked_once_when_vectors_are_filtered(spark):
    """Before, the filter on vectors was pushed below and the texts went to Python twice, to workers of their own."""
    from pyspark.sql import functions as F

    from tessella.operators.search import chunk_texts
    from tessella.plans.retrieval import _embedded
    from tessella.sources.providers import HashEmbedder, embed_udf

    docs = spark.createDataFrame([(1, "One two."), (2, "Three.")], "id long, content string")
    chunks = _embedded(docs, HashEmbedder(64))
    plan = chunk_texts(chunks, docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and chunk_texts(chunks, docs).count() == 2
    asked = docs.withColumn("vector", embed_udf(HashEmbedder(4))(F.col("content"))).where("size(vector) > 0")
    assert asked._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
