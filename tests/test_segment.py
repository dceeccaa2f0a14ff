import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import segment as s

TEXTS = ["One. Two! Three? Four", "A line\nAnother line.  Spaced.\n\n Last", "no end", "", None, " \n ", "3.14 is pi. e.g. x...  Yes", "é😀. ü"]


@pytest.mark.parametrize("text", TEXTS)
def test_sentences_cover_the_text(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(s.sentences(F.col("t")).alias("s")).first()["s"]
    for x in got:
        assert text[x["start_char"] : x["end_char"]] == x["content"] == x["content"].strip()
    assert "".join("".join(x["content"].split()) for x in got) == "".join((text or "").split())


def greedy(spans, size, overlap, breaks=None):
    out, g = [], []
    length = lambda g: sum(len(x["content"]) for x in g) + max(len(g) - 1, 0)
    flush = lambda g: (g[0]["start_char"], g[-1]["end_char"], " ".join(x["content"] for x in g))
    tail = lambda g: g[-overlap:] if overlap else []
    for i, x in enumerate(spans):
        if breaks and breaks[i] and g:
            out.append(flush(g))
            g = tail(g)
        if g and length(g) + 1 + len(x["content"]) > size:
            out.append(flush(g))
            g = tail(g)
        g = [*g, x]
    return [*out, flush(g)] if g else out


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_chunks_equal_a_plain_loop(spark, overlap):
    rng = random.Random(overlap)
    rows = [(" ".join("w" * rng.randint(1, 40) + "." for _ in range(rng.randint(0, 25))), [rng.random() < 0.2 for _ in range(25)]) for _ in range(40)]
    df = spark.createDataFrame(rows, "t string, b array<boolean>").withColumn("s", s.sentences(F.col("t")))
    b = F.slice("b", F.lit(1), F.size("s"))
    for r in df.select("s", "b", s.chunks(F.col("s"), 60, overlap).alias("c"), s.chunks(F.col("s"), 60, overlap, b).alias("d")).collect():
        assert [tuple(x) for x in r["c"]] == greedy(r["s"], 60, overlap)
        assert [tuple(x) for x in r["d"]] == greedy(r["s"], 60, overlap, r["b"][: len(r["s"])])


def test_long_sentence_stays_whole(spark):
    c = spark.createDataFrame([("x" * 80 + ". Short.",)], "t string").select(s.chunks(s.sentences(F.col("t")), 50, 0).alias("c")).first()["c"]
    assert [x["content"] for x in c] == ["x" * 80 + ".", "Short."]


def test_semantic_breaks(spark):
    df = spark.createDataFrame([("A. B. C. D.", [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]]), ("A. B.", [[1.0, 0.0], None])], "t string, v array<array<double>>")
    got = [[x["content"] for x in r["c"]] for r in df.select(s.chunks_with_vectors(s.sentences(F.col("t")), F.col("v"), 500, 0).alias("c")).collect()]
    assert got == [["A. B.", "C. D."], ["A. B."]]


def test_rule_splitter(spark):
    text = "Dr. Smith met J. Doe. They left etc. soon. 1. First item\nNext line"
    want = ["Dr. Smith met J. Doe.", "They left etc. soon.", "1. First item", "Next line"]
    assert [x[0] for x in s.split_sentences(text)] == want
    got = spark.createDataFrame([(text,), (None,)], "t string").select(s.rule_sentences(F.col("t")).alias("s")).collect()
    assert [x["content"] for x in got[0]["s"]] == want and got[1]["s"] == []


def test_time_grows_with_the_length(spark):
    """A document a hundred times as long as another takes a hundred times as long at most, and not its square."""
    import time

    one = " ".join("w" * (k % 40 + 1) + "." for k in range(2_000))
    took = []
    for text in (one, one, " ".join([one] * 100)):
        began = time.perf_counter()
        spans = s.plain_sentences(text)
        at = s._gathered([len(x[0]) for x in spans], [False] * len(spans), 500, 1)
        took.append(time.perf_counter() - began)
        assert len(at) > len(spans) / 30
    assert took[2] < 400 * min(took[:2])
