import pytest
from pyspark.sql import functions as F

from tessella.functions import metrics as m
from tessella.operators import evaluate as e

ROWS = [
    # answer, expected, keywords, sources -> recall, f1, overlap, precision, hit, overall
    ("A heap is a tree", "A heap is a tree", ["heap", "tree"], [], 1.0, 1.0, 1.0, 0.0, False, 100.0),
    ("nothing here", "a heap is a tree", ["heap", "tree", "root"], ["Heap text", "other"], 0.0, 0.0, 0.0, 0.5, True, 10.0),
    ("", "words", [], None, 1.0, 0.0, 0.0, 0.0, False, 40.0),
    ("the the cat", "the cat sat", ["CAT"], ["x"], 1.0, 2 / 3, 2 / 3, 0.0, False, 64.0),
]


@pytest.mark.parametrize("row", ROWS)
def test_all(spark, row):
    df = spark.createDataFrame([row[:4]], "a string, e string, k array<string>, s array<string>")
    r = df.select(*m.all_metrics(*(F.col(c) for c in "aeks"))).first()
    assert [r[i] for i in range(4)] == pytest.approx([round(x, 6) for x in row[4:8]])
    assert r["retrieval_hit"] is row[8] and r["overall_score"] == row[9] and r["passed"] == (row[9] >= 30)


def test_evaluation(spark, tmp_path):
    q = spark.createDataFrame([("l", "q1", "a heap", ["heap"]), ("l", "q2", "a tree", ["tree"])], "lecture_id string, question string, expected_answer string, expected_keywords array<string>")
    a = spark.createDataFrame([("l", "q1", "a heap", ["heap text"]), ("l", "q2", "unknown", [])], "lecture_id string, question string, rag_answer string, sources array<string>")
    results = e.evaluate(q, a)
    s = e.summary(results).first()
    assert (s["total_questions"], s["passed"], s["failed"], s["pass_rate"], s["retrieval_hit_rate"]) == (2, 1, 1, 50.0, 0.5)
    assert e.gate(results) and not e.gate(results, 60)
    text = e.report(results)
    assert "1. [l] q1" in text and "PASS" in text and "FAIL" in text and "  Pass rate:              50.0%" in text
    e.write_report(results, str(tmp_path / "report"))
    assert "".join(f.read_text() for f in (tmp_path / "report").glob("part-*")).strip() == text
    empty = e.summary(results.limit(0)).first()
    assert empty["total_questions"] == 0 and empty["avg_overall_score"] == 0.0 and empty["pass_rate"] == 0.0


def test_scores_round_as_in_sql(spark):
    """14.549999999999999 and 13.649999999999999 are halves once they are scaled."""
    words = lambda n, a: [f"{a}{i}" for i in range(n)]
    shared = words(1, "shared"), words(7, "shared")
    rows = [(" ".join(shared[0] + words(2, "a")), " ".join(shared[0] + words(71, "b")), ["shared0", "missing1", "missing2"], []), (" ".join(shared[1] + words(3, "a")), " ".join(shared[1] + words(33, "b")), ["missing"], [])]
    df = spark.createDataFrame(rows, "a string, e string, k array<string>, s array<string>")
    assert [r["overall_score"] for r in df.select(*m.all_metrics(*(F.col(c) for c in "aeks"))).collect()] == [14.6, 13.7]
    met, cols = m.with_metrics(df, *"aeks")
    assert met.select(*cols).collect() == df.select(*m.all_metrics(*(F.col(c) for c in "aeks"))).collect()
