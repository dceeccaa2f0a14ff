import pytest
from pyspark.sql import functions as F

from tessella.functions import sql, text, vector
from tessella.operators import segment

from .test_vector import CASES


def test_functions_agree_with_columns(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(" A\tb ",), ("",), (None,)], "t string")
    for r in rows.select(text.normalize(F.col("t")), F.expr("normalize_text(t)"), text.fingerprint(F.col("t")), F.expr("text_fingerprint(t)")).collect():
        assert r[0] == r[1] and r[2] == r[3]
    vectors = spark.createDataFrame([c[:2] for c in CASES], "a array<double>, b array<double>")
    for r in vectors.select(vector.cosine(F.col("a"), F.col("b")), F.expr("cosine_similarity(a, b)"), vector.euclidean(F.col("a"), F.col("b")), F.expr("inverse_euclidean(a, b)")).collect():
        assert r[0] == pytest.approx(r[1]) and r[2] == pytest.approx(r[3])


@pytest.mark.parametrize("overlap", [0, 1])
def test_table_function(spark, overlap):
    sql.register(spark)
    content = "One is here. Two is there. Three is gone. " * 5
    spark.createDataFrame([(content,)], "c string").createOrReplaceTempView("texts")
    got = [tuple(r) for r in spark.sql(f"SELECT k.* FROM texts, LATERAL chunk_text(c, 40, {overlap}) k").collect()]
    want = spark.table("texts").select(segment.chunks(segment.rule_sentences(F.col("c")), 40, overlap).alias("k")).first()["k"]
    assert got == [tuple(x) for x in want]
