import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.llm import quality

from .helpers import documents, odd_rows, with_clashes


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c, hit = Counter(g), set()
    for i, x in enumerate(g):
        if c[x] > 1:
            hit.update(range(i, i + 5))
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n)


def test_measures(spark):
    rows = [*odd_rows(), (20, "a b c d e x a b c d e y z a b c d e"), (21, "l1 a\nl1 a\n\n \nl2\nl1 a"), (22, "# a*b $%&|<> " * 9), (23, "q " * 50), (24, "a b c d e f g a b c d e f")]
    df = quality.measure(with_clashes(documents(spark, rows), "w", "l", "stratum", "n_words"))
    got = sorted((str(r["doc_id"]), *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in df.collect())
    assert got == sorted((str(i), *plain(t)) for i, t in rows)


@pytest.mark.parametrize("n, k, p", [(100, 0, 0.05), (1000, 3, 0.005), (5000, 12, 0.005), (2_000_000, 9000, 0.005), (10, 4, 0.1), (0, 0, 0.1)])
def test_tail(spark, n, k, p):
    got = spark.range(1).select(quality._tail(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), p).alias("x")).first()["x"]
    if k > n * p:
        assert got == 1.0
    else:
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-6)


def test_certified_cutoffs(spark):
    good = "plain words of a decent text that goes on for a while " * 3
    good = " ".join(f"{w}{i}" for i, w in enumerate(good.split()))
    bad = good.replace(" ", " ### ")
    rows = [(i, f"{good} own{i}", "en") for i in range(3000)] + [(3000 + i, f"{bad} own{i}", "en") for i in range(20)] + [(4000, bad, "xx"), (4001, good, None), (4002, bad, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)] + [(3000 + i, 0, 0) for i in range(20)] + [(3000, 1, 0), (9, None, 1)], "doc_id long, quality int, toxic int")
    df = documents(spark, rows)
    measured = quality.measure(df)
    cuts = {r["stratum"]: r.asDict() for r in quality.certify(measured, labels).collect()}
    copies = documents(spark, [(i, good if i < 3000 else bad, "en") for i, *_ in rows[:3020]])
    assert {r["cut_symbols"] for r in quality.certify(quality.measure(copies), labels).collect()} == {None}  # one text is one draw
    assert cuts["en"]["cut_symbols"] == 0.02 and cuts["en"]["cut_dup_lines"] is None
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(df, labels).collect()}
    assert kept[0] and not kept[3005] and kept[4000] and kept[4001] and kept[4002]
    # so many good ones rejected that no cutoff can be certified
    worse = labels.where("doc_id >= 3000").withColumn("quality", F.lit(1)).unionByName(labels.where("doc_id < 3000"))
    assert all(quality.judge(df, worse).select((F.col("kept") == ~F.col("base_failed")).alias("x")).toPandas()["x"])


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (None, 1, 0), (4, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(documents(spark, odd_rows()), labels).collect()
    assert len(got) == len(odd_rows()) and sorted(str(r["doc_id"]) for r in got if r["kept"]) == ["4", "None"]


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge(documents(spark, []), labels).collect() == []
    assert quality.judge(documents(spark, [(1, "x")]), labels).first()["kept"] is False
