import pytest
from pyspark.sql import functions as F

from tessella.operators.bm25 import Bm25Index
from tessella.operators.postings import BUCKETS, PostingIndex, bucket, counted
from tessella.sources.log import Log

TEXTS = {1: "Binary search trees keep keys sorted", 2: "Hash tables give constant time search search", 3: "Cooking pasta with tomato sauce", 4: None, 5: "the of", 6: "search keys keys keys trees"}


def corpus(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def scores(df):
    return {(r["query_id"], r["id"]): pytest.approx(r["score"]) for r in df.collect()}


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "search keys"), (2, "tomato trees unknown"), (3, "the of"), (4, None), (5, "replaced words")], "query_id int, query string")


def same(spark, index, texts, queries):
    plain = Bm25Index(corpus(spark, texts))
    assert scores(index.score_all(queries)) == scores(plain.score_all(queries))
    assert index.size() == len(texts) and {(r["term"], r["df"]) for r in index.term_stats().collect()} == {(r["term"], r["df"]) for r in plain.term_stats().collect()}


def test_counted(spark):
    rows = spark.createDataFrame([(["b", "a", "b"],), ([],), (["x"],)], "t array<string>").select(counted(F.col("t")).alias("c")).collect()
    assert [(r["c"]["terms"], r["c"]["tfs"]) for r in rows] == [(["a", "b"], [1, 2]), ([], []), (["x"], [1])]


def test_batches_replacements_removals_compaction(spark, tmp_path, queries):
    index, texts = PostingIndex(spark, str(tmp_path / "i")), {}
    same(spark, index, texts, queries)
    for name, part in [("a", {1: TEXTS[1], 2: "replaced words search", 3: TEXTS[3]}), ("b", {4: None, 5: TEXTS[5], 6: TEXTS[6]}), ("c", {2: TEXTS[2], 6: "keys"}), ("d", {6: TEXTS[6]})]:
        index.add(corpus(spark, part), name)
        texts |= part
        same(spark, index, texts, queries)
    index.add(corpus(spark, {1: "other"}), "d")  # counts already
    index.remove(corpus(spark, {3: None, 77: None}), "e")
    texts.pop(3)
    same(spark, index, texts, queries)
    assert index.score("search trees", 1).first()["id"] == Bm25Index(corpus(spark, texts)).score("search trees", 1).first()["id"]
    held = index.postings(list(range(BUCKETS)))  # a reader from before
    before = held.count()
    index.compact()
    same(spark, index, texts, queries)
    assert held.count() == before and len(list((tmp_path / "i" / "postings").glob("batch=*"))) == 6
    index.vacuum(0)
    assert len(list((tmp_path / "i" / "postings").glob("batch=*"))) == 1
    index.add(corpus(spark, {1: "keys anew", 9: "search"}), "f")
    same(spark, index, texts | {1: "keys anew", 9: "search"}, queries)
    index.clear()
    same(spark, index, {}, queries)


def test_only_asked_buckets_are_read(spark, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "i"))
    index.add(corpus(spark, {i: f"word{i} word{i + 1} common" for i in range(300)}), "a")
    asked = spark.createDataFrame([("word7",), ("common",)], "term string")
    own = {r[0] for r in asked.select(bucket(F.col("term"))).collect()}
    rows = index.log.read("postings", "term string, id bigint, tf int, dl int, bucket int", index.log.view(), F.col("bucket").isin(sorted(own)))
    read = rows.select(F.regexp_extract(F.input_file_name(), r"bucket=(\d+)", 1).cast("int")).distinct().collect()
    assert {r[0] for r in read} == own and len(own) < BUCKETS
    assert index.postings(sorted(own)).where("term = 'common'").count() == 300
    tf, df = index.asked_frequencies(asked, True)
    assert tf.count() == 302 and {(r["term"], r["df"]) for r in df.collect()} == {("word7", 2), ("common", 300)}


def test_repeated_ids_and_failed_batches(spark, tmp_path, queries):
    index = PostingIndex(spark, str(tmp_path / "i"))
    with pytest.raises(ValueError, match="unique"):
        index.add(corpus(spark, {1: "a b"}).unionByName(corpus(spark, {1: "search"})), "a")
    same(spark, index, {}, queries)
    index.add(corpus(spark, {1: "search keys"}), "a")
    same(spark, index, {1: "search keys"}, queries)


def test_log(spark, tmp_path):
    log, other = Log(spark, str(tmp_path)), Log(spark, str(tmp_path))
    a, b = log.begin("a/x ~"), other.begin("b")
    assert (a.number, b.number) == (1, 2) and log.view().seq == {}
    log.commit(b)
    log.commit(a)
    assert log.view().seq == {1: 1, 2: 2} and log.counts("a/x ~") and not log.counts("c")
    again = log.begin("a/x ~")
    assert again.seq == 1 and log.view().seq == {1: 1, 2: 2}
    log.commit(again)
    assert other.view().seq == {3: 1, 2: 2}
    late, child = log.begin("late"), log.begin("child", "b")
    other.clear()
    log.commit(late)
    log.commit(child)
    after = log.begin("orphan", "b")
    log.commit(after)
    assert log.view().seq == {}
    new = log.begin("new")
    log.commit(new)
    assert log.view().seq == {new.number: new.number}
