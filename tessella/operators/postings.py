"""BM25 posting lists on disk, which batches of texts add to.

Postings (term, id, tf, dl) lie in buckets of their terms, so a query reads the buckets of its terms
and no text. Each batch writes, besides its postings, what it changes in document frequencies
(by bucket too) and in the number and length of texts: running totals are sums over batches.
A text whose id an earlier batch holds replaces that one: the frequencies of its old terms, which the
forward rows tell, are taken back, and its old postings no longer count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import index_tokens
from tessella.session import stored
from tessella.sources.log import Batch, Log, View

from .bm25 import BROADCAST_TERMS, idf, query_terms, saturated

BUCKETS = 64
#: Parts of a bucket when it is written, so that a term of very many texts isn't one task's.
SALTS = 4
_FORWARD = "id bigint, owner bigint, dl int, terms array<string>, tfs array<int>"
_TABLES = ["postings", "forward", "deltas", "totals", "replaced"]


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def counted(tokens: Column) -> Column:
    """struct<terms, tfs>: the distinct tokens in order and how often each occurs, by run lengths of the sorted tokens."""
    def run(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.transform(F.array(starts), lambda at: F.struct(
            F.transform(at, lambda i: F.get(s, i)).alias("terms"),
            F.transform(at, lambda i, k: F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tfs")))[0]

    return F.transform(F.array(F.sort_array(tokens)), run)[0]


class PostingIndex:
    """BM25 over (id, text), as Bm25Index, kept in a folder. Ids are whole numbers, unique in a batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, Log(spark, root)

    def add(self, corpus: DataFrame, name: str, gone: DataFrame | None = None) -> None:
        """Adds or replaces texts (id, text[, owner]), and removes those of ``gone`` (id, or owner), as one batch. Null texts have no tokens but count as texts.

        One writer at a time. A batch that was added under this name before changes nothing.
        """
        if self.log.counts(name):
            return
        batch, view = self.log.begin(name), self.log.view()
        batch = Batch(batch.number, batch.number)  # what failed before has no place
        c = counted(index_tokens(F.col("text")))
        owner = F.col("owner").cast("bigint") if "owner" in corpus.columns else F.lit(None).cast("bigint")
        self.log.write(corpus.select(F.col("id").cast("bigint").alias("id"), owner.alias("owner"), c.alias("c")).select("id", "owner", F.aggregate("c.tfs", F.lit(0), lambda a, x: a + x).alias("dl"), "c.terms", "c.tfs"), "forward", batch)
        own = self.spark.read.parquet(f"{self.log.root}/forward/batch={batch.number}").drop("seq")
        n, ids = own.agg(F.count("*"), F.count_distinct("id")).first()
        if n != ids:
            raise ValueError("ids of a batch must be unique and not null")
        changed = own.select("id")
        if gone is not None:
            ids = gone.select(F.col("id").cast("bigint").alias("id")) if "id" in gone.columns else self._forward(view).join(gone.select(F.col("owner").cast("bigint").alias("owner")), "owner", "left_semi").select("id")
            changed = changed.unionByName(ids).distinct()
        old = stored(self._forward(view).join(changed, "id", "left_semi"), "replaced")
        self.log.write(old.select("id"), "replaced", batch)
        each = own.select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), "id", F.col("p.tfs").alias("tf"), "dl")
        each = each.withColumn("bucket", bucket(F.col("term")))
        self.log.write(self._dealt(each), "postings", batch, ("bucket",))
        signed = own.select(F.explode("terms").alias("term"), F.lit(1).alias("d")).unionByName(old.select(F.explode("terms").alias("term"), F.lit(-1).alias("d")))
        deltas = signed.groupBy("term").agg(F.sum("d").alias("df")).where("df <> 0").withColumn("bucket", bucket(F.col("term")))
        self.log.write(deltas.repartition("bucket"), "deltas", batch, ("bucket",))
        sums = own.select("dl", F.lit(1).alias("d")).unionByName(old.select("dl", F.lit(-1).alias("d"))).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("d") * F.col("dl")), F.lit(0)).alias("length"))
        self.log.write(sums, "totals", batch)
        self.log.commit(batch)

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        """A bucket in a few tasks and sorted, so that a file holds few terms a row group."""
        return rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("bucket", "term", "id")

    def remove(self, ids: DataFrame, name: str) -> None:
        """Texts of ids (id) no longer count."""
        self.add(self.spark.createDataFrame([], "id bigint, text string"), name, ids)

    def _current(self, df: DataFrame, view: View) -> DataFrame:
        """Rows of texts that no later batch replaces."""
        later = self.log.read("replaced", "id bigint", view).groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_seq"))
        return df.join(later, (F.col("id") == F.col("_id")) & (F.col("seq") < F.col("_seq")), "left_anti").drop("seq")

    def _forward(self, view: View) -> DataFrame:
        return self._current(self.log.read("forward", _FORWARD, view), view)

    def size(self) -> int:
        return self.totals()[0]

    def totals(self, view: View | None = None) -> tuple[int, float]:
        """How many texts, and their average number of tokens (1 for no text)."""
        n, length = self.log.read("totals", "n bigint, length bigint", view or self.log.view()).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return n, (length / n if n else 1.0)

    def stats(self, view: View | None = None) -> DataFrame:
        """One row: n, avgdl."""
        return self.spark.createDataFrame([self.totals(view)], "n bigint, avgdl double")

    def postings(self, buckets: list[int], view: View | None = None) -> DataFrame:
        """(term, id, tf, dl) of these buckets; other buckets' files are not read."""
        view = view or self.log.view()
        return self._current(self.log.read("postings", "term string, id bigint, tf int, dl int, bucket int", view, F.col("bucket").isin(buckets)).drop("bucket"), view)

    def frequencies(self, buckets: list[int], view: View | None = None) -> DataFrame:
        """(term, df) of these buckets."""
        rows = self.log.read("deltas", "term string, df bigint, bucket int", view or self.log.view(), F.col("bucket").isin(buckets))
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def term_stats(self) -> DataFrame:
        """(term, df, idf) of all terms."""
        view = self.log.view()
        n, _ = self.totals(view)
        return self.frequencies(list(range(BUCKETS)), view).select("term", "df", idf(F.lit(n), F.col("df")).alias("idf"))

    def asked_frequencies(self, asked: DataFrame, few: bool, view: View | None = None) -> tuple[DataFrame, DataFrame]:
        """(id, dl, term, tf) and (term, df) for the terms of asked (term, ...)."""
        view = view or self.log.view()
        terms = asked.select("term").distinct()
        buckets = [r[0] for r in terms.select(bucket(F.col("term"))).distinct().collect()]  # at most BUCKETS
        one = F.broadcast(terms) if few else terms
        tf = self.postings(buckets, view).join(one, "term", "left_semi").select("id", "dl", "term", F.col("tf").cast("bigint").alias("tf"))
        return tf, self.frequencies(buckets, view).join(one, "term", "left_semi")

    def score_all(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, score) for queries (query_id, query)."""
        view = self.log.view()
        asked = queries.select("query_id", F.explode(F.array_distinct(index_tokens(F.col("query")))).alias("term"))
        few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
        tf, df = self.asked_frequencies(asked, few, view)
        n, avgdl = self.totals(view)
        weighed = asked.join(df, "term").select("query_id", "term", idf(F.lit(n), F.col("df")).alias("w"))
        part = F.col("w") * saturated(F.col("tf"), F.col("dl"), F.lit(avgdl))
        return tf.join(F.broadcast(weighed) if few else weighed, "term").groupBy("query_id", "id").agg(F.sum(part).alias("score"))

    def score(self, query: str, top: int | None = None) -> DataFrame:
        """(id, score) of the texts with a term of the query; the best ``top`` in order if given."""
        terms = query_terms(query)
        rows = self.spark.createDataFrame([(0, " ".join(terms))], "query_id int, query string")
        out = self.score_all(rows).select("id", "score")
        return out if top is None else out.orderBy(F.desc("score"), "id").limit(top)

    def compact(self) -> None:
        """One batch in place of those that count now; safe beside readers and writers. See vacuum()."""
        view, batch = self.log.view(), self.log.compaction()
        if len(view.seq) < 2:
            return
        every = list(range(BUCKETS))
        keep = lambda rows: rows.join(  # noqa: E731  with their places, which later replacements compare
            self.log.read("replaced", "id bigint", view).groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_seq")), (F.col("id") == F.col("_id")) & (F.col("seq") < F.col("_seq")), "left_anti")
        forward = self.log.read("forward", _FORWARD, view)
        self.log.write(keep(forward), "forward", batch)
        postings = keep(self.log.read("postings", "term string, id bigint, tf int, dl int, bucket int", view))
        self.log.write(self._dealt(postings), "postings", batch, ("bucket",))
        self.log.write(self.frequencies(every, view).withColumn("bucket", bucket(F.col("term"))).repartition("bucket"), "deltas", batch, ("bucket",))
        n, length = self.log.read("totals", "n bigint, length bigint", view).agg(F.sum("n"), F.sum("length")).first()
        self.log.write(self.spark.createDataFrame([(n, length)], "n bigint, length bigint"), "totals", batch)
        self.log.write(self.log.read("replaced", "id bigint", view), "replaced", batch)  # for batches that were begun before and end after this
        self.log.replace(batch, list(view.seq))

    def vacuum(self, seconds: float = 86_400) -> int:
        """Deletes folders that have been out of use for so long."""
        return self.log.vacuum(_TABLES, seconds)

    def clear(self) -> None:
        self.log.clear()
