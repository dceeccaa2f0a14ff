"""Documents, chunks and status as Parquet folders.

Rows are never changed in place: each batch writes folders of its own and counts from its commit
on, with all of its tables at once (see tessella.sources.log). What began last counts. A
document's vector, status and chunks count if they are at least as new as the document itself,
so a document that is replaced, deleted or cleared takes them with it, and what a late batch writes about
it counts for nothing.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import is_blank, is_safe, rejection_message
from tessella.session import stored

from .log import Batch, Log, View

DOCUMENT = "id bigint, content string, created_at timestamp, head string"
VECTOR = "id bigint, embedding array<double>"
CHUNK = "id bigint, document_id bigint, start_char int, end_char int, embedding array<double>, context string"
STATUS = "id bigint, index_status string"
TABLES = ["documents", "vectors", "status", "chunks", "deleted"]
#: Characters at a document's beginning by which it is found; their digest is stored.
HEAD = 101


def head(content: Column) -> Column:
    return F.sha2(F.substring(content, 1, HEAD), 256)


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root.rstrip("/"), Log(spark, root)

    def screened(self, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(accepted, rejected) of rows with a content: blank and unsafe ones are rejected, with a message."""
        valid = contents.withColumns({"message": rejection_message(F.col("content")), "blank": is_blank(F.col("content"))})
        bad = F.col("message").isNotNull() | F.col("blank")
        return valid.where(~bad).drop("message", "blank"), valid.where(bad).withColumn("message", F.coalesce("message", F.lit("Content can't be blank"))).drop("blank")

    def insert(self, contents: DataFrame, batch: object = None, source: str = "insert") -> tuple[DataFrame, DataFrame]:
        """Adds rows (content) whose content isn't blank and passes the guard; returns (accepted (id, content), rejected (content, message)).

        A batch without a number gets one of its own. Repeating a batch of a source replaces it.
        """
        batch = f"{source}-{uuid.uuid4().hex if batch is None else batch}"
        accepted, rejected = self.screened(contents.select("content"))
        id_ = F.xxhash64(F.lit(batch), F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 63) - 1))
        own = self.add(accepted.select(id_.alias("id"), "content"), batch)
        return self.spark.read.parquet(f"{self.root}/documents/batch={own.number}").select("id", "content"), rejected.select("content", "message")

    def add(self, rows: DataFrame, batch: str) -> Batch:
        """Screened rows (id, content), pending."""
        own = self.log.begin(str(batch))
        self.log.write(rows.select("id", "content", F.current_timestamp().alias("created_at"), head(F.col("content")).alias("head")), "documents", own)
        written = self.spark.read.parquet(f"{self.root}/documents/batch={own.number}")
        self.log.write(written.select("id", F.lit("pending").alias("index_status")), "status", own)
        self.log.commit(own)
        return own

    def put(self, batch: object, parent: object = "", *, vectors: DataFrame | None = None, chunks: DataFrame | None = None, status: DataFrame | None = None) -> None:
        """Vectors (id, embedding), chunks (as CHUNK) and states (id, index_status) of documents, visible all at once. ``parent``: the batch that added the documents."""
        own = self.log.begin(str(batch), str(parent))
        for name, rows, columns in (("vectors", vectors, VECTOR), ("chunks", chunks, CHUNK), ("status", status, STATUS)):
            if rows is not None:
                self.log.write(rows.select(*[c.strip().split(" ")[0] for c in columns.split(", ")]), name, own)
        self.log.commit(own)

    def set_status(self, rows: DataFrame, batch: object, parent: object = "") -> None:
        self.put(batch, parent, status=rows)

    def set_vectors(self, rows: DataFrame, batch: object) -> None:
        self.put(batch, vectors=rows)

    def set_chunks(self, rows: DataFrame, batch: object) -> None:
        self.put(batch, chunks=rows)

    def delete(self, ids: DataFrame, batch: object = None) -> None:
        """The documents of ids (id) go, with all that hangs on them, also what batches that have begun before write later."""
        own = self.log.begin(f"delete-{uuid.uuid4().hex if batch is None else batch}")
        self.log.write(ids.select(F.col("id").cast("bigint").alias("id")), "deleted", own)
        self.log.commit(own)

    def _places(self, view: View) -> DataFrame:
        """(id, place) of the documents that count: the place of their last version. Reads no contents."""
        added = self.log.read("documents", "id bigint", view).groupBy("id").agg(F.max("seq").alias("place"))
        gone = self.log.read("deleted", "id bigint", view).groupBy("id").agg(F.max("seq").alias("gone"))
        return added.join(gone, "id", "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("place"))).select("id", "place")

    def _newest(self, name: str, schema: str, key: str, places: DataFrame, view: View) -> DataFrame:
        """The rows, with seq, that were written last about each document that counts, if not before it."""
        rows = self.log.read(name, schema, view)
        last = rows.groupBy(F.col(key).alias("_id")).agg(F.max("seq").alias("_seq")).join(places.select(F.col("id").alias("_id"), "place"), "_id").where(F.col("_seq") >= F.col("place"))
        return rows.join(last.select("_id", "_seq"), (F.col(key) == F.col("_id")) & (F.col("seq") == F.col("_seq")), "left_semi")

    def _documents(self, places: DataFrame, view: View) -> DataFrame:
        return self._newest("documents", DOCUMENT, "id", places, view).dropDuplicates(["id"])

    def _chunks(self, places: DataFrame, view: View) -> DataFrame:
        """No chunks that a later processing of their document has none of."""
        done = self.log.read("status", STATUS, view).where(F.col("index_status").isin("completed", "failed")).groupBy(F.col("id").alias("_id")).agg(F.max("seq").alias("_done"))
        rows = self._newest("chunks", CHUNK, "document_id", places, view).dropDuplicates(["id"])
        return rows.join(done, (F.col("document_id") == F.col("_id")) & (F.col("seq") < F.col("_done")), "left_anti")

    def documents(self) -> DataFrame:
        """(id, content, embedding, index_status, created_at)."""
        view = self.log.view()
        places = self._places(view)
        vectors = self._newest("vectors", VECTOR, "id", places, view).dropDuplicates(["id"]).drop("seq")
        status = self._newest("status", STATUS, "id", places, view).dropDuplicates(["id"]).drop("seq")
        met = self._documents(places, view).drop("seq").join(vectors, "id", "left").join(status, "id", "left")
        return met.select("id", "content", "embedding", F.coalesce("index_status", F.lit("pending")).alias("index_status"), "created_at")

    def heads(self) -> DataFrame:
        """(id, content, head), head the digest of the first HEAD characters; no vectors are read."""
        view = self.log.view()
        return self._documents(self._places(view), view).select("id", "content", "head")

    def states(self) -> DataFrame:
        """(id, index_status), without reading contents or vectors."""
        view = self.log.view()
        places = self._places(view)
        status = self._newest("status", STATUS, "id", places, view).dropDuplicates(["id"]).drop("seq")
        return places.select("id").join(status, "id", "left").select("id", F.coalesce("index_status", F.lit("pending")).alias("index_status"))

    def chunks(self) -> DataFrame:
        view = self.log.view()
        return self._chunks(self._places(view), view).drop("seq")

    def find(self, id: int) -> DataFrame:
        """The document of this id, or no row."""
        return self.documents().where(F.col("id") == id)

    def in_progress(self) -> int:
        """How many documents are pending or processing."""
        return self.states().where(F.col("index_status").isin("pending", "processing")).count()

    def wait(self, seconds: float = 60, every: float = 1) -> int:
        """Asks again and again until no document is in progress or the time is over; how many are."""
        end = time.monotonic() + seconds
        while (n := self.in_progress()) and time.monotonic() < end:
            time.sleep(every)
        return n

    def compact(self) -> None:
        """One batch in place of those that count now. Readers and writers may be at work: what they have or begin stays right.

        Replaced folders stay until vacuum().
        """
        view = self.log.view()
        if len(view.seq) < 2:
            return
        own, places = self.log.compaction(), self._places(view)
        self.log.write(self._documents(places, view), "documents", own)
        for name, schema in (("vectors", VECTOR), ("status", STATUS)):
            self.log.write(self._newest(name, schema, "id", places, view).dropDuplicates(["id"]), name, own)
        self.log.write(self._chunks(places, view), "chunks", own)
        self.log.write(self.log.read("deleted", "id bigint", view), "deleted", own)  # for batches that have begun before
        self.log.replace(own, list(view.seq))

    def vacuum(self, seconds: float = 86_400) -> int:
        """Deletes folders that no longer count and are older than this: longer than any reader or late batch takes."""
        return self.log.vacuum(TABLES, seconds)

    def clear(self) -> None:
        """All documents go, with all that hangs on them, also what batches that have begun before write later."""
        self.log.clear()


def split_safe(queries: DataFrame, text: str, classify=None) -> tuple[DataFrame, DataFrame]:
    """(safe, unsafe): first by the guard's rules, then the rest by the classifier, which sees no text that the rules reject."""
    ruled = queries.where(is_safe(F.col(text)))
    unruled = queries.where(~is_safe(F.col(text)))
    if classify is None:
        return ruled, unruled
    judged = stored(ruled.withColumn("_verdict", classify(F.col(text))), "verdicts")  # one verdict a row
    return judged.where("_verdict = 'safe'").drop("_verdict"), judged.where("_verdict <> 'safe' or _verdict is null").drop("_verdict").unionByName(unruled)

