"""The request surface: list, create, search, ask, status, clear."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import rejection_message
from tessella.operators import catalog, rag, search
from tessella.operators.postings import PostingIndex
from tessella.sources.providers import Classifier, Embedder, Generator
from tessella.sources.store import Store
from tessella.streaming.ingest import process

UNSAFE = "Query flagged as unsafe"


class Rejected(ValueError):
    """A request that isn't served (status 422 over HTTP)."""


class Service:
    def __init__(self, spark: SparkSession, store: Store, embedder: Embedder, generator: Generator, classifier: Classifier | None = None, index: PostingIndex | None = None):
        """``index``, over the chunks of the store, serves hybrid search if it is given, and gets what is created."""
        self.spark, self.store, self.embedder, self.generator, self.classifier, self.index_ = spark, store, embedder, generator, classifier, index

    def _rejection(self, text: str) -> str | None:
        return self.spark.range(1).select(rejection_message(F.lit(text)).alias("m")).first()["m"]

    def _check(self, query: str) -> None:
        """The rules first; the classifier sees only what they let through."""
        if self._rejection(query) is not None or (self.classifier and self.classifier.classify([query])[0] != "safe"):
            raise Rejected(UNSAFE)

    def _vector(self, query: str) -> list[float]:
        return self.embedder.embed([rag.normal(query)])[0]

    def index(self) -> DataFrame:
        return catalog.listing(self.store.documents(), self.store.chunks())

    def create(self, content: str, batch: object = None) -> DataFrame:
        """Adds one document as a batch of its own and indexes it, by meaning and with contexts. Only the rules are asked."""
        message = self._rejection(content)
        if message is not None:
            raise Rejected(message)
        batch = uuid.uuid4().hex if batch is None else batch
        accepted, rejected = self.store.insert(self.spark.createDataFrame([(content,)], "content string"), batch, "service")
        bad = rejected.first()
        if bad:
            raise Rejected(bad["message"])
        process(self.store, accepted, f"service-{batch}", self.embedder, self.generator, semantic=True, index=self.index_)
        return accepted

    def search(self, query: str, search_type: str | None = None) -> DataFrame:
        self._check(query)
        return search.document_search(self.store.documents(), self._vector(query), (search_type or "cosine").lower())

    def chunk_search(self, query: str, search_type: str | None = None) -> DataFrame:
        self._check(query)
        docs, chunks, kind = self.store.documents(), self.store.chunks(), (search_type or "cosine").lower()
        if kind == "hybrid":
            return search.hybrid_search(chunks, docs, query, rag.vector_or_none(self.embedder, query), index=self.index_)
        return search.chunk_search(chunks, docs, self._vector(query), kind)

    def rag(self, query: str, **given: object) -> dict[str, object]:
        self._check(query)
        return rag.answer(self.store.chunks(), self.store.documents(), query, self.embedder, self.generator, rag.Options.of(given), self.index_)

    def index_status(self) -> dict[str, int]:
        return catalog.status_counts(self.store.states()).first().asDict()

    def clear(self) -> None:
        self.store.clear()
        if self.index_ is not None:
            self.index_.clear()
