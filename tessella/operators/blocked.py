"""Vectors scored against blocks of queries, and the best of them kept where they are read.

Rows arrive as Arrow batches. A batch of vectors times a block of queries is one matrix product, which
says which rows can be among a query's best. Those few are scored again component by component, so
that scores are those of the column functions and equal vectors have equal scores. A task
passes on the ``top`` best contents of each query and no more; every query sees every row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.session import stored

from .bm25 import K1, B

#: Queries that go to the tasks at once; more are worked off in blocks, each a scan of the rows.
QUERIES_AT_ONCE = 4_096
#: Rows and queries of one product.
ROWS, COLUMNS = 2_048, 1_024
#: Rows of lexical scores at once: each of their terms meets all queries that have it.
LEXICAL_ROWS = 512
#: Lexical scores that are held at once.
CELLS = 2_000_000


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) if x.shape[1] else np.zeros(len(x))


def exact(x: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray:
    """Scores of rows against one query, summed in the order of the components as the column functions do."""
    if kind == "euclidean":
        return 1 / (1 + np.sqrt(np.cumsum((x - q) ** 2, axis=1)[:, -1]))
    size = norms(x) * norms(q[None])[0]
    dot = np.cumsum(x * q, axis=1)[:, -1]
    return np.clip(np.divide(dot, size, out=np.zeros(len(x)), where=size > 0), -1, 1)


def _product(x: np.ndarray, q: np.ndarray, kind: str) -> tuple[np.ndarray, float]:
    """Scores by a matrix product, and how far they can be off."""
    dot = x @ q.T
    if kind == "euclidean":
        square = (x * x).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * dot
        return 1 / (1 + np.sqrt(np.maximum(square, 0))), 1e-5
    size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None]
    return np.clip(np.divide(dot, size, out=np.zeros_like(dot), where=size > 0), -1, 1), 1e-9


class Lexical:
    """Okapi BM25 of rows against queries. weights: term to (numbers of queries, their weights)."""

    def __init__(self, weights: dict[str, tuple[np.ndarray, np.ndarray]], avgdl: float):
        self.terms, self.avgdl = pa.array(list(weights), pa.string()), avgdl
        none = [np.empty(0, np.int64)]
        self.size = np.array([len(q) for q, _ in weights.values()], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.queries = np.concatenate(none + [q for q, _ in weights.values()]).astype(np.int64)
        self.weights = np.concatenate(none + [w for _, w in weights.values()]).astype(float)

    def scores(self, b: pa.RecordBatch, lo: int, hi: int, queries: int) -> np.ndarray:
        """(row, query): a row's terms are added in their order, so equal rows have equal scores."""
        terms, tfs = b.column("terms")[lo:hi], b.column("tfs")[lo:hi]
        flat = terms.flatten()
        codes = pc.index_in(flat, value_set=self.terms.cast(flat.type))
        known = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
        if not len(known):
            return np.zeros((hi - lo, queries))
        rows = np.repeat(np.arange(hi - lo), pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False))[known]
        codes, tf = codes.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64), tfs.flatten().take(pa.array(known)).to_numpy(zero_copy_only=False).astype(float)
        dl = b.column("dl")[lo:hi].to_numpy(zero_copy_only=False).astype(float)[rows]
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.avgdl))
        n = self.size[codes]
        at = np.repeat(self.start[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())
        cells = np.repeat(rows * queries, n) + self.queries[at]
        return np.bincount(cells, self.weights[at] * np.repeat(part, n), (hi - lo) * queries).reshape(hi - lo, queries)


class Fusion:
    """alpha * semantic / its maximum + (1 - alpha) * lexical / its maximum, a maximum a query."""

    def __init__(self, alpha: float, semantic: np.ndarray, lexical: np.ndarray):
        self.a = min(max(alpha, 0.0), 1.0)
        self.semantic, self.lexical = semantic, lexical

    def __call__(self, semantic: np.ndarray, lexical: np.ndarray, at) -> np.ndarray:
        part = lambda x, most: np.where(most > 0, np.divide(x, most, out=np.zeros_like(x), where=most > 0), 0.0)
        return self.a * part(semantic, self.semantic[at]) + (1 - self.a) * part(lexical, self.lexical[at])


def _tiles(b: pa.RecordBatch, vectors: list[np.ndarray], kind: str, lexical: Lexical | None):
    """(first row, queries' numbers, semantic scores, their error, lexical scores or None, the rows' vectors by width)."""
    lengths = np.diff(b.column("embedding").offsets.to_numpy())
    widths = sorted({len(v) for v in vectors})
    by = {d: np.array([j for j, v in enumerate(vectors) if len(v) == d]) for d in widths}
    step = ROWS if lexical is None else max(1, min(LEXICAL_ROWS, CELLS // max(1, len(vectors))))
    for lo in range(0, len(b), step):
        hi = min(len(b), lo + step)
        own, words = b.column("embedding")[lo:hi], lexical.scores(b, lo, hi, len(vectors)) if lexical else None
        for d in widths:
            fit = np.flatnonzero(lengths[lo:hi] == d)
            x = own.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fit), d) if d else np.zeros((0, 0))
            whole = np.zeros((hi - lo, d))
            whole[fit if d else []] = x
            q = np.stack([vectors[j] for j in by[d]]) if d else np.zeros((len(by[d]), 0))
            for c in range(0, len(by[d]), COLUMNS):
                at = by[d][c : c + COLUMNS]
                s = np.zeros((hi - lo, len(at)))  # other widths have score 0
                error = 1e-9
                if d and len(fit):
                    s[fit], error = _product(x, q[c : c + COLUMNS], kind)
                yield lo, at, s, error, words[:, at] if lexical else None, whole, lengths[lo:hi] == d


def _rescored(whole: np.ndarray, fits: np.ndarray, q: np.ndarray, rows: np.ndarray, kind: str) -> np.ndarray:
    out = np.zeros(len(rows))
    m = fits[rows]
    if len(q) and m.any():
        out[m] = exact(whole[rows[m]], q, kind)
    return out


def _best(vectors: list[np.ndarray], top: int, kind: str, threshold: float, lexical: Lexical | None, fusion: Fusion | None):
    """The best ``top`` contents of each query in a task's rows: (j, id, _fp, score). Of equal contents the best, of equal scores the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[float, int, object]]] = [[] for _ in vectors]  # (-score, id, fingerprint), in order
        bound = np.full(len(vectors), -np.inf)
        for b in batches:
            ids = b.column("id").to_numpy()
            codes = b.column("_fp").dictionary_encode() if "_fp" in b.schema.names else None
            names = codes.dictionary.to_pylist() if codes is not None else None
            codes = codes.indices.to_numpy() if codes is not None else np.arange(len(b))
            for lo, at, s, error, words, whole, fits in _tiles(b, vectors, kind, lexical):
                rough = fusion(s, words, at) if fusion else s
                slack = error if not fusion else error * np.where(fusion.semantic[at] > 0, fusion.a / np.where(fusion.semantic[at] > 0, fusion.semantic[at], 1), 0) + 1e-12
                possible = (rough >= bound[at] - slack) & (rough > threshold - slack)
                for c in np.flatnonzero(possible.any(0)):
                    j, rows = at[c], np.flatnonzero(possible[:, c])
                    if len(rows) > top:  # those below the top-th content of this tile can't be kept
                        order = rows[np.argsort(-rough[rows, c], kind="stable")]
                        firsts = np.sort(np.unique(codes[lo + order], return_index=True)[1])
                        if len(firsts) > top:
                            least = rough[order[firsts[top - 1]], c] - 2 * (slack if np.isscalar(slack) else slack[c])
                            rows = rows[rough[rows, c] >= least]
                    score = _rescored(whole, fits, vectors[j], rows, kind)
                    if fusion:
                        score = fusion(score, words[rows, c], j)
                    best = {f: (v, i) for v, i, f in held[j]}
                    for r, v in zip(rows.tolist(), score.tolist(), strict=True):
                        if v > threshold:
                            f = names[codes[lo + r]] if names is not None else int(ids[lo + r])
                            new = (-v, int(ids[lo + r]))
                            if f not in best or new < best[f]:
                                best[f] = new
                    held[j] = sorted((v, i, f) for f, (v, i) in best.items())[:top]
                    if len(held[j]) == top:
                        bound[j] = -held[j][-1][0]
        rows = [(j, i, f, -v) for j, own in enumerate(held) for v, i, f in own]
        fp = pa.array([r[2] for r in rows], pa.string()) if rows and isinstance(rows[0][2], str) else pa.array([str(r[2]) for r in rows], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), fp, pa.array([r[3] for r in rows], pa.float64())], names=["j", "id", "_fp", "score"])

    return run


def _maxima(vectors: list[np.ndarray], kind: str, lexical: Lexical):
    """A task's largest semantic and lexical score of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        semantic, words_ = np.full(len(vectors), -np.inf), np.full(len(vectors), -np.inf)
        for b in batches:
            for _, at, s, error, words, whole, fits in _tiles(b, vectors, kind, lexical):
                words_[at] = np.maximum(words_[at], words.max(0))
                for c in np.flatnonzero(s.max(0) >= semantic[at] - error):
                    rows = np.flatnonzero(s[:, c] >= max(s[:, c].max(), semantic[at[c]]) - 2 * error)
                    semantic[at[c]] = max(semantic[at[c]], _rescored(whole, fits, vectors[at[c]], rows, kind).max(initial=-np.inf))
        seen = np.isfinite(words_)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen).astype(np.int32)), pa.array(semantic[seen]), pa.array(words_[seen])], names=["j", "semantic", "lexical"])

    return run


def _block(asked: DataFrame, k: int, blocks: int) -> list:
    rows = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
    return sorted(rows.collect(), key=lambda r: str(r["query_id"]))  # about QUERIES_AT_ONCE


def best_each(rows: DataFrame, queries: DataFrame, top: int, kind: str, threshold: float = -np.inf, *, weights: DataFrame | None = None, avgdl: float = 1.0, alpha: float | None = None, at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query_id, id, score, rank from 0): the best ``top`` contents of each of queries (query_id, vector).

    rows: (id bigint, embedding array<double>[, _fp]); without _fp each row is a content of its
    own. With ``weights`` (query_id, term, w) rows also have (dl, terms, tfs), and scores are
    the fused ones. Vectors of another width than the query's score 0; any number of queries.
    """
    spark = rows.sparkSession
    kind = "euclidean" if kind == "euclidean" else "cosine"
    rows = rows.withColumn("id", F.col("id").cast("bigint")).withColumn("embedding", F.col("embedding").cast("array<double>")).where("embedding is not null")
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    blocks = -(-max(1, asked.count()) // at_once)
    id_kind = queries.schema["query_id"].dataType.simpleString()
    out = []
    for k in range(blocks):
        block = _block(asked, k, blocks)
        vectors = [np.array(r["vector"] or [], float) for r in block]
        names = spark.createDataFrame([(j, r["query_id"]) for j, r in enumerate(block)], f"j int, query_id {id_kind}")
        lexical = fusion = None
        if weights is not None:
            number = {r["query_id"]: j for j, r in enumerate(block)}
            terms: dict[str, list] = {}
            for r in weights.join(F.broadcast(names), "query_id", "left_semi").toLocalIterator():  # the terms of a block of queries
                terms.setdefault(r["term"], []).append((number[r["query_id"]], r["w"]))
            lexical = Lexical({t: (np.array([j for j, _ in x]), np.array([w for _, w in x])) for t, x in terms.items()}, avgdl)
            most = rows.mapInArrow(_maxima(vectors, kind, lexical), "j int, semantic double, lexical double").groupBy("j").agg(F.max("semantic").alias("s"), F.max("lexical").alias("l")).collect()
            semantic, words = np.zeros(len(block)), np.zeros(len(block))
            for r in most:
                semantic[r["j"]], words[r["j"]] = r["s"], r["l"]
            fusion = Fusion(alpha if alpha is not None else 1.0, semantic, words)
        each = rows.mapInArrow(_best(vectors, top, kind, threshold, lexical, fusion), "j int, id bigint, _fp string, score double")
        first = each.groupBy("j", "_fp").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m")).select("j", "m.id", (-F.col("m.s")).alias("score"))
        ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("j").orderBy(F.desc("score"), "id")) - 1).where(F.col("rank") < top)
        met = ranked.join(F.broadcast(names), "j").select("query_id", "id", "score", "rank")
        out.append(met if blocks == 1 else stored(met, "block"))
    return reduce(DataFrame.unionByName, out)


def _task_best(top: int):
    """The best ``top`` contents of a task's rows (id, _fp, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[float, int]] = {}
        bound = -np.inf
        for b in batches:
            score, ids = b.column("score").to_numpy(zero_copy_only=False), b.column("id").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(score >= bound)
            for i, f in zip(at.tolist(), b.column("_fp").take(pa.array(at)).to_pylist(), strict=True):
                new = (-float(score[i]), int(ids[i]))
                if f not in best or new < best[f]:
                    best[f] = new
            if len(best) > top:
                best = dict(sorted(best.items(), key=lambda x: x[1])[:top])
            if len(best) == top:
                bound = -max(best.values())[0]
        yield pa.RecordBatch.from_arrays([pa.array([i for _, i in best.values()], pa.int64()), pa.array(list(best), pa.string()), pa.array([-s for s, _ in best.values()], pa.float64())], names=["id", "_fp", "score"])

    return run


def best_distinct(scored: DataFrame, top: int | None) -> DataFrame:
    """(id, score): of scored (id bigint, _fp, score) the best row of each content, and of these the best ``top``, in order if given.

    No more than ``top`` rows a task are shuffled; without ``top`` a row a content and task.
    """
    slim = scored if top is None else scored.select("id", "_fp", "score").mapInArrow(_task_best(top), "id bigint, _fp string, score double")
    first = slim.groupBy("_fp").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m")).select("m.id", (-F.col("m.s")).alias("score"))
    return first if top is None else first.orderBy(F.desc("score"), "id").limit(top)
