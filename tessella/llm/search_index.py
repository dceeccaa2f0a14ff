"""Exact ranked search over a clustered index.

Building. A bounded sample of documents is ordered by recursive graph bisection: each node of a
binary tree halves its documents so that the gaps between documents that share a term get
short. The tree keeps what the halves' terms say, so every document of the table goes down by
the same gains to a leaf, and leaves (cut by row number where they are large) are the shards:
documents with shared terms stand together. A shard holds postings (place, impact), the largest
impact of each term, and its places' doc_ids.

Searching. A shard's bound for an item is the sum of its terms' weights times largest
impacts. Each item visits its shards from the largest bound on, in waves that grow fourfold, and
stops when no shard ahead can reach its worst kept score; one that can equal it is visited, since a
smaller doc_id may be there. Nothing is approximate.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_path, lean, written, written_at

#: The sample: distinct documents (expected number), terms of each (by least hash), terms in all (the most frequent).
SAMPLE_DOCS, SAMPLE_TERMS, VOCABULARY = 4_000, 400, 20_000
#: The tree: levels at most, sampled documents a leaf at least, rounds of swaps a node.
LEVELS, LEAF_DOCS, SWAPS = 6, 24, 10
#: Documents and postings of a shard at most (about), and documents at least where there are few.
SHARD_DOCS, SHARD_POSTINGS, FEWEST_DOCS = 4_096, 2_000_000, 512
TOP, FIRST_WAVE, QUERY_BLOCK = 10, 4, 1_024
#: More distinct terms of items meet the index by a shuffle and not by a broadcast.
BROADCAST_TERMS = 200_000

#: Bytes: A-Z in lower case; all else below 0x80 but digits and letters becomes a space.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return (text or b"").translate(_TERM).split()


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [sorted(set(terms_of(t)), key=xxhash.xxh3_64_intdigest)[:SAMPLE_TERMS] for t in _binary(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([b" ".join(x) for x in own], pa.binary())], names=["h", "terms"])


def sample(docs: DataFrame, most: int = SAMPLE_DOCS) -> list[list[bytes]]:
    """The terms of about ``most`` distinct texts, chosen by a hash of the text."""
    n = docs.count()
    if not n:
        return []
    share = min(1.0, most / n)
    chosen = docs.select(F.xxhash64("text", F.lit(13)).alias("h"), "text").where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    got = chosen.mapInArrow(lean(_sketch), "h long, terms binary").dropDuplicates(["h"]).limit(2 * most).collect()
    return [t for t in (r["terms"].split() for r in sorted(got, key=lambda r: r["h"])) if t]


@dataclass
class Tree:
    """vocabulary: term to number; weights: (node, term), for the left; cuts: a document goes left if its sum is larger."""

    vocabulary: dict[bytes, int]
    weights: np.ndarray
    cuts: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.cuts) + 1

    def leaf(self, terms) -> int:
        own, node = [n for t in terms if (n := self.vocabulary.get(t)) is not None], 0
        while node < len(self.cuts):
            node = 2 * node + (1 if self.weights[node, own].sum() > self.cuts[node] else 2)
        return node - len(self.cuts)


def _cost(d: np.ndarray, n: int) -> np.ndarray:
    """Bits for the gaps of a term with d of n documents."""
    return d * np.log2(max(n, 1) / (d + 1))


def _halves(docs: np.ndarray, lengths: np.ndarray, terms: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of terms in two halves of these documents, after rounds of swaps as long as swaps gain."""
    flat, starts = np.concatenate([terms[d] for d in docs]), np.cumsum(lengths[docs]) - lengths[docs]
    left = np.arange(len(docs)) < len(docs) // 2
    n, m = int(left.sum()), int((~left).sum())

    def degrees():
        on = np.repeat(left, lengths[docs])
        return np.bincount(flat[on], minlength=size).astype(float), np.bincount(flat[~on], minlength=size).astype(float)

    for _ in range(SWAPS):
        a, b = degrees()
        from_left = np.where(a > 0, _cost(a, n) + _cost(b, m) - _cost(np.maximum(a - 1, 0), n) - _cost(b + 1, m), 0)
        from_right = np.where(b > 0, _cost(b, m) + _cost(a, n) - _cost(np.maximum(b - 1, 0), m) - _cost(a + 1, n), 0)
        gain = np.where(left, np.add.reduceat(from_left[flat], starts), np.add.reduceat(from_right[flat], starts))
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        l, r = l[np.argsort(-gain[l], kind="stable")], r[np.argsort(-gain[r], kind="stable")]
        k = min(len(l), len(r))
        swap = int((gain[l[:k]] + gain[r[:k]] > 0).sum())  # gains fall on both sides, so these are the first
        if not swap:
            break
        left[l[:swap]], left[r[:swap]] = False, True
    return degrees()


def bisect(texts: list[list[bytes]], levels: int = LEVELS) -> Tree:
    """The tree of a sample of documents (lists of distinct terms)."""
    df = Counter(t for x in texts for t in x)
    vocabulary = {t: i for i, (t, _) in enumerate(sorted(((t, c) for t, c in df.items() if c > 1), key=lambda x: (-x[1], x[0]))[:VOCABULARY])}
    terms = [np.array(sorted(vocabulary[t] for t in x if t in vocabulary), np.int64) for x in texts]
    terms = [t for t in terms if len(t)]
    lengths = np.array([len(t) for t in terms], np.int64)
    depth = max(0, min(levels, int(math.log2(max(1, len(terms) / LEAF_DOCS)))))
    nodes = 2**depth - 1
    weights, cuts = np.zeros((nodes, max(1, len(vocabulary))), np.float32), np.zeros(nodes, np.float32)
    at = {0: np.arange(len(terms))}
    for node in range(nodes):
        docs = at.pop(node)
        if len(docs) < 2:
            at[2 * node + 1], at[2 * node + 2] = docs[:0], docs
            cuts[node] = np.inf
            continue
        a, b = _halves(docs, lengths, terms, len(vocabulary))
        n, m = len(docs) // 2, len(docs) - len(docs) // 2
        # What a document with the term adds to the right half, less what it adds to the left.
        weights[node] = np.where(a + b > 0, _cost(b + 1, m) - _cost(b, m) - _cost(a + 1, n) + _cost(a, n), 0)
        score = np.array([weights[node, terms[d]].sum() for d in docs])
        cuts[node] = np.median(score)
        at[2 * node + 1], at[2 * node + 2] = docs[score > cuts[node]], docs[score <= cuts[node]]
    return Tree(vocabulary, weights, cuts)


def _forward(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            leaf, keep, n, terms, tf = [], [], [], [], []
            for i, text in enumerate(_binary(b.column("text"))):
                c = Counter(terms_of(text))
                if c:
                    keep.append(i)
                    leaf.append(tree.leaf(c))
                    n.append(sum(c.values()))
                    terms.append(b" ".join(c))
                    tf.append(np.fromiter(c.values(), "<i4", len(c)).tobytes())
            rows = pa.array(np.arange(row, row + len(keep)))
            row += len(keep)
            yield pa.RecordBatch.from_arrays([rows, pa.array(leaf, pa.int32()), b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], names=["row", "leaf", "doc_id", "n", "terms", "tf"])

    return run


def _sliced(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Parts of an array of int32, as bytes."""
    data = np.ascontiguousarray(data, "<i4")
    offsets = np.append(starts, len(data)).astype(np.int64) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _invert(n_docs: int, n_terms: int, kind: pa.DataType):
    """A shard's documents to its postings, a row a term, and a row (without term) with its doc_ids."""

    def run(docs: pa.Table) -> pa.Table:
        words: dict[bytes, int] = {}
        numbers, size = [], np.zeros(len(docs), np.int64)
        for k, t in enumerate(docs.column("terms")):
            own = t.as_py().split(b" ")
            numbers += [words.setdefault(w, len(words)) for w in own]
            size[k] = len(own)
        names = sorted(words)
        rank = np.empty(len(words), np.int64)
        rank[[words[w] for w in names]] = np.arange(len(names))
        number, place = rank[numbers], np.repeat(np.arange(len(docs)), size)
        tf = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in docs.column("tf")]).astype(np.int64)
        m = np.array([100 - 90 + 90 * n * n_docs // n_terms for n in docs.column("n").to_pylist()], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[place])
        order = np.argsort(number, kind="stable")
        starts = np.searchsorted(number[order], np.arange(len(names)))
        k, shard = len(names), docs.column("shard")[0].as_py()
        ids = docs.column("doc_id").combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        postings = pa.table({
            "shard": pa.array([shard] * k, pa.int32()), "term": pa.array(names, pa.binary()).cast(pa.string()), "df": pa.array(np.diff(np.append(starts, len(number)))), "top": pa.array(np.maximum.reduceat(impact[order], starts)),
            "places": _sliced(place[order], starts), "impacts": _sliced(impact[order], starts), "ids": pa.nulls(k, pa.list_(kind))})
        own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(kind))
        none = lambda t: pa.nulls(1, t)
        return pa.concat_tables([postings, pa.table({"shard": pa.array([shard], pa.int32()), "term": none(pa.string()), "df": none(pa.int64()), "top": none(pa.int64()), "places": none(pa.binary()), "impacts": none(pa.binary()), "ids": own.cast(pa.list_(kind))})])

    return run


@dataclass
class Index:
    """rows (shard, term, df, top, places, impacts, ids); n_docs documents with terms, n_terms of them."""

    rows: DataFrame
    n_docs: int
    n_terms: int
    id_kind: str


def build(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, levels: int = LEVELS, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS, fewest: int = FEWEST_DOCS) -> Index:
    """The index of docs (doc_id, text): every row with a term, whole texts.

    Repeated rows and null ids are rows like any other; other columns are not read. The tree is
    fitted on the sample; leaves of copies or of like documents are cut into shards of bounded size.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, field = docs.sparkSession, docs.schema["doc_id"]
    kind = field.dataType.simpleString()
    docs = docs.select("doc_id", "text")
    tree = bisect(sample(docs, sample_docs), levels)
    forward, path = written_at(docs.mapInArrow(lean(_forward(tree)), f"row long, leaf int, doc_id {kind}, n long, terms binary, tf binary"), "search-forward")
    leaves = {r["leaf"]: r for r in forward.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum(F.octet_length("tf") / 4).alias("postings")).collect()}  # a row a leaf
    n_docs, n_terms = sum(r["docs"] for r in leaves.values()), sum(r["n"] for r in leaves.values())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(shard_docs, max(fewest, math.ceil(n_docs / (2 * tasks)))))
    parts = [max(1, math.ceil(leaves[k]["docs"] / most), math.ceil(leaves[k]["postings"] / shard_postings)) if k in leaves else 1 for k in range(tree.leaves)]
    first = np.cumsum([0, *parts[:-1]]).tolist()
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("leaf") + 1)
    shard = (of(first) + F.pmod(F.col("row"), of(parts))).cast("int")
    schema = f"shard int, term string, df long, top long, places binary, impacts binary, ids array<{kind}>"
    rows = forward.select(shard.alias("shard"), "doc_id", "n", "terms", "tf").groupBy("shard").applyInArrow(_invert(n_docs, n_terms, to_arrow_type(field.dataType)), schema)
    rows = written(rows, "search-index")
    drop_path(spark, path)
    return Index(rows, n_docs, n_terms, kind)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    for b in batches:
        own = [sorted(set(terms_of(t))) for t in _binary(b.column("text"))]
        size = [len(x) for x in own]
        at = pa.array(np.repeat(np.arange(len(own)), size))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(row, row + len(own)), size)), b.column("item_id").take(at), pa.array([t for x in own for t in x], pa.binary()).cast(pa.string())], names=["q", "item_id", "term"])
        row += len(own)


def _score(top: int, kind: pa.DataType):
    """A shard's postings met with items (q, terms with weights): the best documents of each."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        postings, ids = {}, []
        for term, places, impacts, own in zip(index.column("term"), index.column("places"), index.column("impacts"), index.column("ids"), strict=True):
            if term.is_valid:
                postings[term.as_py()] = np.frombuffer(places.as_py(), "<i4"), np.frombuffer(impacts.as_py(), "<i4").astype(np.int64)
            else:
                ids = own.as_py()
        total, rows = np.zeros(len(ids), np.int64), []
        for q, terms in zip(asked.column("q").to_pylist(), asked.column("terms").to_pylist(), strict=True):
            total[:] = 0
            for t in terms:
                if t["term"] in postings:
                    places, impacts = postings[t["term"]]
                    total[places] += t["w"] * impacts
            hit = np.flatnonzero(total)
            if len(hit) > top:
                hit = hit[total[hit] >= np.partition(total[hit], len(hit) - top)[len(hit) - top]]
            best = sorted((-int(total[p]), ids[p] is None, 0 if ids[p] is None else ids[p]) for p in hit.tolist())[:top]
            rows += [(q, None if none else i, -s) for s, none, i in best]
        return pa.table({"q": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], kind), "score": pa.array([r[2] for r in rows], pa.int64())})

    return run


def search(index: Index, items: DataFrame, *, top: int = TOP, first_wave: int = FIRST_WAVE, visits: list[int] | None = None) -> DataFrame:
    """(item_id, rank from 1, doc_id, score): the ``top`` documents of each row of items (item_id, text) with a score above 0.

    Equal scores come by ascending doc_id, null last; a document whose row is repeated has as
    many places. Repeated items and null ids are rows like any other; an item without a term
    that documents hold has no row. ``visits`` gets the visited (item, shard) pairs of each wave and,
    last, the number of those with a bound above 0.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = items.sparkSession
    item_kind = items.schema["item_id"].dataType.simpleString()
    doc_kind = to_arrow_type(index.rows.schema["ids"].dataType.elementType)
    terms = written(items.select("item_id", "text").mapInArrow(lean(_item_terms), f"q long, item_id {item_kind}, term string"), "search-terms")
    distinct = terms.select("term").distinct()
    few = distinct.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    known = F.broadcast(distinct) if few else distinct
    stats = written(index.rows.where("term is not null").select("shard", "term", "df", "top").join(known, "term"), "search-stats")
    ratio = F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)
    weights = stats.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(1000 * F.log(ratio)).alias("w"))
    weighed = written(terms.join(weights, "term").select("q", "term", "w"), "search-weights")
    asked = weighed.groupBy("q").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    bounds = stats.join(weighed, "term").groupBy("q", "shard").agg(F.sum(F.col("w") * F.col("top")).alias("bound")).where("bound > 0")
    bounds = written(bounds.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("bound"), "shard"))), "search-bounds")
    most = bounds.agg(F.max("place")).first()[0] or 0
    blocks = math.ceil(max(1, terms.select("q").distinct().count()) / QUERY_BLOCK)
    order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best, lo, hi = spark.createDataFrame([], f"q long, doc_id {index.id_kind}, score long"), 0, first_wave
    postings = written(index.rows.where("term is not null").join(known, "term", "left_semi").unionByName(index.rows.where("term is null")), "search-postings") if most else None
    while lo < most:
        worst = best.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") == top)
        todo = bounds.where((F.col("place") > lo) & (F.col("place") <= hi)).join(worst, "q", "left").where(F.col("worst").isNull() | (F.col("bound") >= F.col("worst")))
        todo = written(todo.select("q", "shard", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")), "search-wave")
        n = todo.count()
        if visits is not None:
            visits.append(n)
        if not n:
            break  # bounds fall, so no later shard can do more
        wanted = todo.select(F.col("shard").alias("_shard"), F.col("block").alias("_block")).distinct()
        left = postings.join(wanted, F.col("shard") == F.col("_shard")).drop("shard")
        right = todo.join(asked, "q").select("shard", "block", "q", "terms")
        found = left.groupBy("_shard", "_block").cogroup(right.groupBy("shard", "block")).applyInArrow(_score(top, doc_kind), f"q long, doc_id {index.id_kind}, score long")
        best = best.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        best = written(best.drop("rank"), "search-best")
        lo, hi = hi, 4 * hi
    if visits is not None:
        visits.append(bounds.count())
    owners = terms.select("q", "item_id").distinct()
    return best.withColumn("rank", F.row_number().over(order)).join(owners, "q").select("item_id", "rank", "doc_id", "score")
