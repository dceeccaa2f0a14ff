"""Near-duplicates by one-permutation MinHash with optimal densification.

1. Each text becomes its set of hashed shingles, and one permutation's minima over
   ``bins`` bins; an empty bin borrows from the first filled one in an order of its own.
2. Equal sets are one class. The classes' signatures are cut into bands.
3. In a bucket each class is a candidate of the bucket's centre alone, so a bucket of m
   makes m - 1 pairs. First the centre is the class that shares most buckets with others
   (in a group of copies, their source). Buckets that still hold several components get
   other centres as long as a round at least halves what these hold, so the number of
   rounds is at most logarithmic.
4. What these buckets still hold is finished exactly: all pairs of different components
   that can reach the threshold meet by their rarest shingles (prefix filter).
5. Links are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, unused, written
from .components import components

SHINGLE, PERCENT, BINS, ROWS = 5, 85, 160, 5
#: The exact pass deals the holders of a shingle in blocks of about this size.
BLOCK = 256

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the word shingles: A-Z lower-cased, words between ASCII blanks.

    Fewer words than ``size`` are one shingle; no words, none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    size = min(size, len(words))
    s = np.full(len(h) - size + 1, size, _U)
    for j in range(size):
        s = _mix(s * _U(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j])
    return np.unique(s)


class Signer:
    """Band keys of a shingle set."""

    def __init__(self, bins: int = BINS, rows: int = ROWS):
        if bins % rows:
            raise ValueError("rows must divide bins")
        self.bins, self.rows = bins, rows
        self.edges = np.array([(b << 64) // bins for b in range(bins)], dtype=object).astype(_U)
        rng = np.random.default_rng(20240229)
        self.order = np.array([rng.permutation(bins) for _ in range(bins)], np.int32)
        self.band = _mix(np.arange(1, bins // rows + 1, dtype=_U))

    def minima(self, sh: np.ndarray) -> np.ndarray:
        x = np.sort(_mix(sh ^ _U(0xD6E8FEB86659FD93)))
        at = np.searchsorted(x, self.edges)
        full = np.diff(np.append(at, len(x))) > 0
        out = x[np.minimum(at, len(x) - 1)]
        empty = np.flatnonzero(~full)
        if len(empty):
            order = self.order[empty]
            out[empty] = out[order[np.arange(len(empty)), full[order].argmax(1)]]
        return out

    def bands(self, sh: np.ndarray) -> np.ndarray:
        if not len(sh):
            return np.empty(0, np.int64)
        m = self.minima(sh).reshape(-1, self.rows)
        k = self.band
        for j in range(self.rows):
            k = _mix(k * _U(0x9E3779B97F4A7C15) + m[:, j])
        return k.view(np.int64)


def _digest(sh: np.ndarray) -> bytes | None:
    return hashlib.blake2b(sh.tobytes(), digest_size=16).digest() if len(sh) else None


def _sign(bins: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bins, rows)
        for b in batches:
            sets = (shingles(t.as_py(), size) for t in b.column("text"))
            got = [(len(s), _digest(s), signer.bands(s)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "bands"])

    return run


def _full(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("v"), b.column("digest"), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["v", "digest", "found", "shingles"])

    return run


def link(docs: DataFrame, *, percent: int = PERCENT, shingle: int = SHINGLE, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id (long), n_shingles, component_id, kept, digest (of the shingle set, null if empty).

    Two texts are linked if 100 * shared shingles >= percent * all their shingles. The
    component is named by its smallest doc_id. Texts without words are linked with nothing.
    A row with a null doc_id is linked with nothing and kept, with a null component_id.
    Rows that repeat a doc_id are judged by their own texts; of several texts with a
    component's smallest doc_id one is kept.
    """
    signed = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(_sign(bins, rows, shingle)), "doc_id long, n_shingles long, digest binary, bands array<long>"), "signatures")
    # A vertex is the class of one set, named by its smallest doc_id; by a hash of the set if ids repeat with other texts.
    classes = written(signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.min("n_shingles").alias("n"), F.any_value("bands").alias("bands")), "vertices")
    unique = classes.groupBy("first").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    vertices = classes.withColumn("v", F.col("first") if unique else F.xxhash64("digest"))
    rows_of = vertices.select("v", "n", F.explode("bands").alias("bucket"))
    shared = rows_of.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    members = written(rows_of.join(shared, "bucket"), "buckets")
    wanted = members.select("v").distinct().join(vertices.select("v", "first", "digest"), "v")
    texts = docs.select(F.col("doc_id").cast("long").alias("first"), "text").join(wanted, "first").select("v", "digest", "text")
    sets = texts.mapInArrow(lean(_full(shingle)), "v long, digest binary, found binary, shingles array<long>").where("found = digest").select("v", "shingles")
    sets = written(sets.groupBy("v").agg(F.any_value("shingles").alias("shingles")), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        near = pairs.where(F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent)
        near = near.join(sets.select(F.col("v").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("v").alias("b"), F.col("shingles").alias("sb")), "b")
        near = near.withColumn("both", F.size(F.array_intersect("sa", "sb")))
        return written(near.where(F.col("both") * 100 >= (F.size("sa") + F.size("sb") - F.col("both")) * percent).select("a", "b"), "links")

    def stars(of: DataFrame, rank) -> DataFrame:
        """Each member with its bucket's centre, the one of highest rank: (a, an, b, bn), a once with each b."""
        centre = of.groupBy("bucket").agg(F.max(F.struct(rank, (-F.col("v")).alias("o"), "v", "n", "comp")).alias("m"))
        pairs = of.join(centre.select("bucket", F.col("m.v").alias("b"), F.col("m.n").alias("bn"), F.col("m.comp").alias("bcomp")), "bucket").where("v <> b and comp <> bcomp")
        return pairs.select(F.col("v").alias("a"), F.col("n").alias("an"), "b", "bn").distinct()

    def still_open(comp: DataFrame) -> DataFrame:
        """The members, with their components, of the buckets that hold several of these."""
        state = members.join(comp.select(F.col("u").alias("v"), F.col("v").alias("label")), "v", "left").withColumn("comp", F.coalesce("label", "v"))
        open_ = state.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        return state.join(open_, "bucket")

    def rest(of: DataFrame) -> DataFrame:
        """The pairs of different components of (v, comp) that can reach the threshold: (a, an, b, bn).

        Shingles are ordered from the rarest on; those that one component alone has come first,
        and none of these is shared by a pair. From the place of a pair's first shared shingle
        on, both sets must be as long as the overlap that the threshold asks for. The shorter
        (or equal) one of a pair need be found by fewer shingles than the longer one. The
        holders of a shingle that are all of its commonest component never meet.
        """
        own = of.join(sets, "v").select("v", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
        held = own.groupBy("s").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("s", "c")
        e = own.join(held, "s").groupBy("v", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("e")).withColumn("alone", F.col("n") - F.size("e"))
        most = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1 - F.col("alone")
        first = e.where(most > 0).select("v", "comp", "n", "alone", F.posexplode(F.slice("e", F.lit(1), most)).alias("k", "x"))
        first = written(first.select("v", "comp", "n", F.col("x.s").alias("s"), (F.col("n") - F.col("alone") - F.col("k")).alias("left")), "prefixes")
        counts = first.groupBy("s", "comp").agg(F.count("*").alias("c")).groupBy("s").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("total"), F.count("*").alias("comps")).where("comps > 1")
        counts = written(counts, "shingle-counts")  # as a plain table, so that the join can be split where a shingle is hot
        known = first.join(counts.select("s", F.col("top.comp").alias("top"), "total", (F.col("total") - F.col("top.c")).alias("others")), "s")
        other = F.col("comp") != F.col("top")
        # Side 0 has all holders, side 1 those outside the commonest component; blocks follow from these numbers.
        blocks = F.ceil(F.when(F.col("side") == 0, F.col("total")).otherwise(F.col("others")) / BLOCK).cast("int")
        long = known.withColumn("side", F.explode(F.when(other, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        short = known.where(F.col("left") * (100 + percent) >= F.col("n") * 2 * percent).withColumn("side", F.when(other, 0).otherwise(1))
        a = long.select("s", "side", F.pmod(F.xxhash64("v"), blocks).cast("int").alias("block"), F.col("v").alias("a"), F.col("n").alias("an"), F.col("comp").alias("acomp"), F.col("left").alias("aleft"))
        b = short.select("s", "side", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("v").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bcomp"), F.col("left").alias("bleft"))
        enough = F.least("aleft", "bleft") * (100 + percent) >= (F.col("an") + F.col("bn")) * percent
        longer = (F.col("an") > F.col("bn")) | ((F.col("an") == F.col("bn")) & (F.col("a") > F.col("b")))
        near = F.col("bn") * 100 >= F.col("an") * percent
        on = [a["s"] == b["s"], a["side"] == b["side"], a["block"] == b["block"], F.col("acomp") != F.col("bcomp"), longer, near, enough]
        return a.join(b, on).select("a", "an", "b", "bn").distinct()

    def joined(comp: DataFrame, more: DataFrame) -> DataFrame:
        """The components with more links: the labels so far stand for all links so far."""
        return components(comp.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(more))

    degree = members.groupBy("v").agg(F.sum("c").alias("rank"))
    comp = components(confirm(stars(members.join(degree, "v").withColumn("comp", F.col("v")), F.col("rank"))))
    left = written(still_open(comp), "open")
    n, turn = left.count(), 0
    while n:
        more = confirm(stars(left, F.xxhash64("v", "bucket", F.lit(turn)).alias("rank")))
        comp, turn = joined(comp, more), turn + 1
        left = written(still_open(comp), "open")
        before, n = n, left.count()
        if n * 2 > before:
            break
    if n:
        comp = joined(comp, confirm(rest(left.select("v", "comp").distinct())))
    named = vertices.select("digest", "first", "v").join(comp.select(F.col("u").alias("v"), F.col("v").alias("label")), "v", "left").withColumn("component", F.coalesce("label", "v"))
    if unique:
        out = signed.select("doc_id", "n_shingles", "digest").join(named.select("digest", "component"), "digest", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "digest")
    # Hashed vertices get their component's smallest id; of the sets with that id, the one of least digest is kept.
    least = named.groupBy("component").agg(F.min(F.struct("first", "digest")).alias("m")).select("component", F.col("m.first").alias("component_id"), F.col("m.digest").alias("best"))
    out = signed.join(named.select("digest", "component").join(least, "component"), "digest", "left")
    given = F.col("doc_id").isNotNull()
    kept = ~given | F.col("best").isNull() | ((F.col("doc_id") == F.col("component_id")) & (F.col("digest") == F.col("best")))
    return out.select("doc_id", "n_shingles", F.when(given, F.coalesce("component_id", "doc_id")).alias("component_id"), kept.alias("kept"), "digest")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component, the one with its smallest doc_id, and its other columns as they are.

    Rows that are equal in doc_id and shingles are one. Rows without words or without
    doc_id all stay.
    """
    linked = written(link(docs, **how).where("n_shingles > 0 and doc_id is not null").select("doc_id", "kept", "digest"), "near-duplicates")
    id_, set_, own_set = unused(docs, "_id", "_digest", "_d")
    gone = linked.where("not kept").select(F.col("doc_id").alias(id_), F.col("digest").alias(set_)).distinct()
    again = linked.where("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias(id_)).distinct()
    ids = linked.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1")
    same_id = F.col("doc_id").cast("long") == F.col(id_)
    if ids.isEmpty():  # every id has one row
        return docs.join(gone.select(id_), same_id, "left_anti")
    size = how.get("shingle", SHINGLE)

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _digest(shingles(t, size)))

    own = docs.withColumn(own_set, digest("text"))
    own = own.join(gone, same_id & (F.col(own_set) == F.col(set_)), "left_anti")
    several = same_id & F.col(own_set).isNotNull()
    repeated, single = own.join(again, several, "left_semi"), own.join(again, several, "left_anti")
    return single.unionByName(repeated.dropDuplicates(["doc_id", own_set])).drop(own_set)
