"""Centroid clustering with Elkan's bounds, exact in whole numbers.

Each vector carries an upper bound of the distance to its centroid and a lower bound for
each of the k centroids. After a round the bounds move by as much as the centroids
did, and a distance is only computed where neither they nor the distances between
centroids rule a centroid out. Bounds are rounded away from the truth, and only a bound that
is strictly beyond rules out, so that ties reach the exact comparison: squared distances of
whole numbers. The state is a written table a round; only sums of clusters come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, lean, unused, written_at

CLUSTERS, ROUNDS, DIM, SCALE = 40, 5, 64, 256
#: Whole components beyond this have squared distances beyond 64 bits.
LARGEST = 1 << 27


def usable(vector: Column, dim: int = DIM) -> Column:
    """Just ``dim`` components, none null, NaN or infinite; false for null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False))


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("bigint"))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.nextafter(x, -np.inf), -np.inf), 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (the smaller number of equal ones) and its exact squared distance; ``upper`` and ``lower`` are sharpened in place. Third: how many distances were computed.

    between: lower bounds of the distances between centroids.
    """
    k, n = len(centroids), 0
    half = between / 2
    others = np.where(np.eye(k, dtype=bool), np.inf, half)
    nearest = others.min(1) if k > 1 else np.full(k, np.inf)
    a, best = a.copy(), np.full(len(x), -1, np.int64)
    # Strictly nearer than half the way to any other centroid, or than each bound: no other can be as near.
    open_ = np.flatnonzero((upper >= nearest[a]) & (upper[:, None] >= np.where(np.arange(k) == a[:, None], np.inf, lower)).any(1))
    best[open_] = squared(x[open_], centroids[a[open_]])
    n += len(open_)
    root = np.sqrt(best[open_].astype(float))
    upper[open_], lower[open_, a[open_]] = _up(root), _down(root)
    for j in range(k):
        m = open_[(a[open_] != j) & (upper[open_] >= lower[open_, j]) & (upper[open_] >= half[a[open_], j])]
        if not len(m):
            continue
        d = squared(x[m], centroids[j])
        n += len(m)
        root = np.sqrt(d.astype(float))
        lower[m, j] = _down(root)
        won = (d < best[m]) | ((d == best[m]) & (j < a[m]))
        w = m[won]
        a[w], best[w], upper[w] = j, d[won], _up(root[won])
    return a, best, n


def _numbers(column: pa.Array, width: int, kind: str) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width).astype(kind)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel(), kind))


def _step(centroids: np.ndarray, moved: np.ndarray | None, keep: list[str], final: bool):
    """A round over batches of state. moved: how far each centroid went since the bounds were made; None makes them anew."""
    k = len(centroids)
    between = _down(np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(2).astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _numbers(b.column("q"), centroids.shape[1], "i8")
            if moved is None:
                a, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), k))
            else:
                a = b.column("cluster").to_numpy().astype(np.int64)
                upper = _up(b.column("upper").to_numpy() + moved[a])
                lower = _down(_numbers(b.column("lower"), k, "f8") - moved)
            a, best, _ = assign(x, a, upper, lower, centroids, between)
            own, names = [b.column(n) for n in keep], [*keep]
            if final:
                lost = best < 0
                best[lost] = squared(x[lost], centroids[a[lost]])
                own += [pa.array(a.astype(np.int32)), pa.array(best)]
                names += ["cluster", "distance"]
            else:
                low = lower.astype(np.float32)
                low = np.maximum(np.where(low > lower, np.nextafter(low, np.float32(-np.inf)), low), 0)
                own += [b.column("q"), pa.array(a.astype(np.int32)), pa.array(upper), _lists(low, pa.float32())]
                names += ["q", "cluster", "upper", "lower"]
            yield pa.RecordBatch.from_arrays(own, names=names)

    return run


def _sums(k: int, dim: int):
    """A task's sums: (cluster, n, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for b in batches:
            a, x = b.column("cluster").to_numpy(), _numbers(b.column("q"), dim, "i8")
            order = np.argsort(a, kind="stable")
            own, at, size = np.unique(a[order], return_index=True, return_counts=True)
            if len(own):
                n[own] += size
                total[own] += np.add.reduceat(x[order], at, axis=0).astype(object)  # whole numbers of any size
        some = np.flatnonzero(n)
        rows = [(int(j), int(n[j]), [str(v) for v in total[j]]) for j in some]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["cluster", "n", "sums"])

    return run


def centroid_means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters of state (cluster, q); an empty one keeps its centroid. k times dim sums come to the driver."""
    k, dim = centroids.shape
    parts = state.select("cluster", "q").mapInArrow(lean(_sums(k, dim)), "cluster int, n long, sums array<string>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x"))
    out = centroids.copy()
    for r in each.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        out[r["cluster"], r["i"]] = int(r["x"]) // r["n"]
    return out


def kmeans(rows: DataFrame, id: str, vector: str, *, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(rows' id with cluster int, distance long) and the final centroids, for the rows with a usable() vector.

    Components are floor(scale * x). Centroids start as the k vectors with the smallest
    sha256 of ``seed:id``, in that order (equal ids by their components, null ids last; fewer
    vectors than k are as many centroids), and move ``rounds`` times to the floored mean of
    their vectors; equal distances go to the smaller number. Repeated rows count as often as they
    occur. A component beyond LARGEST is an error, since its squared distance is no long.
    No usable vector: no row and no centroid. Other columns are not read.
    """
    spark = rows.sparkSession
    q = whole(F.col(vector), scale)
    own = rows.where(usable(F.col(vector), dim)).select(F.col(id).alias("id"), q.alias("q"))
    own = own.withColumn("q", F.when(F.exists("q", lambda x: F.abs(x) > LARGEST), F.raise_error(F.lit("a component is too large for 64-bit distances"))).otherwise(F.col("q")))
    first = own.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "q").limit(k).collect()  # at most k rows
    kind = own.schema["id"].dataType.simpleString()
    if not first:
        return own.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).withColumnRenamed("id", id), np.zeros((0, dim), np.int64)
    centroids = np.array([r["q"] for r in first], np.int64)
    schema = f"id {kind}, q array<bigint>, cluster int, upper double, lower array<float>"
    state, moved, path = own, None, None
    for r in range(rounds):
        before = path
        state, path = written_at(state.mapInArrow(lean(_step(centroids, moved, ["id"], False)), schema), f"elkan-{r}")
        if before:
            drop_path(spark, before)  # the new state is whole
        now = centroid_means(state, centroids)
        moved, centroids = _up(np.sqrt(((now - centroids) ** 2).sum(1).astype(float))), now
    done, last = written_at(state.mapInArrow(lean(_step(centroids, moved, ["id"], True)), f"id {kind}, cluster int, distance bigint"), "elkan-assigned")
    if path:
        drop_path(spark, path)
    return done.withColumnRenamed("id", id), centroids


def cluster(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", **how) -> DataFrame:
    """Per usable vector: its id, cluster, distance, cluster_inertia, inertia, centroid_sha256. See kmeans()."""
    done, centroids = kmeans(rows, id, vector, **how)
    spark = rows.sparkSession
    sums = {r["cluster"]: r["d"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a cluster
    table = spark.createDataFrame([(c, d, sum(sums.values()), ",".join(map(str, centroids[c]))) for c, d in sums.items()], "c int, cluster_inertia long, inertia long, text string")
    c, *_ = unused(done, "c")
    table = table.select(F.col("c").alias(c), "cluster_inertia", "inertia", F.sha2("text", 256).alias("centroid_sha256"))
    return done.join(F.broadcast(table), F.col("cluster") == F.col(c)).drop(c)  # at most k rows
