"""Vector similarity. Null, empty and unequal vectors have similarity 0."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Metric = Callable[[Column, Column], Column]


def _sound(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))


def _double(a: Column) -> Column:
    return a.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Clamped to [-1, 1]; a zero vector has 0. Norms that are stored can be given."""
    na = norm(a) if norm_a is None else norm_a
    nb = norm(b) if norm_b is None else norm_b
    scaled = F.when((na > 0) & (nb > 0), F.least(F.greatest(dot(a, b) / (na * nb), F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)
    return F.when(_sound(a, b), scaled).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    """1 / (1 + distance)."""
    square = _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))
    return F.when(_sound(a, b), 1 / (1 + F.sqrt(square))).otherwise(0.0)


METRICS: dict[str, Metric] = {"cosine": cosine, "euclidean": euclidean}


def metric(name: object = "cosine") -> Metric:
    """The metric of this name; cosine for an unknown one."""
    return METRICS.get(str(name), cosine)


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]) if len(vector) else F.array().cast("array<double>")


def fast_cosine(vector: list[float]) -> Callable[[Column], Column]:
    """Cosine against one vector as an Arrow UDF, a matrix product a batch; the same values as cosine()."""
    q = np.asarray(vector, float)
    size = float(np.sqrt((q * q).sum()))

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors))
        ok = np.array([v is not None and len(v) == len(q) and len(q) > 0 for v in vectors], bool)
        if ok.any() and size > 0:
            m = np.stack([np.asarray(v, float) for v in vectors[ok]])
            norms = np.sqrt((m * m).sum(1))
            out[ok] = np.clip(np.divide(m @ q, norms * size, out=np.zeros(len(m)), where=norms > 0), -1, 1)
        return pd.Series(np.nan_to_num(out))

    return score
