"""Vectors as arrays: usability, cosine similarity in double precision, and a batched form for wide vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def usable(v: Column, dim: int | None = None) -> Column:
    """Finite, not all zero and of the given length."""
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine & (F.size(v) == dim) if dim is not None else fine, F.lit(False))


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def cosine(v: Column, query: Sequence[float]) -> Column:
    """Cosine similarity with a fixed query vector, rounded to 6 digits; null for vectors that can't have one."""
    q = [float(x) for x in query]
    norm = float(np.sqrt(sum(x * x for x in q)))
    if not q or norm == 0 or not np.isfinite(norm):
        raise ValueError("the query vector must be finite, not zero and not empty")
    value = dot(v, literal(q)) / (F.sqrt(dot(v, v)) * F.lit(norm))
    return F.when(usable(v, len(q)), F.round(value, 6))


def cosine_batched(query: Sequence[float]):
    """As cosine, as a matrix product per Arrow batch: for hundreds of dimensions."""
    q = np.asarray(query, np.float64)
    q = q / np.linalg.norm(q)

    @F.pandas_udf("double")
    def f(v: pd.Series) -> pd.Series:
        fits = np.array([x is not None and len(x) == len(q) for x in v], bool)
        out = np.full(len(v), np.nan)
        if fits.any():
            m = np.stack([np.asarray(x, np.float64) for x in v[fits]])
            norms = np.linalg.norm(m, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[fits] = np.where(np.isfinite(norms) & (norms > 0), np.round(m @ q / norms, 6), np.nan)
        return pd.Series(out).astype("Float64").where(np.isfinite(out))

    return f
