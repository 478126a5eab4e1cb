"""Embedding backends.  A backend turns texts into vectors of one length; an empty vector means none."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Backend(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashingBackend:
    """Deterministic local vectors: signed feature hashing of words, scaled to unit length."""

    dim: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        for word in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            v[h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(v)
        return (v / norm).astype(np.float32).tolist() if norm else []


@dataclass(frozen=True)
class ConstantBackend:
    """The same vector for any text; for tests."""

    dim: int = 64
    value: float = 0.1

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[self.value] * self.dim for _ in texts]


def embed_column(df: DataFrame, text_col: str, backend: Backend, batch: int = 64, out: str = "embedding") -> DataFrame:
    """df with the vectors of a text column, null where the backend gives none; batch 0 sends all of a batch at once.

    A vector of a wrong length raises an error.  Backends go to the executors, so they must be picklable.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            vectors: list[list[float] | None] = []
            step = batch or max(1, len(texts))
            for k in range(0, len(texts), step):
                part = texts[k : k + step]
                made = backend.embed([t or "" for t in part])
                if len(made) != len(part):
                    raise ValueError(f"{len(made)} vectors for {len(part)} texts")
                for v in made:
                    if v and len(v) != backend.dim:
                        raise ValueError(f"a vector of {len(v)} where {backend.dim} are stored")
                    vectors.append(v or None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*b.schema.names, out])

    return df.mapInArrow(run, schema)
