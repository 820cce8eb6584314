"""Exact vector search, and the byte form of a stored vector."""

from __future__ import annotations

import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydex import functions as fn

# The header of a stored vector.
_HEADER = struct.Struct("<4sBI")
_NAME, _VERSION = b"ICEV", 1


def search(vectors: DataFrame, query: list[float], k: int, metric: str) -> DataFrame:
    """(doc_num, score): the k best documents of (doc_num, vector), each by its best vector; ties by doc_num.

    Filter ``vectors`` first to accept only some documents; the others aren't checked.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    scored = vectors.select("doc_num", fn.score(F.col("vector"), query, metric).alias("score"))
    return scored.groupBy("doc_num").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "doc_num").limit(k)


def encode(vector: list[float]) -> bytes:
    """The byte form: a header (name, version, size) and little-endian float32 values."""
    if not vector or not all(math.isfinite(x) for x in vector):
        raise ValueError("vector must be finite and not empty")
    return _HEADER.pack(_NAME, _VERSION, len(vector)) + struct.pack(f"<{len(vector)}f", *vector)


def decode(data: bytes) -> list[float]:
    if len(data) < _HEADER.size:
        raise ValueError("vector is too short")
    name, version, n = _HEADER.unpack_from(data)
    if name != _NAME or version != _VERSION or not n or len(data) != _HEADER.size + 4 * n:
        raise ValueError("not a vector")
    out = list(struct.unpack_from(f"<{n}f", data, _HEADER.size))
    if not all(map(math.isfinite, out)):
        raise ValueError("vector must be finite")
    return out
