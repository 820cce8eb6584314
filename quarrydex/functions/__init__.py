"""Column functions: prefix-coded integers, norms, block numbers, vector scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(length: Column) -> Column:
    """The float32 norm of a field length."""
    return (F.lit(1.0) / F.sqrt(length)).cast("float")


def prefix_coded(value: Column) -> Column:
    """A 64-bit integer as hex text of a byte 0x20 and ten 7-bit bytes, sign flipped: text order is numeric order."""
    flipped = value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))
    parts = [F.lpad(F.hex(F.shiftrightunsigned(flipped, 7 * i).bitwiseAND(F.lit(127))), 2, "0") for i in range(9, -1, -1)]
    return F.concat(F.lit("20"), *parts)


def prefix_decoded(text: Column) -> Column:
    """The integer of a prefix-coded hex text."""
    out = F.lit(0).cast("bigint")
    for i in range(10):
        byte = F.conv(F.substring(text, 3 + 2 * i, 2), 16, 10).cast("bigint")
        out = out.bitwiseOR(F.shiftleft(byte, 7 * (9 - i)))
    return out.bitwiseXOR(F.lit(-(1 << 63)))


def chunk_size(num_docs: Column, card: Column) -> Column:
    """Documents in a postings block of a term with ``card`` postings."""
    return F.call_function("div", num_docs, F.call_function("div", card, F.lit(1024)) + 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def score(vector: Column, query: list[float], metric: str) -> Column:
    """Cosine (clamped to [-1, 1]), dot product or negative squared distance, in float64.

    A wrong size, NaN or infinity, and for cosine a zero vector, fail the query from
    within the expression, so that no optimisation drops the check.
    """
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    if not query or any(x != x or abs(x) == float("inf") for x in query):
        raise ValueError("query vector must be finite and not empty")
    if metric == "cosine" and not any(query):
        raise ValueError("query vector must not be zero for cosine")
    q, v = F.array(*[F.lit(float(x)) for x in query]), _doubles(vector)
    dot = _sum(F.zip_with(v, q, lambda a, b: a * b))
    if metric == "dot":
        value = dot
    elif metric == "l2":
        value = -_sum(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)))
    else:
        length = F.sqrt(_sum(F.transform(v, lambda a: a * a)))
        size = sum(float(x) ** 2 for x in query) ** 0.5
        value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (length * F.lit(size))))
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) | F.exists(v, lambda x: x.isNull())
    if metric == "cosine":
        bad = bad | ~F.exists(v, lambda x: x != 0)
    return F.when(F.size(v) != len(query), F.raise_error(F.lit("vector dimension differs from the query's"))).when(bad, F.raise_error(F.lit("invalid vector"))).otherwise(value)
