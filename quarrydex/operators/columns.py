"""Typed columns: ranges, blocks, the index gate, time bounds. Input: rows with segment_id, doc_num, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydex.model import BLOCK_DOCS


def numeric_range(values: DataFrame, lo: int, hi: int) -> DataFrame:
    """(segment_id, doc_num) of documents with any value from lo to hi, both included."""
    return values.where(F.col("value").between(lo, hi)).select("segment_id", "doc_num").distinct()


def numeric_blocks(values: DataFrame) -> DataFrame:
    """(segment_id, block, n, min_value, max_value, dense) of each 1024 documents."""
    out = values.groupBy("segment_id", F.floor(F.col("doc_num") / BLOCK_DOCS).alias("block"))
    out = out.agg(F.count("*").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.countDistinct("doc_num").alias("d"))
    return out.select("segment_id", "block", "n", "min_value", "max_value", ((F.col("n") == BLOCK_DOCS) & (F.col("d") == BLOCK_DOCS)).alias("dense"))


def same_documents(column: DataFrame, indexed: DataFrame) -> DataFrame:
    """(supported): true if the column's documents are just the indexed ones, else a range can't be answered from it."""
    left, right = column.select("doc_id").distinct(), indexed.select("doc_id").distinct()
    odd = left.join(right, "doc_id", "left_anti").unionByName(right.join(left, "doc_id", "left_anti"))
    return odd.agg((F.count("*") == 0).alias("supported"))


def time_bounds(rows: DataFrame) -> DataFrame:
    """(segment_id, num_docs, time_min, time_max); both zero if a document's time (ts) is unknown (null or 0)."""
    unknown = F.count_if(F.col("ts").isNull() | (F.col("ts") == 0)) > 0
    return rows.groupBy("segment_id").agg(F.count("*").alias("num_docs"), F.when(unknown, 0).otherwise(F.min("ts")).alias("time_min"), F.when(unknown, 0).otherwise(F.max("ts")).alias("time_max"))


def overlapping(meta: DataFrame, lo: int, hi: int) -> DataFrame:
    """Segments that may hold times from lo to hi; those of unknown bounds stay."""
    return meta.where(((F.col("time_min") == 0) & (F.col("time_max") == 0)) | ((F.col("time_min") <= hi) & (F.col("time_max") >= lo)))
