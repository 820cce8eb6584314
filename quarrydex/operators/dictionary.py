"""Term dictionary: scans, ranges, patterns, lookups. Input: postings (doc_id, segment_id, term, freq, ...)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(lo: str | None = None, hi: str | None = None) -> Column:
    """lo <= term < hi, bytewise; None is unbounded."""
    out = F.lit(True)
    if lo is not None:
        out = out & (F.col("term") >= lo)
    if hi is not None:
        out = out & (F.col("term") < hi)
    return out


def successor(prefix: str) -> str | None:
    """The least text above every text that starts with the prefix; None if there is none."""
    while prefix:
        code = ord(prefix[-1]) + 1
        if 0xD800 <= code < 0xE000:
            code = 0xE000
        if code <= 0x10FFFF:
            return prefix[:-1] + chr(code)
        prefix = prefix[:-1]
    return None


def with_prefix(prefix: str) -> Column:
    """A prefix as the range that Parquet statistics can prune by."""
    return in_range(prefix, successor(prefix))


def literal_prefix(pattern: str) -> str:
    """The literal text that every match of a pattern starts with; none for a pattern with an alternative outside of groups."""
    depth, k = 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            if pattern[k + 1 : k + 2] == "Q":  # quoted text, up to its end
                k = (pattern + "\\E").find("\\E", k)
            k += 1
        elif c == "[":
            k = _class_end(pattern, k)
        elif c == "|" and not depth:
            return ""
        depth += (c == "(") - (c == ")")
        k += 1
    lead = re.match(r"[\w ]*", pattern, re.ASCII)[0]
    return lead[:-1] if pattern[len(lead) : len(lead) + 1] in ("?", "*", "{", "+") else lead


def _class_end(pattern: str, k: int) -> int:
    """The place of the bracket that ends the class which begins at k; classes may be nested."""
    depth = 0
    first = True
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif c == "[":
            depth += 1
            first = True
            k += pattern[k + 1 : k + 2] == "^"
            k += 1
            continue
        elif c == "]" and not first:
            depth -= 1
            if not depth:
                return k
        first = False
        k += 1
    return k


def matching(pattern: str) -> Column:
    """A pattern over the whole term, with the range of its literal prefix beside it."""
    return with_prefix(literal_prefix(pattern)) & F.col("term").rlike(f"^(?:{pattern})$")


def near(term: str, distance: int) -> Column:
    """Levenshtein distance over code points, without transpositions; the length test spares the rest."""
    return F.length("term").between(len(term) - distance, len(term) + distance) & (F.levenshtein(F.col("term"), F.lit(term), distance) >= 0)


def dictionary(postings: DataFrame) -> DataFrame:
    """(term, doc_freq, total_freq)."""
    return postings.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("freq").alias("total_freq"))


def scan(relation: DataFrame, field: str, where: Column | None = None) -> DataFrame:
    """(term, doc_freq, total_freq) over all segments of a written dictionary; the filters reach the scan."""
    rows = relation.where(F.col("field") == field)
    rows = rows if where is None else rows.where(where)
    return rows.groupBy("term").agg(F.sum("doc_freq").alias("doc_freq"), F.sum("total_freq").alias("total_freq"))


def contains(terms: DataFrame, probes: list[str]) -> DataFrame:
    """(probe, found) for each probe; only probed terms leave the scan."""
    spark = terms.sparkSession
    asked = spark.createDataFrame([(p,) for p in probes], "probe string")
    found = terms.where(F.col("term").isin(probes)).select("term").distinct()
    return asked.join(found, F.col("probe") == F.col("term"), "left").select("probe", F.col("term").isNotNull().alias("found"))


def merged_terms(postings: DataFrame) -> DataFrame:
    """(term, segments): the segments of each term in order, as an ordered merge of the segments' dictionaries yields them."""
    return postings.select("term", "segment_id").distinct().groupBy("term").agg(F.array_join(F.array_sort(F.collect_list(F.col("segment_id"))).cast("array<string>"), ",").alias("segments"))
