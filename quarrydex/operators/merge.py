"""Merging segments: survivors, new document numbers, and relations moved to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrydex import functions as fn
from quarrydex.operators.numbering import dense_numbers
from quarrydex.operators.postings import block_bounds


_KEY = ["segment_id", "doc_num"]


def _key(rows: DataFrame) -> list[str]:
    """What names a document in rows: its id where they have one, else its segment and number."""
    return ["doc_id"] if "doc_id" in rows.columns else _KEY


def survivors(numbers: DataFrame, drops: DataFrame) -> DataFrame:
    """Documents (segment_id, doc_num, doc_id if known) that aren't dropped."""
    key = _key(drops)
    return numbers.join(drops.select(*key), key, "left_anti")


def renumbered(numbers: DataFrame, drops: DataFrame) -> DataFrame:
    """(segment_id, doc_num, new_doc_num, doc_id if known): dense numbers over the survivors, segment by segment.

    The numbers before a segment are the sums of the survivor counts (a row per segment).
    """
    local = dense_numbers(survivors(numbers, drops), ["segment_id"], "doc_num", "local")
    counts = local.groupBy("segment_id").agg(F.count("*").alias("n"))
    before = Window.orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("segment_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return local.join(F.broadcast(base), "segment_id").select(*numbers.columns, (F.col("base") + F.col("local")).alias("new_doc_num"))


def moved(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows with new_doc_num, without those of dropped documents."""
    key = _key(rows)
    return rows.join(numbers.select(*key, "new_doc_num"), key)


def mixed_terms(values: DataFrame, typed: DataFrame) -> DataFrame:
    """Values of a column that some segment (typed: segment_id, is_numeric) has as terms only: prefix-coded terms throughout, else integers as they are."""
    numeric = typed.agg(F.coalesce(F.bool_and("is_numeric"), F.lit(True)).alias("_numeric"))  # one row
    rows = values.join(F.broadcast(numeric), F.lit(True))
    term, number = F.when(~F.col("_numeric"), fn.prefix_coded(F.col("value"))), F.when(F.col("_numeric"), F.col("value"))
    return rows.select(*values.columns, term.alias("term"), number.alias("number"))


def source_bounds(meta: DataFrame) -> DataFrame:
    """(time_min, time_max) of the merged segment from its sources' bounds; zeros if one is unknown."""
    unknown = F.count_if((F.col("time_min") == 0) & (F.col("time_max") == 0)) > 0
    return meta.agg(F.when(unknown, 0).otherwise(F.min("time_min")).alias("time_min"), F.when(unknown, 0).otherwise(F.max("time_max")).alias("time_max"))


def superseded(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of a key that have a later version: the greatest version of each key stays."""
    last = rows.groupBy(key).agg(F.max(version).alias("_last"))
    return rows.join(last, key).where(F.col(version) < F.col("_last")).drop("_last")


def merge_relations(relations: dict[str, DataFrame], drops: DataFrame, into: int = 0) -> tuple[dict[str, DataFrame], DataFrame]:
    """The relations of one segment ``into`` from persisted ones without the dropped (segment_id, doc_num), and the map of document numbers.

    Postings, stored and column values move to the new numbers; dictionary and field
    statistics are aggregated again, so a term or field without survivors is gone; norms
    are kept. A column that some segment holds as terms becomes prefix-coded terms. Time
    bounds come from the sources. No survivors make a valid empty segment.
    """
    numbers = renumbered(relations["stored"].where("field = '_id'").select(*_KEY).distinct(), drops)

    def placed(name: str) -> DataFrame:
        rows = relations[name].join(numbers, _KEY).drop(*_KEY)
        return rows.withColumn("segment_id", F.lit(into).cast("bigint")).withColumnRenamed("new_doc_num", "doc_num").select(*relations[name].columns)

    postings, terms, values = placed("postings"), placed("docvalues"), placed("numcol")
    mixed = terms.select("field").distinct()  # fields, of which there are few
    coded = values.join(F.broadcast(mixed), "field", "left_semi").withColumn("term", fn.prefix_coded(F.col("value"))).select(*terms.columns)
    stats = postings.groupBy("field").agg(F.countDistinct("doc_num").alias("docs"), F.sum("freq").alias("tokens"))
    kinds = relations["fields"].groupBy("field").agg(F.min("field_id").alias("field_id"), F.when(F.bool_and(F.col("dv_kind") == "numeric"), "numeric").otherwise(F.max("dv_kind")).alias("dv_kind"))
    segment = F.lit(into).cast("bigint").alias("segment_id")
    bounds = source_bounds(relations["segment_meta"])
    meta = numbers.agg(F.count("*").alias("num_docs")).join(F.broadcast(bounds), F.lit(True))  # one row each
    terms_of = postings.groupBy("field", "term").agg(F.count("*").alias("doc_freq"), F.sum("freq").alias("total_freq")).select(segment, "field", "term", "doc_freq", "total_freq")
    merged = {
        "segment_meta": meta.select(segment, "num_docs", "time_min", "time_max"),
        "fields": stats.join(F.broadcast(kinds), "field").select(segment, "field_id", "field", "docs", "tokens", "dv_kind"),
        "dictionary": terms_of,
        "postings": postings,
        "block_bounds": block_bounds(postings, terms_of, meta.select(segment, "num_docs")),
        "lengths": placed("lengths"),
        "vectors": placed("vectors"),
        "stored": placed("stored"),
        "docvalues": terms.unionByName(coded),
        "numcol": values.join(F.broadcast(mixed), "field", "left_anti").select(*values.columns),
    }
    return merged, numbers
