"""Looking into persisted segments: thin selections of the relations that sources.load returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Relations = dict[str, DataFrame]


def footer(relations: Relations, segment_id: int | None = None) -> DataFrame:
    """Documents and time bounds of each segment, or of one."""
    meta = relations["segment_meta"]
    return meta if segment_id is None else meta.where(F.col("segment_id") == segment_id)


def fields(relations: Relations, segment_id: int) -> DataFrame:
    """The fields of a segment by id, with their statistics."""
    return relations["fields"].where(F.col("segment_id") == segment_id).orderBy("field_id")


def dictionary(relations: Relations, segment_id: int, field: str) -> DataFrame:
    """The terms of a field with their counts; none for an unknown field."""
    return relations["dictionary"].where((F.col("segment_id") == segment_id) & (F.col("field") == field)).orderBy("term")


def explore(relations: Relations, segment_id: int, field: str, term: str) -> DataFrame:
    """A term's postings with their locations."""
    where = (F.col("segment_id") == segment_id) & (F.col("field") == field) & (F.col("term") == term)
    return relations["postings"].where(where).orderBy("doc_num")


def stored(relations: Relations, segment_id: int, doc_num: int) -> DataFrame:
    """A document's stored values by field and order; none past the last document."""
    return relations["stored"].where((F.col("segment_id") == segment_id) & (F.col("doc_num") == doc_num)).orderBy("field_id", "ord")


def docvalues(relations: Relations, segment_id: int, doc_num: int, names: list[str]) -> DataFrame:
    """(req_pos, field, ord, term, value) of a document, in the order asked for; unknown fields are left out, repeated ones repeat."""
    here = (F.col("segment_id") == segment_id) & (F.col("doc_num") == doc_num)
    terms = relations["docvalues"].where(here).select("field", "ord", "term", F.lit(None).cast("bigint").alias("value"))
    numbers = relations["numcol"].where(here).select("field", "ord", F.lit(None).cast("string").alias("term"), "value")
    asked = terms.sparkSession.createDataFrame(list(enumerate(names)), "req_pos int, asked string")
    found = asked.join(terms.unionByName(numbers), F.col("asked") == F.col("field"))
    return found.select("req_pos", "field", "ord", "term", "value").orderBy("req_pos", "ord")


def size_in_bytes(relations: Relations) -> dict[str, int]:
    """Catalyst's size of each relation that has rows."""
    sizes = {name: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for name, df in relations.items()}
    return {name: size for name, size in sizes.items() if size}
