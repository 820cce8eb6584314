"""One query for each operator of the index, over the test tables."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrydex import functions as fn
from quarrydex import model
from quarrydex.operators import columns, dictionary, merge, postings, vectors
from quarrydex.operators.index import DocumentIndex, split_terms
from quarrydex.operators.numbering import dense_numbers
from quarrydex.sources import table, temporary

TERM, OTHER = "the", "and"
QUERY_VECTOR = [((i * 37) % 23 - 11) / 10 for i in range(64)]
TOP = 10
PROBES = ["the", "and", "tion", "nosuchterm", ""]
TARGETS = [0, 1, 7, 40, 100, 100000]
DV_REQUEST = ["source", "lang", "missing", "source"]
TIME_RANGE = (1704067200000000, 1704153600000000)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


_built: dict[tuple[str, str], tuple[tuple[str, ...], dict[str, DataFrame]]] = {}


def relations(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The written index of the documents of a folder, built once in a session unless the table's files change."""
    docs = table(spark, d, "documents")
    key, files = (spark.sparkContext.applicationId, d), tuple(sorted(docs.inputFiles()))
    if key not in _built or _built[key][0] != files:
        _built[key] = files, DocumentIndex(docs).write(f"{temporary(spark, 'index')}/documents")
    return _built[key][1]


def _drops(spark: SparkSession, d: str) -> DataFrame:
    """(segment_id, doc_num) of the toxic documents, found by their ids' postings."""
    ids = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("term")).distinct()
    return _of_field(spark, d, "_id").join(ids, "term", "left_semi").select("segment_id", "doc_num")


def _of_field(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    rows = relations(spark, d)["postings"]
    return rows.where(F.col("field") == fields[0]) if len(fields) == 1 else rows.where(F.col("field").isin(*fields))


def _of_term(spark: SparkSession, d: str, term: str = TERM) -> DataFrame:
    return _of_field(spark, d, "body").where(F.col("term") == term)


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    """(segment_id, doc_num) of all documents; each has an id."""
    return relations(spark, d)["lengths"].where("field = '_id'").select("segment_id", "doc_num")


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), (F.col("event_id") % model.SEGMENTS).alias("segment_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "user_id")
    return rows


_numbered: dict[tuple[str, str], DataFrame] = {}


def _event_values(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, segment_id, value, doc_num) of the events; numbered once in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _numbered:
        rows = _events(spark, d).select("doc_id", "segment_id", F.col("user_id").cast("bigint").alias("value"))
        _numbered[key] = dense_numbers(rows, ["segment_id"], "doc_id", "doc_num")
    return _numbered[key].where("value is not null")


@query
def term_postings(spark, d):
    return _of_term(spark, d).select("segment_id", "doc_num", "freq", "norm")


@query
def term_locations(spark, d):
    rows = _of_term(spark, d).select("segment_id", "doc_num", F.explode("locs").alias("at"))
    return rows.select("segment_id", "doc_num", F.col("at.pos").cast("bigint").alias("pos"), F.col("at.start").alias("start_byte"), F.col("at.end").alias("end_byte"))


@query
def postings_no_freq(spark, d):
    return _of_term(spark, d).select("segment_id", "doc_num", F.lit(0).cast("bigint").alias("freq"), F.lit(0.0).alias("norm"))


@query
def postings_count_live(spark, d):
    dropped = _drops(spark, d).withColumn("dropped", F.lit(1))
    rows = _of_term(spark, d).select("segment_id", "doc_num").join(dropped, ["segment_id", "doc_num"], "left")
    return rows.groupBy("segment_id").agg(F.count("*").alias("docs"), F.count_if(F.col("dropped").isNull()).alias("live"))


@query
def postings_except(spark, d):
    return postings.excluding(_of_term(spark, d), _drops(spark, d)).select("segment_id", "doc_num", "freq", "norm")


@query
def postings_restrict(spark, d):
    return postings.restricted(_of_term(spark, d), _of_term(spark, d, OTHER)).select("segment_id", "doc_num", "freq", "norm")


@query
def postings_advance(spark, d):
    targets = spark.createDataFrame([(s, t) for s in range(model.SEGMENTS) for t in TARGETS], "segment_id bigint, target bigint")
    return postings.advance(_of_term(spark, d), targets)


@query
def postings_batches(spark, d):
    return postings.batches(_of_term(spark, d))


@query
def one_hit_terms(spark, d):
    return postings.one_hit(_of_field(spark, d, "_id", "lang", "source"))


@query
def dict_full(spark, d):
    return _dict(spark, d)


@query
def dict_terms_only(spark, d):
    return relations(spark, d)["dictionary"].where("field = 'body'").select("term").distinct()


def _dict(spark, d, where=None):
    return dictionary.scan(relations(spark, d)["dictionary"], "body", where)


@query
def dict_range(spark, d):
    return _dict(spark, d, dictionary.in_range("th", "ti"))


@query
def dict_prefix(spark, d):
    return _dict(spark, d, dictionary.with_prefix("tion"))


@query
def dict_regex(spark, d):
    return _dict(spark, d, dictionary.matching("the(re|an)[a-z]*"))


@query
def dict_fuzzy(spark, d):
    return _dict(spark, d, dictionary.near("there", 2))


@query
def dict_contains(spark, d):
    return dictionary.contains(relations(spark, d)["dictionary"].where("field = 'body'"), PROBES)


PAIRS = [("body", "the"), ("lang", "fr"), ("source", "src3"), ("nosuchfield", "x")]


@query
def docs_matching_terms(spark, d):
    wanted = [(F.col("field") == f) & (F.col("term") == t) for f, t in PAIRS]
    return relations(spark, d)["postings"].where(functools.reduce(operator.or_, wanted)).select("segment_id", "doc_num").distinct()


def _docs_in_range(spark, d):
    return _of_field(spark, d, "body").where(dictionary.in_range("th", "ti")).select("segment_id", "doc_num").distinct()


@query
def or_postings_range(spark, d):
    return _docs_in_range(spark, d)


@query
def or_postings_bitmap(spark, d):
    return postings.union_bitmap(_docs_in_range(spark, d))


@query
def terms_kway_merge(spark, d):
    return dictionary.merged_terms(relations(spark, d)["dictionary"].where("field = 'body'"))


@query
def field_list(spark, d):
    found = relations(spark, d)
    names = found["stored"].select("field_id", "field").distinct()
    kinds = found["numcol"].select("field", F.lit("numeric").alias("dv_kind")).unionByName(found["docvalues"].select("field", F.lit("terms").alias("dv_kind"))).distinct()
    return names.join(F.broadcast(kinds), "field", "left").select("field_id", "field", F.coalesce("dv_kind", F.lit("none")).alias("dv_kind"))  # a row per field


@query
def segment_footer(spark, d):
    return columns.time_bounds(_events(spark, d))


@query
def segment_count(spark, d):
    return relations(spark, d)["segment_meta"].select("segment_id", "num_docs")


@query
def stored_fields(spark, d):
    return relations(spark, d)["stored"].select("segment_id", "doc_num", "field_id", "field", "ord", "value")


def _requested(spark, d, fields):
    """The column values of the fields asked for, a row per field and place."""
    found = relations(spark, d)
    terms = found["docvalues"].select("segment_id", "doc_num", "field", "term", F.lit(None).cast("bigint").alias("number"))
    numbers = found["numcol"].select("segment_id", "doc_num", "field", F.lit(None).cast("string").alias("term"), F.col("value").alias("number"))
    asked = F.array(*[F.struct(F.lit(i).alias("req_pos"), F.lit(f).alias("name")) for i, f in enumerate(fields)])
    rows = terms.unionByName(numbers).where(F.col("field").isin(*fields))
    return rows.select("*", F.explode(F.filter(asked, lambda x: x["name"] == F.col("field"))["req_pos"]).alias("req_pos"))


@query
def docvalues_terms(spark, d):
    return _requested(spark, d, DV_REQUEST).select("segment_id", "doc_num", "req_pos", "field", "term")


@query
def docvalues_numbers(spark, d):
    return _requested(spark, d, ["lang", "n_chars", "source"]).select("segment_id", "doc_num", "req_pos", "field", "term", "number")


@query
def ordinal_column(spark, d):
    return postings.ordinals(relations(spark, d)["docvalues"].where("field = 'source'"))


@query
def numeric_column(spark, d):
    return _event_values(spark, d).select("segment_id", "doc_num", F.lit(0).alias("ord"), "value")


@query
def numeric_blocks(spark, d):
    return columns.numeric_blocks(_event_values(spark, d))


@query
def numeric_range(spark, d):
    return columns.numeric_range(_event_values(spark, d), 10, 40)


@query
def numeric_range_multi(spark, d):
    rows = _event_values(spark, d)
    both = rows.select("segment_id", "doc_num", F.explode(F.array("value", -F.col("value"))).alias("value"))
    return columns.numeric_range(both, -40, -10)


@query
def numeric_range_gate(spark, d):
    index = DocumentIndex(table(spark, d, "documents"))
    column = index.docs.where("n_chars is not null").select("doc_id")
    out = columns.same_documents(column, index.terms("n_chars")).withColumn("field", F.lit("n_chars"))
    none = columns.same_documents(column.where("false"), index.terms("lang")).withColumn("field", F.lit("lang"))
    return out.unionByName(none).select("field", "supported")


@query
def prefix_coded(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", fn.prefix_coded(F.col("user_id")).alias("code"), fn.prefix_coded(-F.col("user_id")).alias("negative_code"))


@query
def collection_stats(spark, d):
    return relations(spark, d)["fields"].groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


@query
def collection_stats_merged(spark, d):
    per_segment = postings.excluding(relations(spark, d)["lengths"], _drops(spark, d)).groupBy("segment_id", "field").agg(F.count("*").alias("docs"), F.sum("length").alias("tokens"))
    return per_segment.groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


@query
def time_bounds(spark, d):
    unknown = F.when(F.col("doc_id") == 3, F.lit(0).cast("bigint")).otherwise(F.col("ts"))
    return columns.time_bounds(_events(spark, d).withColumn("ts", unknown))


@query
def segment_prune_time(spark, d):
    return columns.overlapping(columns.time_bounds(_events(spark, d)), *TIME_RANGE)


@query
def field_rollup(spark, d):
    turns = table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", split_terms(F.col("text")).alias("terms"))
    length = turns.groupBy("conv_id").agg(F.sum(F.size("terms")).alias("length"))
    rows = turns.select("conv_id", "turn", F.posexplode("terms").alias("at", "term"))
    places = F.transform(F.array_sort(F.collect_list(F.struct("turn", "at"))), lambda x: F.concat_ws(":", x["turn"].cast("string"), (x["at"] + 1).cast("string")))
    grouped = rows.groupBy("conv_id", "term").agg(F.count("*").alias("freq"), F.array_join(places, " ").alias("locs"))
    return grouped.join(length, "conv_id").select("conv_id", "term", "freq", fn.norm(F.col("length")).alias("norm"), "locs")


@query
def composite_field(spark, d):
    parts = _of_field(spark, d, "body", "lang", "source").groupBy("segment_id", "doc_num", "term")
    return parts.agg(F.sum("freq").alias("freq"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


@query
def norms(spark, d):
    return relations(spark, d)["lengths"].select("segment_id", "doc_num", "field", "length", "norm")


@query
def block_bounds(spark, d):
    return relations(spark, d)["block_bounds"].where("field = 'body'").drop("field")


@query
def skip_blocks(spark, d):
    found = relations(spark, d)
    bounds = found["block_bounds"].where((F.col("field") == "body") & (F.col("term") == TERM))
    terms = found["dictionary"].where((F.col("field") == "body") & (F.col("term") == TERM))
    return postings.skip_blocks(_of_term(spark, d), bounds, terms, found["segment_meta"], F.col("max_freq") >= 12).select("segment_id", "doc_num", "freq", "norm")


def _vectors(spark, d):
    return table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_num"), F.col("embedding").alias("vector"), "label")


def _found(rows):
    return rows.select("doc_num", F.round("score", 6).alias("score"))


@query
def vector_cosine(spark, d):
    return _found(vectors.search(_vectors(spark, d), QUERY_VECTOR, TOP, "cosine"))


@query
def vector_dot(spark, d):
    return _found(vectors.search(_vectors(spark, d), QUERY_VECTOR, TOP, "dot"))


@query
def vector_l2(spark, d):
    return _found(vectors.search(_vectors(spark, d), QUERY_VECTOR, TOP, "l2"))


@query
def vector_filtered(spark, d):
    return _found(vectors.search(_vectors(spark, d).where("label = 3"), QUERY_VECTOR, TOP, "cosine"))


@query
def vector_multi(spark, d):
    rows = _vectors(spark, d).withColumn("doc_num", F.call_function("div", F.col("doc_num"), F.lit(5)))
    return _found(vectors.search(rows, QUERY_VECTOR, TOP, "dot"))


def _renumbered(spark, d):
    return merge.renumbered(_numbers(spark, d), _drops(spark, d))


@query
def merge_docnums(spark, d):
    return _renumbered(spark, d).select("segment_id", "doc_num", "new_doc_num")


@query
def merge_postings(spark, d):
    return merge.moved(_of_term(spark, d), _renumbered(spark, d)).select("new_doc_num", "freq", "norm")


@query
def merge_stats(spark, d):
    kept = postings.excluding(relations(spark, d)["postings"].select("segment_id", "doc_num", "field", "freq"), _drops(spark, d))
    per_doc = kept.groupBy("segment_id", "doc_num", "field").agg(F.sum("freq").alias("freq"))
    return per_doc.groupBy("field").agg(F.count("*").alias("docs"), F.sum("freq").alias("tokens"))


@query
def merge_fields(spark, d):
    return merge.moved(relations(spark, d)["stored"].select("segment_id", "doc_num", "field"), _renumbered(spark, d)).select("field").distinct()


@query
def merge_docvalues(spark, d):
    values = relations(spark, d)["numcol"].where("field = 'n_chars'")
    return merge.moved(values, _renumbered(spark, d)).select("new_doc_num", "value")


@query
def merge_mixed_docvalues(spark, d):
    typed = spark.createDataFrame([(s, s == 0) for s in range(model.SEGMENTS)], "segment_id bigint, is_numeric boolean")
    return merge.mixed_terms(_event_values(spark, d).select("segment_id", "doc_num", "value"), typed).select("segment_id", "doc_num", "term")


@query
def merge_stored(spark, d):
    return merge.moved(relations(spark, d)["stored"], _renumbered(spark, d)).select("new_doc_num", "field_id", "field", "ord", "value")


@query
def merge_time_bounds(spark, d):
    return merge.source_bounds(columns.time_bounds(_events(spark, d)))


@query
def latest_version_drops(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id")
    return merge.superseded(rows, "user_id", "event_id").select("event_id", "user_id")
