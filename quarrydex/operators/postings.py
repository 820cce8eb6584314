"""Postings access: seek, batches, exclusion, restriction, blocks, unions. Input: rows with segment_id and doc_num."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrydex import functions as fn
from quarrydex.operators.numbering import dense_numbers

BATCH = 128
BITMAP_DOCS = 32768


def excluding(postings: DataFrame, drops: DataFrame) -> DataFrame:
    """Postings of documents that aren't dropped, by (segment_id, doc_num)."""
    return postings.join(drops.select("segment_id", "doc_num"), ["segment_id", "doc_num"], "left_anti")


def restricted(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings of the given documents."""
    return postings.join(docs.select("segment_id", "doc_num"), ["segment_id", "doc_num"], "left_semi")


def advance(postings: DataFrame, targets: DataFrame, span: int = 4096) -> DataFrame:
    """(segment_id, target, doc_num): the first posting at or after each target, or null.

    A forward as-of lookup by ranges of ``span`` documents: an equi-join on the range
    finds the postings of the target's own range, a second one the first posting of the
    next range that has any. That is found for each range of postings or targets by a
    window over a segment's ranges, of which there are a ``span``-th of its documents.
    """
    at = [F.col("segment_id"), F.floor(F.col("doc_num") / span).alias("range")]
    rows = postings.select(*at, "doc_num")
    asked = targets.select("segment_id", "target", F.floor(F.col("target") / span).alias("range"))
    ranges = rows.groupBy("segment_id", "range").agg(F.min("doc_num").alias("first"))
    ranges = ranges.unionByName(asked.select("segment_id", "range", F.lit(None).cast("bigint").alias("first"))).groupBy("segment_id", "range").agg(F.min("first").alias("first"))
    later = Window.partitionBy("segment_id").orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    following = ranges.select("segment_id", "range", F.min("first").over(later).alias("after"))
    here = asked.join(rows, ["segment_id", "range"]).where("doc_num >= target").groupBy("segment_id", "target").agg(F.min("doc_num").alias("here"))
    out = asked.join(here, ["segment_id", "target"], "left").join(following, ["segment_id", "range"], "left")
    return out.select("segment_id", "target", F.coalesce("here", "after").alias("doc_num"))


def batches(postings: DataFrame, size: int = BATCH) -> DataFrame:
    """(segment_id, batch, n, first_doc, last_doc) of runs of ``size`` postings in document order."""
    rows = dense_numbers(postings.select("segment_id", "doc_num"), ["segment_id"], "doc_num", "at")
    return rows.groupBy("segment_id", F.floor(F.col("at") / size).alias("batch")).agg(F.count("*").alias("n"), F.min("doc_num").alias("first_doc"), F.max("doc_num").alias("last_doc"))


def _chunked(postings: DataFrame, terms: DataFrame, segment_docs: DataFrame) -> DataFrame:
    """Postings with the size and number of their block.

    The frequencies come from the dictionary (a written one, so that the join can be
    split where a term has many postings); no task holds a term.
    """
    sizes = terms.join(F.broadcast(segment_docs.select("segment_id", "num_docs")), "segment_id")  # a row per segment
    sizes = sizes.select("segment_id", "field", "term", fn.chunk_size(F.col("num_docs"), F.col("doc_freq")).alias("_size"))
    return postings.join(sizes, ["segment_id", "field", "term"]).withColumn("chunk", F.call_function("div", F.col("doc_num"), F.col("_size")))


def block_bounds(postings: DataFrame, terms: DataFrame, segment_docs: DataFrame) -> DataFrame:
    """(segment_id, field, term, chunk, max_freq, min_norm, end_doc, n) of the blocks of each term's postings.

    A block has num_docs div (doc_freq div 1024 + 1) documents. terms: the dictionary;
    segment_docs: (segment_id, num_docs), a row per segment.
    """
    rows = _chunked(postings.select("segment_id", "field", "term", "doc_num", "freq", "norm"), terms, segment_docs)
    out = rows.groupBy("segment_id", "field", "term", "chunk", "_size").agg(F.max("freq").alias("max_freq"), F.min("norm").alias("min_norm"), F.count("*").alias("n"))
    return out.select("segment_id", "field", "term", "chunk", "max_freq", "min_norm", ((F.col("chunk") + 1) * F.col("_size")).alias("end_doc"), "n")


#: Ranges of documents up to which they are a filter of the scan.
MAX_RANGES = 200


def skip_blocks(postings: DataFrame, bounds: DataFrame, terms: DataFrame, segment_docs: DataFrame, competitive: Column) -> DataFrame:
    """Postings in blocks whose bounds (max_freq, min_norm) pass.

    Ranges of documents of the passing blocks, if few, go to the scan as a filter: files
    and pages of other blocks aren't read. The join with the blocks decides in any case.
    """
    passing = bounds.where(competitive)
    size = F.call_function("div", F.col("end_doc"), F.col("chunk") + 1)
    ranges = passing.select("segment_id", (F.col("end_doc") - size).alias("lo"), "end_doc").distinct().limit(MAX_RANGES + 1).collect()
    if len(ranges) <= MAX_RANGES:
        within = F.lit(False)
        for segment, lo, hi in ranges:
            within = within | ((F.col("segment_id") == segment) & (F.col("doc_num") >= lo) & (F.col("doc_num") < hi))
        postings = postings.where(within)
    rows = _chunked(postings, terms, segment_docs)
    return rows.join(passing.select("segment_id", "field", "term", "chunk"), ["segment_id", "field", "term", "chunk"], "left_semi").select(*postings.columns)


def union_bitmap(docs: DataFrame, span: int = BITMAP_DOCS) -> DataFrame:
    """(segment_id, bucket, docs): sizes of the union's bitmaps of ``span`` documents."""
    bits = F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("doc_num") + 1)))
    return docs.groupBy("segment_id", F.floor(F.col("doc_num") / span).alias("bucket")).agg(bits.alias("docs"))


def intersection_bitmap(left: DataFrame, right: DataFrame, span: int = BITMAP_DOCS) -> DataFrame:
    """(segment_id, bucket, docs): sizes of the bitmaps of documents in both."""
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col("doc_num") + 1))
    each = [x.groupBy("segment_id", F.floor(F.col("doc_num") / span).alias("bucket")).agg(bits.alias("bits")) for x in (left, right)]
    both = each[0].unionByName(each[1]).groupBy("segment_id", "bucket").agg(F.count("*").alias("n"), F.bitmap_count(F.bitmap_and_agg("bits")).alias("docs"))
    return both.where("n = 2 and docs > 0").select("segment_id", "bucket", "docs")


def one_hit(postings: DataFrame) -> DataFrame:
    """(segment_id, field, term, doc_num) of terms with one posting, of frequency one and without locations."""
    out = postings.groupBy("segment_id", "field", "term").agg(F.count("*").alias("n"), F.sum("freq").alias("f"), F.max(F.size("locs")).alias("l"), F.min("doc_num").alias("doc_num"))
    return out.where("n = 1 and f = 1 and l <= 0").select("segment_id", "field", "term", "doc_num")


def ordinals(values: DataFrame) -> DataFrame:
    """(segment_id, doc_num, ord): the rank of each value among its segment's distinct terms, which are ranked apart from the rows and by ranges."""
    distinct = values.select("segment_id", "term").distinct()
    ranked = dense_numbers(distinct, ["segment_id"], "term", "ord")
    return values.select("segment_id", "doc_num", "term").join(ranked, ["segment_id", "term"]).select("segment_id", "doc_num", "ord")
