"""Build: documents to relations.

Relations are lazy DataFrames. Text columns are tokenised where they are read and
never shuffled; only terms are. Document numbers come from the id column alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quarrydex import functions as fn
from quarrydex import model, sources
from quarrydex.operators import columns, postings
from quarrydex.operators.numbering import dense_numbers

_KEY = ["doc_id", "segment_id"]
_LOCS = "array<struct<field: string, pos: int, start: bigint, end: bigint>>"


def split_terms(text: Column) -> Column:
    """Terms between single spaces; empty ones are kept."""
    return F.split(text, " ", -1)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has fewer input partitions than those (a small file); a large input is left where it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _cells(values: Column, value: str, **constants: Column) -> Column:
    """A struct of the constants, the place as ``ord`` and the value for each of some values."""
    return F.transform(values, lambda v, k: F.struct(*[c.alias(n) for n, c in constants.items()], k.alias("ord"), v.alias(value)))


def _split_value(numeric: bool) -> Callable[[Column], Column]:
    """(req_pos, field, ord, term, number) of a cell whose value is the one or the other."""
    none = F.lit(None)

    def split(x: Column) -> Column:
        term, number = (none.cast("string"), x["value"]) if numeric else (x["value"], none.cast("bigint"))
        return F.struct(x["req_pos"].alias("req_pos"), x["field"].alias("field"), x["ord"].alias("ord"), term.alias("term"), number.alias("number"))

    return split


class DocumentIndex:
    """The relations of a table of documents, in ``segments`` segments by an integer id, or as the one segment ``segment``.

    ``fields`` says what is read from which column and how; ``analyzer`` maps a text to
    its terms, ``norm`` a field's length to its norm (a field may have its own);
    ``time_column`` holds 64-bit times, null or 0 if unknown. Null values are no values;
    an unknown field matches nothing.
    """

    def __init__(
        self,
        documents: DataFrame,
        segments: int = model.SEGMENTS,
        fields: tuple[model.Field, ...] = model.DOCUMENT_FIELDS,
        id_column: str = "doc_id",
        time_column: str | None = None,
        analyzer: Callable[[Column], Column] = split_terms,
        norm: Callable[[Column], Column] = fn.norm,
        segment: int | None = None,
    ):
        names = [f.name for f in fields]
        if len(set(names)) < len(names):
            raise ValueError("a field is defined twice")
        #: `_id` first, the others by name; a field's place is its id.
        self.fields = {f.name: f for f in sorted(fields, key=lambda f: (f.name != "_id", f.name))}
        unknown = [x for f in fields for x in f.of if x not in self.fields or not self.fields[x].indexed or self.fields[x].of]
        if unknown:
            raise ValueError(f"not indexed fields: {unknown}")
        self.time_column, self.analyzer, self.norm = time_column, analyzer, norm
        at = F.pmod(F.col(id_column), F.lit(segments)) if segment is None else F.lit(segment)
        self.docs = documents.withColumns({"doc_id": F.col(id_column), "segment_id": at.cast("bigint")})

    @cached_property
    def numbers(self) -> DataFrame:
        """(doc_id, segment_id, doc_num): local document numbers."""
        return dense_numbers(self.docs.select(*_KEY), ["segment_id"], "doc_id", "doc_num")

    def numbered(self, df: DataFrame) -> DataFrame:
        """df with doc_num beside its doc_id and segment_id."""
        return df.join(self.numbers, _KEY)

    def _repeated(self, field: model.Field) -> bool:
        kind = self.docs.schema[field.source].dataType
        if field.kind == "vector":
            kind = kind.elementType
        return isinstance(kind, ArrayType)

    def _values(self, field: model.Field, kind: str) -> Column:
        """The field's values of a document in order, without nulls."""
        value = F.col(field.source)
        if self._repeated(field):
            return F.filter(F.coalesce(value, F.array()).cast(f"array<{kind}>"), lambda x: x.isNotNull())
        return F.filter(F.array(value.cast(kind)), lambda x: x.isNotNull())

    def _terms(self, field: model.Field, text: Column) -> Column:
        return self.analyzer(text) if field.kind == "text" else F.array(text)

    def terms(self, name: str) -> DataFrame:
        """(doc_id, segment_id, field, ord, pos, term, length) of an indexed or numeric field: each term of each value, and the length of all values."""
        field = self.fields.get(name)
        if field is None or field.kind == "vector":
            return self.docs.sparkSession.createDataFrame([], "doc_id bigint, segment_id bigint, field string, ord int, pos int, term string, length bigint")
        if field.of:
            parts = None
            for part in field.of:
                own = self.terms(part).drop("length")
                parts = own if parts is None else parts.unionByName(own)
            return parts.join(self.lengths(name).drop("field"), _KEY)
        rows = self.docs.select(*_KEY, field.source)
        if field.kind == "text":
            rows = spread(rows)
        # the length is projected before the explode
        if self._repeated(field):
            rows = rows.select(*_KEY, F.transform(self._values(field, "string"), lambda v: self._terms(field, v)).alias("values"))
            rows = rows.select(*_KEY, F.aggregate("values", F.lit(0), lambda a, v: a + F.size(v)).cast("bigint").alias("length"), F.posexplode("values").alias("ord", "terms"))
        else:
            rows = rows.where(F.col(field.source).isNotNull()).select(*_KEY, F.lit(0).alias("ord"), self._terms(field, F.col(field.source).cast("string")).alias("terms"))
            rows = rows.select(*_KEY, "ord", "terms", F.size("terms").cast("bigint").alias("length"))
        rows = rows.select(*_KEY, "ord", "length", F.posexplode("terms").alias("at", "term"))
        return rows.select(*_KEY, F.lit(name).alias("field"), "ord", (F.col("at") + 1).alias("pos"), "term", "length")

    def lengths(self, name: str) -> DataFrame:
        """(doc_id, segment_id, field, length) of the documents that have the field."""
        field = self.fields[name]
        if field.of:
            parts = None
            for part in field.of:
                own = self.lengths(part)
                parts = own if parts is None else parts.unionByName(own)
            return parts.groupBy(*_KEY).agg(F.sum("length").alias("length")).select(*_KEY, F.lit(name).alias("field"), "length")
        value = F.col(field.source)
        if self._repeated(field):
            sizes = F.transform(self._values(field, "string"), lambda v: F.size(self._terms(field, v)))
            rows = self.docs.select(*_KEY, sizes.alias("sizes")).where(F.size("sizes") > 0)
            length = F.aggregate("sizes", F.lit(0), lambda a, v: a + v)
        else:
            rows = self.docs.where(value.isNotNull())
            length = F.size(self.analyzer(value)) if field.kind == "text" else F.lit(1)
        return rows.select(*_KEY, F.lit(name).alias("field"), length.cast("bigint").alias("length"))

    def normed(self, name: str, length: Column) -> Column:
        field = self.fields.get(name)
        return ((field and field.norm) or self.norm)(length).cast("float")

    def postings(self, name: str, where: Column | None = None) -> DataFrame:
        """(doc_id, segment_id, term, freq, norm); ``where`` filters terms before they are shuffled."""
        rows = self.terms(name)
        if where is not None:
            rows = rows.where(where)
        grouped = rows.groupBy(*_KEY, "term").agg(F.count("*").alias("freq"), F.max("length").alias("length"))
        return grouped.select(*_KEY, "term", "freq", self.normed(name, F.col("length")).alias("norm"))

    def locations(self, name: str, where: Column | None = None) -> DataFrame:
        """(doc_id, segment_id, field, ord, term, pos, start, end, length): byte offsets in the value, a running sum over the terms of one value."""
        field = self.fields.get(name)
        own = [*_KEY, "ord"] if field and (field.of or self._repeated(field)) else _KEY
        order = Window.partitionBy(*own, *(["field"] if field and field.of else [])).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum(F.octet_length("term") + 1).over(order), F.lit(0)).cast("bigint")
        rows = self.terms(name).select(*_KEY, "field", "ord", "term", "pos", start.alias("start"), "length")
        rows = rows.withColumn("end", F.col("start") + F.octet_length("term"))
        return rows if where is None else rows.where(where)

    def term_locations(self, term: str, name: str = "body") -> DataFrame:
        """locations() of one term of a single-valued text field of terms between blanks: the offset is the length of the text before, so other terms aren't shuffled."""
        rows = spread(self.docs.select(*_KEY, F.col(self.fields[name].source).alias("text"))).where(F.contains(F.col("text"), F.lit(term)))
        rows = rows.select(*_KEY, "text", split_terms(F.col("text")).alias("terms"))
        hits = F.filter(F.transform("terms", lambda x, i: F.struct((i + 1).alias("pos"), x.alias("term"))), lambda x: x["term"] == term)
        rows = rows.select(*_KEY, "text", F.explode(hits).alias("h"))
        before = F.octet_length(F.expr("substring_index(text, ' ', h.pos - 1)")).cast("bigint")
        start = F.when(F.col("h.pos") == 1, F.lit(0).cast("bigint")).otherwise(before + 1)
        rows = rows.select(*_KEY, F.col("h.term").alias("term"), F.col("h.pos").alias("pos"), start.alias("start"))
        return rows.withColumn("end", F.col("start") + F.octet_length("term"))

    def full_postings(self, name: str) -> DataFrame:
        """(doc_id, segment_id, field, term, freq, norm, locs): values of a repeated field and parts of a composite one are rolled up, locations in value order. Keywords have no locations."""
        field = self.fields[name]
        if field.kind == "keyword":
            return self.postings(name).select(*_KEY, F.lit(name).alias("field"), "term", "freq", "norm", F.array().cast(_LOCS).alias("locs"))
        place = F.struct("field", "ord", "pos", "start", "end")
        grouped = self.locations(name).groupBy(*_KEY, "term").agg(F.count("*").alias("freq"), F.max("length").alias("length"), F.array_sort(F.collect_list(place)).alias("at"))
        locs = F.transform("at", lambda x: F.struct(x["field"].alias("field"), x["pos"].alias("pos"), x["start"].alias("start"), x["end"].alias("end")))
        return grouped.select(*_KEY, F.lit(name).alias("field"), "term", "freq", self.normed(name, F.col("length")).alias("norm"), locs.cast(_LOCS).alias("locs"))

    @cached_property
    def stored(self) -> DataFrame:
        """(doc_id, segment_id, field_id, field, ord, value) of every stored field, as text."""
        cells = []
        for i, (name, field) in enumerate(self.fields.items()):
            if field.stored and field.kind not in ("composite", "vector"):
                cells.append(_cells(self._values(field, "string"), "value", field_id=F.lit(i), field=F.lit(name)))
        cells.append(F.array().cast("array<struct<field_id: int, field: string, ord: int, value: string>>"))
        rows = self.docs.select(*_KEY, F.explode(F.concat(*cells)).alias("c"))
        return rows.select(*_KEY, "c.*")

    def docvalues(self, names: list[str]) -> DataFrame:
        """(doc_id, segment_id, req_pos, field, ord, term, number) in request order: repeated requests repeat, unknown fields are skipped; terms of a document are distinct and in order, numbers come typed and in order of the values."""
        kind = "array<struct<req_pos: int, field: string, ord: int, term: string, number: bigint>>"
        cells = [F.array().cast(kind)]
        for i, name in enumerate(names):
            field = self.fields.get(name)
            if field is None or not field.docvalues:
                continue
            numeric = field.kind == "numeric"
            values = self._values(field, "bigint" if numeric else "string")
            if field.kind == "text":
                values = F.flatten(F.transform(values, self.analyzer))
            values = values if numeric else F.array_sort(F.array_distinct(values))
            own = _cells(values, "value", req_pos=F.lit(i), field=F.lit(name))
            cells.append(F.transform(own, _split_value(numeric)).cast(kind))
        rows = self.docs.select(*_KEY, F.explode(F.concat(*cells)).alias("c"))
        return rows.select(*_KEY, "c.*")

    @cached_property
    def vectors(self) -> DataFrame:
        """(doc_id, segment_id, field, ord, vector) of the vector fields."""
        cells = [F.array().cast("array<struct<field: string, ord: int, vector: array<float>>>")]
        for name, field in self.fields.items():
            if field.kind == "vector":
                cells.append(_cells(self._values(field, "array<float>"), "vector", field=F.lit(name)))
        return self.docs.select(*_KEY, F.explode(F.concat(*cells)).alias("c")).select(*_KEY, "c.*")

    @cached_property
    def stats(self) -> DataFrame:
        """(doc_id, segment_id, field, length) of every indexed field."""
        out = None
        for name, field in self.fields.items():
            if field.indexed:
                part = self.lengths(name)
                out = part if out is None else out.unionByName(part)
        return out if out is not None else self.docs.limit(0).select(*_KEY, F.lit("").alias("field"), F.lit(0).cast("bigint").alias("length"))

    @cached_property
    def all_postings(self) -> DataFrame:
        """The postings relation, in no order."""
        out = None
        for name, field in self.fields.items():
            if field.indexed:
                part = self.full_postings(name)
                out = part if out is None else out.unionByName(part)
        if out is None:
            return self.docs.sparkSession.createDataFrame([], model.SCHEMAS["postings"])
        return _typed("postings", self.numbered(out))

    @cached_property
    def all_lengths(self) -> DataFrame:
        """The lengths relation, in no order."""
        out = None
        for name, field in self.fields.items():
            if field.indexed:
                part = self.lengths(name).withColumn("norm", self.normed(name, F.col("length")))
                out = part if out is None else out.unionByName(part)
        return _typed("lengths", self.numbered(out)) if out is not None else self.docs.sparkSession.createDataFrame([], model.SCHEMAS["lengths"])

    def relations(self, found: DataFrame | None = None, terms: DataFrame | None = None, lengths: DataFrame | None = None) -> dict[str, DataFrame]:
        """Everything that persists, in the declared schemas; from written postings, dictionary and lengths if given."""
        found = self.all_postings if found is None else found
        terms = dictionary_of(found) if terms is None else terms
        lengths = self.all_lengths if lengths is None else lengths
        names = list(self.fields)
        kind = F.create_map(*[F.lit(x) for n, f in self.fields.items() if f.docvalues for x in (n, "numeric" if f.kind == "numeric" else "terms")], F.lit(""), F.lit(""))
        values = self.numbered(self.docvalues([n for n in names if self.fields[n].docvalues]))
        times = F.lit(0) if self.time_column is None else F.col(self.time_column)
        meta = columns.time_bounds(self.docs.select("segment_id", times.cast("bigint").alias("ts")))
        ids = F.array_position(F.array(*map(F.lit, names)), F.col("field")) - 1
        out = {
            "segment_meta": meta,
            "fields": lengths.groupBy("segment_id", "field").agg(F.count("*").alias("docs"), F.sum("length").alias("tokens")).withColumn("field_id", ids).withColumn("dv_kind", kind[F.col("field")]),
            "dictionary": terms,
            "postings": found,
            "block_bounds": postings.block_bounds(found, terms, meta),
            "lengths": lengths,
            "stored": self.numbered(self.stored),
            "docvalues": values.where("term is not null"),
            "numcol": values.where("number is not null").withColumn("value", F.col("number")),
            "vectors": self.numbered(self.vectors),
        }
        return {name: _typed(name, df) for name, df in out.items()}

    def write(self, path: str, mode: str = "errorifexists") -> dict[str, DataFrame]:
        """Persists the index below the path and loads it.

        Texts are tokenised once for postings and once for lengths: both are written as
        they come, then sorted, and what follows from them is read from there.
        """
        spark = self.docs.sparkSession
        raw = sources.written(self.all_postings, "postings")
        terms = sources.written(dictionary_of(raw), "dictionary")
        lengths = sources.written(self.all_lengths, "lengths")
        relations = self.relations(raw, terms, lengths)
        bounds = relations["block_bounds"] = sources.written(relations["block_bounds"], "bounds")
        for name, df in relations.items():
            if name != "vectors" or any(f.kind == "vector" for f in self.fields.values()):
                sources.write_relation(df, path, name, mode)
        sources.remove(raw, terms, lengths, bounds)
        return sources.load(spark, path)


def dictionary_of(found: DataFrame) -> DataFrame:
    """The dictionary relation of postings."""
    return _typed("dictionary", found.groupBy("segment_id", "field", "term").agg(F.count("*").alias("doc_freq"), F.sum("freq").alias("total_freq")))


def _typed(name: str, df: DataFrame) -> DataFrame:
    """The declared columns of a relation, in their types."""
    parts = re.findall(r"(\w+) (array<struct<.*?>>|array<\w+>|\w+)(?:, |$)", model.SCHEMAS[name])
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in parts])
