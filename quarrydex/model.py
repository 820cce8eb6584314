"""Fields of a document, and schemas of the derived relations (long format: a new field never changes a schema)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

_LOCS = "array<struct<field: string, pos: int, start: bigint, end: bigint>>"

#: Written relations of a segment set, by name.
SCHEMAS = {
    "segment_meta": "segment_id bigint, num_docs bigint, time_min bigint, time_max bigint",
    "fields": "segment_id bigint, field_id int, field string, docs bigint, tokens bigint, dv_kind string",
    "dictionary": "segment_id bigint, field string, term string, doc_freq bigint, total_freq bigint",
    "postings": f"segment_id bigint, doc_num bigint, field string, term string, freq bigint, norm float, locs {_LOCS}",
    "block_bounds": "segment_id bigint, field string, term string, chunk bigint, max_freq bigint, min_norm float, end_doc bigint, n bigint",
    "lengths": "segment_id bigint, doc_num bigint, field string, length bigint, norm float",
    "stored": "segment_id bigint, doc_num bigint, field_id int, field string, ord int, value string",
    "docvalues": "segment_id bigint, doc_num bigint, field string, ord int, term string",
    "numcol": "segment_id bigint, doc_num bigint, field string, ord int, value bigint",
    "vectors": "segment_id bigint, doc_num bigint, field string, ord int, vector array<float>",
}

#: What the rows of a written relation are sorted by, after segment_id; a scan of a term or a document skips what statistics rule out.
SORTED = {
    "segment_meta": (),
    "fields": ("field_id",),
    "dictionary": ("field", "term"),
    "postings": ("field", "term", "doc_num"),
    "block_bounds": ("field", "term", "chunk"),
    "lengths": ("field", "doc_num"),
    "stored": ("doc_num", "field_id", "ord"),
    "docvalues": ("field", "doc_num", "ord"),
    "numcol": ("field", "doc_num", "ord"),
    "vectors": ("field", "doc_num", "ord"),
}

#: Documents in a posting or column block.
BLOCK_DOCS = 1024
SEGMENTS = 4


@dataclass(frozen=True)
class Field:
    """A field of a document, read from a column; an array column makes a repeated field, its values in order.

    kind: "text" (analysed, with locations), "keyword" (the value is the term), "numeric"
    (an integer; not indexed), "vector", or "composite" (the terms of the fields ``of``,
    whose locations keep their own field's name). ``norm`` is a function of the length.
    """

    name: str
    column: str = ""
    kind: str = "keyword"
    stored: bool = True
    docvalues: bool = False
    of: tuple[str, ...] = ()
    norm: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.kind not in ("text", "keyword", "numeric", "vector", "composite"):
            raise ValueError(f"unknown kind of field: {self.kind}")
        if (self.kind == "composite") != bool(self.of):
            raise ValueError("a composite field, and no other, is made of fields")

    @property
    def source(self) -> str:
        return self.column or self.name

    @property
    def indexed(self) -> bool:
        return self.kind in ("text", "keyword", "composite")


#: The fields of the table (doc_id, text, lang, source, n_chars).
DOCUMENT_FIELDS = (
    Field("_id", "doc_id", docvalues=True),
    Field("body", "text", "text"),
    Field("lang", docvalues=True),
    Field("n_chars", kind="numeric", docvalues=True),
    Field("source", docvalues=True),
)
#: Their names in id order: `_id` first, the others by name.
FIELDS = tuple(f.name for f in DOCUMENT_FIELDS)
