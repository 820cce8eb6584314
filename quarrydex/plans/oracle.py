"""DuckDB SQL of the registered queries, over the same tables."""

from __future__ import annotations

from quarrydex.plans.queries import DV_REQUEST, OTHER, PAIRS, PROBES, QUERY_VECTOR, TARGETS, TERM, TIME_RANGE, TOP

_D = "d AS (SELECT *, doc_id % 4 AS segment_id, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 AS doc_num FROM documents)"
_T = f"{_D}, w AS (SELECT segment_id, doc_num, doc_id, string_split(text, ' ') AS ws FROM d WHERE text IS NOT NULL), t AS (SELECT segment_id, doc_num, doc_id, len(ws) AS length, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM w)"
_NORM = "CAST(1 / sqrt({}) AS FLOAT)"
_P = f"{_T}, p AS (SELECT segment_id, doc_num, doc_id, term, count(*) AS freq, {_NORM.format('max(length)')} AS norm FROM t GROUP BY segment_id, doc_num, doc_id, term)"
_X = "x AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"
_E = "e AS (SELECT event_id AS doc_id, event_id % 4 AS segment_id, epoch_us(ts) AS ts, user_id AS value, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS doc_num FROM events)"
_F = f"{_T}, f AS (SELECT segment_id, doc_num, doc_id, '_id' AS field, 1::BIGINT AS length FROM d UNION ALL SELECT segment_id, doc_num, doc_id, 'body', len(ws) FROM w UNION ALL SELECT segment_id, doc_num, doc_id, 'lang', 1 FROM d WHERE lang IS NOT NULL UNION ALL SELECT segment_id, doc_num, doc_id, 'source', 1 FROM d WHERE source IS NOT NULL)"
_R = f"{_P}, {_X}, r AS (SELECT doc_id, segment_id, doc_num, row_number() OVER (ORDER BY segment_id, doc_num) - 1 AS new_doc_num FROM d WHERE doc_id NOT IN (FROM x))"
_S = "s AS (SELECT segment_id, doc_num, doc_id, 0 AS field_id, '_id' AS field, 0 AS ord, doc_id::VARCHAR AS value FROM d UNION ALL SELECT segment_id, doc_num, doc_id, 1, 'body', 0, text FROM d WHERE text IS NOT NULL UNION ALL SELECT segment_id, doc_num, doc_id, 2, 'lang', 0, lang FROM d WHERE lang IS NOT NULL UNION ALL SELECT segment_id, doc_num, doc_id, 3, 'n_chars', 0, n_chars::VARCHAR FROM d WHERE n_chars IS NOT NULL UNION ALL SELECT segment_id, doc_num, doc_id, 4, 'source', 0, source FROM d WHERE source IS NOT NULL)"
_BOUNDS = "SELECT segment_id, count(*) AS num_docs, CASE WHEN count(*) FILTER (ts IS NULL OR ts = 0) > 0 THEN 0 ELSE min(ts) END AS time_min, CASE WHEN count(*) FILTER (ts IS NULL OR ts = 0) > 0 THEN 0 ELSE max(ts) END AS time_max FROM e GROUP BY segment_id"
_C = f"{_P}, n AS (SELECT segment_id, count(*) AS num_docs FROM d GROUP BY segment_id), c AS (SELECT segment_id, term, count(*) AS card FROM p GROUP BY segment_id, term), k AS (SELECT segment_id, term, num_docs // (card // 1024 + 1) AS size FROM c JOIN n USING (segment_id)), b AS (SELECT p.*, doc_num // size AS chunk, size FROM p JOIN k USING (segment_id, term))"
_DICT = "SELECT term, count(*) AS doc_freq, sum(freq)::BIGINT AS total_freq FROM p WHERE {} GROUP BY term"


def _hex(value: str) -> str:
    parts = [f"printf('%02X', ((({value})::HUGEINT + 9223372036854775808::HUGEINT) // {1 << (7 * i)}::HUGEINT % 128)::INT)" for i in range(9, -1, -1)]
    return "'20' || " + " || ".join(parts)


def _vector(metric: str, where: str = "TRUE", doc: str = "vec_id") -> str:
    q = f"{QUERY_VECTOR}::DOUBLE[]"
    v = "embedding::DOUBLE[]"
    dot = f"list_dot_product({v}, {q})"
    score = {
        "dot": dot,
        "cosine": f"greatest(-1.0, least(1.0, {dot} / (sqrt(list_dot_product({v}, {v})) * sqrt(list_dot_product({q}, {q})))))",
        "l2": f"-(list_dot_product({v}, {v}) - 2 * {dot} + list_dot_product({q}, {q}))",
    }[metric]
    return f"SELECT doc_num, round(score, 6) AS score FROM (SELECT {doc} AS doc_num, max({score}) AS score FROM embeddings WHERE embedding IS NOT NULL AND {where} GROUP BY 1 ORDER BY score DESC, doc_num LIMIT {TOP})"


_POST = f"SELECT segment_id, doc_num, freq, norm FROM p WHERE term = '{TERM}'"
_TARGETS = ", ".join(f"({s}::BIGINT, {t}::BIGINT)" for s in range(4) for t in TARGETS)
_REQUEST = " UNION ALL ".join(f"SELECT segment_id, doc_num, {i} AS req_pos, '{f}' AS field, {f} AS term FROM d WHERE {f} IS NOT NULL" for i, f in enumerate(DV_REQUEST) if f in ("lang", "source"))
_PAIRS = ", ".join(f"('{f}', '{t}')" for f, t in PAIRS)
_KEYWORDS = "SELECT segment_id, doc_num, '_id' AS field, doc_id::VARCHAR AS term FROM d UNION ALL SELECT segment_id, doc_num, 'lang', lang FROM d WHERE lang IS NOT NULL UNION ALL SELECT segment_id, doc_num, 'source', source FROM d WHERE source IS NOT NULL"

ORACLE_SQL = {
    "term_postings": f"WITH {_P} {_POST}",
    "term_locations": f"WITH {_T}, o AS (SELECT *, coalesce(sum(octet_length(encode(term)) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte FROM t) SELECT segment_id, doc_num, pos::BIGINT AS pos, start_byte, (start_byte + octet_length(encode(term)))::BIGINT AS end_byte FROM o WHERE term = '{TERM}'",
    "postings_no_freq": f"WITH {_T} SELECT DISTINCT segment_id, doc_num, 0::BIGINT AS freq, 0.0::DOUBLE AS norm FROM t WHERE term = '{TERM}'",
    "postings_count_live": f"WITH {_P}, {_X} SELECT segment_id, count(*) AS docs, count(*) FILTER (doc_id NOT IN (FROM x)) AS live FROM p WHERE term = '{TERM}' GROUP BY segment_id",
    "postings_except": f"WITH {_P}, {_X} {_POST} AND NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = p.doc_id)",
    "postings_restrict": f"WITH {_P} {_POST} AND doc_id IN (SELECT doc_id FROM t WHERE term = '{OTHER}')",
    "postings_advance": f"WITH {_P}, a(segment_id, target) AS (VALUES {_TARGETS}) SELECT a.segment_id, target, min(doc_num) AS doc_num FROM a LEFT JOIN p ON p.segment_id = a.segment_id AND term = '{TERM}' AND doc_num >= target GROUP BY a.segment_id, target",
    "postings_batches": f"WITH {_P}, b AS (SELECT segment_id, doc_num, (row_number() OVER (PARTITION BY segment_id ORDER BY doc_num) - 1) // 128 AS batch FROM p WHERE term = '{TERM}') SELECT segment_id, batch, count(*) AS n, min(doc_num) AS first_doc, max(doc_num) AS last_doc FROM b GROUP BY segment_id, batch",
    "one_hit_terms": f"WITH {_D}, k AS ({_KEYWORDS}) SELECT segment_id, field, term, min(doc_num) AS doc_num FROM k GROUP BY segment_id, field, term HAVING count(*) = 1",
    "dict_full": f"WITH {_P} {_DICT.format('TRUE')}",
    "dict_terms_only": f"WITH {_T} SELECT DISTINCT term FROM t",
    "dict_range": f"WITH {_P} " + _DICT.format("term >= 'th' AND term < 'ti'"),
    "dict_prefix": f"WITH {_P} " + _DICT.format("starts_with(term, 'tion')"),
    "dict_regex": f"WITH {_P} " + _DICT.format("regexp_full_match(term, 'the(re|an)[a-z]*')"),
    "dict_fuzzy": f"WITH {_P} " + _DICT.format("levenshtein(regexp_replace(term, '[^ther]', '?', 'g'), 'there') <= 2"),
    "dict_contains": f"WITH {_T}, a(probe) AS (VALUES {', '.join(f"('{p}')" for p in PROBES)}) SELECT probe, EXISTS (SELECT 1 FROM t WHERE term = probe) AS found FROM a",
    "docs_matching_terms": f"WITH {_T}, k AS (SELECT segment_id, doc_num, 'body' AS field, term FROM t UNION ALL {_KEYWORDS}) SELECT DISTINCT segment_id, doc_num FROM k WHERE (field, term) IN ({_PAIRS})",
    "or_postings_range": f"WITH {_T} SELECT DISTINCT segment_id, doc_num FROM t WHERE term >= 'th' AND term < 'ti'",
    "or_postings_bitmap": f"WITH {_T} SELECT segment_id, doc_num // 32768 AS bucket, count(DISTINCT doc_num) AS docs FROM t WHERE term >= 'th' AND term < 'ti' GROUP BY ALL",
    "terms_kway_merge": f"WITH {_T}, k AS (SELECT DISTINCT term, segment_id FROM t) SELECT term, string_agg(segment_id::VARCHAR, ',' ORDER BY segment_id) AS segments FROM k GROUP BY term",
    "field_list": f"WITH {_D}, {_S} SELECT DISTINCT field_id, field, CASE field WHEN 'body' THEN 'none' WHEN 'n_chars' THEN 'numeric' ELSE 'terms' END AS dv_kind FROM s",
    "segment_footer": f"WITH {_E} {_BOUNDS}",
    "segment_count": f"WITH {_D} SELECT segment_id, count(*) AS num_docs FROM d GROUP BY segment_id",
    "stored_fields": f"WITH {_D}, {_S} SELECT segment_id, doc_num, field_id, field, ord, value FROM s",
    "docvalues_terms": f"WITH {_D} {_REQUEST}",
    "docvalues_numbers": f"WITH {_D} SELECT segment_id, doc_num, 0 AS req_pos, 'lang' AS field, lang AS term, NULL::BIGINT AS number FROM d WHERE lang IS NOT NULL UNION ALL SELECT segment_id, doc_num, 1, 'n_chars', NULL, n_chars FROM d WHERE n_chars IS NOT NULL UNION ALL SELECT segment_id, doc_num, 2, 'source', source, NULL FROM d WHERE source IS NOT NULL",
    "ordinal_column": f"WITH {_D} SELECT segment_id, doc_num, dense_rank() OVER (PARTITION BY segment_id ORDER BY source) - 1 AS ord FROM d WHERE source IS NOT NULL",
    "numeric_column": f"WITH {_E} SELECT segment_id, doc_num, 0 AS ord, value FROM e WHERE value IS NOT NULL",
    "numeric_blocks": f"WITH {_E} SELECT segment_id, doc_num // 1024 AS block, count(*) AS n, min(value) AS min_value, max(value) AS max_value, count(*) = 1024 AS dense FROM e WHERE value IS NOT NULL GROUP BY ALL",
    "numeric_range": f"WITH {_E} SELECT segment_id, doc_num FROM e WHERE value BETWEEN 10 AND 40",
    "numeric_range_multi": f"WITH {_E} SELECT segment_id, doc_num FROM e WHERE value BETWEEN -40 AND -10 OR -value BETWEEN -40 AND -10",
    "numeric_range_gate": "SELECT 'n_chars' AS field, NOT EXISTS (SELECT doc_id FROM documents WHERE n_chars IS NOT NULL EXCEPT SELECT doc_id FROM documents WHERE n_chars::VARCHAR IS NOT NULL) AS supported UNION ALL SELECT 'lang', NOT EXISTS (SELECT doc_id FROM documents WHERE lang IS NOT NULL)",
    "prefix_coded": f"SELECT event_id, user_id, {_hex('user_id')} AS code, {_hex('-user_id')} AS negative_code FROM events",
    "collection_stats": f"WITH {_F} SELECT field, count(*) AS docs, sum(length)::BIGINT AS tokens FROM f GROUP BY field",
    "collection_stats_merged": f"WITH {_F}, {_X} SELECT field, count(*) AS docs, sum(length)::BIGINT AS tokens FROM f WHERE doc_id NOT IN (FROM x) GROUP BY field",
    "time_bounds": f"WITH o AS (SELECT event_id AS doc_id, event_id % 4 AS segment_id, epoch_us(ts) AS real_ts FROM events), e AS (SELECT *, CASE WHEN doc_id = 3 THEN 0 ELSE real_ts END AS ts FROM o) {_BOUNDS}",
    "segment_prune_time": f"WITH {_E}, m AS ({_BOUNDS}) SELECT * FROM m WHERE (time_min = 0 AND time_max = 0) OR (time_min <= {TIME_RANGE[1]} AND time_max >= {TIME_RANGE[0]})",
    "field_rollup": f"WITH v AS (SELECT conv_id, turn, string_split(text, ' ') AS ws FROM conversations WHERE text IS NOT NULL), l AS (SELECT conv_id, sum(len(ws)) AS length FROM v GROUP BY conv_id), t AS (SELECT conv_id, turn, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM v), g AS (SELECT conv_id, term, count(*) AS freq, string_agg(turn || ':' || pos, ' ' ORDER BY turn, pos) AS locs FROM t GROUP BY conv_id, term) SELECT conv_id, term, freq, {_NORM.format('length')} AS norm, locs FROM g JOIN l USING (conv_id)",
    "composite_field": f"WITH {_T}, k AS (SELECT segment_id, doc_num, 'body' AS field, term FROM t UNION ALL SELECT segment_id, doc_num, 'lang', lang FROM d WHERE lang IS NOT NULL UNION ALL SELECT segment_id, doc_num, 'source', source FROM d WHERE source IS NOT NULL) SELECT segment_id, doc_num, term, count(*) AS freq, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM k GROUP BY segment_id, doc_num, term",
    "norms": f"WITH {_F} SELECT segment_id, doc_num, field, length, {_NORM.format('length')} AS norm FROM f",
    "block_bounds": f"WITH {_C} SELECT segment_id, term, chunk, max(freq) AS max_freq, min(norm) AS min_norm, (chunk + 1) * size AS end_doc, count(*) AS n FROM b GROUP BY segment_id, term, chunk, size",
    "skip_blocks": f"WITH {_C}, g AS (SELECT segment_id, term, chunk FROM b GROUP BY segment_id, term, chunk HAVING max(freq) >= 12) SELECT segment_id, doc_num, freq, norm FROM b SEMI JOIN g USING (segment_id, term, chunk) WHERE term = '{TERM}'",
    "vector_cosine": _vector("cosine"),
    "vector_dot": _vector("dot"),
    "vector_l2": _vector("l2"),
    "vector_filtered": _vector("cosine", "label = 3"),
    "vector_multi": _vector("dot", doc="vec_id // 5"),
    "merge_docnums": f"WITH {_R} SELECT segment_id, doc_num, new_doc_num FROM r",
    "merge_postings": f"WITH {_R} SELECT new_doc_num, freq, norm FROM p JOIN r USING (doc_id) WHERE term = '{TERM}'",
    "merge_stats": f"WITH {_F}, {_X} SELECT field, count(*) AS docs, sum(length)::BIGINT AS tokens FROM f WHERE doc_id NOT IN (FROM x) GROUP BY field",
    "merge_fields": f"WITH {_R}, {_S} SELECT DISTINCT field FROM s JOIN r USING (doc_id)",
    "merge_docvalues": f"WITH {_R} SELECT new_doc_num, n_chars AS value FROM d JOIN r USING (doc_id) WHERE n_chars IS NOT NULL",
    "merge_mixed_docvalues": f"WITH {_E} SELECT segment_id, doc_num, {_hex('value')} AS term FROM e WHERE value IS NOT NULL",
    "merge_stored": f"WITH {_R}, {_S} SELECT new_doc_num, field_id, field, ord, value FROM s JOIN r USING (doc_id)",
    "merge_time_bounds": f"WITH {_E}, m AS ({_BOUNDS}) SELECT CASE WHEN count(*) FILTER (time_min = 0 AND time_max = 0) > 0 THEN 0 ELSE min(time_min) END AS time_min, CASE WHEN count(*) FILTER (time_min = 0 AND time_max = 0) > 0 THEN 0 ELSE max(time_max) END AS time_max FROM m",
    "latest_version_drops": "SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n > 1",
}
