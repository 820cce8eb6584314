"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force, round trips or held-out labels.

The rest: op1, op7 and op10 need a tokenizer, op5 XXH64, op3 mines rules, op6 is
trained, op9 aligns.
"""

from __future__ import annotations

from quarrydex.llm.quality_rules import BASE_FAILED, STOP_WORDS, compiled

_BLANK = r"[ \t\n\x0B\f\r]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '')"
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM d WHERE len(ws) >= 8),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i + 7], ' ')) AS n FROM w),
s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM g WHERE n > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(j - i, 8)))::BIGINT AS n_repeat_words FROM s GROUP BY doc_id),
m AS (
    SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_same_next, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM d LEFT JOIN r USING (doc_id)
)
SELECT *, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND {compiled()} AS kept FROM m
"""

_NORMAL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS ws FROM documents),
b AS (SELECT item_id, {_NORMAL} AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT n FROM v),
p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, k WHERE len(ws) >= n),
h AS (SELECT DISTINCT p.doc_id, p.i, p.n, v.item_id FROM p JOIN v ON v.n = p.n AND v.win = array_to_string(p.ws[p.i:p.i + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM w),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM n WHERE n > 1),
t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept FROM t ANTI JOIN x USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_quality_rules": OP2, "op4_benchmark_decontamination": OP4, "op8_substring_dedup": OP8}
