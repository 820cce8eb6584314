"""The registered queries as they are: against DuckDB where there is SQL, against brute force or round trips elsewhere."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from quarrydex.llm import license_scan, queries, token_counts, url_filter
from test_operators import fingerprint, linked, pairs


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, small, duck, name):
    df = queries.QUERIES[name](spark, small)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(cursor.fetchall())


def test_token_counts_and_files(spark, small, docs):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = dict(pairs(docs))
    ids = {i: plain.encode(t or "", add_special_tokens=False).ids for i, t in rows.items()}
    assert {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, small).collect()} == {i: len(x) for i, x in ids.items()}
    start, want = 0, {}
    for i in sorted(rows):
        own = np.array([*ids[i], 2], "<u4")
        want[i] = (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_files(spark, small).collect()} == want


def test_url_verdicts(spark, small, duck):
    got = queries.op3_url_filters(spark, small).collect()
    urls = dict(duck.execute("SELECT page_id, url FROM pages").fetchall())
    assert Counter(r.page_id for r in got) == Counter(list(urls))
    mined = url_filter.mine(url_filter.labelled_pages(spark.read.parquet(f"{small}/pages.parquet"), spark.read.parquet(f"{small}/labels.parquet"))).collect()
    tokens = {r.url: set(r.t) for r in spark.createDataFrame([(u,) for u in set(urls.values())], "url string").select("url", url_filter.tokens(F.col("url")).alias("t")).collect()}
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    for r in got:
        rest = (urls[r.page_id] or "").partition("://")[2]
        host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
        path = rest[len(host) :].partition("?")[0].partition("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fixed = next(((v, h + p) for v, h, p in rules if (host == h or host.endswith(f".{h}")) and path.startswith(p)), None)
        blocked = any(set(m.words) <= tokens[urls[r.page_id]] for m in mined)
        assert (r.host, r.path) == (host, path)
        assert (r.verdict, r.rule) == (fixed or ("block" if blocked else "allow", None))


def test_near_duplicates_and_toxicity(spark, small, docs):
    rows = pairs(docs)
    fps = [fingerprint(t) for _, t in rows]
    group = linked(fps)
    least = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in set(group)}
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op5_simhash_near_dedup(spark, small).collect()} == {(i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, group)}
    out = queries.op6_toxicity(spark, small).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in out)


def test_licenses(spark, small, docs):
    """Each match is as good as any alignment of its template over the whole text, and no template that aligns well enough in a band is missed."""
    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    got: dict = {}
    for r in queries.op9_license_scans(spark, small).collect():
        got.setdefault(r.doc_id, []).append(r)
    import pyarrow as pa

    from quarrydex.llm import flattext as ft

    for i, t in pairs(docs):
        (_, _, own), = ft.slices(pa.array([t], pa.string()), 1 << 30)
        joined, _, _, _ = ft.joined(own, ft.ALNUM_WORDS, lower=True)
        words = joined.data[: joined.off[-1]].tobytes().split()
        for name, template in zip(index.names, index.words):
            places = {w: [k for k, x in enumerate(template) if x == w] for w in template}
            lines = Counter(p - k for p, w in enumerate(words) for k in places.get(w, ()))
            best = 0
            for low in sorted(lines):  # bands that begin at a diagonal with an equal word
                if sum(n for d, n in lines.items() if low <= d <= low + 2 * license_scan.BAND) >= license_scan.LEAST * len(template):
                    best = max(best, license_scan.align(template, words, low, low + 2 * license_scan.BAND)[0])
            own_rows = [r for r in got.get(i, ()) if r.license == name]
            if best >= license_scan.LEAST * len(template):  # found, unless a match of more words lies over it
                assert any(r.matched_words >= best for r in got.get(i, ())), (i, name)
            for r in own_rows:
                assert r.matched_words <= len(template) and r.coverage >= license_scan.LEAST and r.end_word <= len(words)


def test_packing(spark, small, docs):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = queries.op10_best_fit_packing(spark, small).collect()
    want = Counter()
    for i, t in pairs(docs):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    at: Counter = Counter()
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096 and len(at) == -(-sum(at.values()) // 4096)


def test_edits_keep_the_text_but_for_repeated_lines(docs):
    for _, t in pairs(docs)[:50]:
        for a, z, new in token_counts.repeated_lines(t or ""):
            assert new == "" and (t or "").encode()[a:z]
