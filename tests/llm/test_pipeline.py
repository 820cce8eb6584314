"""The stages against brute force, each on its own input."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from test_operators import fingerprint, hit, linked, measures, pairs, removed, words


def test_stages(spark, small, docs, tmp_path):
    bench = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    df, rows = docs, dict(pairs(docs))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, df, small)
        out.write.parquet(str(tmp_path / str(k)))
        df = spark.read.parquet(str(tmp_path / str(k)))
        assert df.schema == docs.schema, name
        new = dict(pairs(df))
        if k == 0:
            base = {i for i, t in rows.items() if (m := measures(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
            assert set(new) <= base and len(new) > 0.9 * len(base) and all(new[i] == rows[i] for i in new)
        if k == 1:
            ids = sorted(rows)
            group = linked([fingerprint(rows[i]) for i in ids])
            assert set(new) == {ids[g] for g in group} and all(new[i] == rows[i] for i in new)
        if k == 2:
            want = {i: h for i, _, _, h in removed(sorted(rows.items()))}
            assert {i: hashlib.sha256(" ".join(words(t)).encode()).hexdigest() for i, t in new.items()} == want
        if k == 3:
            judged = {i: (n, bad) for i, _, n, _, _, bad in hit(rows.items(), bench)}
            assert set(new) == {i for i, (_, bad) in judged.items() if not bad}
            assert all(new[i] == rows[i] for i in new if not judged[i][0])
            assert not any(n for _, _, n, _, _, _ in hit(new.items(), bench))
        rows = new
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter({i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows.items()})
    out = corpus_pipeline.STAGES[-1][1](spark, df, small).collect()
    got: Counter = Counter()
    for r in out:
        got[r.doc_id] += r.length
    assert got == want
    ran = __spark_entry__.queries()["pipeline"](spark, small)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in ran.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in out)


def test_odd_inputs(spark, small, odd, empty):
    for df in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, small)
            assert out.columns == df.columns
            assert out.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, small).count() >= df.count()
