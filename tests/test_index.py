"""Parts of the index that no query covers: files, streams, bytes, errors, merges, odd inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quarrydex import functions as fn
from quarrydex import model, sources, streaming
from quarrydex.operators import columns, dictionary, inspect, merge, postings, vectors
from quarrydex.operators.index import DocumentIndex
from quarrydex.operators.numbering import dense_numbers

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def tiny(spark):
    rows = [(0, "apple ball cat", "en", "a", 14), (1, "ball  ball", "en", "b", 10), (2, None, None, "b", None), (4, "été cat", "fr", "a", 7), (5, "", "fr", "c", 0)]
    return spark.createDataFrame(rows, DOCS)


def test_tokens_keep_empty_terms_and_byte_offsets(tiny):
    rows = DocumentIndex(tiny).locations("body").orderBy("doc_id", "pos").select("doc_id", "term", "pos", "start", "end").collect()
    assert [tuple(r) for r in rows] == [(0, "apple", 1, 0, 5), (0, "ball", 2, 6, 10), (0, "cat", 3, 11, 14), (1, "ball", 1, 0, 4), (1, "", 2, 5, 5), (1, "ball", 3, 6, 10), (4, "été", 1, 0, 5), (4, "cat", 2, 6, 9), (5, "", 1, 0, 0)]


def test_term_locations_equal_the_filtered_ones(tiny):
    index = DocumentIndex(tiny)
    for term in ("ball", "cat", "été"):
        a = index.term_locations(term).select("doc_id", "pos", "start", "end").collect()
        b = index.locations("body", F.col("term") == term).select("doc_id", "pos", "start", "end").collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a


def test_persist_and_load(spark, tiny, tmp_path):
    relations = DocumentIndex(tiny).relations()
    sources.persist(relations, str(tmp_path / "s"))
    back = sources.load(spark, str(tmp_path / "s"))
    for name, df in relations.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, back[name].select(df.columns).collect())), name
    with pytest.raises(Exception, match="exists|EXISTS"):
        sources.persist({"fields": relations["fields"]}, str(tmp_path / "s"))


def test_stream_ingest_is_idempotent(spark, tiny, tmp_path):
    for k, part in enumerate((tiny.where("doc_id < 2"), tiny.where("doc_id >= 2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.ingest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    first = sources.load(spark, str(tmp_path / "out"))["stored"].orderBy("segment_id", "doc_num", "field_id").collect()
    assert {r.segment_id for r in first} == {0, 1}
    write = streaming.segment_writer(str(tmp_path / "out"))
    write(tiny.where("doc_id < 2"), 0)
    again = sources.load(spark, str(tmp_path / "out"))["stored"].where("segment_id = 0 and field = '_id'").orderBy("doc_num").collect()
    assert [r.value for r in again] == ["0", "1"]


def test_dense_numbers_over_ranges(spark):
    rng = random.Random(1)
    keys = sorted(rng.sample(range(-500, 10_000), 700))
    df = spark.createDataFrame([(k % 3, k) for k in keys], "g bigint, k bigint")
    got = {(r.g, r.k): r.n for r in dense_numbers(df, ["g"], "k", "n", span=97).collect()}
    for g in range(3):
        own = [k for k in keys if k % 3 == g]
        assert [got[g, k] for k in own] == list(range(len(own)))


def test_prefix_coding_orders_and_round_trips(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 123456789, -987654321]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", fn.prefix_coded(F.col("v")).alias("c")).withColumn("b", fn.prefix_decoded(F.col("c"))).orderBy("c").collect()
    assert [r.v for r in rows] == sorted(values) and all(r.v == r.b for r in rows)


def test_vector_bytes_and_errors():
    assert vectors.encode([1.0]) == bytes.fromhex("49434556 01 01000000 0000803f".replace(" ", ""))
    assert vectors.decode(vectors.encode([0.5, -2.0])) == [0.5, -2.0]
    for bad in ([], [float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            vectors.encode(bad)
    for data in (b"", b"ICEV\x01\x02\x00\x00\x00\x00\x00\x80\x3f", b"XXXX" + vectors.encode([1.0])[4:]):
        with pytest.raises(ValueError):
            vectors.decode(data)


def test_vector_search(spark):
    rows = [(0, [1.0, 0.0]), (0, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [5.0, 0.0])]
    df = spark.createDataFrame(rows, "doc_num bigint, vector array<float>")
    assert [tuple(r) for r in vectors.search(df, [1.0, 0.0], 3, "dot").collect()] == [(2, 5.0), (0, 3.0), (1, 3.0)]
    one = spark.createDataFrame([(0, [3.0, 4.0])], "doc_num bigint, vector array<float>")
    assert [round(vectors.search(one, [1.0, 0.0], 1, m).first().score, 6) for m in ("cosine", "dot", "l2")] == [0.6, 3.0, -20.0]
    for k, metric, query in ((0, "dot", [1.0, 0.0]), (1, "manhattan", [1.0, 0.0]), (1, "dot", []), (1, "cosine", [0.0, 0.0])):
        with pytest.raises(ValueError):
            vectors.search(df, query, k, metric)
    for bad in ([1.0], [float("nan"), 1.0]):
        odd = df.unionByName(spark.createDataFrame([(9, bad)], df.schema))
        with pytest.raises(Exception, match="vector"):
            vectors.search(odd, [1.0, 0.0], 1, "dot").collect()
        assert vectors.search(odd.where("doc_num < 9"), [1.0, 0.0], 1, "dot").count() == 1


def test_dictionary_patterns(spark):
    words = "apple ball cat dog egg fish bat".split()
    df = spark.createDataFrame([(i, w, 1) for i, w in enumerate(words)], "doc_id bigint, term string, freq bigint")
    found = lambda where: sorted(r.term for r in df.where(where).collect())
    assert found(dictionary.with_prefix("b")) == ["ball", "bat"]
    assert found(dictionary.in_range("cat", "egg")) == ["cat", "dog"]
    assert found(dictionary.in_range("cat")) == ["cat", "dog", "egg", "fish"]
    assert [len(found(dictionary.near(*q))) for q in (("summer", 2), ("cat", 1), ("cat", 2), ("cat", 3))] == [0, 2, 2, 5]
    assert found(dictionary.matching("(b|c)at")) == ["bat", "cat"]
    assert [dictionary.literal_prefix(p) for p in ("the(re|an)", "ab*", "a|b", "(a|b)c", "")] == ["the", "a", "", "", ""]
    assert dictionary.successor("\U0010ffff") is None and dictionary.successor("a\U0010ffff") == "b"


def test_fuzzy_query_keeps_every_term_within_the_distance(spark, tmp_path):
    from quarrydex.plans.queries import QUERIES

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    terms = {"there", "here", "été", "chére", "Élere", "érere", "th\U0001d11ere", "\U0001d11e\U0001d11eere", ""} | {"".join(rng.choices("therçéß\U0001d11e", k=rng.randint(1, 8))) for _ in range(2000)}
    spark.createDataFrame([(k, t, "fr", "a", len(t)) for k, t in enumerate(sorted(terms))], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.term for r in QUERIES["dict_fuzzy"](spark, str(tmp_path)).collect()}
    assert got == {t for t in terms if distance(t, "there") <= 2} and {"chére", "Élere", "th\U0001d11ere"} <= got


def test_merge_equals_building_the_survivors(spark, tiny):
    drops = spark.createDataFrame([(1,), (4,)], "doc_id bigint")
    index = DocumentIndex(tiny)
    numbers = merge.renumbered(index.numbers, drops)
    assert [r.new_doc_num for r in numbers.orderBy("new_doc_num").collect()] == [0, 1, 2]
    rebuilt = DocumentIndex(tiny.join(drops, "doc_id", "left_anti"))
    a = merge.moved(index.postings("body"), numbers).select("doc_id", "term", "freq", "norm").collect()
    b = rebuilt.postings("body").select("doc_id", "term", "freq", "norm").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    everything = tiny.select("doc_id")
    assert merge.renumbered(index.numbers, everything).count() == 0


def test_mixed_columns_become_terms(spark):
    values = spark.createDataFrame([(0, 0, 5), (1, 0, -7)], "segment_id bigint, doc_num bigint, value bigint")
    mixed = spark.createDataFrame([(0, True), (1, False)], "segment_id bigint, is_numeric boolean")
    assert all(r.number is None and len(r.term) == 22 for r in merge.mixed_terms(values, mixed).collect())
    assert sorted(r.number for r in merge.mixed_terms(values, mixed.where("is_numeric")).collect()) == [-7, 5]


def test_time_bounds(spark):
    rows = [(0, 10), (0, 30), (1, -30), (1, -10), (2, 5), (2, 0), (3, None)]
    got = {r.segment_id: (r.time_min, r.time_max) for r in columns.time_bounds(spark.createDataFrame(rows, "segment_id bigint, ts bigint")).collect()}
    assert got == {0: (10, 30), 1: (-30, -10), 2: (0, 0), 3: (0, 0)}
    meta = columns.time_bounds(spark.createDataFrame(rows[:5], "segment_id bigint, ts bigint"))
    assert sorted(r.segment_id for r in columns.overlapping(meta, 6, 20).collect()) == [0]


def test_advance_against_a_walk(spark):
    rng = random.Random(2)
    docs = sorted(rng.sample(range(400), 60))
    rows = spark.createDataFrame([(0, n) for n in docs], "segment_id bigint, doc_num bigint")
    targets = spark.createDataFrame([(s, t) for s in (0, 1) for t in range(0, 420, 7)], "segment_id bigint, target bigint")
    for r in postings.advance(rows, targets, span=32).collect():
        assert r.doc_num == (min((n for n in docs if n >= r.target), default=None) if r.segment_id == 0 else None)


def test_numeric_range_edges(spark):
    rows = spark.createDataFrame([(0, 0, 5), (0, 0, -5), (0, 1, 7)], "segment_id bigint, doc_num bigint, value bigint")
    assert [columns.numeric_range(rows, lo, hi).count() for lo, hi in ((5, 7), (-5, 5), (8, 1), (7, 7))] == [2, 1, 0, 1]


def test_empty_documents(spark):
    index = DocumentIndex(spark.createDataFrame([], DOCS))
    assert index.postings("body").count() == 0 and index.numbers.count() == 0
    assert {k: v.count() for k, v in index.relations().items()} == dict.fromkeys(model.SCHEMAS, 0)


def test_inspection_of_persisted_segments(spark, tiny, tmp_path):
    sources.persist(DocumentIndex(tiny).relations(), str(tmp_path / "s"))
    rel = sources.load(spark, str(tmp_path / "s"))
    assert {r.segment_id: r.num_docs for r in inspect.footer(rel).collect()} == {0: 2, 1: 2, 2: 1} and inspect.footer(rel, 2).count() == 1
    assert [(r.field, r.docs, r.tokens) for r in inspect.fields(rel, 0).collect()] == [("_id", 2, 2), ("body", 2, 5), ("lang", 2, 2), ("source", 2, 2)]
    assert [(r.term, r.doc_freq) for r in inspect.dictionary(rel, 0, "body").collect()] == [("apple", 1), ("ball", 1), ("cat", 2), ("été", 1)]
    assert inspect.dictionary(rel, 0, "unknown").count() == 0
    assert [(r.doc_num, [x.start for x in r.locs]) for r in inspect.explore(rel, 0, "body", "cat").collect()] == [(0, [11]), (1, [6])]
    assert [r.value for r in inspect.stored(rel, 1, 0).collect()] == ["1", "ball  ball", "en", "10", "b"] and inspect.stored(rel, 1, 99).count() == 0
    got = [(r.field, r.term, r.value) for r in inspect.docvalues(rel, 1, 0, ["source", "n_chars", "none", "source"]).collect()]
    assert got == [("source", "b", None), ("n_chars", None, 10), ("source", "b", None)]
    assert all(v > 0 for v in inspect.size_in_bytes(rel).values())


def test_merged_relations_equal_the_rebuilt_survivors(spark, tiny):
    relations = DocumentIndex(tiny).relations()
    drops = spark.createDataFrame([(1, 0), (0, 1)], "segment_id bigint, doc_num bigint")  # documents 1 and 4
    merged, numbers = merge.merge_relations(relations, drops)
    assert sorted((r.segment_id, r.doc_num, r.new_doc_num) for r in numbers.collect()) == [(0, 0, 0), (1, 1, 1), (2, 0, 2)]
    kept = tiny.where("doc_id in (0, 5, 2)").withColumn("doc_id", F.expr("case doc_id when 0 then 0 when 5 then 1 else 2 end").cast("bigint"))
    rebuilt = DocumentIndex(kept, segments=1).relations()
    for name in ("postings", "dictionary", "docvalues", "numcol", "fields", "segment_meta"):
        rows = lambda r: sorted(str(tuple(x[c] for c in r[name].columns)) for x in r[name].where("field <> '_id'" if "field" in r[name].columns else "true").collect())
        assert rows(merged) == rows(rebuilt), name
    everything = relations["stored"].select("segment_id", "doc_num").distinct()
    none, _ = merge.merge_relations(relations, everything)
    assert none["segment_meta"].first().num_docs == 0 and all(none[n].count() == 0 for n in none if n != "segment_meta")


def test_merging_typed_and_term_columns(spark, tiny):
    relations = DocumentIndex(tiny).relations()
    terms = relations["docvalues"].unionByName(spark.createDataFrame([(2, 0, "n_chars", 0, "x")], relations["docvalues"].schema))
    merged, _ = merge.merge_relations(relations | {"docvalues": terms}, spark.createDataFrame([], "segment_id bigint, doc_num bigint"))
    assert merged["numcol"].count() == 0
    assert sum(len(r.term) == 22 for r in merged["docvalues"].where("field = 'n_chars'").collect()) == 4


def test_bitmaps(spark):
    rows = lambda docs: spark.createDataFrame([(0, n) for n in docs], "segment_id bigint, doc_num bigint")
    a, b = rows([0, 5, 40_000, 70_000]), rows([5, 6, 40_000, 99_999])
    both = a.unionByName(b).distinct()
    assert sorted((r.bucket, r.docs) for r in postings.union_bitmap(both).collect()) == [(0, 3), (1, 1), (2, 1), (3, 1)]
    assert sorted((r.bucket, r.docs) for r in postings.intersection_bitmap(a, b).collect()) == [(0, 1), (1, 1)]


def test_literal_prefixes_lose_no_match(spark):
    """Filters of patterns against Python's matches, with alternatives behind groups, in classes, escaped and quantified."""
    words = ["ab", "cd", "a", "b", "abc", "abd", "acd", "a|b", "(ab", "xab", "ab|cd", "", "abab", "cdcd", "a]b", "a(b", "the", "there"]
    df = spark.createDataFrame([(w,) for w in words], "term string")
    import re

    for pattern in ("a(b)|c(d)", "(a)(b)|(c)", "a[|]b", "a\\|b", "(a|x)ab|cd", "ab*", "ab?c", "ab{0,2}", "a+b", "[a-c]b|the.*", "a[]|]b", "a[^)]b|(cd)+", "a\\(b|cd", "(?:ab|cd)+", "the(re)?", "ab|", ".*", "a(b|c)d"):
        want = sorted(w for w in words if re.fullmatch(pattern, w)) if "[]" not in pattern else None  # Java reads an empty class otherwise
        got = sorted(r.term for r in df.where(dictionary.matching(pattern)).collect()) if want is not None else None
        assert got == want, pattern
    rng = random.Random(4)
    for _ in range(60):
        pattern = "".join(rng.choice(["a", "b", "c", "d", "(", ")", "|", "[ab]", "?", "*", "\\|"]) for _ in range(rng.randint(1, 7)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        if re.search(r"[?*][?*]|[(|][?*]", pattern) or pattern[0] in "?*":
            continue  # possessive and lazy forms
        lead = dictionary.literal_prefix(pattern)
        assert all(w.startswith(lead) for w in words if compiled.fullmatch(w)), pattern


def test_column_values_of_ids_and_unknown_fields(tiny):
    index = DocumentIndex(tiny)
    got = [(r.doc_id, r.req_pos, r.field, r.term) for r in index.docvalues(["_id", "none", "lang"]).orderBy("doc_id", "req_pos").collect()]
    assert got[:2] == [(0, 0, "_id", "0"), (0, 2, "lang", "en")] and (2, 0, "_id", "2") in got and not any(r[0] == 2 and r[2] == "lang" for r in got)
    assert index.docvalues(["none"]).count() == 0 and index.docvalues([]).count() == 0 and index.docvalues(["body"]).count() == 0
    assert index.terms("none").count() == 0 and index.postings("none").count() == 0


def test_one_hit_terms_have_no_locations(tiny):
    rows = DocumentIndex(tiny).relations()["postings"]
    found = {(r.field, r.term) for r in postings.one_hit(rows).collect()}
    assert ("_id", "0") in found and ("source", "c") in found and not any(f == "body" for f, _ in found)


def test_time_bounds_of_built_segments(spark, tmp_path):
    rows = [(0, "a", 50), (1, "b", -7), (2, "c", 20), (3, "d", -3), (4, "e", 10), (5, "f", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ts bigint")
    fields = (model.Field("_id", "doc_id"), model.Field("text", kind="text"))
    index = DocumentIndex(df, segments=3, fields=fields, time_column="ts").write(str(tmp_path / "s"))
    got = {r.segment_id: (r.num_docs, r.time_min, r.time_max) for r in index["segment_meta"].collect()}
    assert got == {0: (2, -3, 50), 1: (2, -7, 10), 2: (2, 0, 0)}
    assert tuple(merge.source_bounds(index["segment_meta"]).first()) == (0, 0)
    assert tuple(merge.source_bounds(index["segment_meta"].where("segment_id < 2")).first()) == (-7, 50)
    merged, _ = merge.merge_relations({k: v.where("segment_id < 2") for k, v in index.items()}, spark.createDataFrame([(0, 0)], "segment_id bigint, doc_num bigint"))
    assert tuple(merged["segment_meta"].first()) == (0, 3, -7, 50)  # of the sources, though the document at 50 is gone


def test_repeated_composite_and_vector_fields(spark, tmp_path):
    rows = [(0, ["a b", None, "b"], "x", [[1.0, 2.0], [3.0, 4.0]], [5, 3, 5]), (1, [], None, None, None), (2, ["b b"], "a", [[0.5, 0.5]], [1])]
    df = spark.createDataFrame(rows, "key bigint, texts array<string>, tag string, v array<array<float>>, n array<bigint>")
    fields = (
        model.Field("_id", "key"), model.Field("body", "texts", "text", docvalues=True), model.Field("tag", norm=lambda n: n * F.lit(2.0)),
        model.Field("all", kind="composite", of=("body", "tag")), model.Field("v", kind="vector"), model.Field("n", kind="numeric", docvalues=True),
    )
    index = DocumentIndex(df, segments=1, fields=fields, id_column="key").write(str(tmp_path / "s"))
    got = {(r.doc_num, r.field, r.term): (r.freq, round(r.norm, 6), [tuple(x) for x in r.locs]) for r in index["postings"].collect()}
    norm = round(3**-0.5, 6)
    assert got[0, "body", "b"] == (2, norm, [("body", 2, 2, 3), ("body", 1, 0, 1)])  # values in order, the norm of their summed length
    assert got[0, "all", "b"] == (2, 0.5, [("body", 2, 2, 3), ("body", 1, 0, 1)]) and got[0, "all", "x"] == (1, 0.5, [("tag", 1, 0, 1)])
    assert got[2, "all", "a"][2] == [("tag", 1, 0, 1)] and got[2, "tag", "a"] == (1, 2.0, []) and got[2, "body", "b"][0] == 2
    assert not any(d == 1 and f != "_id" for d, f, _ in got)
    assert [(r.doc_num, r.ord, r.vector) for r in index["vectors"].orderBy("doc_num", "ord").collect()] == [(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0]), (2, 0, [0.5, 0.5])]
    assert [(r.doc_num, r.ord, r.value) for r in index["numcol"].orderBy("doc_num", "ord").collect()] == [(0, 0, 5), (0, 1, 3), (0, 2, 5), (2, 0, 1)]
    assert [r.term for r in index["docvalues"].where("field = 'body' and doc_num = 0").orderBy("ord").collect()] == ["a", "b"]
    assert [(r.field, r.ord, r.value) for r in index["stored"].where("doc_num = 0 and field = 'body'").orderBy("ord").collect()] == [("body", 0, "a b"), ("body", 1, "b")]
    assert vectors.search(index["vectors"], [1.0, 0.0], 1, "dot").first().doc_num == 0
    merged, _ = merge.merge_relations(index, spark.createDataFrame([(0, 0)], "segment_id bigint, doc_num bigint"))
    assert [(r.doc_num, r.vector) for r in merged["vectors"].collect()] == [(1, [0.5, 0.5])]
    assert {(r.field, r.docs, r.tokens) for r in merged["fields"].collect()} == {("_id", 2, 2), ("body", 1, 2), ("tag", 1, 1), ("all", 1, 3)}
    for bad in ({"kind": "other"}, {"kind": "composite"}, {"of": ("body",)}):
        with pytest.raises(ValueError):
            model.Field("f", **bad)
    for bad in ((fields[0], fields[0]), (model.Field("all", kind="composite", of=("none",)),)):
        with pytest.raises(ValueError):
            DocumentIndex(df, fields=bad, id_column="key")


def test_an_analyzer_of_the_caller(spark):
    df = spark.createDataFrame([(0, "One, two;TWO")], "doc_id bigint, text string")
    index = DocumentIndex(df, fields=(model.Field("body", "text", "text"),), analyzer=lambda t: F.split(F.lower(t), "[^a-z]+"))
    assert sorted((r.term, r.freq) for r in index.postings("body").collect()) == [("one", 1), ("two", 2)]


def test_numbers_of_sparse_and_clustered_keys(spark):
    rng = random.Random(6)
    keys = sorted({rng.getrandbits(62) for _ in range(3000)} | set(range(3000)) | {2**62 + 1})
    df = spark.createDataFrame([(k % 2, k) for k in keys], "g bigint, k bigint")
    rows = dense_numbers(df, ["g"], "k", "n", span=500)
    got = {(r.g, r.k): r.n for r in rows.collect()}
    for g in range(2):
        assert [got[g, k] for k in keys if k % 2 == g] == list(range(sum(k % 2 == g for k in keys)))


def test_blocks_and_skips_against_a_walk(spark):
    rng = random.Random(9)
    docs = 5000
    rows = [(0, n, "body", t, rng.randint(1, 9), rng.random()) for t, share in (("hot", 0.9), ("rare", 0.01)) for n in range(docs) if rng.random() < share]
    found = spark.createDataFrame(rows, "segment_id bigint, doc_num bigint, field string, term string, freq bigint, norm float")
    terms = found.groupBy("segment_id", "field", "term").agg(F.count("*").alias("doc_freq"))
    meta = spark.createDataFrame([(0, docs)], "segment_id bigint, num_docs bigint")
    want: dict = {}
    for term in ("hot", "rare"):
        own = [r for r in found.collect() if r.term == term]
        size = docs // (len(own) // 1024 + 1)
        for r in own:
            want.setdefault((term, r.doc_num // size, size), []).append(r)
    bounds = postings.block_bounds(found, terms, meta)
    got = {(r.term, r.chunk): (r.max_freq, r.min_norm, r.end_doc, r.n) for r in bounds.collect()}
    assert got == {(t, c): (max(r.freq for r in v), min(r.norm for r in v), (c + 1) * size, len(v)) for (t, c, size), v in want.items()}
    for least in (0.0003, 0.5):
        passing = sorted(r.doc_num for (t, _, _), v in want.items() if t == "hot" and min(r.norm for r in v) >= least for r in v)
        hot = found.where("term = 'hot'")
        assert sorted(r.doc_num for r in postings.skip_blocks(hot, bounds.where("term = 'hot'"), terms, meta, F.col("min_norm") >= least).collect()) == passing


def test_scans_of_a_written_index_push_their_filters(spark, small):
    from quarrydex.plans.queries import QUERIES

    for name, filters in (("dict_prefix", ("EqualTo(field,body)", "GreaterThanOrEqual(term,tion)", "LessThan(term,tioo)")), ("term_postings", ("EqualTo(field,body)", "EqualTo(term,the)"))):
        plan = spark._jvm.PythonSQLUtils.explainString(QUERIES[name](spark, small)._jdf.queryExecution(), "formatted")
        assert all(f in plan for f in filters), plan


def test_a_cancelled_merge_leaves_no_result(spark, tiny, tmp_path):
    """Cancelling the job group of a merge fails its write; the sources stay and merge again."""
    import threading
    import time

    relations = DocumentIndex(tiny).relations()
    none = spark.createDataFrame([], "segment_id bigint, doc_num bigint")
    slow = F.udf(lambda x: time.sleep(30) or x, "bigint")
    merged, _ = merge.merge_relations(relations, none)
    failed = []

    def run():
        spark.sparkContext.setJobGroup("merge", "a merge", True)
        try:
            merged["postings"].withColumn("doc_num", slow("doc_num")).write.parquet(str(tmp_path / "out"))
        except Exception as e:
            failed.append(str(e))

    from pyspark import InheritableThread

    worker = InheritableThread(target=run)
    worker.start()
    tracker = spark.sparkContext.statusTracker()
    until = time.time() + 60
    while not failed and time.time() < until and not any((tracker.getJobInfo(j) or None) and tracker.getJobInfo(j).status == "RUNNING" for j in tracker.getJobIdsForGroup("merge")):
        time.sleep(0.2)
    while worker.is_alive() and time.time() < until:
        spark.sparkContext.cancelJobGroup("merge")
        time.sleep(0.2)
    worker.join(30)
    assert failed and "cancel" in failed[0].lower() and not (tmp_path / "out" / "_SUCCESS").exists()
    assert merged["postings"].count() == relations["postings"].count()


def test_a_failed_build_leaves_no_segment(spark, tiny, tmp_path):
    """An error while documents are read fails the build, and again when tried again; nothing loads as a segment."""
    bad = tiny.withColumn("text", F.when(F.col("doc_id") == 1, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    for _ in range(2):
        with pytest.raises(Exception, match="broken"):
            DocumentIndex(bad).write(str(tmp_path / "s"))
    assert sources.load(spark, str(tmp_path / "s"))["postings"].count() == 0
