"""Operators against brute force on small tables, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrydex.llm import decontaminate, license_scan, packing, quality_rules, queries, simhash, substring_dedup, token_counts, token_files, toxicity, url_filter
from quarrydex.llm.scratch import Scratch, fresh, keyed, shared_dir

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# quality rules


def measures(t):
    w = words(t)
    seen: dict = {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {x for v in seen.values() if len(v) > 1 for k in v for x in range(k, k + 8)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, odd):
    for df in (docs, odd):
        texts = Counter((i, *measures(t)) for i, t in pairs(df))
        got = Counter(tuple(r) for r in quality_rules.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
        assert got == texts


def test_quality_kept_rows(spark, docs, odd, empty):
    for df in (docs, odd, empty):
        out = quality_rules.kept(df)
        assert out.columns == df.columns and out.count() == quality_rules.judge(df).where("kept").count()
    rule = quality_rules.Rule("r", "a", "b", least=(1, 2), most=(3, 1))
    assert rule.sql() == "a * 2 >= 1 * b AND a * 1 <= 3 * b" and quality_rules.compiled(()) == "TRUE"
    edge = spark.createDataFrame([(1, " ".join(["the"] * 5 + [f"word{i}" for i in range(15)])), (2, " ".join(f"word{i}" for i in range(19)))], "doc_id bigint, text string")
    assert [r.kept for r in quality_rules.judge(edge).orderBy("doc_id").collect()] == [True, False]


def test_quality_needs_a_stop_word_in_a_hundred(spark):
    lists = [["der"] * n + [f"word{i}" for i in range(size - n)] for n, size in ((0, 20), (0, 100), (1, 100), (1, 101), (2, 101), (12, 20), (13, 20))]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lists)], "doc_id bigint, text string")
    assert [r.n_stop_words for r in quality_rules.judge(rows).orderBy("doc_id").collect()] == [0, 0, 1, 1, 2, 12, 13]
    assert [r.doc_id for r in quality_rules.judge(rows).where(quality_rules.RULES[2].sql()).orderBy("doc_id").collect()] == [2, 4, 5]
    assert {r.doc_id for r in quality_rules.kept(rows).collect()} & {0, 1, 3} == set()


# URL filters


def test_url_rules(spark):
    urls = ["https://Example.ORG/es/1?x", "http://a.example.org/en/12", "http://a.example.org/en/2", "http://x.com/de/1", "http://x.com/fr/1", "http://x.com/en/1", "nourl", None, "http://x.org", "http://x.org?/es/", "ftp://notexample.org/en/1#f", "a://b://c/d"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filtered(pages, none).collect()}
    assert got == {
        0: ("example.org", "/es/1", "example.org/es/", "block"), 1: ("a.example.org", "/en/12", "example.org/en/1", "block"), 2: ("a.example.org", "/en/2", "org/", "allow"),
        3: ("x.com", "/de/1", "com/de/", "block"), 4: ("x.com", "/fr/1", "com/fr/", "allow"), 5: ("x.com", "/en/1", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("x.org", "", None, "allow"), 9: ("x.org", "", None, "allow"), 10: ("notexample.org", "/en/1", "org/", "allow"), 11: ("b:", "//c/d", None, "allow"),
    }


def test_ten_bad_pages_make_a_rule_in_a_table_of_any_size(spark):
    host = F.when(F.col("id") < 10, "rare.bad").when(F.col("id") < 19, "nine.bad").otherwise(F.concat(F.lit("h"), F.col("id") % 300, F.lit(".net")))
    for n in (3000, 13000):
        labelled = spark.range(n).select(F.concat(F.lit("http://"), host, F.lit("/x/"), F.col("id")).alias("url"), (F.col("id") < 19).alias("bad"))
        pages = spark.createDataFrame([(1, "http://rare.bad/y/1"), (2, "http://h7.net/x/2"), (3, "http://nine.bad/y/3")], "page_id bigint, url string")
        rules = {tuple(r.words): round(r.support * n) for r in url_filter.mine(labelled).collect()}
        assert rules["name=rare",] == 10 and not any("name=nine" in words for words in rules)
        assert {r.page_id for r in url_filter.filtered(pages, labelled, ()).collect() if r.verdict == "block"} == {1, 3}  # both hosts end in .bad


def test_mined_url_rules_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        host, lang = rng.choice(["win.casino.net", "m.news.net", "blog.x.net"]), rng.choice(["en", "fr"])
        bad = host == "win.casino.net" and lang == "fr" or rng.random() < 0.05
        rows.append((f"http://{host}/{lang}/{i}", bad))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_filter.mine(labelled, 0.02, 0.7).collect()
    tokens = {r.url: set(r.t) for r in labelled.select("url", url_filter.tokens(F.col("url")).alias("t")).collect()}
    assert rules
    for r in rules:
        has = [bad for url, bad in rows if set(r.words) <= tokens[url]]
        assert abs(r.confidence - sum(has) / len(has)) < 1e-9 and r.confidence >= 0.7 and sum(has) / len(rows) >= 0.02
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)] * 2, "page_id bigint, url string")
    got = url_filter.filtered(pages, labelled, (), 0.02, 0.7).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        assert (r.verdict == "block") == any(set(x.words) <= tokens[rows[r.page_id][0]] for x in rules)


def brute_rules(rows, tokens, min_pages, min_confidence, min_lift=url_filter.MIN_LIFT):
    """All sets of up to three tokens that pass, less those with a part as confident; of tokens that the same URLs have only the first counts."""
    from itertools import combinations

    of: dict = {}
    for k, (url, _) in enumerate(rows):
        for w in tokens[url]:
            of.setdefault(w, set()).add(k)
    first = {frozenset(v): min(w for w in of if of[w] == v) for v in of.values()}
    bad = {k for k, (_, b) in enumerate(rows) if b}
    found = {}
    for size in (1, 2, 3):
        for words_ in combinations(sorted(first.values()), size):
            has = set.intersection(*(of[w] for w in words_))
            n = len(has & bad)
            if n >= min_pages and n >= min_confidence * len(has) and n * len(rows) >= min_lift * len(bad) * len(has):
                found[words_] = n / len(has)
    return {w: c for w, c in found.items() if not any(set(x) < set(w) and found[x] >= c for x in found)}


def test_all_rules_of_brute_force_are_found(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        names = [n for n in ("a", "b", "c", "d", "e", "f", "g", "h", "k", "m", "n", "o") if rng.random() < 0.7]  # more tokens than a basket has
        host = rng.choice(["one.org", "two.net", "m.two.net"])
        bad = ("a" in names and "f" not in names and host == "one.org") or (host == "m.two.net" and rng.random() < 0.8) or rng.random() < 0.1
        rows.append((f"http://{host}/p{i % 3}/{i}?" + "&".join(f"{n}={i}" for n in names), bad))
    rows += rows[:25]
    labelled = spark.createDataFrame([*rows, (None, True), ("nourl", True), ("http://x.org/1", None)], "url string, bad boolean")
    tokens = {r.url: set(r.t) for r in labelled.select("url", url_filter.tokens(F.col("url")).alias("t")).collect()}
    rows.append(("nourl", True))
    got = {tuple(r.words): r.confidence for r in url_filter.mine(labelled, min_pages=6, min_confidence=0.7).collect()}
    want = brute_rules(rows, tokens, 6, 0.7)
    assert len(want) > 5 and any(len(w) == 3 for w in want)
    assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in want)


def test_planted_rules_judge_pages_of_the_registered_query(spark, tmp_path):
    rng = random.Random(3)
    label, pages = [], []
    for i in range(600):
        host = rng.choice(["spam.win", "good.net", "m.good.net", "fine.dev"])
        label.append((i, 0 if host == "spam.win" or (host == "m.good.net" and i % 2) else 1, 0))
        pages.append((i, f"https://{host}/{'ads' if i % 2 else 'en'}/{i}", None))
    pages += [(1000, "https://x.spam.win/new", "h"), (1001, "https://good.net/ads/x", None), (1002, None, None), (None, "https://spam.win/none", None), (1003, "https://sub.example.org/es/spam.win", None)]
    spark.createDataFrame(label, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for name in ("host", "tokens", "key", "words", "n"):  # extra columns of clashing names
        table = table.withColumn(name, F.lit("clash"))
    table.write.parquet(str(tmp_path / "pages.parquet"))
    out = {r.page_id: r for r in queries.op3_url_filters(spark, str(tmp_path)).collect()}
    assert len(out) == len(pages)
    for i, (_, quality, _) in enumerate(label):
        assert (out[i].verdict == "block") == (quality == 0), pages[i]
    assert out[1000].verdict == out[None].verdict == "block" and "name=win" in out[1000].blocked_by or "name=spam" in out[1000].blocked_by
    assert out[1001].verdict == out[1002].verdict == "allow" and out[1003].rule == "example.org/es/" and out[1003].verdict == "block"
    marked = url_filter.labelled_pages(table, spark.createDataFrame(label, "doc_id bigint, quality int, toxic int"))
    quality = url_filter.held_out_quality(marked).first()
    assert quality.blocked == quality.blocked_bad == quality.bad > 0


def test_url_filter_of_empty_tables(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.mine(none).count() == 0 and url_filter.filtered(pages, none).count() == 0
    some = spark.createDataFrame([(f"http://h.org/{i}", True) for i in range(20)], none.schema)
    assert url_filter.filtered(pages, some).count() == 0 and url_filter.mine(some).count() == 0  # all URLs bad: no rule says more


# decontamination


def hit(rows, items, length=13):
    tok = lambda t: [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))]
    windows: dict = {}
    for i, t in items:
        w = tok(t)
        for k in range(max(1, len(w) - length + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + length]), set()).update([] if i is None else [str(i)])
    for i, t in rows:
        w = tok(t)
        mask, found = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    mask[k : k + n] = [1] * n
        n = sum(mask)
        yield i, len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_contamination(spark, small, docs, odd, block):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    for df in (docs, odd):
        got = Counter(tuple(r)[:6] for r in decontaminate.contamination(df, bench, block_bytes=block).collect())
        assert got == Counter(hit(pairs(df), [tuple(r) for r in bench.select("item_id", "text").collect()]))


def test_contamination_of_random_words(spark):
    rng = random.Random(7)
    line = lambda n: " ".join(rng.choices("abc", k=n))
    items = [(i, line(rng.choice([2, 3, 4, 5, 6, 9]))) for i in range(12)] + [(3, "a a"), (None, "c c c c c"), (50, None), (51, ""), (52, "Z!z")]
    rows = [(i, line(rng.choice([0, 1, 5, 40]))) for i in range(60)] + [(99, "z Z"), (100, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (1 << 20, 300):
        got = Counter(tuple(r)[:6] for r in decontaminate.contamination(df, bench, length=4, block_bytes=block).collect())
        assert got == Counter(hit(rows, items, 4))
    for single in ([(1, "a")], []):  # words of one letter run over the ends of documents
        got = Counter(tuple(r)[:6] for r in decontaminate.contamination(df, spark.createDataFrame(single, bench.schema)).collect())
        assert got == Counter(hit(rows, single))


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_cleaned(spark, block):
    item = " ".join(f"q{i}" for i in range(15))
    rows = [(1, f"{item} some", "e", 1), (2, "Before " + "w " * 400 + item.upper() + ", after  it", "e", 3), (3, "clean text", "e", None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_chars bigint")
    out = {r.doc_id: r for r in decontaminate.cleaned(df, spark.createDataFrame([(1, item), (2, "unseen words " * 9)], "item_id bigint, text string"), block_bytes=block).collect()}
    assert set(out) == {2, 3, 4} and out[2].text == "Before " + "w " * 400 + "after  it" and out[2].n_chars == len(out[2].text) and out[3] == tuple(rows[2]) and out[4].text is None


def test_contamination_by_long_items_and_hot_blocks(spark, monkeypatch):
    """Items longer than a block, one item that most documents hold, and empty tables, by way of the routed blocks."""
    monkeypatch.setattr(decontaminate, "SHARE_DOCS", 7)
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(40)}" for _ in range(400))
    items = [(1, long), (2, "one two three four five six seven eight nine ten eleven twelve thirteen"), (3, "short item"), (4, long), (None, "nameless one")]
    part = long.split()
    rows = [(i, " ".join(["x"] * (i % 5) + ["One two three, four five six seven eight nine ten eleven twelve thirteen!"] * (i % 3 > 0) + part[i : i + 12 + i % 4])) for i in range(60)]
    rows += [(100, "a short item, a nameless one"), (101, None), (102, "")]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for block in (200, 1000):
        assert Counter(tuple(r)[:6] for r in decontaminate.contamination(df, bench, block_bytes=block).collect()) == Counter(hit(rows, items))
    none = spark.createDataFrame([], df.schema)
    for block in (200, 1 << 20):
        assert decontaminate.contamination(none, bench, block_bytes=block).count() == 0 and decontaminate.cleaned(none, bench, block_bytes=block).count() == 0


# SimHash


def fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, most=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_near_duplicates(docs, odd, empty):
    for df in (docs, odd):
        rows = pairs(df)
        fps = [fingerprint(t) for _, t in rows]
        group = linked(fps)
        least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
        want = Counter((i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fps, group))
        assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
        out = simhash.representatives(df)
        assert out.columns == df.columns and Counter(fingerprint(r.text) for r in out.collect()).most_common(1)[0][1] == 1
        assert out.count() == len(set(group))
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_crowded_fingerprints(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(700):  # chains of neighbours, and one list past the pairwise bound
        x = rng.choice(list(fps)) ^ (1 << rng.randrange(64))
        fps.add(x ^ (1 << rng.randrange(64)) if rng.random() < 0.5 else x)
    fps |= {base ^ rng.getrandbits(16) for _ in range(600)} | {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    roots = {r.node: r.root for r in simhash.components(Scratch(spark, "test"), simhash.links(df)).collect()}
    group = linked(fps)
    ours = [roots.get(x, x) for x in signed]
    assert len(set(zip(ours, group))) == len(set(ours)) == len(set(group))


# substring dedup


def removed(rows, window=20):
    seen, out = set(), []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if (key := tuple(w[k : k + window])) in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


@pytest.mark.parametrize("batches", [1, 3])
def test_remove_repeats(docs, odd, batches):
    for df in (docs, odd):
        out = substring_dedup.remove_repeats(df, batches=batches, fanout=1).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == Counter(removed(in_order(pairs(df))))
        for r in out:
            if r.n_removed:
                assert hashlib.sha256(" ".join(words(r.kept_text)).encode()).hexdigest() == r.kept_sha256


def test_remove_repeats_of_few_words(spark, empty):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("ab", k=rng.choice([0, 3, 8, 20])))) for i in range(40)] + [(50, "a " * 30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for batches in (1, 4):
        out = substring_dedup.remove_repeats(df, batches=batches, window=5, gram=2, fanout=2)
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()) == sorted(removed(rows, 5))
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_without_repeats_keeps_rows_and_layout(spark, odd):
    p = " ".join(f"p{i}" for i in range(30))
    df = spark.createDataFrame([(1, f"Head,\n{p}\ntail", 5), (2, f"Other\n  {p}\n end  ", 6), (3, p, 7), (4, "short", None)], "doc_id bigint, text string, n_chars bigint")
    out = {r.doc_id: (r.text, r.n_chars) for r in substring_dedup.without_repeats(df).collect()}
    assert out == {1: (f"Head,\n{p}\ntail", 5), 2: ("Other\n  end  ", 13), 3: ("", 0), 4: ("short", None)}
    again = substring_dedup.without_repeats(odd)
    assert again.columns == odd.columns and again.count() == odd.count()


# toxicity


def test_toxicity_on_held_out_labels(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        w = ["".join(rng.choices(["th", "er", "on", "an", "re", "é"], k=rng.randint(1, 4))) for _ in range(rng.choice([5, 40, 300]))]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["Moron", "trash", "clown"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "moron")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    out = toxicity.scored(df, toxicity.train(df, marks)).collect()
    truth = dict(labels)
    assert len(out) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    own = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in own) > 0.95 * len(own)
    none = toxicity.train(df, marks.where("false"))
    assert {r.score for r in toxicity.scored(df, none).collect()} == {toxicity.scored(df, none).first().score}


def test_toxicity_never_reads_other_labels(spark):
    rows = [(i, f"word{i} text") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    own = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 3 == 1)) for i, _ in rows], "doc_id bigint, toxic int")
    a, b = (toxicity.train(df, own(f)) for f in (False, True))
    assert np.array_equal(a.weight, b.weight) and a.intercept == b.intercept


def test_toxicity_of_odd_and_empty_tables(spark, odd, empty):
    marks = spark.createDataFrame([(i, int(i % 2)) for i in range(10)], "doc_id bigint, toxic int")
    out = toxicity.scored(odd, toxicity.train(odd, marks))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == odd.count()
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxicity.scored(empty, toxicity.train(empty, marks)).count() == 0


def test_toxic_words_that_only_come_often(spark):
    """A word that clean texts have once and toxic ones four times tells by its count."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        w = ["".join(rng.choices(["th", "er", "on", "an"], k=3)) for _ in range(60)]
        for _ in range(4 if i % 3 == 0 else 1):
            w[rng.randrange(60)] = "zugu"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = [r for r in toxicity.scored(df, toxicity.train(df, spark.createDataFrame(labels, "doc_id bigint, toxic int"))).collect() if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in out) > 0.9 * len(out)


# token files, counts and packing


def test_token_files(docs, odd, empty):
    plain = Tokenizer.from_file(BYTES)
    for df in (docs, odd):
        start, want = 0, Counter()
        rows = sorted(pairs(df), key=lambda r: (r[0] is not None, r[0] or 0))
        got = token_files.token_files(df, BYTES, 2, segment_ids=20_000).collect()
        unique = {i for i, n in Counter(i for i, _ in rows).items() if n == 1}
        for i, t in rows:
            ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
            want[i, start if i in unique else None, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
            start += len(ids)
        assert Counter((r.doc_id, r.start if r.doc_id in unique else None, r.n_tokens, r.ids_crc32) for r in got) == want
        at = sorted((r.start, r.n_tokens) for r in got)
        assert [s for s, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
    assert token_files.token_files(empty, BYTES, 2).count() == 0


def test_edited_counts(spark, docs, odd, empty):
    plain = Tokenizer.from_file(BYTES)
    n = lambda t: len(plain.encode(t, add_special_tokens=False).ids)

    def deleted(t):
        for a, z, new in token_counts.repeated_lines(t):
            raw = t.encode()
            t = (raw[:a] + new.encode() + raw[z:]).decode()
        return t

    for df in (docs, odd):
        want = Counter((i, n(t or ""), n(deleted(t or ""))) for i, t in pairs(df))
        assert Counter((r.doc_id, r.n_tokens, r.n_tokens_edited) for r in token_counts.edited_counts(df, BYTES, token_counts.repeated_lines).collect()) == want
    kind = "doc_id bigint, text string, edits array<struct<start: bigint, end: bigint, text: string>>"
    df = spark.createDataFrame([(1, "one two three", [(4, 7, "2"), (0, 0, "zero ")]), (2, None, [(0, 5, "new")]), (3, "same", None)], kind)
    out = {r.doc_id: (r.n_edits, r.n_tokens_edited) for r in token_counts.edited_counts(df, WORDS, "edits").collect()}
    words_n = lambda t: len(Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids)
    assert out == {1: (2, words_n("zero one 2 three")), 2: (1, words_n("new")), 3: (0, words_n("same"))}
    assert token_counts.edited_counts(empty, BYTES, token_counts.repeated_lines).count() == 0


@pytest.mark.parametrize("histogram", [{}, {1: 5}, {4096: 3}, {3000: 10}, {2049: 7, 2047: 7, 5: 3}, dict(Counter(np.random.default_rng(1).integers(1, 4097, 3000).tolist())), dict(Counter(np.clip(np.random.default_rng(2).lognormal(6, 1.2, 5000), 1, 4096).astype(int).tolist()))])
def test_plan(histogram):
    plan = packing.make_plan(histogram)
    length = np.repeat(np.array(list(histogram), np.int64), np.array(list(histogram.values()), np.int64))
    rank = np.concatenate([np.arange(c) for c in histogram.values()]) if histogram else length
    sequence, offset = plan.place(length, rank)
    order = np.lexsort((offset, sequence))
    at, s = 0, None
    for k in order:
        at = 0 if sequence[k] != s else at
        s = sequence[k]
        assert offset[k] == at
        at += length[k]
        assert at <= 4096
    assert len(set(sequence.tolist())) == plan.sequences
    fit: list[int] = []
    for x in sorted(length.tolist(), reverse=True):  # first fit, longest first
        k = next((k for k, free in enumerate(fit) if free >= x), None)
        if k is None:
            fit.append(4096 - x)
        else:
            fit[k] -= x
    assert plan.sequences <= len(fit)


def test_configurations_cover_the_demand():
    size, demand = np.array([5, 7, 3]), np.array([40, 30, 100])
    found = packing.solve_configurations(size, demand, 16)
    cover = sum(x * c for x, c in found)
    assert (cover >= demand * 0.999).all() and all((c * size).sum() <= 16 for _, c in found)
    assert sum(x for x, _ in found) <= 1.25 * (size * demand).sum() / 16 + 1
    assert packing.best_configuration(np.array([4, 5]), np.array([4.0, 5.5]), 13, np.array([9, 9])).tolist() == [2, 1]
    assert packing.best_configuration(np.array([4, 5]), np.array([4.0, 5.5]), 13, np.array([1, 1])).tolist() == [1, 1]


def test_configurations_place_the_pieces():
    """The plan comes from the program: best fit places a residue, and the sequences are as few as tokens allow, or nearly."""
    rng = np.random.default_rng(3)
    for sizes in (rng.lognormal(6, 1.2, 10_000), rng.lognormal(5, 2, 40_000), rng.integers(1, 4097, 5000), rng.integers(1400, 1500, 5000)):
        histogram = dict(Counter(np.clip(sizes, 1, 4096).astype(int).tolist()))
        plan, pieces = packing.make_plan(histogram), sum(histogram.values())
        assert plan.configured >= 0.95 * pieces
        bound = max(-(-sum(n * c for n, c in histogram.items()) // 4096), sum(c for n, c in histogram.items() if n > 2048), -(-sum(c for n, c in histogram.items() if n > 1365) // 2))
        assert plan.sequences <= 1.005 * bound + 1


def fewest(pieces, capacity):
    best = len(pieces)

    def go(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(pieces):
            best = len(free)
            return
        for k in {f: k for k, f in enumerate(free) if f >= pieces[i]}.values():
            go(i + 1, [*free[:k], free[k] - pieces[i], *free[k + 1 :]])
        go(i + 1, [*free, capacity - pieces[i]])

    go(0, [])
    return best


def test_plans_of_few_pieces_against_all_packings():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 16, 20, 30])
        pieces = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 10))), reverse=True)
        assert packing.make_plan(Counter(pieces), capacity).sequences == fewest(pieces, capacity), pieces


def test_pack(docs, odd, empty):
    plain = Tokenizer.from_file(WORDS)
    for df in (docs, odd):
        want: Counter = Counter()
        for i, t in pairs(df):
            ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
            for k in range(0, len(ids), 512):
                want[i, k // 512, k, len(ids[k : k + 512]), zlib.crc32(np.array(ids[k : k + 512], "<u4").tobytes())] += 1
        out = packing.pack(df, WORDS, 1, capacity=512, with_ids=True).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
        at: dict = {}
        for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == at.get(r.sequence_id, 0) and len(r.ids) == r.length
            at[r.sequence_id] = r.offset + r.length
        assert max(at.values()) <= 512
    assert packing.pack(empty, WORDS, 1).count() == 0


# license scans


def test_license_matches():
    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    rng = random.Random(3)
    filler = "thnd erstor ther rendor anorou was inoure reinntly".split()
    for name, text in license_scan.TEMPLATES.items():
        for change in range(6):
            w = text.split()
            if len(w) > 12 and change % 3:
                k = rng.randrange(len(w))
                w[k : k + 1] = [] if change % 3 == 1 else [w[k], "xyzzy"]
            lead = rng.choices(filler, k=rng.randint(0, 30))
            found = list(license_scan.matches(index, pa.array([" ".join(lead + w + rng.choices(filler, k=20))])))
            assert len(found) == 1 and found[0][1] == name
            assert found[0][2] >= 0.8 * found[0][3] and found[0][4] >= len(lead)
    assert list(license_scan.matches(index, pa.array([None, "", "licensed under the moon", "Released under the MIT License."]))) == [(3, "MIT", 5, 5, 0, 5)]
    assert list(license_scan.matches(index, pa.array([" ".join(filler * 50)]))) == []


def test_license_matches_of_all_changes_of_one_word():
    """A document of a template with one word changed, left out or put in, against alignment in every band."""
    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    for name, template in zip(index.names, index.words):
        texts = []
        for k in range(len(template)):
            for new in ([], [b"xyzzy"], [template[k], b"xyzzy"]):
                texts.append([b"thnd"] * 20 + template[:k] + new + template[k + 1 :] + [b"rendor"] * 20)
        got = list(license_scan.matches(index, pa.array([b" ".join(w).decode() for w in texts])))
        for i, w in enumerate(texts):
            best = max(license_scan.align(template, w, low, low + 16)[0] for low in range(-8, 41))
            mine = [r for r in got if r[0] == i]
            assert [(r[1], r[2]) for r in mine] == ([(name, best)] if best >= 0.8 * len(template) else []), (name, w)
    said = ["Distributed under the MIT License.", "Licensed under the MIT License.", "Licensed under XX BY-NC 4.0.", "Released xx under xx the xx MIT xx License"]
    assert [r[:3] for r in license_scan.matches(index, pa.array(said))] == [(0, "MIT", 4), (1, "MIT", 4), (2, "CC-BY-NC-4.0", 6), (3, "MIT", 5)]
    assert [r[1:] for r in license_scan.matches(license_scan.TemplateIndex({"short": "All rights"}), pa.array(["x all rights y"]))] == [("short", 2, 2, 1, 3)]


def test_license_notices_in_a_row():
    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        size = len(index.words[index.names.index(name)])
        for n in range(1, 21):
            found = sorted(license_scan.matches(index, pa.array(["thnd\n" + f"{text}\n" * n + "rendor"])), key=lambda r: r[4])
            assert found == [(0, name, size, size, 1 + k * size, 1 + (k + 1) * size) for k in range(n)]
    mixed = ["Licensed under the MIT License.", "Released under the MIT License.", license_scan.TEMPLATES["CC-BY-NC-4.0"]]
    found = sorted(license_scan.matches(index, pa.array([" ".join(mixed * 7)])), key=lambda r: r[4])
    assert [r[1] for r in found] == ["MIT", "MIT", "CC-BY-NC-4.0"] * 7 and all(a[5] <= b[4] for a, b in zip(found, found[1:]))


def test_align_counts_matches_in_the_band():
    t = "a b c d e".split()
    t = [x.encode() for x in t]
    assert license_scan.align(t, [x.encode() for x in "x a b q c d e y".split()], -2, 4) == (5, 1, 7)
    assert license_scan.align(t, [x.encode() for x in "a b d e".split()], -2, 2) == (4, 0, 4)


def test_license_scan_of_tables(spark, docs, odd, empty):
    plain = re.compile(r"Licensed under CC BY-NC 4\.0\.|This work is licensed under the GNU General Public License, version 3\.|Licensed under the Apache License, Version 2\.0\.|Released under the MIT License\.")
    got = {r.doc_id for r in license_scan.scan(docs).collect()}
    assert {i for i, t in pairs(docs) if plain.search(t or "")} <= got
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0


# keys and registration


def test_keys(spark, odd, docs):
    rows, plain = keyed(Scratch(spark, "test"), odd)
    assert not plain
    got = rows.orderBy("doc_key").collect()
    assert [r.doc_key for r in got] == list(range(len(got)))
    assert [(r.doc_id, r.text) for r in got] == in_order(pairs(odd))
    assert keyed(Scratch(spark, "test"), docs)[1] and fresh(odd, "_row_key") == "_row_key_"


def test_scratch_uses_the_shared_folder():
    """The cluster's folder is read from the session; a folder of our own only stands in where there is none."""

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        def __init__(self, **conf):
            self.conf = Conf(conf)
            self.sparkContext = self

        def getConf(self):
            return Conf()

    assert shared_dir(Session(**{"spark.checkpoint.dir": "hdfs://x/shared/"})) == "hdfs://x/shared"
    none = Session()
    assert shared_dir(none).startswith("file://") and shared_dir(none) == shared_dir(none)


def test_names():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 11)] and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_joins_of_hot_keys_are_split(spark):
    """One fingerprint in all documents, one hub of all links: no task of the joins gets all of their rows."""
    keys = ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in zip(keys, ("20k", "20k", "false", "-1")):
            spark.conf.set(k, v)
        scratch = Scratch(spark, "test")
        rows = scratch.write(spark.range(0, 200_000, 1, 8).select((F.col("id") % 7 * F.lit(0) + 5).alias("print"), F.xxhash64("id").alias("doc_key")).unionByName(spark.range(1000).select(F.col("id").alias("print"), F.col("id").alias("doc_key"))), "rows")
        shared = scratch.write(rows.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "shared")
        sizes = [r["count"] for r in scratch.write(rows.join(shared, "print", "left_semi").withColumn("part", F.spark_partition_id()), "joined").groupBy("part").count().collect()]
        assert sum(sizes) == 200_001 and max(sizes) < 150_000
        links = spark.range(1, 20_000).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
        roots = simhash.components(scratch, links)
        assert roots.where("root = 0").count() == 19_999
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
