"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Texts are normalised by lower-casing A-Z and taking runs of letters, digits and
non-ASCII characters as words. A window is ``length`` consecutive words of an item;
an item of fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit. A document is contaminated if some word is hit and
the hit words are at least ``coverage`` of its words.

Items are read into a generalised suffix automaton over words. Document words are
streamed through it, tracking the longest match that ends at each word: a match of
``length`` words or more ends an occurrence of a window, and so does a match that
reaches a short item's end. A word pair that no item has ends every match, so only
runs of known pairs are streamed; they are found by array operations over hashes,
and the automaton then compares the words themselves.

A benchmark of at most ``block_bytes`` of text, a bound checked before anything is
collected, travels to the tasks as one automaton. A larger one is cut into blocks of that
many bytes at most (a long item into pieces that share ``length - 1`` words, so that no
window is lost), and the documents are read once, whatever the number of blocks:

1. hashes of all windows are written with their blocks; a bit for each hash, in a map of
   2 ** FILTER_BITS bits, travels to the tasks, which list the hashes of each document's
   word sequences that it lets pass;
2. a join with the window hashes names the blocks that each document may match;
3. candidate documents are dealt to (block, share), with the block's pieces before them;
   a block that many documents match has a share for each SHARE_DOCS of them. A task
   builds the automaton of a block from its pieces, then streams the documents through.

Nulls and oddities: a null text has no words. A document without words is clean. A
null item_id hits words but is not counted among the items; rows that repeat an
item_id count once. Repeated documents are judged alike. An empty benchmark hits
nothing, an empty documents table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydex.llm import flattext as ft
from quarrydex.llm.scratch import Scratch, fresh, keyed, small_batches

LENGTH = 13
#: Hit words of a contaminated document, as a share of its words: numerator and denominator.
COVERAGE = (1, 20)
#: An automaton takes about 250 bytes for each byte of its items, once on the driver and in each worker.
BLOCK_BYTES = 1_000_000
#: Bits of a position in the map of window hashes: 8 MB. More windows than that let more documents pass, no fewer.
FILTER_BITS = 26
#: Candidate documents of a block that make a further share of it.
SHARE_DOCS = 20_000


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the windows' items at its states.

    next[s]: word -> state; link, size: suffix link and longest match of each state.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], length: int = LENGTH):
        self.length = length
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        at: list[set[int]] = [set()]
        whole: dict[int, set[int]] = {}
        for n, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._extend(last, w)
                while len(at) < len(self.size):
                    at.append(set())
                if len(words) >= length:
                    at[last].add(n)
            if words and len(words) < length:
                whole.setdefault(last, set()).add(n)
        # an item ends at every suffix of the places where it ends
        for s in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if at[s] and self.link[s] > 0:
                at[self.link[s]] |= at[s]
        ids = [i for i, _ in items]
        name = lambda found: frozenset(ids[n] for n in found if ids[n] is not None)
        #: States whose matches hold exactly the last ``length`` words: the items that have this window.
        self.window_items = {s: name(at[s]) for s in range(1, len(self.size)) if self.size[s] >= length > self.size[self.link[s]]}
        #: Short items that are matched in full at a state: (words, items), the longest first, from it and its suffixes.
        self.short: dict[int, list[tuple[int, frozenset]]] = {}
        for s in sorted(range(1, len(self.size)), key=lambda s: self.size[s]):
            own = self.short.get(self.link[s], [])
            if s in whole:
                own = [(self.size[s], name(whole[s])), *own]
            if own:
                self.short[s] = own
        self.least = min([length if len(w) >= length else len(w) for _, w in items if w], default=0)

    def _new(self, size: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        return len(self.size) - 1

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.size[q] == self.size[last] + 1 else self._clone(last, q, w)
        cur, p = self._new(self.size[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: bytes) -> int:
        c = self._new(self.size[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset]]:
        """(first word, word after the last, items) of occurrences of windows in a stream of words; one that lies in a longer one ending with it is left out, but its items are not."""
        s = n = 0
        for i, w in enumerate(words):
            while s and w not in self.next[s]:
                s = self.link[s]
                n = self.size[s]
            if w not in self.next[s]:
                continue
            s, n = self.next[s][w], n + 1
            hit, found = 0, set()
            if n >= self.length:
                t = s
                while self.size[self.link[t]] >= self.length:
                    t = self.link[t]
                hit = self.length
                found |= self.window_items[t]
            for size, items in self.short.get(s, ()):
                if size <= n:
                    hit = max(hit, size)
                    found |= items
            if hit:
                yield i + 1 - hit, i + 1, frozenset(found)


class Matcher:
    """An automaton with the hashes that tell which runs of a text can matter to it."""

    def __init__(self, items: list[tuple[str | None, str | None]], length: int = LENGTH):
        column = pa.array([t for _, t in items], pa.string())
        split: list[list[bytes]] = []
        one, two = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for _, _, t in ft.slices(column):
            own, starts, ends, first = ft.joined(t, ft.ALNUM_WORDS, lower=True)
            h = ft.word_hashes(own.data, starts, ends)
            one.append(h)
            two.append(ft.run_hashes(h, 2)[ft.inside(first, 2)])
            raw = own.data.tobytes()
            split += [raw[a:z].split() for a, z in zip(own.off[:-1].tolist(), own.off[1:].tolist())]
        self.automaton = SuffixAutomaton([(i, w) for (i, _), w in zip(items, split)], length)
        self.words, self.pairs = np.unique(np.concatenate(one)), np.unique(np.concatenate(two))

    def runs(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(first word, word after the last) of the longest runs of known words and pairs that can hold a window."""
        least = self.automaton.least
        if not least or not len(h):
            return []
        k = 1 if least == 1 else 2
        known = _member(h if k == 1 else ft.run_hashes(h, 2), self.words if k == 1 else self.pairs) & ft.inside(first, k)
        edge = np.diff(known.astype(np.int8), prepend=0, append=0)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + k - 1
        if k == 1:  # single words go on over a document's end
            cut = np.unique(first[1:-1])
            cut = cut[(cut > 0) & (cut < len(h))]
            cut = cut[known[cut - 1] & known[np.minimum(cut, len(h) - 1)]]
            begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
        wide = end - begin >= least
        return list(zip(begin[wide].tolist(), end[wide].tolist()))

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, dict[int, tuple[np.ndarray, set]]]]:
        """(first row, row after the last, words of each, {row: (mask of hit words, items)}) by slices."""
        for i, j, t in ft.slices(column):
            own, starts, ends, first = ft.joined(t, ft.ALNUM_WORDS, lower=True)
            h = ft.word_hashes(own.data, starts, ends)
            found: dict[int, tuple[np.ndarray, set]] = {}
            runs = self.runs(h, first)
            docs = np.searchsorted(first, [a for a, _ in runs], "right") - 1
            for (a, z), d in zip(runs, docs.tolist()):
                for x, y, items in self.automaton.matches(own.data[starts[a] : ends[z - 1]].tobytes().split(b" ")):
                    if d not in found:
                        found[d] = (np.zeros(first[d + 1] - first[d], bool), set())
                    found[d][0][a - first[d] + x : a - first[d] + y] = True
                    found[d][1].update(items)
            yield i, j, np.diff(first), found


def _member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values if len(keys) else np.zeros(len(values), bool)


def _small(benchmark: DataFrame, block_bytes: int) -> list[tuple[str | None, str | None]] | None:
    """The items, if their texts make one block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return [tuple(r) for r in items.collect()] if total <= block_bytes else None


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, coverage: tuple[int, int] = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for each document.

    items_sha256: of the items' ids, sorted as strings and joined by commas. spans:
    the hit runs as (first word, words).
    """
    small_batches(docs.sparkSession)
    items = _small(benchmark, block_bytes)
    if items is not None:
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
        return _judged(_scanned(rows, items, length), coverage)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows, _ = keyed(scratch, docs)
    hits = _routed(scratch, rows, benchmark, length, block_bytes)
    merged = hits.groupBy("doc_key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = merged.withColumnRenamed("doc_key", "hit_key")
    none = {"spans": _SPANS, "items": "array<string>"}
    words = scratch.spark.read.parquet(f"{scratch.root}/passed").select("doc_key", "doc_id", "n_words")
    every = words.join(merged, F.col("doc_key") == F.col("hit_key"), "left").select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(k)).alias(c) for c, k in none.items()])
    return _judged(every, coverage)


_SPANS = "array<struct<start: long, words: long>>"


def _cut_items(benchmark: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(block, item_id, words: pieces of items, their normalised words joined by spaces) in blocks of at most block_bytes, filled one after the other in each part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, room = -1, 0
        for b in batches:
            ids, part = b.column(0).to_pylist(), b.column(2)
            block, item, text = [], [], []
            for i, j, t in ft.slices(b.column(1)):
                own, starts, ends, first = ft.joined(t, ft.ALNUM_WORDS, lower=True)
                raw = own.data.tobytes()
                for d in range(j - i):
                    x, z = int(first[d]), int(first[d + 1])
                    while x < z:
                        y = int(np.searchsorted(ends[x:z], starts[x] + block_bytes, "right")) + x
                        y = max(min(y, z), min(x + length, z))  # a piece has a window at least
                        size = int(ends[y - 1] - starts[x]) + 64
                        if size > room:
                            n, room = n + 1, block_bytes
                        room -= size
                        block.append(part[i + d].as_py() << 40 | n)
                        item.append(ids[i + d])
                        text.append(raw[starts[x] : ends[y - 1]])
                        x = z if y == z else y - length + 1
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(item, pa.string()), pa.array(text, pa.binary()).cast(pa.string())], ["block", "item_id", "words"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().cast("long").alias("part")).where("text is not null")
    return items.mapInArrow(ft.released(run), "block long, item_id string, words string")


def _window_hashes(column: pa.Array, sizes: list[int], whole: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, words of each row, row of each window, hash) of the word sequences of the given sizes by slices; with ``whole``, of pieces: those of the last size, and shorter pieces as a whole."""
    for i, j, t in ft.slices(column):
        own, starts, ends, first = ft.joined(t, ft.ALNUM_WORDS, lower=True)
        h, n_words = ft.word_hashes(own.data, starts, ends), np.diff(first)
        rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for n in sizes:
            at = np.flatnonzero(ft.inside(first, n))
            row = np.searchsorted(first, at, "right") - 1
            if whole and n < sizes[-1]:
                at, row = at[n_words[row] == n], row[n_words[row] == n]
            rows.append(row)
            hashes.append(ft.run_hashes(h, n)[at] ^ np.uint64(n))
        yield i, j, n_words, np.concatenate(rows), np.concatenate(hashes)


def _routed(scratch: Scratch, rows: DataFrame, benchmark: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(doc_key, spans, items) of hit documents, a row for each block that hits one; writes (doc_key, doc_id, n_words, hashes) of all as "passed"."""
    spark = scratch.spark
    pieces = scratch.write(_cut_items(benchmark, length, block_bytes).repartition("block"), "pieces")

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column(0).to_numpy()
            for i, j, n_words, row, h in _window_hashes(b.column(1), list(range(1, length + 1)), True):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(block[i:j][row]), pa.array(np.minimum(n_words[row], length).astype(np.int32))], ["h", "block", "size"])

    found = scratch.write(pieces.select("block", "words").mapInArrow(ft.released(windows), "h long, block long, size int").distinct(), "windows")
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())  # at most ``length``
    place = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    marks = found.groupBy(F.bitmap_bucket_number(place + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in marks.toLocalIterator():  # 4 kB each, of 2 ** FILTER_BITS bits in all
        own = np.frombuffer(r["bits"], np.uint8)
        bits[(r["k"] - 1) * len(own) : r["k"] * len(own)] = own
    shared = spark.sparkContext.broadcast(bits)

    def passing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, n_words, row, h in _window_hashes(b.column(2), sizes, False):
                at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                ok = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                row, h = row[ok], h[ok]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
                off = np.searchsorted(row[new], np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n_words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(off), pa.array(h[new].view(np.int64)))], ["doc_key", "doc_id", "n_words", "hashes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    passed = scratch.write(rows.select("doc_key", "doc_id", "text").mapInArrow(ft.released(passing), f"doc_key long, doc_id {kind}, n_words long, hashes array<long>"), "passed")
    sure = passed.select("doc_key", F.explode("hashes").alias("h")).join(found.select("h", "block"), "h").select("doc_key", "block").distinct()
    sure = scratch.write(sure, "candidates")
    shares = scratch.write(sure.groupBy("block").agg(F.ceil(F.count("*") / F.lit(SHARE_DOCS)).alias("shares")), "shares")
    texts = rows.select("doc_key", "text").join(sure, "doc_key").join(shares, "block")
    texts = texts.select("block", F.pmod(F.xxhash64("doc_key"), F.col("shares")).alias("share"), F.lit(1).alias("kind"), "doc_key", F.lit(None).cast("string").alias("item_id"), "text")
    head = pieces.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_key"), "item_id", F.col("words").alias("text"))
    dealt = head.unionByName(texts).repartition("block", "share").sortWithinPartitions("block", "share", "kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items, matcher = None, [], None
        for b in batches:
            key = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            x = 0
            while x < len(key):
                y = x
                while y < len(key) and key[y] == key[x]:
                    y += 1
                if key[x][:2] != now:
                    now, items, matcher = key[x][:2], [], None
                part = b.slice(x, y - x)
                if key[x][2] == 0:
                    items += zip(part.column(4).to_pylist(), part.column(5).to_pylist())
                else:
                    matcher = matcher or Matcher(items, length)
                    for i, j, n_words, found in matcher.scan(part.column(5)):
                        keys, spans, ids = _found(part.column(3).slice(i, j - i), n_words, found)
                        yield pa.RecordBatch.from_arrays([keys, spans, ids], ["doc_key", "spans", "items"]).take(pa.array(sorted(found), pa.int64()))
                x = y

    return scratch.write(dealt.mapInArrow(ft.released(run), f"doc_key long, spans {_SPANS}, items array<string>"), "hits")


def _found(keys: pa.Array, n_words: np.ndarray, found: dict[int, tuple[np.ndarray, set]]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The keys of a slice beside the hit spans and items of each row."""
    spans: list[list] = [[] for _ in n_words]
    ids: list[list] = [[] for _ in n_words]
    for d, (hit, own) in found.items():
        edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
        spans[d] = [{"start": int(x), "words": int(y - x)} for x, y in zip(edge[::2], edge[1::2])]
        ids[d] = list(own)
    return keys, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))), pa.array(ids, pa.list_(pa.string()))


def _scanned(rows: DataFrame, items: list, length: int) -> DataFrame:
    """(doc_id, n_words, spans, items) of documents, against one automaton."""
    matcher = rows.sparkSession.sparkContext.broadcast(Matcher(items, length))  # bounded by block_bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, n_words, found in matcher.value.scan(b.column(1)):
                keys, spans, ids = _found(b.column(0).slice(i, j - i), n_words, found)
                yield pa.RecordBatch.from_arrays([keys, pa.array(n_words.astype(np.int64)), spans, ids], ["doc_id", "n_words", "spans", "items"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(ft.released(run), f"doc_id {kind}, n_words long, spans {_SPANS}, items array<string>")


def _judged(rows: DataFrame, coverage: tuple[int, int]) -> DataFrame:
    merged = F.aggregate(  # spans of several blocks may overlap
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["start"] + x["words"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["start"] + x["words"]).alias("end")),
    )["n"]
    rows = rows.withColumn("n_hit", merged)
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * coverage[1] >= F.col("n_words") * coverage[0])).alias("contaminated"),
        "spans",
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, length: int = LENGTH, coverage: tuple[int, int] = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the limits applied, in the columns of docs.

    Contaminated documents go. From others each hit span is cut out of the text (with
    the bytes up to the next word), and an n_chars column follows; texts without a hit
    stay as they are. The cut needs no shuffle of texts for a one-block benchmark.
    """
    small_batches(docs.sparkSession)
    items = _small(benchmark, block_bytes)
    if items is None:
        scratch = Scratch(docs.sparkSession, "cleaned")
        names = docs.columns
        key = fresh(docs, "_row_key")
        rows = scratch.write(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
        judged = contamination(rows.select(F.col(key).alias("doc_id"), "text"), benchmark, length, coverage, block_bytes)
        hits = judged.where("n_hit > 0").select(F.col("doc_id").alias(key), F.col("spans").alias(fresh(rows, "_spans")))
        joined = rows.join(hits, key, "left")
        return joined.select(*names, hits.columns[1]).mapInArrow(_cutter(names, None, length, coverage), docs.schema)
    matcher = docs.sparkSession.sparkContext.broadcast(Matcher(items, length))  # bounded by block_bytes
    return docs.mapInArrow(_cutter(docs.columns, matcher, length, coverage), docs.schema)


def _cutter(names: list[str], matcher, length: int, coverage: tuple[int, int]):
    at = names.index("text")

    def hits(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, dict[int, np.ndarray]]]:
        if matcher is not None:
            for i, _, n_words, found in matcher.value.scan(b.column(at)):
                yield i, n_words, {d: hit for d, (hit, _) in found.items()}
            return
        spans = b.column(len(names)).to_pylist()
        for i, j, t in ft.slices(b.column(at)):
            n_words = np.diff(ft.joined(t, ft.ALNUM_WORDS, lower=True)[3])
            found = {}
            for d in range(j - i):
                if spans[i + d]:
                    found[d] = np.zeros(n_words[d], bool)
                    for x in spans[i + d]:
                        found[d][x["start"] : x["start"] + x["words"]] = True
            yield i, n_words, found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, changed = np.ones(b.num_rows, bool), {}
            for i, n_words, found in hits(b):
                for d, hit in found.items():
                    if hit.sum() * coverage[1] >= n_words[d] * coverage[0]:
                        keep[i + d] = False
                    elif hit.any():
                        changed[i + d] = _without(b.column(at)[i + d].as_py(), hit)
            columns = list(b.columns[: len(names)])
            if changed:
                columns[at] = pa.array([changed.get(k, v) for k, v in enumerate(columns[at].to_pylist())], columns[at].type)
                if "n_chars" in names:
                    n = names.index("n_chars")
                    columns[n] = pa.array([len(changed[k]) if k in changed else v for k, v in enumerate(columns[n].to_pylist())], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return ft.released(run)


def _without(text: str, hit: np.ndarray) -> str:
    """The text without its hit words, each with what stands between it and the next word."""
    raw = text.encode()
    data = ft.LOWER[np.frombuffer(raw + bytes(8), np.uint8)]
    starts, _, _ = ft.words(ft.Texts(data, np.array([0, len(raw)])), ft.ALNUM_WORDS)
    ends = np.append(starts[1:], len(raw))
    parts, at = [], 0
    for k in np.flatnonzero(hit).tolist():
        parts.append(raw[at : starts[k]])
        at = int(ends[k])
    return (b"".join(parts) + raw[at:]).decode()
