"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has 64 bits, that is eight bytes at eight positions. Two fingerprints
that differ in at most ``max_bits`` bits differ in at most ``max_bits`` bytes, so
they share at least ``8 - max_bits`` positional bytes: the guaranteed minimum of
matches. Posting lists of single positional bytes hold a 256th of all fingerprints
each, so tallying over them would be quadratic. The index is therefore keyed by
every choice of that many positions with the bytes found there (28 keys for two
bits): a pair meets in a list exactly if its tally reaches the minimum. The bits
left free by a key bound a list of distinct fingerprints to 65,536 entries for two
bits, whatever the input. Within a list each member looks up the members that differ
in few enough of the free bits (136 places for two bits), so a list costs in
proportion to its length. The shared positional bytes of each pair that meets are
tallied, pairs under the minimum go, and the others are verified by Hamming distance.
Lists give a star of links for each connected part, never all of its pairs. Equal
fingerprints are one entry of the index.

Components are then found by alternating large-star and small-star steps, each a
shuffle of links; nothing of the corpus goes to the driver. What is joined by a node is
written first: a join of two written tables is one that Spark splits where a node has
many links.

Nulls and oddities: a null text has no words; a text without words has fingerprint
zero and links like any other. A null doc_id is a row of its own, passes over as a
component's smallest id, and gives a null component_id only where its component has
no other. Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydex.llm import flattext as ft
from quarrydex.llm.scratch import Scratch, few, fresh, with_keys

SHINGLE_WORDS = 3
MAX_BITS = 2
#: _SPREAD[b]: the bits of a byte in eight one-byte counters.
_SPREAD = np.array([sum(1 << (8 * i) for i in range(8) if b >> i & 1) for b in range(256)], np.uint64)


def fingerprint_array(column: pa.Array, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprints of texts: bit j is set if over half of the shingles' XXH64 have it set."""
    out = np.zeros(len(column), np.uint64)
    for i, j, t in ft.slices(column):
        own, starts, ends, first = ft.joined(t, ft.SPACE_WORDS, lower=True)
        n_words = np.diff(first)
        full = np.flatnonzero(ft.inside(first, k))
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        h = ft.xxh64(own.data, np.concatenate([starts[full], own.off[:-1][short]]), np.concatenate([ends[full + k - 1], own.off[1:][short]]))
        doc = np.concatenate([np.searchsorted(first, full, "right") - 1, short])
        out[i:j] = _majority(h[: len(full)], doc[: len(full)], len(t))
        out[i:j][short] = h[len(full) :]
    return out


def _majority(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """The bits set in over half of each document's hashes; ``doc`` ascends."""
    if not len(h):
        return np.zeros(n_docs, np.uint64)
    n = np.bincount(doc, minlength=n_docs)
    begin = np.cumsum(n) - n
    chunk = doc * 1_000_000 + (np.arange(len(h)) - begin[doc]) // 255  # a one-byte counter holds 255
    at = np.flatnonzero(np.diff(chunk, prepend=-1))
    counts = np.empty((len(at), 8, 8), np.uint8)
    bytes_ = h.view(np.uint8).reshape(-1, 8)
    for b in range(8):
        counts[:, b] = np.add.reduceat(_SPREAD[bytes_[:, b]], at).view(np.uint8).reshape(-1, 8)
    of = doc[at]
    docs_at = np.flatnonzero(np.diff(of, prepend=-1))
    total = np.add.reduceat(counts.reshape(-1, 64).astype(np.int64), docs_at, axis=0)
    bits = np.packbits(2 * total > n[of[docs_at], None], axis=1, bitorder="little")
    out = np.zeros(n_docs, np.uint64)
    out[of[docs_at]] = np.ascontiguousarray(bits).view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint_array(b.column(1), k).view(np.int64))], ["doc_id", "fp"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(ft.released(run), f"doc_id {kind}, fp long")


def posting_masks(max_bits: int = MAX_BITS) -> list[int]:
    """A mask for each choice of 8 - max_bits positions, as signed longs."""
    masks = (sum(0xFF << (8 * p) for p in c) for c in combinations(range(8), 8 - max_bits))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each one's connected part, for links a-b among n entries."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def met(fp: np.ndarray, mask: int, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the linked pairs among the sorted members of the lists of one choice of positions."""
    free = [b for b in range(64) if not (mask >> b) & 1]
    flips = [sum(1 << b for b in c) for k in range(1, max_bits + 1) for c in combinations(free, k)]
    here, there = [], []
    for f in flips:  # what differs in free bits alone has the same key
        want = fp ^ np.uint64(f)
        at = np.minimum(np.searchsorted(fp, want), len(fp) - 1)
        hit = np.flatnonzero((fp[at] == want) & (fp < want))
        here.append(hit)
        there.append(at[hit])
    i, j = np.concatenate(here), np.concatenate(there)
    differ = fp[i] ^ fp[j]
    tally = (differ[:, None].view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    ok = (tally >= 8 - max_bits) & (np.bitwise_count(differ) <= max_bits)
    return i[ok], j[ok]


def linked_parts(fp: np.ndarray, mask: int, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(fp, smallest fp of its part) for the connected parts of posting lists of distinct fingerprints under one choice of positions."""
    fp = np.sort(fp)
    i, j = met(fp, mask, max_bits) if len(fp) > 1 else (fp[:0], fp[:0])
    if not len(i):
        return fp[:0], fp[:0]
    label = _min_labels(len(fp), i, j)
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): for each posting list, members of a connected part with the part's smallest member."""
    masks = posting_masks(max_bits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def done(s, key, fp) -> pa.RecordBatch:
            new = np.concatenate([[True], (s[1:] != s[:-1]) | (key[1:] != key[:-1]), [True]])
            shared = ~(new[:-1] & new[1:])  # not alone in a list
            s, fp = s[shared], fp[shared]
            turn = np.flatnonzero(np.diff(s, prepend=-1, append=-1))
            found = [linked_parts(fp[x:y], masks[s[x]] % (1 << 64), max_bits) for x, y in zip(turn[:-1], turn[1:])]
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
            b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            s, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append((s.astype(np.int64), key, fp.view(np.uint64)))
            s, key, fp = (np.concatenate(x) for x in zip(*held))
            if not len(s):
                continue
            last = int(np.flatnonzero((s != s[-1]) | (key != key[-1]))[-1]) + 1 if (s[0], key[0]) != (s[-1], key[-1]) else 0
            if last:  # the last list may go on in the next batch
                yield done(s[:last], key[:last], fp[:last])
            held = [(s[last:], key[last:], fp[last:])]
        if held and len(held[0][0]):
            yield done(*held[0])

    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("s"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    posts = distinct.select("fp", F.explode(keys).alias("k")).select("k.s", "k.key", "fp")
    return posts.repartition("s", "key").sortWithinPartitions("s", "key").mapInArrow(ft.released(run), "a long, b long").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component with links, by large-star and small-star steps.

    A node of many links is no single group: minima are taken with partial aggregation
    and written, so that the join that hands them out is one that Spark splits.
    """
    now, seen, step = scratch.write(edges.where("a <> b"), "edges-0"), None, 0
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = scratch.write(low, f"low-{step}")
        large = scratch.write(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), f"large-{step}")
        low = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")), f"least-{step}")
        small = large.join(low, "a")
        moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        new = scratch.write(moved, f"edges-{step}")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(*[f"{name}-{step - 1}" for name in ("edges", "low", "large", "least")])
        if state == seen:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, seen = new, state


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    fingerprint is in 16 lowercase hex digits; component_id is the smallest doc_id
    that links reach, the document's own included.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.write(fingerprints(docs, k), "fingerprints")
    distinct = scratch.write(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(scratch, links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    least = scratch.write(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = scratch.write(rooted.join(least, "root").select("fp", "component_id"), "named")
    scratch.drop("distinct", "rooted", "least")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs without near-duplicates: the document of the smallest doc_id of each component stays, in the columns of docs.

    Where doc_ids are null or come twice, the first row by (doc_id with nulls first, text) stays.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    key = fresh(docs, "_row_key")
    rows, _ = with_keys(scratch, docs, key)
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), k, max_bits)
    copies = scratch.write(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)), "copies")
    return rows.join(few(copies), key, "left_anti").select(*docs.columns)
