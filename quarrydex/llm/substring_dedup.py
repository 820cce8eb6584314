"""Substring deduplication with a log-structured fingerprint index.

A window is ``window`` consecutive words of one document. Each word is removed that
a window covers whose word sequence also starts earlier: in a document of a smaller
key, or before in the same document. Windows are judged on the input.

The index is a log of sorted immutable runs, one for each batch of documents, and is
compacted into one run when there are more than ``fanout`` of them. A window's
fingerprint is the smallest hash among its ``gram``-word runs: equal windows have
equal fingerprints, and neighbouring windows mostly share theirs, so a run holds a
seventh of the windows' number. A new batch is

1. reduced to the first document of each group of equal word sequences (the others
   are copies, wholly covered by windows that start earlier);
2. written as a run, range-partitioned and sorted by (fingerprint, key): hot
   fingerprints spread over partitions by key;
3. merge-joined with the runs: fingerprints that occur in two documents, of which one
   is new, name the candidates. They are counted with partial aggregation and written;
   the join that hands them out is one of two shuffled tables, which Spark splits where
   a fingerprint has many rows;
4. verified: the texts of candidate documents (and of documents that repeat a window
   in themselves) are read again, and each candidate window is identified by 96 bits
   of two independent hashes over its whole word sequence, the first document of each
   is found by a minimum with partial aggregation, and windows other than the first
   occurrence are marked.

No step holds the rows of a fingerprint in one place, whatever its share of the rows;
a task holds slices of texts and the windows of single documents.

Nulls and oddities: a null text has no words. Rows are ordered by doc_id; where ids
are null or come twice, by (doc_id with nulls first, text). Repeated rows are copies
of the first one. Texts under ``window`` words lose nothing. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydex.llm import flattext as ft
from quarrydex.llm.scratch import BROADCAST_KEYS, Scratch, few, fresh, keyed, with_keys

WINDOW = 20
GRAM = 8
#: Runs that the log may have; the registered query adds more batches than that, so it compacts.
FANOUT = 1
BATCHES = 3
_SEED2 = 0x5BD1E995


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive entries."""
    if len(a) < w:
        return a[:0]
    size = 1
    while 2 * size <= w:
        a, size = np.minimum(a[:-size], a[size:]), 2 * size
    return np.minimum(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


class Windows:
    """The windows of the texts of a slice: document, start word, fingerprint, and hash mixed with the document."""

    def __init__(self, t: ft.Texts, window: int, gram: int, second: bool = False):
        self.starts, self.ends, self.first = ft.words(t, ft.SPACE_WORDS)
        h = ft.word_hashes(t.data, self.starts, self.ends)
        self.at = np.flatnonzero(ft.inside(self.first, window))
        self.doc = np.searchsorted(self.first, self.at, "right") - 1
        grams = ft.run_hashes(h, gram)
        self.print = sliding_min(grams, window - gram + 1)[self.at]
        self.hash = ft.run_hashes(h, window)[self.at]
        self.salt = ft.mix(np.arange(len(t), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        self.own = self.hash ^ self.salt[self.doc]
        if second:
            h = ft.word_hashes(t.data, self.starts, self.ends, _SEED2)
            self.hash2 = (ft.run_hashes(h, window, 0xC2B2AE3D27D4EB4F)[self.at] >> np.uint64(32)).astype(np.uint32)

    def repeated(self) -> np.ndarray:
        """Marks windows found twice or more in their document."""
        s = np.sort(self.own)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        return member(self.own, twice)

    def candidates(self, prints: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Indexes of the windows whose fingerprint is among their document's, or that come twice in it."""
        keys = np.sort(prints ^ self.salt[of])
        return np.flatnonzero(member(self.print ^ self.salt[self.doc], keys) | self.repeated())


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Marks the values found in sorted keys."""
    if not len(keys):
        return np.zeros(len(values), bool)
    return keys[np.minimum(np.searchsorted(keys, values), len(keys) - 1)] == values


def _lists(column: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists i to j as unsigned 64-bit integers, and the list (from 0) of each."""
    own = column.slice(i, j - i)
    size = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return own.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(j - i), size)


def first_pass(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_key, n_words, digest of the words joined by spaces, inner: repeats a window in itself, prints: distinct fingerprints)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in ft.slices(b.column(1)):
                w = Windows(t, window, gram)
                own = ft.joined(t, ft.SPACE_WORDS, lower=False)[0]
                raw = own.data.tobytes()
                digest = [hashlib.sha256(raw[a:z]).digest() for a, z in zip(own.off[:-1].tolist(), own.off[1:].tolist())]
                inner = np.zeros(j - i, bool)
                inner[w.doc[w.repeated()]] = True
                turn = np.flatnonzero(np.concatenate([[True], (w.print[1:] != w.print[:-1]) | (w.doc[1:] != w.doc[:-1])])) if len(w.at) else w.at
                order = turn[np.lexsort((w.print[turn], w.doc[turn]))]
                p, d = w.print[order], w.doc[order]
                keep = np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])]) if len(p) else np.zeros(0, bool)
                p, d = p[keep], d[keep]
                off = np.searchsorted(d, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(np.diff(w.first).astype(np.int64)), pa.array(digest, pa.binary()), pa.array(inner), pa.ListArray.from_arrays(pa.array(off), pa.array(p.view(np.int64)))],
                    ["doc_key", "n_words", "digest", "inner", "prints"],
                )

    return docs.select("doc_key", "text").mapInArrow(ft.released(run), "doc_key long, n_words long, digest binary, inner boolean, prints array<long>")


def candidate_windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(h1, h2, doc_key) once for each candidate window sequence of a document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, t in ft.slices(b.column(1)):
                w = Windows(t, window, gram, second=True)
                c = w.candidates(*_lists(b.column(2), i, j))
                c = c[np.unique(w.own[c], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(w.hash[c].view(np.int64)), pa.array(w.hash2[c].view(np.int32)), pa.array(key[i:j][w.doc[c]])], ["h1", "h2", "doc_key"])

    return texts.select("doc_key", "text", "prints").mapInArrow(ft.released(run), "h1 long, h2 int, doc_key long")


def cut(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_key, n_removed, kept digest, text without the removed words) from texts with prints and the windows they own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in ft.slices(b.column(1)):
                w = Windows(t, window, gram)
                c = w.candidates(*_lists(b.column(2), i, j))
                owned, of = _lists(b.column(3), i, j)
                mine = member(w.own[c], np.sort(owned ^ w.salt[of]))
                first = np.zeros(len(c), bool)
                first[np.unique(w.own[c], return_index=True)[1]] = True
                gone = w.at[c[~(mine & first)]]
                edge = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + window, -1)
                out = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(out)])
                n_removed = total[w.first[1:]] - total[w.first[:-1]]
                digest, text = [], []
                raw = t.data.tobytes()
                for d in range(j - i):
                    a, z = w.first[d], w.first[d + 1]
                    kept = np.flatnonzero(~out[a:z]) + a
                    digest.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(w.starts[kept].tolist(), w.ends[kept].tolist())])).digest())
                    text.append(_without(raw, t.off[d], t.off[d + 1], w.starts, w.ends, out, a, z) if n_removed[d] else raw[t.off[d] : t.off[d + 1]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n_removed), pa.array(digest, pa.binary()), pa.array(text, pa.binary()).cast(pa.string())], ["doc_key", "n_removed", "kept", "kept_text"])

    return texts.select("doc_key", "text", "prints", "owned").mapInArrow(ft.released(run), "doc_key long, n_removed long, kept binary, kept_text string")


def _without(raw: bytes, begin: int, end: int, starts: np.ndarray, ends: np.ndarray, out: np.ndarray, a: int, z: int) -> bytes:
    """A document's bytes without each run of removed words and the blanks after it (for a run at the end, the blanks before it)."""
    turn = np.flatnonzero(np.diff(out[a:z].astype(np.int8), prepend=0, append=0)) + a
    parts, at = [], begin
    for x, y in zip(turn[::2].tolist(), turn[1::2].tolist()):
        if y < z:
            parts.append(raw[at : starts[x]])
            at = starts[y]
        else:
            parts.append(raw[at : max(at, ends[x - 1])] if x > a else b"")
            at = end
    parts.append(raw[at:end])
    return b"".join(parts)


class FingerprintIndex:
    """The log of runs of one corpus, and what verification needs of it: digests of documents and their texts."""

    def __init__(self, scratch: Scratch, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        if not 0 < gram <= window:
            raise ValueError("gram must be from 1 to window")
        self.scratch, self.window, self.gram, self.fanout = scratch, window, gram, fanout
        self.runs: list[tuple[str, DataFrame]] = []
        self.digests: list[DataFrame] = []
        self.sources: list[DataFrame] = []
        self.n = 0

    def add(self, docs: DataFrame) -> DataFrame:
        """Judges a batch (doc_key, text), whose keys are above all before, against the index and itself, and adds it.

        (doc_key, n_words, n_removed, kept digest, kept_text or null where nothing was removed.)
        """
        s, b = self.scratch, self.n
        self.n += 1
        seen = s.write(first_pass(docs, self.window, self.gram), f"seen-{b}")
        full = seen.where(F.col("n_words") >= self.window)
        known = full.select("digest", "doc_key")
        for d in self.digests:
            known = known.unionByName(d)
        # written first, so that the join's own exchanges can be split where one digest holds many documents
        owner = s.write(known.groupBy("digest").agg(F.min("doc_key").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), f"owners-{b}")
        copy = F.coalesce(F.col("owner") != F.col("doc_key"), F.lit(False))
        roles = s.write(full.join(owner, "digest", "left").withColumn("copy", copy).drop("owner"), f"roles-{b}")
        lead = roles.where("not copy")
        run = lead.select(F.explode("prints").alias("print"), "doc_key").repartitionByRange("print", "doc_key").sortWithinPartitions("print", "doc_key")
        new = s.write(run, f"run-{b}")
        s.release()
        every = new.select("print", "doc_key", F.lit(1).alias("new"))
        for _, old in self.runs:
            every = every.unionByName(old.select("print", "doc_key", F.lit(0).alias("new")))
        shared = every.groupBy("print").agg(F.count("*").alias("n"), F.max("new").alias("new")).where("n > 1 and new = 1").select("print")
        shared = s.write(shared, f"shared-{b}")  # so that the join below can be split where one print holds many documents
        wanted = every.join(shared, "print", "left_semi").select("doc_key", "print")
        wanted = wanted.groupBy("doc_key").agg(F.collect_list("print").alias("prints"))
        inner = lead.where("inner").select(F.col("doc_key").alias("inner_key"))
        wanted = wanted.join(inner, wanted["doc_key"] == inner["inner_key"], "full").select(F.coalesce("doc_key", "inner_key").alias("doc_key"), "prints")
        wanted = s.write(wanted, f"wanted-{b}")
        s.release()
        self.sources.append(docs.select("doc_key", "text"))
        texts = self.sources[0]
        for x in self.sources[1:]:
            texts = texts.unionByName(x)
        if wanted.count() <= BROADCAST_KEYS:
            texts = texts.join(F.broadcast(wanted.select("doc_key")), "doc_key", "left_semi")
        texts = s.write(texts.join(wanted, "doc_key"), f"texts-{b}")
        s.drop(f"wanted-{b}", f"shared-{b}")
        first = candidate_windows(texts, self.window, self.gram).groupBy("h1", "h2").agg(F.min("doc_key").alias("doc_key"))
        owned = s.write(first.groupBy("doc_key").agg(F.collect_list("h1").alias("owned")), f"owned-{b}")
        s.release()
        judged = texts.join(lead.select("doc_key"), "doc_key", "left_semi") if self.runs else texts
        result = s.write(cut(judged.join(owned, "doc_key", "left"), self.window, self.gram), f"cut-{b}")
        s.drop(f"texts-{b}", f"owned-{b}")
        self.digests.append(lead.select("digest", "doc_key"))
        self.runs.append((f"run-{b}", new))
        if len(self.runs) > self.fanout:
            self.compact()
        nothing = F.unhex(F.sha2(F.lit(b""), 256))
        copies = roles.where("copy").select("doc_key", F.lit(0).alias("copied"))
        hit = result.select(F.col("doc_key").alias("hit_key"), "n_removed", "kept", "kept_text").where("n_removed > 0")
        # doc keys are unique and neither side is large: digests and counts, and the texts that changed
        out = seen.select("doc_key", "n_words", "digest").join(copies.withColumnRenamed("doc_key", "copy_key"), F.col("doc_key") == F.col("copy_key"), "left").join(hit, F.col("doc_key") == F.col("hit_key"), "left")
        return out.select(
            "doc_key",
            "n_words",
            F.when(F.col("copied").isNotNull(), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(F.col("copied").isNotNull(), nothing).otherwise(F.coalesce("kept", "digest")).alias("kept"),
            F.when(F.col("copied").isNotNull(), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        )

    def compact(self) -> None:
        """Merges all runs into one sorted run."""
        merged = self.runs[0][1]
        for _, r in self.runs[1:]:
            merged = merged.unionByName(r)
        name = f"compacted-{self.n}"
        new = self.scratch.write(merged.repartitionByRange("print", "doc_key").sortWithinPartitions("print", "doc_key"), name)
        self.scratch.drop(*[n for n, _ in self.runs])
        self.runs = [(name, new)]


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with the repeated words cut out of their texts, in the columns of docs; an n_chars column follows the text.

    Every row stays; a text that is repeated as a whole becomes empty. Only texts that change are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "without-repeats")
    key = fresh(docs, "_row_key")
    rows, _ = with_keys(scratch, docs, key)
    found = remove_repeats(rows.select(F.col(key).alias("doc_id"), "text"), **options)
    changed = scratch.write(found.where("kept_text is not null").select(F.col("doc_id").alias(key), F.col("kept_text").alias("text")), "changed")
    ids = few(changed.select(key))
    new = rows.join(ids, key, "left_semi").drop("text").join(changed, key)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.join(ids, key, "left_anti").select(*docs.columns).unionByName(new.select(*docs.columns))


def remove_repeats(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT) -> DataFrame:
    """(doc_key, doc_id, n_words, n_removed, kept_sha256, kept_text) for each row of docs, added to an index in ``batches`` ranges of keys.

    kept_text is null where nothing was removed. The result doesn't depend on ``batches``.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    rows, plain = keyed(scratch, docs)
    index = FingerprintIndex(scratch, window, gram, fanout)
    cuts = rows.approxQuantile("doc_key", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges: list[float | None] = [None, *sorted({c for c in cuts}), None]
    out = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        own = rows
        if lo is not None:
            own = own.where(F.col("doc_key") > int(lo))
        if hi is not None:
            own = own.where(F.col("doc_key") <= int(hi))
        found = index.add(own)
        out = found if out is None else out.unionByName(found)
    out = out.withColumn("kept_sha256", F.lower(F.hex("kept"))).drop("kept")
    if plain:
        return out.select("doc_key", F.col("doc_key").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text")
    return out.join(rows.select("doc_key", "doc_id"), "doc_key").select("doc_key", "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
