"""Toxicity: a character n-gram linear classifier on naive-Bayes log-count ratios.

A text, its A-Z lower-cased and its words joined by single blanks, is the set of its
hashed character n-grams, each once for every level of LEVELS that its count in the text
reaches: a common n-gram can tell by coming often. On a bounded sample of labelled
documents each feature gets the naive Bayes ratio r = log((p + a) / |p|) - log((q + a) / |q|)
of its document counts p and q in toxic and other documents. Features of no association
with the mark (a chi-square under MIN_CHI, or under MIN_SHARE of the documents) say
nothing and go, the others all stay; a logistic regression is fitted to the presence of
each, scaled by its r. Scores are the fitted probabilities, with the intercept moved from
the sample's share of toxic documents to that of all labels used.

The sample: of the labels whose document is not held out, at most MAX_PER_CLASS of
either class, those of the smallest hash of doc_id. So the driver holds at most
2 * MAX_PER_CLASS documents' kept features, and 2 ** BITS counts. Every document is
scored, over its whole text, however long.

Nulls and oddities: a null text is empty and scores by the intercept. A null doc_id is
not held out and is never trained on. Labels with a null id or mark are not used;
contradicting labels of one document count as toxic. Without labels of both classes
every score is the share of toxic ones (0 without labels). Repeated rows score alike.
An empty table gives an empty result. Other columns are not read, so their names don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrydex.llm import flattext as ft
from quarrydex.llm.scratch import Scratch, small_batches

GRAMS = (3, 4, 5)
#: Counts of an n-gram in a text that make a feature each.
LEVELS = (1, 2, 3)
BITS = 21
#: Least chi-square of a feature with the mark, as such and as a share of the sample's documents.
MIN_CHI = 20.0
MIN_SHARE = 0.005
MAX_PER_CLASS = 4000
SMOOTHING = 1.0
PENALTY = 0.1
THRESHOLD = 0.7
_STEP = 0x9E3779B97F4A7C15
_STEP32 = 0x9E3779B1


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id's text leaves 1 when divided by 3."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def grams_of(wanted: np.ndarray) -> np.ndarray:
    """Marks the n-grams that have a wanted feature at some level."""
    every, out = np.arange(1 << BITS), wanted.copy()
    for level in LEVELS[1:]:
        out |= wanted[(every * _STEP32 * level + level) & ((1 << BITS) - 1)]
    return out


def presences(column: pa.Array, wanted: np.ndarray | None = None, grams: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, rows, features) by slices: the distinct features of each row, of the wanted ones if given (with grams_of them)."""
    for i, j, t in ft.slices(column, ft.SLICE_BYTES // 3):
        own, _, _, _ = ft.joined(t, ft.SPACE_WORDS, lower=True)
        data = own.data[: own.off[-1]]
        point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first = point[own.off]
        chars = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        docs, feats = [], []
        for n in GRAMS:
            ok = np.flatnonzero(ft.inside(first, n))
            f = (ft.run_hashes(chars + np.uint64(n), n, _STEP)[ok] >> np.uint64(64 - BITS)).astype(np.int64)
            if grams is not None:
                hit = np.flatnonzero(grams[f])
                ok, f = ok[hit], f[hit]
            docs.append(np.searchsorted(first, ok, "right") - 1)
            feats.append(f)
        pair, count = np.unique((np.concatenate(docs) << BITS) | np.concatenate(feats), return_counts=True)
        many, mask = [pair], (1 << BITS) - 1
        for level in LEVELS[1:]:
            own = pair[count >= level]
            many.append((own & ~mask) | (((own & mask) * _STEP32 * level + level) & mask))
        pair = np.unique(np.concatenate(many))
        if wanted is not None:
            pair = pair[wanted[pair & mask]]
        yield i, j, pair >> BITS, pair & mask


@dataclass
class Model:
    """The weight of each feature (0: not kept) and the intercept."""

    weight: np.ndarray
    intercept: float
    wanted: np.ndarray | None = None
    grams: np.ndarray | None = None

    def score(self, column: pa.Array) -> np.ndarray:
        if self.wanted is None:
            self.wanted = self.weight != 0
            self.grams = grams_of(self.wanted)
        out = np.full(len(column), self.intercept)
        for i, j, docs, feats in presences(column, self.wanted, self.grams):
            out[i:j] += np.bincount(docs, self.weight[feats], j - i)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def ratios(toxic: np.ndarray, clean: np.ndarray, a: float = SMOOTHING) -> np.ndarray:
    """Naive Bayes log-count ratios from document counts."""
    p, q = toxic + a, clean + a
    return np.log(p / p.sum()) - np.log(q / q.sum())


def chi_square(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    n = n_toxic + n_clean
    with_it = toxic + clean
    part = with_it * (n - with_it) * float(n_toxic) * float(n_clean)
    return np.where(part > 0, n * (toxic * float(n_clean) - clean * float(n_toxic)) ** 2 / np.maximum(part, 1), 0)


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_cols: int, penalty: float = PENALTY, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge-penalised logistic regression over sparse entries, by accelerated gradient steps."""
    w, b, vw, vb = np.zeros(n_cols), 0.0, np.zeros(n_cols), 0.0
    load = np.zeros(n_cols)
    np.add.at(load, cols, values**2)
    per_row = np.bincount(rows, np.abs(values), len(y)).max(initial=1.0)
    bound = np.maximum(np.bincount(cols, np.abs(values) * per_row, n_cols) / 4, 1e-9) + penalty  # a diagonal bound of the curvature
    bound_b = len(y) / 4 + per_row
    t = 1.0
    for _ in range(rounds):
        z = vb + np.bincount(rows, values * vw[cols], len(y))
        slope = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        new_w = vw - (np.bincount(cols, values * slope[rows], n_cols) + penalty * vw) / bound
        new_b = vb - slope.sum() / bound_b
        new_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, min_chi: float = MIN_CHI, min_share: float = MIN_SHARE) -> Model:
    """Fits the classifier on a bounded sample of the labels that are not held out."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    used = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    used = scratch.write(used, "labels")
    shares = {r["y"]: r["n"] for r in used.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = shares.get(1, 0), shares.get(0, 0)
    total = n_toxic + n_clean
    none = Model(np.zeros(1 << BITS), float(np.log(max(n_toxic, 1e-9) / max(n_clean, 1e-9))) if total else -500.0)
    if not n_toxic or not n_clean:
        return none
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = used.where("y = 1").orderBy(*order).limit(max_per_class).unionByName(used.where("y = 0").orderBy(*order).limit(max_per_class))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # at most 2 * max_per_class ids
    sample = scratch.write(rows.groupBy("doc_id", "y").agg(F.max("text").alias("text")).repartition(8, "doc_id"), "sample")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            n += np.bincount(y, minlength=2)
            for i, j, docs_, feats in presences(b.column(1)):
                for k in (0, 1):
                    count[k] += np.bincount(feats[y[i:j][docs_] == k], minlength=1 << BITS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([n[0]]), pa.array([n[1]]), pa.array([count[0].tobytes()], pa.binary()), pa.array([count[1].tobytes()], pa.binary())], ["n0", "n1", "c0", "c1"])

    clean, toxic, n0, n1 = np.zeros(1 << BITS), np.zeros(1 << BITS), 0, 0
    for r in sample.select("y", "text").mapInArrow(ft.released(counted), "n0 long, n1 long, c0 binary, c1 binary").toLocalIterator():  # a row of fixed size for each of a few partitions
        clean += np.frombuffer(r["c0"], np.int32)
        toxic += np.frombuffer(r["c1"], np.int32)
        n0, n1 = n0 + r["n0"], n1 + r["n1"]
    if not n0 or not n1:
        return none
    worth = chi_square(toxic, clean, n1, n0)
    keep = np.flatnonzero(worth >= max(min_chi, min_share * (n0 + n1)))
    r_all = ratios(toxic, clean)
    wanted = np.zeros(1 << BITS, bool)
    wanted[keep] = True
    grams = grams_of(wanted)

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, docs_, feats in presences(b.column(1), wanted, grams):
                off = np.searchsorted(docs_, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(off), pa.array(feats.astype(np.int32)))], ["y", "feats"])

    found = sample.select("y", "text", "doc_id").orderBy("doc_id").drop("doc_id").mapInArrow(ft.released(listed), "y int, feats array<int>").toArrow()  # at most 2 * max_per_class rows
    lists = found.column("feats").combine_chunks()
    y = found.column("y").to_numpy().astype(float)
    rows_at = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy(zero_copy_only=False))
    cols = np.searchsorted(keep, lists.flatten().to_numpy())
    w, b = fit_logistic(rows_at, cols, r_all[keep][cols], y, len(keep))
    weight = np.zeros(1 << BITS)
    weight[keep] = w * r_all[keep]
    return Model(weight, b + float(np.log(n_toxic / n_clean) - np.log(n1 / n0)))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1)))], ["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(ft.released(run), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
