"""Best-fit packing by a configuration linear program over the length histogram.

Documents become pieces of at most ``capacity`` tokens; only longer documents are
cut. What the plan needs of the corpus is its histogram of piece lengths: at most
``capacity`` numbers, whatever the input.

1. Lengths are grouped into CLASSES classes of about equal token mass, each as long as
   its longest length; with fewer lengths each is a class of its own.
2. The configuration program (fewest sequences so that the configurations cover each
   class) is solved by multiplicative weights: a class's weight falls exponentially
   with its cover, and the pricing step finds the configuration of most weight by a
   bounded knapsack dynamic program over the capacity, in tokens.
3. The fractional solution is rounded to whole configurations, those with the longest
   class first, and each is refined to real lengths: the longest of each class, of which
   one or two are then exchanged so that the sequence is full. Configurations are taken
   up to the number of sequences that the tokens fill. If that leaves more than TAIL
   sequences' worth, the program is solved again for what is left.
4. The rounding residue goes to the fullest sequence with room (best fit, longest
   first), else to new sequences.

Sequences of equal content are one entry with a multiplicity throughout, so the plan
takes the same time for any number of pieces. It is a table of runs: pieces of one
length and consecutive ranks lie at one offset in consecutive sequences. Pieces get
their rank within their length from a running count in the partition they were
written in and the counts of the partitions before, so no length's pieces meet in one
task.

Nulls and oddities: a null text is empty and has the end id alone. Documents are
keyed by doc_id; repeated or null doc_ids are packed as documents of their own. An
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrydex.llm import flattext as ft
from quarrydex.llm.encoder import encoder
from quarrydex.llm.scratch import Scratch

CAPACITY = 4096
CLASSES = 64
#: Share of its demand that a pricing step covers of the class that limits it.
STEP = 0.2
ROUNDS = 4000
#: Sequences' worth of residue that is left to best fit.
TAIL = 16
#: Exchanges of two lengths that are tried for a configuration's pair of pieces.
_TRIES = 4


class Plan:
    """Runs of pieces: those of one length with ranks from ``rank`` on lie at ``offset`` in sequences from ``sequence`` on."""

    def __init__(self, runs: list[tuple[int, int, int, int]], sequences: int, configured: int = 0):
        length, rank, sequence, offset = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((rank, length))
        self.length, self.rank, self.sequence, self.offset = length[order], rank[order], sequence[order], offset[order]
        self.sequences = sequences
        #: Pieces that configurations of the program place.
        self.configured = configured

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        bits = np.int64(44)
        at = np.searchsorted((self.length << bits) | self.rank, (length << bits) | rank, "right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def best_configuration(size: np.ndarray, value: np.ndarray, capacity: int, most: np.ndarray) -> np.ndarray:
    """Copies of each class, at most ``most`` of it, in the configuration of most value: a bounded knapsack by dynamic programming over the capacity."""
    best = np.zeros((len(size) + 1, capacity + 1))  # best[k, c]: most value of the first k classes in c tokens
    for k, (s, v, m) in enumerate(zip(size.tolist(), value.tolist(), most.tolist())):
        now, left, part = best[k], min(m, capacity // s) if v > 0 else 0, 1
        while left > 0:  # copies by parts of 1, 2, 4, ..., any number of which is a sum of some
            part = min(part, left)
            before, now = now, now.copy()
            np.maximum(before[part * s :], before[: capacity + 1 - part * s] + part * v, out=now[part * s :])
            left, part = left - part, 2 * part
        best[k + 1] = now
    copies, c, slip = np.zeros(len(size), np.int64), capacity, 1e-9 * best[-1, -1]
    for k in range(len(size), 0, -1):
        if best[k, c] > best[k - 1, c] + slip:
            n = np.arange(min(int(most[k - 1]), c // int(size[k - 1])) + 1)
            copies[k - 1] = np.argmax(best[k - 1, c - n * size[k - 1]] + n * value[k - 1] >= best[k, c] - slip)
            c -= int(copies[k - 1] * size[k - 1])
    return copies


def solve_configurations(size: np.ndarray, demand: np.ndarray, capacity: int, step: float = STEP, rounds: int = ROUNDS) -> list[tuple[float, np.ndarray]]:
    """(sequences, copies of each class): a fractional cover of the demand by multiplicative weights."""
    cover = np.zeros(len(size))
    rate = math.log(len(size) + 1) / step
    found: dict[bytes, list] = {}
    for _ in range(rounds):
        low = cover.min()
        if low >= 1:
            break
        weight = np.where(cover >= 1, 0.0, np.exp(-rate * np.minimum(cover - low, 1)))
        copies = best_configuration(size, weight / demand, capacity, demand)
        used = np.flatnonzero(copies)
        amount = step * float((demand[used] / copies[used]).min())
        cover[used] += amount * copies[used] / demand[used]
        entry = found.setdefault(copies.tobytes(), [0.0, copies])
        entry[0] += amount
    return [(x, c) for x, c in found.values()]


class Stock:
    """The pieces that are left, by length."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.lengths = sorted(self.left)
        self.has = np.zeros(capacity + 1, bool)
        self.has[self.lengths] = True

    def tokens(self) -> int:
        return sum(n * c for n, c in self.left.items())

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.lengths.pop(bisect.bisect_left(self.lengths, length))
            self.has[length] = False

    def classes(self, n: int) -> list[list[int]]:
        """The lengths in at most n classes of about equal token mass."""
        if len(self.lengths) <= n:
            return [[x] for x in self.lengths]
        mass = np.cumsum([x * self.left[x] for x in self.lengths], dtype=np.float64)
        of = np.minimum((mass - 1e-9) * n / mass[-1], n - 1).astype(int)
        return [[x for x, k in zip(self.lengths, of) if k == g] for g in np.unique(of)]

    def covers(self, content: Counter) -> bool:
        return all(self.left.get(x, 0) >= n for x, n in content.items())

    def refined(self, content: Counter) -> Counter:
        """The content with one or two pieces beside its longest exchanged for lengths that fill the sequence; else pieces exchanged or added while that leaves less room."""
        room = self.capacity - sum(x * n for x, n in content.items())
        own = sorted(content, reverse=True)
        rest = own[1:] or own
        pairs = [(x, y) for i, x in enumerate(rest) for y in rest[i:] if x != y or content[x] > 1]
        for out in [(x,) for x in reversed(rest)] + pairs if room else ():
            want = sum(out) + room
            if want > self.capacity:
                continue
            if len(out) == 1:
                new = [(want,)] if self.has[want] else []
            else:  # the two lengths of that sum nearest to the old ones first
                a = np.flatnonzero(self.has[1:want] & self.has[want - 1 : 0 : -1]) + 1
                new = [(int(x), want - int(x)) for x in a[np.argsort(np.abs(a - out[0]), kind="stable")[:_TRIES]]]
            for found in new:
                changed = content - Counter(out) + Counter(found)
                if self.covers(changed):
                    return changed
        while room:
            gains = []
            for x in [*rest, 0]:
                k = bisect.bisect_right(self.lengths, x + room) - 1
                while k >= 0 and self.lengths[k] > x and self.left[self.lengths[k]] <= content[self.lengths[k]]:
                    k -= 1
                if k >= 0 and self.lengths[k] > x:
                    gains.append((self.lengths[k] - x, x, self.lengths[k]))
            if not gains:
                break
            gain, x, y = max(gains)
            content = content - Counter([x] if x else []) + Counter([y])
            own = sorted(content, reverse=True)
            rest = own[1:] or own
            room -= gain
        return content


def configured(stock: Stock, classes: int) -> Iterator[tuple[Counter, int]]:
    """(content, sequences) of the rounded program over the stock, which are taken from it."""
    groups = stock.classes(classes)
    demand = np.array([sum(stock.left[n] for n in g) for g in groups])
    budget = max(1, stock.tokens() // stock.capacity)
    found = solve_configurations(np.array([g[-1] for g in groups]), demand, stock.capacity)
    for amount, copies in sorted(found, key=lambda x: (-np.flatnonzero(x[1])[-1], -x[0])):
        whole = min(max(1, int(amount)), budget)
        budget -= whole
        while whole > 0:  # sequences alike as long as none of their lengths runs out
            content: Counter = Counter()
            for g in np.flatnonzero(copies).tolist():
                need = int(copies[g])
                for x in reversed(groups[g]):
                    if need and (k := min(need, stock.left.get(x, 0))):
                        content[x] += k
                        need -= k
            if not content:
                budget += whole
                break
            content = stock.refined(content)
            n = min(whole, *(stock.left[x] // k for x, k in content.items()))
            for x, k in content.items():
                stock.take(x, k * n)
            yield content, n
            whole -= n


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES) -> Plan:
    """The packing of a histogram {length: pieces}, lengths from 1 to capacity."""
    stock = Stock(histogram, capacity)
    room: list[list] = [[] for _ in range(capacity + 1)]  # by free tokens: (content, multiplicity); content: (length, copies, before) links
    placed = 0
    while stock.left:
        for lengths, n in configured(stock, classes):
            content = None
            for x, k in sorted(lengths.items(), reverse=True):
                content = (x, k, content)
                placed += k * n
            room[capacity - sum(x * k for x, k in lengths.items())].append((content, n))
        if stock.tokens() <= TAIL * capacity:
            break
    for x, n in sorted(stock.left.items(), reverse=True):
        free = x
        while n > 0:
            while free <= capacity and not room[free]:
                free += 1
            if free > capacity:
                room[capacity].append((None, -(-n // (capacity // x))))
                free = capacity
            content, many = room[free].pop()
            each = free // x
            full = min(many, n // each)
            if full:
                room[free - each * x].append(((x, each, content), full))
                n -= full * each
                many -= full
            if many and 0 < n < each:
                room[free - n * x].append(((x, n, content), 1))
                many, n = many - 1, 0
            if many:
                room[free].append((content, many))
    next_rank = dict.fromkeys(histogram, 0)
    runs: list[tuple[int, int, int, int]] = []
    sequence = 0
    for group in room:
        for content, many in group:
            if content is None:
                continue
            offset = 0
            while content is not None:
                x, copies, content = content
                for _ in range(copies):
                    runs.append((x, next_rank[x], sequence, offset))
                    next_rank[x] += many
                    offset += x
            sequence += many
    return Plan(runs, sequence, placed)


def token_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, place[, ids]); place: the piece's number among those of its length in its partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, count = encoder(tokenizer), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for i, j, ids, at in own_encoder.encode(b.column(1), end):
                n = -(-np.diff(at) // capacity)
                doc = np.repeat(np.arange(j - i), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                begin = at[doc] + piece * capacity
                length = np.minimum(at[doc + 1] - begin, capacity)
                order = np.argsort(length, kind="stable")
                s = length[order]
                turn = np.flatnonzero(np.diff(s, prepend=-1))
                place = np.empty(len(s), np.int64)
                place[order] = count[s] + np.arange(len(s)) - np.repeat(turn, np.diff(np.append(turn, len(s))))
                count += np.bincount(length, minlength=capacity + 1)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(begin.tolist(), length.tolist())]
                columns = [b.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece.astype(np.int64) * capacity), pa.array(length), pa.array(crc, pa.int64()), pa.array(place)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "place"]
                if with_ids:
                    off = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(off), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(ft.released(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, place long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece of each document."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(token_pieces(docs, tokenizer, end, capacity, with_ids).withColumn("part", F.spark_partition_id()), "pieces")
    counts = scratch.write(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = docs.sparkSession.sparkContext.broadcast(make_plan(histogram, capacity))  # bounded by the lengths and the program's configurations
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # the counts grow with the parts and are small on disk only, so they aren't left to be broadcast
    ranked = pieces.join(bases.hint("merge"), (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, len(names)))
            sequence, offset = plan.value.place(length, rank)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    ranked = ranked.select(*names, (F.col("base") + F.col("place")).alias("rank"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(ft.released(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long")
