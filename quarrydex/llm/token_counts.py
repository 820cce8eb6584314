"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A document is cut into pieces before its blanks, over which the tokenizer never joins
(see encoder). The tree's leaves are runs of about LEAF pieces; its nodes hold the
bytes and the tokens below them. An edit replaces a byte range: the pieces it touches
and one whole piece of context on either side are cut and encoded again, their leaf
is rewritten, and the sums on the way to the root are updated. Everything else keeps
its counts. An edit that brings in characters over which pieces could join (other
white space, controls, a special token's string) makes it encode the document anew.

Nulls and oddities: a null text counts as empty, null edits as none. Edits apply one
after another, each to the text that the one before left, in bytes; a range past the
end is cut off at it. Rows are independent: repeated rows get repeated results, an
empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydex.llm import flattext as ft
from quarrydex.llm.encoder import Encoder, _odd, encoder
from quarrydex.llm.scratch import small_batches

LEAF = 64
Edit = tuple[int, int, str]


class CountTree:
    """Token counts of one document under edits."""

    def __init__(self, encoder: Encoder, raw: bytes, lengths: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.encoder = encoder
        self.encoded_bytes = 0
        if lengths is None:
            lengths, counts = self._cut(raw)
        self._build(raw, lengths, counts)

    def _cut(self, raw: bytes, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Byte lengths and token counts of the pieces of some bytes."""
        self.encoded_bytes += len(raw)
        data = np.zeros(len(raw) + 8, np.uint8)
        data[: len(raw)] = np.frombuffer(raw, np.uint8)
        if whole and raw:
            pieces = pa.array([raw.decode()], pa.large_string())
        else:
            pieces, _ = self.encoder._pieces(ft.Texts(data, np.array([0, len(raw)])))
        off = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1]
        return np.diff(off), self.encoder._ids(pieces)[1]

    def _build(self, raw: bytes, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.leaves: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        at = 0
        for k in range(0, len(lengths), LEAF):
            own = lengths[k : k + LEAF]
            size = int(own.sum())
            self.leaves.append((raw[at : at + size], own, counts[k : k + LEAF]))
            at += size
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.bytes, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, (b, _, c) in enumerate(self.leaves):
            self.bytes[self.width + k], self.tokens[self.width + k] = len(b), int(c.sum())
        for n in range(self.width - 1, 0, -1):
            self._sum(n)

    def _sum(self, n: int) -> None:
        self.bytes[n] = self.bytes[2 * n] + self.bytes[2 * n + 1]
        self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    def _set(self, leaf: int, value: tuple[bytes, np.ndarray, np.ndarray]) -> None:
        self.leaves[leaf] = value
        n = self.width + leaf
        self.bytes[n], self.tokens[n] = len(value[0]), int(value[2].sum())
        while n > 1:
            n //= 2
            self._sum(n)

    @property
    def n_bytes(self) -> int:
        return self.bytes[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> bytes:
        return b"".join(b for b, _, _ in self.leaves)

    def _piece(self, at: int) -> tuple[int, int, int, int]:
        """(leaf, piece in it, first byte, byte after the last) of the piece that holds a byte."""
        n, base = 1, 0
        while n < self.width:
            n *= 2
            if at - base >= self.bytes[n]:
                base += self.bytes[n]
                n += 1
        ends = np.cumsum(self.leaves[n - self.width][1])
        k = int(np.searchsorted(ends, at - base, "right"))
        return n - self.width, k, base + (int(ends[k - 1]) if k else 0), base + int(ends[k])

    def edit(self, start: int, end: int, text: str) -> None:
        """Replaces the bytes from start to end by a text."""
        n, new = self.n_bytes, text.encode()
        start, end = max(0, min(start, n)), max(0, min(end, n))
        end = max(start, end)
        if not n:
            return self._whole(new)
        first = self._piece(max(start - 1, 0))
        if first[2]:
            first = self._piece(first[2] - 1)
        last = self._piece(min(end, n - 1))
        if last[3] < n:
            last = self._piece(last[3])
        base = first[2] - int(self.leaves[first[0]][1][: first[1]].sum())
        held = b"".join(self.leaves[k][0] for k in range(first[0], last[0] + 1))
        body = held[first[2] - base : start - base] + new + held[end - base : last[3] - base]
        data = np.frombuffer(body, np.uint8)
        whole = self._special(first[0], last[0], held[: start - base] + new + held[end - base :])
        if whole or self.encoder.mode == "whole" or len(_odd(data, np.array([0, len(data)]))) or len(self.leaves) == 1 and len(self.leaves[0][1]) == 1:
            everything = self.text()
            return self._whole(everything[:start] + new + everything[end:])
        lengths, counts = self._cut(body)
        head, tail = self.leaves[first[0]], self.leaves[last[0]]
        lengths = np.concatenate([head[1][: first[1]], lengths, tail[1][last[1] + 1 :]])
        counts = np.concatenate([head[2][: first[1]], counts, tail[2][last[1] + 1 :]])
        raw = held[: first[2] - base] + body + held[last[3] - base :]
        if len(lengths) > 4 * LEAF:  # a leaf grown too long: lay the leaves out anew, from known counts
            before, after = self.leaves[: first[0]], self.leaves[last[0] + 1 :]
            return self._build(
                b"".join([*(x[0] for x in before), raw, *(x[0] for x in after)]),
                np.concatenate([*(x[1] for x in before), lengths, *(x[1] for x in after)]),
                np.concatenate([*(x[2] for x in before), counts, *(x[2] for x in after)]),
            )
        none = np.zeros(0, np.int64)
        for k in range(first[0] + 1, last[0] + 1):
            self._set(k, (b"", none, none))
        self._set(first[0], (raw, lengths, counts))

    def _special(self, k: int, z: int, middle: bytes) -> bool:
        """True if a special token's string lies in the edited leaves, or over their ends."""
        reach = max(map(len, self.encoder.special), default=0)
        before = after = b""
        while k > 0 and len(before) < reach:
            k -= 1
            before = self.leaves[k][0] + before
        while z + 1 < len(self.leaves) and len(after) < reach:
            z += 1
            after += self.leaves[z][0]
        around = before[-reach:] + middle + after[:reach]
        return any(x in around for x in self.encoder.special)

    def _whole(self, raw: bytes) -> None:
        self._build(raw, *self._cut(raw))


def repeated_lines(text: str) -> list[Edit]:
    """Edits that delete each line equal to an earlier one, from the last to the first."""
    seen: set[bytes] = set()
    out: list[Edit] = []
    at, raw = 0, text.encode()
    for line in raw.split(b"\n"):
        if line.strip() and line in seen:
            out.append((at, min(at + len(line) + 1, len(raw)), ""))
        seen.add(line)
        at += len(line) + 1
    return out[::-1]


def edited_counts(docs: DataFrame, tokenizer: str, edits: Callable[[str], list[Edit]] | str) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_bytes, n_bytes_encoded) for each document.

    edits: a function of the text, or the name of a column array<struct<start,end,text>>.
    n_bytes_encoded: bytes encoded again for the edits.
    """
    small_batches(docs.sparkSession)
    named = isinstance(edits, str)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer, led=True)
        for b in batches:
            for i, j, t in ft.slices(b.column(1)):
                pieces, first = own_encoder._pieces(t)
                lengths = np.diff(np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1])
                counts = own_encoder._ids(pieces)[1]
                before = np.concatenate([[0], np.cumsum(counts)])
                total = np.diff(before[first])
                n_edits, edited, again = np.zeros(j - i, np.int64), total.copy(), np.zeros(j - i, np.int64)
                raw = t.data.tobytes()
                for d in range(j - i):
                    own = raw[t.off[d] : t.off[d + 1]]
                    todo = [(x["start"], x["end"], x["text"] or "") for x in b.column(2)[i + d].as_py() or []] if named else edits(own.decode())
                    if todo:
                        tree = CountTree(own_encoder, own, lengths[first[d] : first[d + 1]], counts[first[d] : first[d + 1]])
                        for e in todo:
                            tree.edit(*e)
                        n_edits[d], edited[d], again[d] = len(todo), tree.n_tokens, tree.encoded_bytes
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *map(pa.array, (total, n_edits, edited, np.diff(t.off), again))], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_bytes", "n_bytes_encoded"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *([F.col(edits).cast("array<struct<start:bigint,end:bigint,text:string>>").alias("edits")] if named else []))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(ft.released(run), f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_bytes long, n_bytes_encoded long")
