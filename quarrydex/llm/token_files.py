"""Token-id files of patched frame-of-reference blocks.

A segment holds the ids of consecutive documents, in ascending doc_id order:

    magic "QPF1", u32 block size, u64 ids, u32 documents, u32 blocks
    i64 doc_id and u8 null mark of each document, u32 ids of each document
    u64 byte start of each block, counted from the end of this index, plus the total
    blocks: u32 minimum, u8 width, u16 exceptions;
            ids minus the minimum, their low ``width`` bits packed little-endian;
            u16 positions and u32 differences of the exceptions

The width of a block is the bits that the ``percentile`` smallest share of its
differences need; larger differences are exceptions, patched after unpacking. The
block index lets a reader unpack a single block. Segments are the rows of a Parquet
container, so they are committed by Spark on any shared store and a lost executor's
files are written again; the rows of a part are in order, and so are the parts.

Nulls and oddities: a null text is empty and has the end id alone. Null doc_ids come
first; rows of one doc_id are ordered by a hash of their text, and a range of rows may
end among equal ones, so that repeated rows don't meet in one task. Other columns are
not read, so their names don't matter. An empty table gives no segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrydex.llm import flattext as ft
from quarrydex.llm.encoder import encoder
from quarrydex.llm.scratch import Scratch, few, starts

BLOCK = 1024
PERCENTILE = 0.9
SEGMENT_IDS = 500_000
#: Blocks packed or unpacked at once, which bounds the bits laid out in memory.
_AT_ONCE = 128
_MAGIC = b"QPF1"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned 32-bit value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values as rows of bytes, the low ``width`` bits of each."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(*values.shape, 4), axis=-1, count=width, bitorder="little") if width else np.zeros((*values.shape, 0), np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    """The inverse of _pack, for rows of n values."""
    if not width:
        return np.zeros((len(data), n), np.uint32)
    bits = np.unpackbits(data, axis=1, count=n * width, bitorder="little").reshape(len(data), n, width)
    full = np.zeros((len(data), n, 32), np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full.reshape(len(data), -1), axis=1, bitorder="little").view("<u4")


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of some ids; the last may be shorter."""
    out: list[bytes] = []
    n = len(ids) // block * block
    for rows in (ids[:n].reshape(-1, block), ids[n:].reshape(1, -1)):
        if not rows.size:
            continue
        low = rows.min(axis=1)
        diff = (rows - low[:, None]).astype("<u4")
        bits = _bits(diff)
        k = min(rows.shape[1] - 1, int(np.ceil(percentile * rows.shape[1])) - 1)
        width = np.partition(bits, k, axis=1)[:, k]
        past = bits > width[:, None]
        packed: list[bytes] = [b""] * len(rows)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            for k in range(0, len(own), _AT_ONCE):
                part = own[k : k + _AT_ONCE]
                for r, p in zip(part.tolist(), _pack(diff[part], w)):
                    packed[r] = p.tobytes()
        at, pos = np.nonzero(past)
        cut = np.searchsorted(at, np.arange(len(rows) + 1))
        values = diff[at, pos].astype("<u4")
        pos = pos.astype("<u2")
        for r in range(len(rows)):
            a, z = cut[r], cut[r + 1]
            out.append(struct.pack("<IBH", int(low[r]), int(width[r]), z - a) + packed[r] + pos[a:z].tobytes() + values[a:z].tobytes())
    return out


def decode_block(data: bytes, n: int) -> np.ndarray:
    """The n ids of one block."""
    return decode_blocks(data, np.array([0, len(data)]), n, n)


def decode_blocks(data: bytes, starts: np.ndarray, n_ids: int, block: int) -> np.ndarray:
    """The ids of consecutive blocks at the byte starts (plus the end)."""
    out = np.zeros(n_ids, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    heads = [struct.unpack_from("<IBH", data, int(s)) for s in starts[:-1]]
    sizes = np.full(len(heads), block)
    if n_ids % block and len(heads):
        sizes[-1] = n_ids % block
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (_, width, _) in enumerate(heads):
        groups.setdefault((width, int(sizes[k])), []).append(k)
    parts = [(w, n, own[k : k + _AT_ONCE]) for (w, n), own in groups.items() for k in range(0, len(own), _AT_ONCE)]
    for width, n, own in parts:
        length = (n * width + 7) // 8
        rows = np.stack([raw[int(starts[k]) + 7 : int(starts[k]) + 7 + length] for k in own])
        values = _unpack(rows, n, width)
        for k, v in zip(own, values):
            low, _, m = heads[k]
            if m:
                p = int(starts[k]) + 7 + length
                v[np.frombuffer(data, "<u2", m, p)] = np.frombuffer(data, "<u4", m, p + 2 * m)
            out[k * block : k * block + n] = v + np.uint32(low)
    return out


def encode_segment(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    blocks = encode_blocks(ids, block, percentile)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<u8")
    named = np.array([d or 0 for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    return b"".join([_MAGIC, struct.pack("<IQII", block, len(ids), len(doc_ids), len(blocks)), named.tobytes(), nulls.tobytes(), sizes.astype("<u4").tobytes(), starts.tobytes(), *blocks])


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document, all ids)."""
    if data[:4] != _MAGIC:
        raise ValueError("not a segment of token ids")
    block, n_ids, n_docs, n_blocks = struct.unpack_from("<IQII", data, 4)
    p = 24
    named = np.frombuffer(data, "<i8", n_docs, p).tolist()
    nulls = np.frombuffer(data, np.uint8, n_docs, p + 8 * n_docs)
    sizes = np.frombuffer(data, "<u4", n_docs, p + 9 * n_docs)
    p += 13 * n_docs
    starts = np.frombuffer(data, "<u8", n_blocks + 1, p).astype(np.int64) + p + 8 * (n_blocks + 1)
    return [None if x else d for d, x in zip(named, nulls)], sizes, decode_blocks(data, starts, n_ids, block)


def token_segments(docs: DataFrame, tokenizer: str, end: int, block: int = BLOCK, percentile: float = PERCENTILE, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """(part, seq, before, n_ids, payload): segments in ascending doc_id order; before: ids of the part before the segment."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder = encoder(tokenizer)
        seq = before = held = 0
        names: list = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            payload = encode_segment(names, np.concatenate(sizes), flat, block, percentile)
            return pa.RecordBatch.from_arrays([pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([payload], pa.binary())], ["seq", "before", "n_ids", "payload"])

        for b in batches:
            own = b.column(0).to_pylist()
            for i, j, found, at in own_encoder.encode(b.column(1), end):
                names += own[i:j]
                sizes.append(np.diff(at))
                ids.append(found)
                held += len(found)
                if held >= segment_ids:
                    yield closed()
                    seq, before, held, names, sizes, ids = seq + 1, before + held, 0, [], [], []
        if names:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.withColumn("salt", F.rand(7)).repartitionByRange(*order, "salt").drop("salt").sortWithinPartitions(*order, "text")
    return ordered.mapInArrow(ft.released(run), "seq long, before long, n_ids long, payload binary").select(F.spark_partition_id().alias("part"), "seq", "before", "n_ids", "payload")


def read_back(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of written segments."""
    parts = few(starts(segments.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "part_start"))  # a row for each written part

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin, payload in zip(b.column(0).to_pylist(), b.column(1)):
                names, sizes, ids = decode_segment(payload.as_buffer().to_pybytes())
                at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(at[:-1] + begin), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = segments.join(parts, "part").select((F.col("part_start") + F.col("before")).alias("start"), "payload")
    return placed.mapInArrow(ft.released(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end: int, **format_options) -> DataFrame:
    """Writes the segments of docs to the shared folder and gives what the files hold, per document."""
    scratch = Scratch(docs.sparkSession, "tokens")
    return read_back(scratch.write(token_segments(docs, tokenizer, end, **format_options), "segments"))
