"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once.

Where the tokenizer's own splitting never joins characters over a blank, a text is
cut before its blanks (byte-level splitting, in which a blank leads the next word) or
at them (splitting that drops blanks), and between ASCII letters, digits and symbols,
which either splitting keeps apart but for contractions. The pieces of a slice are
dictionary-encoded exactly, and only pieces not met before go through the tokenizer.
Any other tokenizer gets whole texts, and slices that hold a special token's string
are cut at blanks alone. The ids are those of encoding each whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quarrydex.llm import flattext as ft

#: Pieces kept between slices; beyond it the store starts anew.
STORE_PIECES = 500_000
_STORED_BYTES = 48
SLICE_BYTES = 4_000_000
#: 1: ASCII letter, 2: digit, 3: symbol; 0: blanks, controls, non-ASCII bytes and the apostrophe, beside which nothing is cut.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = 3


def splitting(path: str) -> str:
    """How texts may be cut for the tokenizer of a file: "led" (a blank belongs to the word after it), "words" (blanks are dropped) or "whole"."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre, norm = d.get("pre_tokenizer") or {}, d.get("normalizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in d.get("added_tokens", []))
    if not plain:
        return "whole"
    if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "led"
    steps = pre.get("pretokenizers", [])
    kinds = [n.get("type") for n in norm.get("normalizers", [])]
    drops = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"[^\s" in steps[0]["pattern"].get("Regex", "") and steps[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    return "words" if drops and set(kinds) <= {"NFC", "Replace", "Lowercase"} and all(n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norm["normalizers"] if n["type"] == "Replace") else "whole"


#: Pieces of Latin letters alone (led: after one blank) are one pre-token each.
_LETTERS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
_PLAIN = {"words": re.compile(_LETTERS), "led": re.compile(f" {_LETTERS}")}
_JOINED = 1000


_made: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, led: bool = False) -> Encoder:
    """The encoder of a file, made once in a worker process: loading a tokenizer takes longer than a small task."""
    if (path, led) not in _made:
        _made[path, led] = Encoder(path, led)
    return _made[path, led]


class Encoder:
    """Encodes columns of texts; made in the process that uses it."""

    def __init__(self, path: str, led: bool = False):
        """led: cut before blanks even where the tokenizer drops them, so that the pieces make up the text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.mode = Tokenizer.from_file(path), splitting(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # which ids end (words) or begin (led) a pre-token; joined pieces are told apart by them
        vocab = self.tokenizer.get_vocab()
        mark = {"words": lambda v: v.endswith("</w>"), "led": lambda v: v.startswith("\u0120")}.get(self.mode)
        self.plain = _PLAIN.get(self.mode)
        if led and self.mode == "words":
            self.mode, self.plain = "led", None
        self.edges = np.zeros(max(vocab.values(), default=0) + 1, bool)
        if mark:
            self.edges[[i for v, i in vocab.items() if mark(v)]] = True
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.begin, self.size, self.ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        self.n_slots = self.n_ids = 0

    def _pieces(self, t: ft.Texts) -> tuple[pa.Array, np.ndarray]:
        """The pieces of the texts and the first piece of each text."""
        n = int(t.off[-1])
        if self.mode == "words":
            starts, ends, first = ft.words(t, ft.SPACE_WORDS)
            data = t.data[:n]
            kind = self._kinds(data)
            kept = ft.SPACE_WORDS[data]
            # a capital is lowered as the tokenizer does, but where a combining mark may follow
            upper = np.flatnonzero((data >= 0x41) & (data < 0x5B))
            after = t.data[upper + 1]
            data = data.copy()
            data[upper[(after < 0xCC) | ((after > 0xCD) & (after < 0xE0))]] += 0x20
            data, kind = data[kept], kind[kept]
            off = np.concatenate([[0], np.cumsum(ends - starts)])
            edge = np.zeros(len(data) + 1, bool)
            edge[off] = True
            edge[1:-1] |= (kind[1:] != 0) & (kind[:-1] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
            begin = off[first]
            off = np.flatnonzero(edge) if len(data) else np.zeros(1, np.int64)
            first = np.searchsorted(off, begin)
        else:
            data = t.data[:n]
            edge = np.zeros(n + 1, bool)
            edge[t.off] = True
            if self.mode == "led":
                blank = ~ft.SPACE_WORDS[data]
                edge[1:n] |= blank[1:] & ~blank[:-1]
                kind = self._kinds(data)
                edge[1:n] |= (kind[1:] != 0) & (kind[:-1] != 0) & (kind[1:] != kind[:-1])
                for d in _odd(data, t.off):
                    edge[t.off[d] + 1 : t.off[d + 1]] = False
            off = np.flatnonzero(edge)
            if n == 0:
                off = np.zeros(1, np.int64)
            first = np.searchsorted(off[:-1], t.off)
        array = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        return array, first

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte for cuts; none if a special token's string is there."""
        raw = data.tobytes()
        return np.zeros(len(data), np.uint8) if any(x in raw for x in self.special) else _CLASS[data]

    def encode(self, column: pa.Array, end: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, ids, first id of each row plus the total) by slices; ``end`` is appended to each row's ids."""
        for i, j, t in ft.slices(column, SLICE_BYTES):
            pieces, first = self._pieces(t)
            ids, per_piece = self._ids(pieces)
            at = np.concatenate([[0], np.cumsum(per_piece)])[first]
            if end is not None:
                ids = np.insert(ids, at[1:], np.uint32(end))
                at = at + np.arange(len(at))
            yield i, j, ids, at

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.n_slots > STORE_PIECES:
            self._clear()
        coded = pieces.dictionary_encode()
        vocab = coded.dictionary.to_pylist()
        index = coded.indices.to_numpy(zero_copy_only=False) if len(pieces) else np.zeros(0, np.int64)
        slot = np.fromiter((self.slot.get(v, -1) for v in vocab), np.int64, len(vocab))
        new = np.flatnonzero(slot < 0).tolist()
        if new:
            new, size, flat = self._new(vocab, new)
            slot[new] = self.n_slots + np.arange(len(new))
            self.begin.append(self.n_ids + np.cumsum(size) - size)
            self.size.append(size)
            self.ids.append(flat)
            self.slot.update((vocab[k], self.n_slots + n) for n, k in enumerate(new) if len(vocab[k]) <= _STORED_BYTES)
            self.n_slots += len(new)
            self.n_ids += len(flat)
            for x in (self.begin, self.size, self.ids):
                x[:] = [np.concatenate(x)]
        own = slot[index]
        size = self.size[0][own]
        before = np.cumsum(size) - size
        where = np.repeat(self.begin[0][own] - before, size) + np.arange(int(size.sum()))
        return self.ids[0][where], size


    def _new(self, vocab: list[str], new: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The pieces in the order encoded, ids of each, and all ids. Plain pieces are encoded in long texts of a thousand, which gives the same ids sooner."""
        simple = [k for k in new if self.plain.fullmatch(vocab[k])] if self.plain else []
        sizes, flats = [], []
        if simple:
            glue = "\n" if self.mode == "words" else ""
            texts = [glue.join([vocab[k] for k in simple[a : a + _JOINED]]) for a in range(0, len(simple), _JOINED)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            at = np.flatnonzero(self.edges[flat])
            size = np.diff(at, prepend=-1) if self.mode == "words" else np.diff(at, append=len(flat))
            if len(size) == len(simple) and int(size.sum()) == len(flat):
                sizes.append(size)
                flats.append(flat)
            else:
                simple = []
        done = set(simple)
        rest = [k for k in new if k not in done]
        found = [e.ids for e in self.tokenizer.encode_batch_fast([vocab[k] for k in rest], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        sizes.append(size)
        flats.append(np.fromiter((x for e in found for x in e), np.uint32, int(size.sum())))
        return simple + rest, np.concatenate(sizes), np.concatenate(flats)


def _odd(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts with white space or controls beyond the blanks of words, which may join with blanks; these aren't cut."""
    control = (data < 9) | ((data > 13) & (data < 32)) | (data == 127)
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    at = np.flatnonzero(control)
    if len(lead):
        b = np.concatenate([data, np.zeros(2, np.uint8)])
        x, y, z = b[lead], b[lead + 1], b[lead + 2]
        odd = (x == 0xC2) & (y < 0xA1) | (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE2) & (y == 0x80) & ((z < 0x90) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
        at = np.concatenate([at, lead[odd]])
    return np.unique(np.searchsorted(off, at, "right") - 1)
