"""Words, hashes and encodings against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from quarrydex.llm import flattext as ft
from quarrydex.llm import token_counts, token_files
from quarrydex.llm.encoder import Encoder, splitting

TEXTS = ["Hello  World foo\nbar baz", "", None, " lead trail ", "one", "\n\n", "Ünï çödé WÖRDS here, now AND then", "x" * 100 + " y " + "z" * 20, "\x0b\x0c tab\there"]
ALPHABET = [" ", "  ", "\n", "\t", "a", "Bc", "'s", "'ll", "don't", "1", "23", "!", "?!", "é", "\u0301", "日本", "<|endoftext|>", "\x00", "\x1f", "\u0085", "\u00a0", "\u3000", "ﬁ", "Σ", "word", "naïve", "Éa", "İx", " mot", "œuf", "<|", "|>", "endoftext"]


def lowered(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("most", [1, 40, 10_000])
def test_words_and_xxh64(most):
    texts = TEXTS * 3
    for i, j, t in ft.slices(pa.array(texts), most):
        own, starts, ends, first = ft.joined(t, ft.SPACE_WORDS, lower=True)
        alnum, _, _, _ = ft.joined(t, ft.ALNUM_WORDS, lower=True)
        for d in range(i, j):
            a, z = own.off[d - i], own.off[d - i + 1]
            assert own.data[a:z].tobytes().decode() == " ".join(re.findall(r"[^\x20\x09-\x0D]+", lowered(texts[d])))
            a, z = alnum.off[d - i], alnum.off[d - i + 1]
            assert alnum.data[a:z].tobytes() == b" ".join(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(texts[d]).encode()))
        full = np.flatnonzero(ft.inside(first, 3))
        for k, h in zip(full, ft.xxh64(own.data, starts[full], ends[full + 2])):
            assert xxhash.xxh64_intdigest(own.data[starts[k] : ends[k + 2]].tobytes(), 42) == h
            assert np.searchsorted(first, k, "right") == np.searchsorted(first, k + 2, "right")


def test_xxh64_of_every_length():
    raw = bytes(range(1, 256)) * 8
    data = np.frombuffer(raw + bytes(8), np.uint8)
    starts = np.repeat(np.arange(0, 40, 7), 140)
    ends = starts + np.tile(np.arange(140), 6)
    assert all(xxhash.xxh64_intdigest(raw[a:z], 42) == h for a, z, h in zip(starts, ends, ft.xxh64(data, starts, ends)))


def test_equal_words_have_equal_hashes():
    (_, _, t), = ft.slices(pa.array(["aa bb aa cc bb " + "q" * 70 + " " + "q" * 70]), 1 << 20)
    starts, ends, _ = ft.words(t, ft.SPACE_WORDS)
    h = ft.word_hashes(t.data, starts, ends)
    assert h[0] == h[2] and h[1] == h[4] and h[5] == h[6] and len(set(h.tolist())) == 4


@pytest.mark.parametrize("name, mode", [("byte_bpe_50k.json", "led"), ("word_bpe_49k.json", "words")])
def test_encoder_gives_the_ids_of_whole_texts(name, mode):
    path = public_tokenizers.path(name)
    assert splitting(path) == mode
    rng = random.Random(1)
    texts = [None, ""] + ["".join(rng.choices(ALPHABET, k=rng.randint(1, 40))) for _ in range(4000)] + ["".join(rng.choices(ALPHABET[:-3][:16] + ["le", "Mot,"], k=30)) for _ in range(2000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for led in (False, True):
        got = []
        for _, _, ids, at in Encoder(path, led).encode(pa.array(texts), 7):
            got += [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])]
        assert got == [w + [7] for w in want]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_count_tree_under_random_edits(name):
    path = public_tokenizers.path(name)
    encoder, plain, rng = Encoder(path, led=True), Tokenizer.from_file(path), random.Random(3)
    for trial in range(40):
        parts = ALPHABET if trial % 3 == 0 else [" ", "  ", "\n", "a", "Bc", "'s", "word", "the", "1", "!", "é", "日本"]
        tree = token_counts.CountTree(encoder, "".join(rng.choices(parts, k=rng.choice([0, 3, 50, 1500]))).encode())
        for _ in range(6):
            text = tree.text().decode()
            a = rng.randint(0, len(text))
            z = min(len(text), a + rng.choice([0, 1, 5, 50, 400]))
            new = "".join(rng.choices(parts, k=rng.choice([0, 1, 4, 30])))
            start = len(text[:a].encode())
            tree.edit(start, start + len(text[a:z].encode()), new)
            assert tree.text().decode() == text[:a] + new + text[z:]
            assert tree.n_tokens == len(plain.encode(text[:a] + new + text[z:], add_special_tokens=False).ids)


def test_count_tree_encodes_little_again():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), led=True)
    raw = ("word and more words. " * 5000).encode()
    tree = token_counts.CountTree(encoder, raw)
    tree.encoded_bytes = 0
    tree.edit(50_000, 50_003, "xyz")
    assert 0 < tree.encoded_bytes < 60
    tree.edit(10**9, 10**9 + 5, " end")
    assert tree.text().endswith(b" end")


def test_repeated_lines():
    assert token_counts.repeated_lines("a\nb\na\n\n\na") == [(8, 9, ""), (4, 6, "")]


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_token_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 2**32, n, dtype=np.uint32), (rng.zipf(1.3, n) % 2**32).astype(np.uint32), np.full(n, 9, np.uint32)):
        data = token_files.encode_segment([1, None, 3], np.array([n, 0, 0]), ids, block=128, percentile=0.9)
        names, sizes, back = token_files.decode_segment(data)
        assert names == [1, None, 3] and sizes.tolist() == [n, 0, 0] and (back == ids).all()
    blocks = token_files.encode_blocks(np.arange(1000, dtype=np.uint32), 128)
    assert (token_files.decode_block(blocks[3], 128) == np.arange(384, 512)).all()
    with pytest.raises(ValueError):
        token_files.decode_segment(b"nope" + bytes(40))


def test_outliers_are_exceptions():
    ids = np.full(1024, 5, np.uint32)
    ids[10] = 4_000_000_000
    assert len(token_files.encode_blocks(ids)[0]) == 7 + 2 + 4
