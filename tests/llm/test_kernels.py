from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from calibra.llm import kernels as K

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é\n\t!ß", max_size=30)), max_size=12)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(column, table, lower=False):
    data, offs = K.flatten(pa.array(column, pa.string()))
    out = [[] for _ in column]
    hashes = [[] for _ in column]
    for first, _, block, cut in K.blocks(data, offs, 16):
        starts, ends, doc, h = K.words(block, cut, table, lower)
        for a, b, d, x in zip(starts, ends, doc, h, strict=True):
            out[first + d].append(bytes(block[a:b]).decode())
            hashes[first + d].append(int(x))
    return out, hashes


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_are_those_of_the_patterns(column):
    assert split(column, K.NONSPACE)[0] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in column]
    want = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for t in column]
    assert [[w.translate(LOWER) for w in ws] for ws in split(column, K.ALNUM, True)[0]] == want


@settings(max_examples=80, deadline=None)
@given(texts)
def test_equal_words_and_only_those_have_equal_hashes(column):
    found, hashes = split(column, K.ALNUM, True)
    seen = {}
    for w, h in ((w.translate(LOWER), h) for ws, hs in zip(found, hashes, strict=True) for w, h in zip(ws, hs, strict=True)):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_rolling_and_grams_do_not_cross_documents():
    data, offs = K.flatten(pa.array(["a b c", "b c", None, "a b c d"]))
    _, _, doc, h = K.words(data, offs, K.NONSPACE)
    for f in (lambda: K.rolling(h, doc, 3), lambda: K.grams(h, doc, (0, 1, 2))):
        at, g = f()
        assert list(doc[at]) == [0, 3, 3]
        assert g[0] == g[1] != g[2]


def test_sliced_and_empty_columns():
    data, offs = K.flatten(pa.array(["xx", "yy", "zz"]).slice(1, 1))
    assert bytes(data) == b"yy" and list(offs) == [0, 2]
    data, offs = K.flatten(pa.array([], pa.string()))
    assert len(data) == 0 and list(offs) == [0]
    assert [len(x) for x in K.words(data, offs, K.NONSPACE)] == [0, 0, 0, 0]


def test_unique_pairs():
    d, v = K.unique_pairs(np.array([1, 0, 1, 1]), np.array([5, 5, 5, 2]))
    assert list(zip(d.tolist(), v.tolist(), strict=True)) == [(0, 5), (1, 2), (1, 5)]


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[rng.integers(0, 5000, 600)] = 32
    data[1000:2500] = 97  # one long word
    offs = np.array([0, 700, 700, 5000])
    want = K.words(data, offs, K.NONSPACE)
    grams = K.rolling(want[3], want[2], 5)
    monkeypatch.setattr(K, "PIECE", 64)
    got = K.words(data, offs, K.NONSPACE)
    assert all(np.array_equal(a, b) for a, b in zip(want, got, strict=True))
    assert all(np.array_equal(a, b) for a, b in zip(grams, K.rolling(got[3], got[2], 5), strict=True))


def test_slices_overlap_by_words():
    raw = ("one two " * 50 + "x" * 300 + " three four ").encode()
    for overlap in (0, 1, 3):
        parts = [bytes(p).split() for p in K.slices(np.frombuffer(raw, np.uint8), K.NONSPACE, overlap, 40)]
        assert parts[0] + [w for p in parts[1:] for w in p[overlap:]] == raw.split()
