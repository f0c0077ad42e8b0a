from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from calibra.llm import packing
from calibra.llm.tables import table

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBzé ÉßIS'st!.,|<>$%012\n\t\x1c\x85\xa0 éΣσİªµ"), max_size=40))
def test_encoder_equals_the_tokenizer(text):
    assert np.frombuffer(packing.encoder(PATH)(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("text", ["<|endoftext|>. A<|ENDOFTEXT|>!", "don't. DON'T!! we'll's", "a" * 300 + "!!", "ΑΣ ΣΑΣ. İstanbul!"])
def test_encoder_on_special_cases(text):
    assert np.frombuffer(packing.encoder(PATH)(text), "<u4").tolist() == ids(text)


def test_encoder_forgets_beyond_its_limit():
    small = packing.Encoder(PATH, limit=5)
    text = " ".join(f"w{i} Word{i}." for i in range(50))
    assert np.frombuffer(small(text), "<u4").tolist() == ids(text)
    assert len(small.known) <= 6


def test_lengths():
    assert packing.lengths(1) == [1] and packing.lengths(4096 * 2 + 5) == [4096, 4096, 4, 1]
    assert all(sum(packing.lengths(n)) == n for n in range(1, 9000, 7))


def test_pieces_of_all_documents(spark, sf, odd):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    for df in (docs, odd):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        rows = packing.pack(df).collect()
        assert len({r["sequence_id"] for r in rows}) == len(rows)
        by = {}
        for r in rows:
            assert r["offset"] == 0 and r["length"] == 1 << r["bucket"] <= 4096
            by.setdefault(r["doc_id"], {}).setdefault(r["start"], []).append(r)
        assert set(by) == set(texts)
        for doc, starts in by.items():
            want, at = np.array([*ids(texts[doc]), 2], "<u4"), 0
            for start in sorted(starts):
                r = starts[start][0]
                part = want[at : at + r["length"]].tobytes()
                assert start == at and r["ids"] == part and r["ids_crc32"] == zlib.crc32(part) and r["doc_tokens"] == len(want)
                at += r["length"]
            assert at == len(want)


def test_round_trip_and_buckets(spark, odd, tmp_path):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    pieces = packing.pack(docs)
    packing.write_buckets(pieces, f"file://{tmp_path}/buckets")
    back = packing.unpack(spark.read.parquet(f"file://{tmp_path}/buckets"))
    want = {r["doc_id"]: np.array([*ids(r["text"]), 2], "<u4").tobytes() for r in docs.collect()}
    assert {r["doc_id"]: bytes(r["ids"]) for r in back.collect()} == want


def test_no_documents(nothing):
    assert packing.pack(nothing).count() == 0
