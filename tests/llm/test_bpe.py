"""Encoding and decoding against the tokenizers library; merges against a plain loop."""

import hashlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from crawlscope.llm import bpe
from crawlscope.llm.queries import QUERIES, tokenizer_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", " ", "\n\t \x85\xa0", "é ñ ß <|endoftext|>   　x  y \n\n z don't I'll, 12,5", "Σίσυφος ΣΑΣ İstanbul ﬁ ǅ 中文字 한국어 éà  x\u0085y\x1cz ½Ⅷ² 🙂👍🏽",
    "<|startoftext|><|endoftext|>a<|endoftext", "'S 'T'RE don'T I'LL d'd''ll_x__ --- ... !?!? 1234567890", "a" * 3000, "ab" * 700 + "c", " ​x﻿öy‍z \x00\x01",
]


@lru_cache
def both(name: str) -> tuple[Tokenizer, bpe.Coder]:
    path = tokenizer_path(name)
    return Tokenizer.from_file(path), bpe.Coder(path)


def ids_of(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


@pytest.mark.parametrize("name", FILES)
def test_odd_texts_as_in_the_library(name):
    library, coder = both(name)
    for text in ODD:
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids_of(coder.encode(text)) == expected
        assert coder.decode(coder.encode(text)) == library.decode(expected, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=60) | st.text("aAbé'st <|>endofx.0９Σσİ\n", max_size=60))
def test_random_texts_as_in_the_library(text):
    for name in FILES:
        library, coder = both(name)
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids_of(coder.encode(text)) == expected
        assert coder.decode(coder.encode(text)) == library.decode(expected, skip_special_tokens=False)


@given(symbols=st.lists(st.integers(0, 3), max_size=40), order=st.permutations([(a, b) for a in range(5) for b in range(5)]))
def test_merges_as_a_plain_loop(symbols, order):
    ranks = {pair: (rank, 4 + rank % 3) for rank, pair in enumerate(order)}
    slow = list(symbols)
    while pairs := [(ranks[p], i) for i, p in enumerate(zip(slow, slow[1:])) if p in ranks]:
        (_, made), i = min(pairs)
        slow[i : i + 2] = [made]
    assert bpe.merge(list(symbols), ranks) == slow


def test_a_long_word_takes_no_square_time():
    coder = both(FILES[0])[1]
    text = "abcdefghij" * 30_000
    ids = coder.encode(text)
    assert coder.decode(ids).replace("</w>", "").replace(" ", "") == text


def test_words_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_BYTES", 5_000)
    path = tokenizer_path(FILES[0])
    coder, library = bpe.Coder(path), Tokenizer.from_file(path)
    text = " ".join(f"word{i}x" for i in range(200)) + " " + "q" * 500
    assert ids_of(coder.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert len(coder.raw) < 20 and "q" * 500 not in coder.raw


def test_unknown_kinds_are_refused(tmp_path):
    import json

    with open(tokenizer_path(FILES[0]), encoding="utf-8") as file:
        steps = json.load(file)
    steps["model"]["byte_fallback"] = True
    (tmp_path / "t.json").write_text(json.dumps(steps))
    with pytest.raises(ValueError, match="byte_fallback"):
        bpe.Coder(str(tmp_path / "t.json"))


def test_query_rows(spark, odd_docs, clashing, no_docs):
    path = tokenizer_path(FILES[0])
    library = Tokenizer.from_file(path)
    for docs in (odd_docs, clashing, no_docs):
        expected = []
        for r in docs.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            plain = library.decode(ids, skip_special_tokens=False)
            expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()))
        got = bpe.digests(bpe.decode(bpe.encode(docs, path), path))
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_null_ids_decode_to_nothing(spark):
    rows = bpe.decode(spark.createDataFrame([(1, None), (None, bytearray(b""))], bpe.IDS), tokenizer_path(FILES[0])).collect()
    assert [r.decoded for r in rows] == ["", ""]


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    path = tokenizer_path(FILES[0])
    library = Tokenizer.from_file(path)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = QUERIES["op13_bpe_round_trip"](spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
