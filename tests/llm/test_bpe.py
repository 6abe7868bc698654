import random

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldpulse.llm import bpe
from fieldpulse.llm.vocab import byte_bpe, word_bpe

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def want(library, pairs):
    out = {}
    for i, t in pairs:
        ids = library[0].encode(t or "", add_special_tokens=False).ids
        out[i] = (len(ids), brute.ids_digest(ids), brute.sha(library[0].decode(ids, skip_special_tokens=False)))
    return out


def found(df):
    return {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()}


TEXTS = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.,sdtlmverABCabc019é ́İΣ<|>")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_encoders_agree_with_the_library(text):
    for path, ids in ((BYTE, byte_bpe(BYTE).encode(text).tolist()),
                      (WORD, np.frombuffer(word_bpe(WORD).encode_bytes(text), "<u4").tolist())):
        assert ids == _library(path).encode(text, add_special_tokens=False).ids, path
    assert byte_bpe(BYTE).decode(byte_bpe(BYTE).encode(text)) == text


_open = {}


def _library(path):
    return _open.setdefault(path, Tokenizer.from_file(path))


def test_special_tokens_and_emptied_memo(library, small_pairs):
    enc = word_bpe(WORD)
    size, enc.MEMO = enc.MEMO, 50
    try:
        for t in ["a<|endoftext|>b <|startoftext|>", *(t for _, t in small_pairs[:20])]:
            assert np.frombuffer(enc.encode_bytes(t), "<u4").tolist() == library[1].encode(t, add_special_tokens=False).ids
            assert byte_bpe(BYTE).encode(t).tolist() == library[0].encode(t, add_special_tokens=False).ids
    finally:
        enc.MEMO = size


def test_edges_and_whole_small_table(edges, edge_pairs, small, small_pairs, library):
    assert found(bpe.digests(bpe.encode(edges, BYTE), BYTE)) == want(library, edge_pairs)
    assert found(bpe.digests(bpe.encode(small, BYTE), BYTE)) == want(library, small_pairs)
    text = {r.doc_id: r.text for r in bpe.decode(bpe.encode(edges, BYTE), BYTE).collect()}
    assert text == {i: t or "" for i, t in edge_pairs}


def test_any_subset_of_chunks_joins_exactly(library):
    rng = random.Random(5)
    vocabulary = ["the", " ", "\n", "don't", "été", "日本", "12", "...", "  ", "x" * 90, "<|endoftext|>", "  ", "Ä "]
    for _ in range(60):
        raw = "".join(rng.choice(vocabulary) + rng.choice(["", " "]) for _ in range(1500)).encode()
        cuts, known, enc = bpe.chunk_cuts(raw), {}, byte_bpe(BYTE)
        assert b"".join(raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])) == raw
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            span = bpe.safe_span(raw[a:b])
            if span and rng.random() < 0.7:
                known[i] = enc.encode(raw[a:b][span[0]:span[1]].decode()).tobytes()
        got = np.frombuffer(bpe.join_chunks(raw, known, enc), enc.dtype).tolist()
        assert got == library[0].encode(raw.decode(), add_special_tokens=False).ids


def test_chunks_are_shared_across_documents(small_pairs):
    """A passage gives the same inner chunks wherever it stands."""
    passage = " ".join(t for _, t in small_pairs[:30])[:40_000]
    parts = [set(bpe._keys((head + passage + " end").encode())) for head in ("", "short ", "another, much longer beginning " * 40)]
    shared = parts[0] & parts[1] & parts[2]
    assert len(shared) >= 0.9 * len(parts[0])


def test_odd_ids_and_empty(odd_ids, no_docs, library):
    rows = bpe.digests(bpe.encode(odd_ids, BYTE), BYTE).collect()
    n = len(library[0].encode("p q r", add_special_tokens=False).ids)
    assert sorted((r.n_tokens for r in rows)) == sorted([0, n, n, n, n, len(library[0].encode("only here").ids)])
    assert bpe.digests(bpe.encode(no_docs, BYTE), BYTE).count() == 0
