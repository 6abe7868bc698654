"""Readers of public tokenizer files for use inside tasks.

Both encoders return what the ``tokenizers`` library returns for the same file;
tests hold them against it.  The files' merges are numbered like their tokens,
so merging by token rank gives the same result."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _load(path: str) -> tuple[dict, dict[str, int], dict[str, int]]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return spec, {t: i for t, i in spec["model"]["vocab"].items() if t not in special}, special


class ByteBPE:
    """Byte-level BPE whose pre-tokenizer is the ByteLevel pattern."""

    def __init__(self, path: str):
        spec, vocab, special = _load(path)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a plain byte-level tokenizer file")
        chars = _byte_of_char()
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items()}
        # Fixed value: the ByteLevel pattern.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._bpe = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.dtype = np.dtype("<u2" if self._bpe.max_token_value < 1 << 16 else "<u4")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._bpe.encode(text, allowed_special="all"), dtype=self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return self._bpe.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


class WordBPE:
    """BPE with word ends over a lower-casing, white-space dropping pre-tokenizer.

    A text is encoded word by word through a memo, since no token spans white
    space.  New words are split into pre-tokens and encoded together, an end
    mark standing for the word-end suffix.  Words outside the simple range
    (combining marks, control characters, special tokens) go through the
    ``tokenizers`` library."""

    #: The memo is emptied at this size; it only saves time.
    MEMO = 400_000
    END = "\x01"

    def __init__(self, path: str):
        spec, vocab, special = _load(path)
        suffix = spec["model"]["end_of_word_suffix"]
        chars, ranks = _byte_of_char(), {}
        for t, i in vocab.items():
            core = t.removesuffix(suffix)
            ranks[bytes(chars[c] for c in core) + (self.END.encode() if core != t else b"")] = i
        self._bpe = tiktoken.Encoding("words", pat_str=f"[^{self.END}]+{self.END}", mergeable_ranks=ranks, special_tokens={})
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for b, i in ranks.items() if b.endswith(self.END.encode()) and len(b) > 1]] = True
        # Fixed value: the file's split pattern.
        self._piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self._library = Tokenizer.from_file(path)
        self._special = tuple(s.encode() for s in special)
        self._memo: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        simple, counts, pieces = [], [], []
        for w in words:
            if max(w) < 0xCC and min(w) > 0x1F and 0x7F not in w:
                found = self._piece.findall(w.decode().lower())
                simple.append(w)
                counts.append(len(found))
                pieces += found
            else:
                ids = self._library.encode(w.decode(), add_special_tokens=False).ids
                self._memo[w] = np.array(ids, "<u4").tobytes()
        if pieces:
            ids = np.array(self._bpe.encode_ordinary(self.END.join(pieces) + self.END), "<u4")
            ends = np.concatenate([[0], np.flatnonzero(self._ends[ids]) + 1])
            cuts = ends[np.concatenate([[0], np.cumsum(counts)])] * 4
            raw = ids.tobytes()
            self._memo.update(zip(simple, (raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
        elif simple:
            self._memo.update(dict.fromkeys(simple, b""))

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        raw = text.encode()
        if any(s in raw for s in self._special):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self._words(raw)
        new = set(words).difference(self._memo)
        if len(self._memo) + len(new) > self.MEMO:
            self._memo.clear()
            new = set(words)
        if new:
            self._learn(new)
        return b"".join(map(self._memo.__getitem__, words))

    def _words(self, raw: bytes) -> list[bytes]:
        # without combining marks, ASCII letters may be lowered first: fewer different words
        simple = not raw or np.frombuffer(raw, np.uint8).max() < 0xCC
        return (raw.lower() if simple else raw).split()


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)
