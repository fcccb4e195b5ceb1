"""Tokenizing of whole texts: numbers of tokens by chunks, and ids.

For numbers, a chunk ends where white space follows anything else. The byte-level and the
word-level vocabularies never merge over that boundary, so each distinct chunk
goes through the library once and a dictionary serves the rest. Texts that hold
characters on which white-space definitions differ go to the library whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: White space for Python but not for every engine, or the other way round.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
_CHUNK = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Distinct chunks kept per worker; beyond that the dictionary starts anew.
CACHE_ENTRIES = 600_000


@lru_cache(maxsize=4)
def load(path: str):
    """The library's own object for a .json or .model file."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@lru_cache(maxsize=2)
def lengths_of(path: str, drops_space: bool) -> "Lengths":
    return Lengths(path, drops_space)


def word_chunks(text: str) -> list[str]:
    """Runs between white space, for vocabularies that drop white space; may hold empty strings."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class Lengths:
    """Numbers of tokens of texts."""

    def __init__(self, path: str, drops_space: bool):
        self.path, self.drops_space = path, drops_space
        self.cache: dict[str, int] = {"": 0}

    def _encode(self, texts: list[str]) -> list[int]:
        tokenizer = load(self.path)
        if self.path.endswith(".model"):
            return [len(x) for x in tokenizer.encode(texts, num_threads=1)]
        return [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        if self.path.endswith(".model"):
            return self._encode(texts)
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
            cache[""] = 0
        split = word_chunks if self.drops_space else _CHUNK.findall
        parts = [[text] if _ODD.search(text) else split(text) for text in texts]
        missing = list({w for ws in parts for w in ws if w not in cache})
        for i in range(0, len(missing), 20_000):
            some = missing[i : i + 20_000]
            cache.update(zip(some, self._encode(some), strict=True))
        return [sum(map(cache.__getitem__, ws)) for ws in parts]


@lru_cache(maxsize=2)
def ids_of(path: str) -> "Ids":
    """One encoder for all tasks of a worker."""
    return Ids(path)


#: Fixed value: the pattern by which byte-level vocabularies of this kind part a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in a row that the pattern's look-ahead would walk back over; texts with more go to the library.
LONG_GAP = 10_000
_GAP = re.compile(rf"\s{{{LONG_GAP}}}")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def merge_ranks(model: dict, special: set[str]) -> dict[bytes, int] | None:
    """The rank of each byte string of a vocabulary whose ids ascend as its merges do; None if they don't."""
    byte = byte_of()
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    if any(c not in byte for t in vocab for c in t):
        return None
    last = -1
    for m in model["merges"]:
        i = vocab.get("".join(m if isinstance(m, list) else m.split(" ")))
        if i is None or i <= last:
            return None
        last = i
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
    return ranks if len(model["merges"]) + 256 == len(ranks) else None


class Ids:
    """Token ids of whole texts under a byte-level vocabulary, as little-endian unsigned 32-bit arrays.

    Ids are those of the tokenizers library for the file. Its merges, read as
    ranks, drive an encoder that gives the same ids several times as fast.
    Texts that hold a special token's string, or white space without end, go to the library itself,
    and so do all texts where the file isn't a byte-level vocabulary with ascending merges.
    """

    def __init__(self, path: str):
        import json

        self.path = path
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        self.special = [t["content"] for t in given.get("added_tokens") or []]
        cut = given.get("pre_tokenizer") or {}
        level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and given.get("normalizer") is None
        ranks = merge_ranks(given["model"], set(self.special)) if level and given["model"].get("type", "BPE") == "BPE" else None
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, text: str) -> bool:
        return self.fast is None or any(t in text for t in self.special) or _GAP.search(text) is not None

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self._by_library(text):
                out.append(np.array(load(self.path).encode(text, add_special_tokens=False).ids, "<u4"))
            else:
                out.append(np.array(self.fast.encode_ordinary(text), "<u4"))
        return out
