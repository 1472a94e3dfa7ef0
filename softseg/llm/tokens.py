"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed values of the vocabulary: strings that are one token wherever they stand.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoding(name: str = VOCABULARY) -> tiktoken.Encoding:
    """The vocabulary, with its special tokens."""
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str | None, name: str = VOCABULARY) -> bytes:
    """Ids as little-endian unsigned 32-bit words; null counts as empty."""
    return array("I", encoding(name).encode(text, allowed_special="all")).tobytes() if text else b""
