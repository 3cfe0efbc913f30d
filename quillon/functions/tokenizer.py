"""Windows in tokens of a public byte-level BPE; the ranks file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np

#: Ranks file; token windows take another path as well.
TOKENIZER = os.environ.get("QUILLON_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: split pattern of the byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("windows", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def bpe_ends(path: str = TOKENIZER):
    """A token_ends function: (whole characters before each token's end, and those begun before it).

    A token can end inside a character; a window that ends there leaves the character out, one that begins there
    begins behind it.
    """

    def ends(text: str) -> tuple[np.ndarray, np.ndarray]:
        encoding, lengths = _encoding(path)
        at = np.cumsum(lengths[np.array(encoding.encode_ordinary(text), dtype=np.int64)])
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        begun = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # characters begun before each byte
        inside = np.r_[(raw & 0xC0) == 0x80, False]  # bytes that continue a character
        return begun[at] - inside[at], begun[at]

    return ends
