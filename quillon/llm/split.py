"""Problem 1: cutting oversized texts at natural boundaries, by recursive bisection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import TOKENIZER, encoding
from quillon.session import spread

# The characters with the Unicode property White_Space, and the sentence ends.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SENTENCE_ENDS = ".!?。！？"
WIDE_ENDS = "。！？"

# Strength of a cut, strongest first; a cut lies behind its boundary character.
PARAGRAPH, LINE, SENTENCE, SPACE, INNER, HARD = 5, 4, 3, 2, 1, 0
CUT_NAMES = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", SPACE: "space", INNER: "inner", HARD: "hard"}

_SPACE, _END, _WIDE, _LINE = 1, 2, 4, 8
_KIND = np.zeros(0x10000, dtype=np.uint8)
_KIND[WHITE_SPACE] |= _SPACE
_KIND[[ord(c) for c in SENTENCE_ENDS]] |= _END
_KIND[[ord(c) for c in WIDE_ENDS]] |= _WIDE
_KIND[[0x0A, 0x0D, 0x85, 0x2028, 0x2029]] |= _LINE


def boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions (just behind each natural boundary) of a text's codepoints, and their strengths."""
    kind = np.where(codes < 0x10000, _KIND[np.minimum(codes, 0xFFFF)], 0)
    at = np.flatnonzero(kind)
    own = kind[at]
    before = np.where(at > 0, kind[at - 1], 0)
    space = (own & _SPACE) > 0
    strength = np.where(space, SPACE, np.where((own & _WIDE) > 0, SENTENCE, INNER))
    strength = np.where(space & ((before & _END) > 0), SENTENCE, strength)
    strength = np.where((own & _LINE) > 0, np.where((before & _LINE) > 0, PARAGRAPH, LINE), strength)
    return at + 1, strength


def bisect(length: int, cuts: np.ndarray, strength: np.ndarray, core: int) -> list[tuple[int, int]]:
    """Cut positions in (0, length), with their strength, so that no part is longer than ``core``.

    A part that is too long is cut at the strongest boundary in its middle half (of equals the one nearest
    its midpoint), else at the boundary nearest the midpoint, else at the midpoint itself.
    """
    found, todo = [], [(0, length)]
    while todo:
        low, high = todo.pop()
        if high - low <= core:
            continue
        middle, quarter = (low + high) // 2, (high - low) // 4
        a, b = np.searchsorted(cuts, (low + quarter, high - quarter))
        if a == b:
            a, b = np.searchsorted(cuts, (low + 1, high))
            rank = np.zeros(b - a)
        else:
            rank = -strength[a:b]
        if a == b:
            cut, how = middle, HARD
        else:
            best = a + np.lexsort((np.abs(cuts[a:b] - middle), rank))[0]
            cut, how = int(cuts[best]), int(strength[best])
        found.append((cut, how))
        todo += [(low, cut), (cut, high)]
    return sorted(found)


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, strength of the cut before it, start and length of the boundary-free stretch it cuts or -1) of each piece."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    if n <= limit:
        return [(0, n, PARAGRAPH, -1, -1)]
    cuts, strength = boundaries(codes)
    found = [(0, PARAGRAPH), *bisect(n, cuts, strength, limit - overlap), (n, PARAGRAPH)]
    out = []
    for (cut, how), (end, _) in zip(found, found[1:], strict=False):
        start, run_at, run = cut, -1, -1
        if cut:
            near = np.searchsorted(cuts, cut - overlap)
            at = int(cuts[near]) if near < len(cuts) else cut
            start = at if at <= cut - overlap // 2 else cut - overlap
            if how == HARD:
                k = int(np.searchsorted(cuts, cut, side="right"))
                run_at = int(cuts[k - 1]) if k else 0
                run = (int(cuts[k]) - 1 if k < len(cuts) else n) - run_at
        out.append((max(start, 0), end, how, run_at, run))
    return out


def split_texts(
    df: DataFrame, key: str, text: str, limit: int = 1200, overlap: int = 120, tokenizer: str | None = TOKENIZER
) -> DataFrame:
    """Pieces of at most ``limit`` codepoints of every text that is longer.

    Returns (key, piece_index, text, start_pos, end_pos, start_token, end_token, cut, stretch_start,
    stretch_length). A piece begins ``overlap`` codepoints before the end of the one before it, or at the first
    natural boundary behind that point if one lies in the first half of the overlap. ``cut`` names the boundary
    before the piece; a 'hard' cut lies in a stretch without any boundary, whose place and length are given.
    Tokens are those of the public tokenizer in ``tokenizer`` that begin before the position (None: no tokens).

    Texts within the limit, empty and null texts and rows without a key give no row; repeated rows are cut each for
    itself; an empty table gives an empty result. Other columns of ``df`` aren't read, so their names can't clash.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and smaller than limit")
    kind = df.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, piece_index int, text string, start_pos int, end_pos int, start_token int, end_token int,"
        " cut string, stretch_start int, stretch_length int"
    )
    columns = [f.split()[0].strip("`") for f in schema.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body in zip(batch["_key"], batch["_text"], strict=True):
                got = pieces(body, limit, overlap)
                tokens = None
                if tokenizer:
                    enc, width = encoding(tokenizer)
                    ends = np.cumsum(width[enc.encode_ordinary(body)])
                    begins = np.concatenate(([0], ends[:-1]))
                    codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    place = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))))
                    tokens = np.searchsorted(begins, place[[p for x in got for p in x[:2]]]).tolist()
                for i, (a, b, how, run_at, run) in enumerate(got):
                    t = tokens[2 * i : 2 * i + 2] if tokens else (None, None)
                    hard = how == HARD
                    rows.append((k, i, body[a:b], a, b, *t, CUT_NAMES[how], run_at if hard else None, run if hard else None))
            frame = pd.DataFrame(rows, columns=columns)
            for c in ("start_token", "end_token", "stretch_start", "stretch_length"):
                frame[c] = frame[c].astype("Int32")
            yield frame

    longer = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_key").isNotNull() & (F.length("_text") > limit))
    return spread(longer).mapInPandas(cut, schema)


def oversized(split: DataFrame, key: str, limit: int = 1200) -> DataFrame:
    """(key, start_pos): -1 for each text that was split, and the start of each stretch over ``limit`` without a boundary."""
    whole = F.when(F.col("piece_index") == 0, F.lit(-1).cast("long"))
    stretch = F.when(F.col("stretch_length") > limit, F.col("stretch_start").cast("long"))
    return split.select(key, F.explode(F.array_compact(F.array(whole, stretch))).alias("start_pos")).distinct()
