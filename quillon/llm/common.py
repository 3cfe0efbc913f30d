"""What the training-data operators share: token counting and ranks that survive hot groups."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranks file of a public byte-level BPE; every operator that counts tokens takes another path.
TOKENIZER = os.environ.get("QUILLON_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Split pattern of the byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = TOKENIZER):
    """The tiktoken encoding of a ranks file, and the length in bytes of each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return enc, lengths


def token_count(path: str = TOKENIZER):
    """A pandas UDF: tokens of a text (null for null)."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc, _ = encoding(path)
        for texts in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int32")

    return count


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], name: str, salts: int = 64) -> DataFrame:
    """Add a 0-based rank within ``keys``; no task has to hold all rows of one key.

    Rows of a key are dealt to ``salts`` sub-groups by a hash of the order columns; the rank is the rank
    in the sub-group plus the sizes of the sub-groups before it. The table of sub-group sizes has at most
    ``salts`` rows a key and is joined, not collected.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_salt", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_in", F.row_number().over(inside) - 1)
    return (
        ranked.join(sizes, [*keys, "_salt"])
        .withColumn(name, (F.col("_in") + F.col("_before")).cast("long"))
        .drop("_salt", "_in", "_before")
    )
