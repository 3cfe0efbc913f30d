"""Embeddings of texts by a pluggable embedder; the default needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.text import embedding_text
from quillon.session import spread

DIM = 64
WORD = regex.compile(r"[\p{L}\p{N}]+")
# Fixed value: what is put in front of a query before it is embedded.
INSTRUCTION = "Represent this sentence for searching relevant passages: "


@lru_cache(maxsize=100_000)
def _place(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dim


def hashed(texts: list[str], dim: int = DIM) -> np.ndarray:
    """The default embedder: counts of hashed words, scaled to length 1 (all zero without words)."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        for w in WORD.findall(t.lower()):
            out[i, _place(w, dim)] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def with_embedding(df: DataFrame, text: str, name: str, embedder: Callable[[list[str]], np.ndarray] = hashed, query: bool = False) -> DataFrame:
    """``df`` with the embedding of a text column added, batch by batch, each distinct text of a batch once; null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            distinct = batch[text].dropna().unique().tolist()
            known = dict(zip(distinct, embedder([INSTRUCTION + t for t in distinct] if query else distinct), strict=True)) if distinct else {}
            yield batch.assign(**{name: [known.get(t) for t in batch[text]]})

    return spread(df).mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def embed_chunks(chunks: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """(chunk_id, embedding) of every chunk with a text."""
    return with_embedding(chunks.filter("text IS NOT NULL").select("chunk_id", "text"), "text", "embedding", embedder).drop("text")


def embed_entities(entities: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """(entity_id, embedding_text, embedding) of every entity."""
    said = F.filter("observations", lambda o: o.isNotNull())
    rows = entities.select(F.col("id").alias("entity_id"), embedding_text(F.col("entity_type"), F.col("name"), said).alias("embedding_text"))
    return with_embedding(rows, "embedding_text", "embedding", embedder)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 if one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def sentence_scores(sentences: DataFrame, queries: DataFrame, embedder: Callable[[list[str]], np.ndarray] = hashed) -> DataFrame:
    """(query, chunk_id, n, sentence, score): cosine of each sentence (query, chunk_id, n, sentence) to its query (query, text).

    A sentence is embedded once, however many candidates hold it.
    """
    distinct = with_embedding(sentences.select("sentence").distinct(), "sentence", "_s", embedder)
    asked = with_embedding(queries.select("query", "text"), "text", "_q", embedder, query=True).drop("text")
    return sentences.join(distinct, "sentence").join(asked, "query").select("query", "chunk_id", "n", "sentence", cosine("_s", "_q").alias("score"))
