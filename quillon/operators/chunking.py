"""Fixed token windows over documents, with codepoint-exact positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.session import spread

WORDS = regex.compile(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]")


def word_ends(text: str) -> np.ndarray:
    """The default tokenizer: ends of words and of single other characters."""
    return np.fromiter((m.end() for m in WORDS.finditer(text)), dtype=np.int64)


def windows(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Token windows: one begins at every multiple of the stride, also if it lies inside the one before."""
    return [(a, min(a + size, n)) for a in range(0, n, size - overlap)]


def chunk_texts(
    df: DataFrame, key: str, text: str, size: int = 800, overlap: int = 160, token_ends: Callable[[str], np.ndarray] = word_ends
) -> DataFrame:
    """(key, chunk_index, text, start_pos, end_pos, start_token, end_token) of every window of every text.

    ``token_ends`` gives the codepoint at which each token of a text ends, or two such arrays where tokens can end inside
    a character (for windows that end there, and that begin there). Null and empty texts have no window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    columns = [key, "chunk_index", "text", "start_pos", "end_pos", "start_token", "end_token"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body in zip(batch["_key"], batch["_text"], strict=True):
                found = token_ends(body)
                to, since = (np.concatenate(([0], x)) for x in (found if isinstance(found, tuple) else (found, found)))
                for i, (a, b) in enumerate(windows(len(to) - 1, size, overlap)):
                    p, q = int(since[a]), max(int(since[a]), int(to[b]))
                    rows.append((k, i, body[p:q], p, q, a, b))
            yield pd.DataFrame(rows, columns=columns)

    some = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.length("_text") > 0)
    kind = df.schema[key].dataType.simpleString()
    return spread(some).mapInPandas(run, f"`{key}` {kind}, chunk_index int, text string, start_pos int, end_pos int, start_token int, end_token int")


def entity_chunks(entities: DataFrame) -> DataFrame:
    """One synthesised chunk for each entity."""
    said = F.array_join("observations", ". ")
    body = F.concat("name", F.lit(" is a "), "entity_type", F.lit(". "), F.when(F.size("observations") > 0, said).otherwise("No additional information available."))
    return entities.select(
        F.concat(F.lit("kg_entity_"), F.col("id")).alias("chunk_id"), F.lit("entity").alias("chunk_type"), F.col("id").alias("entity_id"), body.alias("text"), F.lit(0).alias("start_pos"), F.length(body).alias("end_pos")
    )


def relationship_chunks(edges: DataFrame) -> DataFrame:
    """One synthesised chunk for each relationship with both ends (from_name, to_name)."""
    body = F.concat("from_name", F.lit(" "), F.regexp_replace(F.lower("relation_type"), "_", " "), F.lit(" "), "to_name")
    return edges.select(
        F.concat(F.lit("kg_relationship_"), F.col("id")).alias("chunk_id"), F.lit("relationship").alias("chunk_type"), F.col("id").alias("relationship_id"), body.alias("text"), F.lit(0).alias("start_pos"), F.length(body).alias("end_pos")
    )


def context(chunks: DataFrame) -> DataFrame:
    """Chunks of documents with the texts of the chunks before and after (chunk_index one less and one more)."""
    own = chunks.filter("document_id IS NOT NULL AND chunk_index IS NOT NULL")
    near = own.groupBy("document_id", "chunk_index").agg(F.min_by("text", "chunk_id").alias("near"))
    before = near.select("document_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("near").alias("before"))
    after = near.select("document_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("near").alias("after"))
    return own.join(before, ["document_id", "chunk_index"], "left").join(after, ["document_id", "chunk_index"], "left")


def backfill_positions(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, start_pos, end_pos) found again by searching each chunk's text behind the one before it.

    Chunks whose text isn't found have null positions and don't move the cursor.
    """
    texts = chunks.filter("chunk_index IS NOT NULL").select("document_id", "chunk_id", "chunk_index", "text")
    whole = documents.select(F.col("id").alias("document_id"), "content")
    texts = texts.join(whole.select("document_id"), "document_id", "left_semi")

    def run(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        cursor, rows = 0, []
        content = own["content"].iloc[0] if len(own) else None
        for r in pdf.sort_values(["chunk_index", "chunk_id"]).itertuples():
            at = -1 if r.text is None or content is None else content.find(r.text, cursor)
            rows.append((r.chunk_id, at if at >= 0 else None, at + len(r.text) if at >= 0 else None))
            cursor = at if at >= 0 else cursor
        return pd.DataFrame(rows, columns=["chunk_id", "start_pos", "end_pos"]).astype({"start_pos": "Int32", "end_pos": "Int32"})

    # a document is sent once, beside its chunks
    return texts.groupBy("document_id").cogroup(whole.groupBy("document_id")).applyInPandas(run, "chunk_id string, start_pos int, end_pos int")


def codepoint_positions(chunks: DataFrame, documents: DataFrame, positions: tuple[str, str] = ("start_pos", "end_pos")) -> DataFrame:
    """(chunk_id, start_pos, end_pos): positions stored in UTF-16 units as codepoints of the document.

    A character beyond the basic plane has two units and one codepoint; a position inside one counts it. Null positions,
    and chunks of documents that are gone, keep theirs.
    """
    a, b = positions
    wide = documents.select(F.col("id").alias("document_id"), F.regexp_replace("content", "[^\\x{10000}-\\x{10ffff}]", " ").alias("marks"))
    wide = wide.filter(F.length(F.trim("marks")) > 0)
    # units before the k-th wide character: its codepoint and the k wide ones before it
    signs = wide.select("document_id", F.posexplode(F.split("marks", "")).alias("at", "sign")).filter("sign <> ' ' AND sign <> ''")
    order = Window.partitionBy("document_id").orderBy("at")
    signs = signs.select("document_id", (F.col("at") + F.row_number().over(order) - 1).alias("unit"))
    ends = chunks.select("chunk_id", "document_id", F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col(a).alias("p")), F.struct(F.lit("b").alias("end"), F.col(b).alias("p")))).alias("x"))
    before = ends.select("chunk_id", "document_id", "x.*").join(signs, "document_id").filter("unit < p").groupBy("chunk_id", "end").agg(F.count("*").alias("n"))
    less = before.groupBy("chunk_id").agg(F.max(F.when(F.col("end") == "a", F.col("n"))).alias("na"), F.max(F.when(F.col("end") == "b", F.col("n"))).alias("nb"))
    shifted = [(F.col(p) - F.coalesce(n, F.lit(0))).cast("int").alias(name) for p, n, name in ((a, "na", "start_pos"), (b, "nb", "end_pos"))]
    return chunks.select("chunk_id", *positions).join(less, "chunk_id", "left").select("chunk_id", *shifted)
