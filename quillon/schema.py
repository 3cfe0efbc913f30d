"""The memory: entities, relationships, documents and chunks as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import slug
from quillon.session import table


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order, by partial aggregation instead of a window.

    Every column is an aggregate of its own, so that a query scans and shuffles only the columns it uses.
    """
    rest = [c for c in df.columns if c != key]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in rest])


def relation_id(source: Column, kind: Column, target: Column) -> Column:
    return F.lower(F.concat(F.lit("rel_"), source, F.lit("_"), kind, F.lit("_"), target))


@dataclass(frozen=True)
class Memory:
    """An immutable bundle of tables; every change gives a new one."""

    entities: DataFrame  # id, name, entity_type, observations, metadata, created_at
    relationships: DataFrame  # id, source_entity, target_entity, relation_type, confidence, metadata, created_at
    documents: DataFrame  # id, content, metadata, created_at
    chunks: DataFrame  # chunk_id, chunk_type, document_id, entity_id, chunk_index, text, positions, embedding
    links: DataFrame | None = None  # chunk_id, entity_id; None: none made yet
    entity_vectors: DataFrame | None = None  # entity_id, embedding_text, embedding; None: none made yet

    def with_(self, **tables: DataFrame) -> Memory:
        return replace(self, **tables)


def entities_of(raw: DataFrame) -> DataFrame:
    """Stored entities: deliveries once, of colliding ids the first."""
    rows = raw.filter(F.col("id").isNotNull() & F.col("name").isNotNull())
    return first_by(rows, "id", "entity_no", "ingested_at").select(
        "id", "name", F.coalesce("entity_type", F.lit("CONCEPT")).alias("entity_type"),
        F.coalesce("observations", F.array().cast("array<string>")).alias("observations"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), "created_at", "entity_no",
    )


def relationships_of(raw: DataFrame) -> DataFrame:
    """Stored relationships: ends as ids, of colliding relation ids the first."""
    ends = raw.filter(F.col("from_name").isNotNull() & F.col("to_name").isNotNull() & F.col("relation_type").isNotNull())
    ends = ends.withColumn("source_entity", slug("from_name")).withColumn("target_entity", slug("to_name"))
    ends = ends.withColumn("id", relation_id(F.col("source_entity"), F.col("relation_type"), F.col("target_entity")))
    rows = first_by(ends, "id", "rel_no", "ingested_at")
    return rows.select("id", "source_entity", "target_entity", "relation_type", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), "created_at", "rel_no")


def chunks_of(raw: DataFrame) -> DataFrame:
    return first_by(raw, "chunk_id", "chunk_no", "ingested_at")


def memory(spark: SparkSession, directory: str) -> Memory:
    """The memory held in the tables of a data directory."""
    documents = table(spark, directory, "documents")
    return Memory(
        entities_of(table(spark, directory, "entities")),
        relationships_of(table(spark, directory, "relations")),
        first_by(documents, "id", "doc_id", "ingested_at").select("id", F.col("text").alias("content"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), "created_at", "doc_id"),
        chunks_of(table(spark, directory, "chunks")),
    )
