"""Queries over texts: slugs, observations, terms, sentences, windows, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import chunking, graph, linking, search
from quillon.plans.catalog import query
from quillon.schema import memory
from quillon.session import table


@query
def slugify(spark, directory):
    names = table(spark, directory, "relations").select(F.explode(F.array("from_name", "to_name")).alias("name")).filter("name IS NOT NULL").distinct()
    return names.select("name", T.slug("name").alias("id"))


@query
def strip_dates(spark, directory):
    said = memory(spark, directory).entities.select("id", F.posexplode("observations").alias("n", "o")).filter("o IS NOT NULL")
    return said.select("id", "n", T.strip_date(F.col("o")).alias("plain"), T.stamp(F.col("o"), "2025-01-31").alias("stamped"))


@query
def embedding_texts(spark, directory):
    own = memory(spark, directory).entities
    return own.select("id", T.embedding_text(F.col("entity_type"), F.col("name"), F.filter("observations", lambda o: o.isNotNull())).alias("text"))


@query
def extract_terms(spark, directory):
    documents = memory(spark, directory).documents
    return documents.select("id", F.array_join(T.terms(F.col("content")), "|").alias("terms"))


@query
def sentences(spark, directory):
    documents = memory(spark, directory).documents
    return documents.select("id", F.posexplode(T.sentences(F.col("content"))).alias("n", "sentence"))


@query
def character_classes(spark, directory):
    documents = memory(spark, directory).documents
    return documents.select("id", F.col("content").rlike("[가-힣]").alias("korean"), F.col("content").rlike(r"^[\x00-\x7F]*$").alias("ascii"), F.col("content").rlike(T.CJK).alias("cjk"))


@query
def normalised_queries(spark, directory):
    own = memory(spark, directory).entities
    return own.select("id", T.normalise_query(F.col("name")).alias("query"), T.normalise_query(F.col("name"), True).alias("ascii_query"))


@query
def chunk_windows(spark, directory):
    documents = memory(spark, directory).documents
    return chunking.chunk_texts(documents, "id", "content", 100, 20)


@query
def chunk_windows_default(spark, directory):
    documents = memory(spark, directory).documents
    per = chunking.chunk_texts(documents, "id", "content")
    return per.groupBy("id").agg(F.count("*").alias("windows"), F.max("end_pos").alias("end_pos"), F.max("end_token").alias("end_token"))


@query
def chunk_windows_bpe(spark, directory):
    """Windows of 800 tokens of a public tokenizer, 160 of them shared with the one before."""
    from quillon.functions.tokenizer import bpe_ends

    documents = memory(spark, directory).documents
    return chunking.chunk_texts(documents, "id", "content", token_ends=bpe_ends()).drop("text")


@query
def entity_chunks(spark, directory):
    own = memory(spark, directory).entities.withColumn("observations", F.filter("observations", lambda o: o.isNotNull()))
    return chunking.entity_chunks(own)


@query
def relationship_chunks(spark, directory):
    return chunking.relationship_chunks(graph.named_edges(memory(spark, directory)))


@query
def detailed_context(spark, directory):
    m = memory(spark, directory)
    found = chunking.context(m.chunks.filter("chunk_type = 'document'"))
    title = search.titles(m, m.chunks.filter("chunk_type = 'document'")).select("chunk_id", "title")
    return found.join(title, "chunk_id").select("chunk_id", "document_id", "chunk_index", "before", "after", "title")


@query
def backfill_positions(spark, directory):
    m = memory(spark, directory)
    return chunking.backfill_positions(m.chunks.filter("chunk_type = 'document'"), m.documents)


@query
def orphan_chunks(spark, directory):
    """Chunks whose document or entity is gone."""
    m = memory(spark, directory)
    lost = m.chunks.filter("document_id IS NOT NULL").join(m.documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").select("chunk_id", F.lit("document").alias("lost"))
    gone = m.chunks.filter("entity_id IS NOT NULL").join(m.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select("chunk_id", F.lit("entity").alias("lost"))
    return lost.unionByName(gone)


@query
def entity_links(spark, directory):
    m = memory(spark, directory)
    return linking.name_links(m.chunks, m.entities, 4, 2)


@query
def alias_links(spark, directory):
    m = memory(spark, directory)
    own = m.entities.withColumn("observations", F.filter("observations", lambda o: o.isNotNull()))
    return linking.alias_links(m.chunks, own)


@query
def linked_entities(spark, directory):
    """Chunks that each entity is linked to by name or alias."""
    m = memory(spark, directory)
    own = m.entities.withColumn("observations", F.filter("observations", lambda o: o.isNotNull()))
    return linking.auto_links(m.chunks, own).groupBy("entity_id").agg(F.count("*").alias("chunks"))
