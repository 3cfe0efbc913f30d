"""Queries over changes: what a memory holds after upserts, deletions, merges and deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import changes, linking
from quillon.plans.catalog import query
from quillon.schema import memory
from quillon.session import table
from quillon.sources import store

TODAY = "2026-01-01"


def _digest(df):
    """(id, entity_type, observations, n): entities with their observations as one text."""
    return df.select("id", "name", "entity_type", F.size("observations").alias("n"), F.array_join("observations", "|").alias("observations"))


def _halves(spark, directory):
    """Entities held (stored up to the middle of 2024), and items that arrive later, in their order of arrival."""
    m = memory(spark, directory)
    fine = m.entities.withColumn("observations", F.filter("observations", lambda o: o.isNotNull()))
    held = fine.filter("created_at < '2025-01-01'")
    late = table(spark, directory, "entities").filter("name IS NOT NULL").select(F.struct("entity_no", "ingested_at").alias("k"), "entity_no", "name", "entity_type", "observations")
    late = late.groupBy("entity_no").agg(F.min_by(F.struct("name", "entity_type", "observations"), "k").alias("r")).select(F.col("entity_no").alias("n"), "r.*")
    return m, held, late


@query
def create_entities(spark, directory):
    _, held, late = _halves(spark, directory)
    return _digest(changes.create_entities(held, late, TODAY)[0])


@query
def changed_entities(spark, directory):
    _, held, late = _halves(spark, directory)
    return changes.create_entities(held, late, TODAY)[1]


@query
def delete_observations(spark, directory):
    """Every dated observation of 2024 deleted."""
    m, _, _ = _halves(spark, directory)
    fine = m.entities.withColumn("observations", F.filter("observations", lambda o: o.isNotNull()))
    gone = fine.select("name", F.explode("observations").alias("observation")).filter("observation LIKE '[2024-%'")
    return _digest(changes.delete_observations(fine, gone))


@query
def create_relations(spark, directory):
    """Relations between the ends of every relation of low confidence, in the other direction."""
    m = memory(spark, directory)
    back = table(spark, directory, "relations").filter("confidence < 0.5 AND from_name IS NOT NULL AND to_name IS NOT NULL AND relation_type IS NOT NULL")
    items = back.select(F.col("rel_no").alias("n"), F.col("to_name").alias("from_name"), F.col("from_name").alias("to_name"), "relation_type")
    return changes.create_relations(m, items, TODAY)[1].select("id", "relation_type")


@query
def update_relations(spark, directory):
    """Confidences above 1 set to 1, by the relation's names."""
    m = memory(spark, directory)
    rows = table(spark, directory, "relations").filter("confidence > 1 AND from_name IS NOT NULL AND to_name IS NOT NULL AND relation_type IS NOT NULL")
    items = rows.select(F.col("rel_no").alias("n"), "from_name", "to_name", "relation_type", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("metadata"))
    return changes.update_relations(m.relationships, items)[0].select("id", "confidence")


@query
def delete_entities(spark, directory):
    """The graph without its entities of type FILE."""
    m = memory(spark, directory)
    left = changes.delete_entities(m, m.entities.filter("entity_type = 'FILE'").select("name"))
    ent = left.entities.select(F.lit("entity").alias("what"), "id")
    return ent.unionByName(left.relationships.select(F.lit("relation").alias("what"), "id"))


@query
def delete_relations(spark, directory):
    """Relations left once those delivered in lower case are deleted by their names."""
    m = memory(spark, directory)
    items = table(spark, directory, "relations").filter("relation_type = lower(relation_type) AND from_name IS NOT NULL AND to_name IS NOT NULL")
    return changes.delete_relations(m.relationships, items).select("id", "relation_type")


@query
def store_documents(spark, directory):
    """Documents and chunks left once the documents of one source are stored anew with a remark."""
    m = memory(spark, directory)
    source = table(spark, directory, "documents").filter("source = 'glossary'")
    items = source.select(F.col("doc_id").alias("n"), "id", F.concat("text", F.lit(" (stored again)")).alias("content"), F.lit("{}").alias("metadata"), "created_at")
    new = changes.store_documents(m, items)
    docs = new.documents.select(F.lit("document").alias("what"), "id", F.md5("content").alias("digest"))
    return docs.unionByName(new.chunks.select(F.lit("chunk").alias("what"), F.col("chunk_id").alias("id"), F.lit(None).cast("string").alias("digest")))


@query
def delete_documents(spark, directory):
    """Which of the documents named by chunks could be deleted."""
    m = memory(spark, directory)
    asked = table(spark, directory, "chunks").filter("document_id IS NOT NULL").select(F.col("document_id").alias("id"))
    return changes.delete_documents(m, asked)[1]


@query
def import_merge(spark, directory):
    """Counts of an import: a memory of the first half of the entities takes in the whole one's."""
    m = memory(spark, directory)
    held = m.entities.filter("created_at < '2025-01-01'")
    ids = held.select("id")
    inside = m.relationships
    for end in ("source_entity", "target_entity"):
        inside = inside.join(ids.withColumnRenamed("id", end), end, "left_semi")
    whole = m.relationships
    for end in ("source_entity", "target_entity"):
        whole = whole.join(m.entities.select(F.col("id").alias(end)), end, "left_semi")
    return changes.import_memory(m.with_(entities=held, relationships=inside), m.with_(relationships=whole))[1]


def _linked(spark, directory):
    """A memory whose chunks are linked to the entities they name."""
    m = memory(spark, directory)
    fine = m.entities.withColumn("observations", F.filter("observations", lambda o: o.isNotNull()))
    return changes.add_links(m.with_(entity_vectors=m.entities.select(F.col("id").alias("entity_id"))), linking.auto_links(m.chunks, fine))


def _held(m):
    """(what, id): links, entity vectors and chunks of a memory."""
    links = m.links.select(F.lit("link").alias("what"), F.concat_ws(">", "chunk_id", "entity_id").alias("id"))
    vectors = m.entity_vectors.select(F.lit("vector").alias("what"), F.col("entity_id").alias("id"))
    return links.unionByName(vectors).unionByName(m.chunks.select(F.lit("chunk").alias("what"), F.col("chunk_id").alias("id")))


@query
def auto_link(spark, directory):
    """The links that a memory holds once its chunks were linked."""
    return _linked(spark, directory).links


@query
def delete_cascade(spark, directory):
    """Links, vectors and chunks left once the files are deleted as entities, and the documents of one source as documents."""
    m = _linked(spark, directory)
    m = changes.delete_entities(m, m.entities.filter("entity_type = 'FILE'").select("name"))
    gone = table(spark, directory, "documents").filter("source = 'glossary'").select("id")
    return _held(changes.delete_documents(m, gone)[0])


@query
def import_replace(spark, directory):
    """Links, vectors and chunks left once another memory took the place of this one."""
    m = _linked(spark, directory)
    other = m.with_(relationships=m.relationships.limit(0), links=None, entity_vectors=None)
    return _held(changes.import_memory(m, other, merge=False)[0])


@query
def clean_graph_chunks(spark, directory):
    """What is left once the chunks synthesised for entities are removed."""
    return _held(changes.clean_graph_chunks(_linked(spark, directory)))


@query
def update_report(spark, directory):
    """How many of the confidences above 1, sent for the relation and for its reverse, met a relation."""
    m = memory(spark, directory)
    rows = table(spark, directory, "relations").filter("confidence > 1 AND from_name IS NOT NULL AND to_name IS NOT NULL AND relation_type IS NOT NULL").dropDuplicates(["rel_no"])
    ends = [rows.select("rel_no", F.col(a).alias("from_name"), F.col(b).alias("to_name"), "relation_type") for a, b in (("from_name", "to_name"), ("to_name", "from_name"))]
    items = ends[0].unionByName(ends[1]).select(F.col("rel_no").alias("n"), "from_name", "to_name", "relation_type", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("metadata"))
    return changes.update_relations(m.relationships, items)[1]


@query
def export_rows(spark, directory):
    """Entities, relations and documents as JSON: the number of rows made of each kind."""
    return store.export_rows(memory(spark, directory)).groupBy("kind").agg(F.count("json").alias("n"))


@query
def export_lengths(spark, directory):
    """Entities, relations and documents as JSON: the number and total length of each kind."""
    return store.export_rows(memory(spark, directory)).groupBy("kind").agg(F.count("json").alias("n"), F.sum(F.length("json")).alias("length"))


@query
def latest_deliveries(spark, directory):
    """Deliveries of each number: how many, the first and the last."""
    out = None
    for name, key, at in (("chunks", "chunk_no", "ingested_at"), ("entities", "entity_no", "ingested_at"), ("relations", "rel_no", "ingested_at"), ("search_results", "result_no", "received_at")):
        per = table(spark, directory, name).groupBy(F.col(key).alias("n")).agg(F.count("*").alias("times"), F.min(at).alias("first"), F.max(at).alias("last"))
        rows = per.filter("times > 1").select(F.lit(name).alias("name"), "n", "times", "first", "last")
        out = rows if out is None else out.unionByName(rows)
    return out
