"""Changes of a memory, as pure functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import slug, stamp, strip_date
from quillon.schema import Memory, first_by, relation_id


def create_entities(entities: DataFrame, items: DataFrame, today: str) -> tuple[DataFrame, DataFrame]:
    """Insert or extend entities by ``items`` (n, name, entity_type, observations); returns (entities, changed ids).

    Items are one call, in the order of ``n``. A new slug becomes an entity with its first item's name; an item
    adds the observations whose text without its date is new, and a type other than CONCEPT replaces the one
    held. Observations of one item aren't compared with each other, those of a later item are with all before.
    """
    rows = items.filter("name IS NOT NULL").select(
        slug("name").alias("id"), "n", "name", "entity_type",
        F.transform(F.filter(F.coalesce("observations", F.array().cast("array<string>")), lambda o: o.isNotNull()), lambda o: stamp(o, today)).alias("observations"),
    )
    typed = F.coalesce(F.when(F.col("entity_type") != "", F.col("entity_type")), F.lit("CONCEPT"))
    rows = rows.withColumn("kind", typed)
    calls = rows.groupBy("id").agg(F.min_by("name", "n").alias("_first"), F.max_by("kind", F.when(F.col("kind") != "CONCEPT", F.col("n"))).alias("_kind"))
    # an observation is new in the first call that brings its text; one row each, whatever the number of calls
    said = rows.select("id", "n", F.posexplode("observations").alias("k", "o")).withColumn("plain", strip_date(F.col("o")))
    first = said.groupBy("id", "plain").agg(F.min("n").alias("n"))
    old = entities.select("id", F.explode("observations").alias("o")).select("id", strip_date(F.col("o")).alias("plain")).distinct()
    fresh = said.join(first.join(old, ["id", "plain"], "left_anti"), ["id", "plain", "n"], "left_semi")
    new = fresh.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "k", "o"))), lambda x: x["o"]).alias("_new"))
    empty = F.array().cast("array<string>")
    base = entities.select("id", F.col("name").alias("_name"), F.col("entity_type").alias("_type"), F.col("observations").alias("_obs"), "metadata", "created_at", "entity_no")
    both = base.join(calls, "id", "full_outer").join(new, "id", "left")
    was = F.coalesce("_obs", empty)
    now = F.concat(was, F.coalesce("_new", empty))
    kind = F.coalesce("_kind", "_type", F.lit("CONCEPT"))
    out = both.select(
        "id", F.coalesce("_name", "_first").alias("name"), kind.alias("entity_type"), now.alias("observations"), F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        F.coalesce("created_at", F.lit(today)).alias("created_at"), "entity_no", (F.col("_name").isNull() | (F.size(now) > F.size(was)) | (kind != F.col("_type"))).alias("_changed"),
    )
    return out.drop("_changed"), out.filter("_changed").select("id")


def add_observations(entities: DataFrame, items: DataFrame, today: str) -> DataFrame:
    """Entities with the new observations of ``items`` (n, name, observations) added; raises if a name is unknown."""
    ids = items.select(slug("name").alias("id")).distinct()
    lost = ids.join(entities.select("id"), "id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no such entity: {lost[0][0]}")
    return create_entities(entities, items.withColumn("entity_type", F.lit(None).cast("string")), today)[0]


def delete_observations(entities: DataFrame, items: DataFrame) -> DataFrame:
    """Entities without the given observations (name, observation), compared as stored with their date."""
    gone = items.select(slug("name").alias("id"), "observation").groupBy("id").agg(F.collect_set("observation").alias("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("observations")).otherwise(F.filter("observations", lambda o: ~F.array_contains("_gone", o)))
    return entities.join(gone, "id", "left").withColumn("observations", kept).drop("_gone")


def create_relations(m: Memory, items: DataFrame, today: str) -> tuple[Memory, DataFrame]:
    """Insert relations (n, from_name, to_name, relation_type) that aren't held, and the ends that are missing; returns the new ones."""
    ends = items.select("n", F.explode(F.array("from_name", "to_name")).alias("name"), F.lit("CONCEPT").alias("entity_type"), F.array().cast("array<string>").alias("observations"))
    entities, _ = create_entities(m.entities, ends, today)
    rows = items.select("n", slug("from_name").alias("source_entity"), slug("to_name").alias("target_entity"), "relation_type")
    rows = rows.withColumn("id", relation_id(F.col("source_entity"), F.col("relation_type"), F.col("target_entity")))
    new = first_by(rows, "id", "n").join(m.relationships.select("id"), "id", "left_anti")
    new = new.select("id", "source_entity", "target_entity", "relation_type", F.lit(1.0).alias("confidence"), F.lit("{}").alias("metadata"), F.lit(today).alias("created_at"), F.col("n").alias("rel_no"))
    return m.with_(entities=entities, relationships=m.relationships.unionByName(new)), new


def update_relations(relationships: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confidence and metadata replaced by the last item (n, from_name, to_name, relation_type, confidence, metadata) of a relation.

    Returns (relationships, one row of updated and not_found items); items that name neither field count as neither.
    """
    rows = items.filter("confidence IS NOT NULL OR metadata IS NOT NULL").withColumn("id", relation_id(slug("from_name"), F.col("relation_type"), slug("to_name")))
    last = rows.groupBy("id").agg(F.max_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("n"))).alias("_c"), F.max_by("metadata", F.when(F.col("metadata").isNotNull(), F.col("n"))).alias("_m"))
    out = relationships.join(last, "id", "left").withColumn("confidence", F.coalesce("_c", "confidence")).withColumn("metadata", F.coalesce("_m", "metadata")).drop("_c", "_m")
    seen = rows.join(relationships.select("id", F.lit(1).alias("_h")), "id", "left")
    return out, seen.agg(F.count("_h").alias("updated"), (F.count("*") - F.count("_h")).alias("not_found"))


def _left(m: Memory, chunks: DataFrame | None = None, entities: DataFrame | None = None) -> Memory:
    """The memory without the links and vectors of removed chunks (chunk_id) and entities (entity_id)."""
    links, vectors = m.links, m.entity_vectors
    if links is not None and chunks is not None:
        links = links.join(chunks, "chunk_id", "left_anti")
    if links is not None and entities is not None:
        links = links.join(entities, "entity_id", "left_anti")
    if vectors is not None and entities is not None:
        vectors = vectors.join(entities, "entity_id", "left_anti")
    return m.with_(links=links, entity_vectors=vectors)


def add_links(m: Memory, links: DataFrame) -> Memory:
    """The memory with further links (chunk_id, entity_id), each held once."""
    new = links.select("chunk_id", "entity_id")
    return m.with_(links=(new if m.links is None else m.links.unionByName(new)).distinct())


def clean_document(m: Memory, documents: DataFrame) -> Memory:
    """Without the chunks of documents (document_id), and their links."""
    gone = m.chunks.join(documents, "document_id", "left_semi").select("chunk_id")
    return _left(m, chunks=gone).with_(chunks=m.chunks.join(documents, "document_id", "left_anti"))


def clean_graph_chunks(m: Memory) -> Memory:
    """Without the chunks synthesised for entities and relationships, and their links."""
    made = F.col("chunk_type").isin("entity", "relationship")
    return _left(m, chunks=m.chunks.filter(made).select("chunk_id")).with_(chunks=m.chunks.filter(~made | F.col("chunk_type").isNull()))


def delete_entities(m: Memory, names: DataFrame) -> Memory:
    """Without the named entities, the relations that touch them, their links and vectors; unknown names are ignored, chunks stay."""
    gone = names.select(slug("name").alias("id")).distinct()
    rel = m.relationships
    for end in ("source_entity", "target_entity"):
        rel = rel.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return _left(m, entities=gone.withColumnRenamed("id", "entity_id")).with_(entities=m.entities.join(gone, "id", "left_anti"), relationships=rel)


def delete_relations(relationships: DataFrame, items: DataFrame) -> DataFrame:
    """Without the given relations (from_name, to_name, relation_type); the type is compared in its case."""
    gone = items.select(slug("from_name").alias("source_entity"), slug("to_name").alias("target_entity"), "relation_type").distinct()
    return relationships.join(gone, ["source_entity", "target_entity", "relation_type"], "left_anti")


def store_documents(m: Memory, items: DataFrame) -> Memory:
    """Documents (n, id, content, metadata, created_at) stored or replaced, the last of an id; their old chunks and links go."""
    last = items.groupBy("id").agg(F.max_by(F.struct("content", "metadata", "created_at"), "n").alias("d"), F.max("n").alias("doc_id"))
    new = last.select("id", "d.content", "d.metadata", "d.created_at", "doc_id")
    kept = m.documents.join(new.select("id"), "id", "left_anti")
    return clean_document(m, new.select(F.col("id").alias("document_id"))).with_(documents=kept.unionByName(new, allowMissingColumns=True))


def delete_documents(m: Memory, ids: DataFrame) -> tuple[Memory, DataFrame]:
    """Without the documents (id), their chunks and links; returns (memory, (id, deleted) of each request)."""
    asked = ids.select("id").distinct()
    report = asked.join(m.documents.select("id", F.lit(True).alias("_h")), "id", "left").select("id", F.coalesce("_h", F.lit(False)).alias("deleted"))
    left = clean_document(m, asked.withColumnRenamed("id", "document_id"))
    return left.with_(documents=m.documents.join(asked, "id", "left_anti")), report


def import_memory(m: Memory, other: Memory, merge: bool = True) -> tuple[Memory, DataFrame]:
    """Add another memory's entities, relations and documents; returns (memory, (what, imported, skipped)).

    Entities with an id or name already held and relations with an id already held are skipped, documents are
    replaced. Without ``merge`` the three tables are emptied first, and the chunks of documents, links and entity vectors
    with them. Raises if a relation has no ends.
    """
    base = m
    if not merge:
        base = clean_document(m, m.documents.select(F.col("id").alias("document_id")))
        base = _left(base, entities=m.entities.select(F.col("id").alias("entity_id")))
        base = base.with_(entities=m.entities.limit(0), relationships=m.relationships.limit(0), documents=m.documents.limit(0))
    new = other.entities.join(base.entities.select("id"), "id", "left_anti").join(base.entities.select("name"), "name", "left_anti")
    entities = base.entities.unionByName(new.select(base.entities.columns))
    rel = other.relationships.join(base.relationships.select("id"), "id", "left_anti")
    ids = entities.select("id")
    lost = rel.join(ids.withColumnRenamed("id", "source_entity"), "source_entity", "left_anti").unionByName(rel.join(ids.withColumnRenamed("id", "target_entity"), "target_entity", "left_anti").select(*rel.columns), allowMissingColumns=True)
    if not lost.isEmpty():
        raise ValueError("a relation has no entity at one end")
    stored = store_documents(base, other.documents.withColumn("n", F.col("doc_id")))
    out = stored.with_(entities=entities, relationships=base.relationships.unionByName(rel.select(base.relationships.columns)))
    report = None
    for what, given, taken in (("entities", other.entities, new), ("relations", other.relationships, rel), ("documents", other.documents, other.documents)):
        n = given.agg(F.count("*").alias("g")).crossJoin(taken.agg(F.count("*").alias("imported")))  # one row each
        row = n.select(F.lit(what).alias("what"), "imported", (F.col("g") - F.col("imported")).alias("skipped"))
        report = row if report is None else report.unionByName(row)
    return out, report
