"""The reference surface by name: a call with JSON arguments on a memory gives a new memory and a JSON answer.

Reads answer with rows; changes give the memory that holds afterwards. Large memories are better served by the
operators themselves, whose results stay DataFrames.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import slug, terms
from quillon.functions.tokenizer import TOKENIZER, bpe_ends
from quillon.operators import analytics, changes, chunking, crosslingual, embedding, graph, linking, search
from quillon.schema import Memory
from quillon.session import materialise
from quillon.sources import store

Answer = tuple[Memory, Any]
TOOLS: dict[str, Callable[[Memory, dict], Answer]] = {}


def tool(name: str):
    def register(f: Callable[[Memory, dict], Answer]):
        TOOLS[name] = f
        return f

    return register


def call_tool(m: Memory, name: str, arguments: dict) -> Answer:
    """Run a tool; raises KeyError for an unknown one and ValueError for arguments it can't use."""
    return TOOLS[name](m, dict(arguments))


def _session() -> SparkSession:
    return SparkSession.getActiveSession()


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _items(rows: list[dict], schema: str, **renamed: str) -> DataFrame:
    """Arguments as rows, numbered in their order as ``n``."""
    names = [f.split()[0] for f in schema.split(", ")]
    data = [(i, *(r.get(renamed.get(n, n)) for n in names)) for i, r in enumerate(rows)]
    return _session().createDataFrame(data, f"n long, {schema}")


def _names(names: list[str], column: str = "name") -> DataFrame:
    return _session().createDataFrame([(n,) for n in names], f"{column} string")


def _today() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%d")


RELATION = {"from_name": "from", "to_name": "to", "relation_type": "relationType"}
ENDS = "from_name string, to_name string, relation_type string"


@tool("createEntities")
def _(m, a):
    items = _items(a["entities"], "name string, entity_type string, observations array<string>", entity_type="entityType")
    entities, changed = changes.create_entities(m.entities, items, _today())
    return m.with_(entities=entities), _rows(entities.join(changed, "id", "left_semi").select("name", "entity_type", "observations"))


@tool("createRelations")
def _(m, a):
    out, new = changes.create_relations(m, _items(a["relations"], ENDS, **RELATION), _today())
    return out, _rows(new.select("source_entity", "target_entity", "relation_type"))


@tool("addObservations")
def _(m, a):
    items = _items(a["observations"], "name string, observations array<string>", name="entityName", observations="contents")
    new = changes.add_observations(m.entities, items, _today())
    was = m.entities.select("id", F.col("observations").alias("_was"))
    added = F.slice("observations", F.size("_was") + 1, F.greatest(F.lit(0), F.size("observations") - F.size("_was")))
    asked = items.select(slug("name").alias("id")).distinct()
    return m.with_(entities=new), [{"entityName": r["name"], "addedObservations": r["added"]} for r in new.join(asked, "id", "left_semi").join(was, "id").select("name", added.alias("added")).collect()]


@tool("updateRelations")
def _(m, a):
    rel, seen = changes.update_relations(m.relationships, _items(a["updates"], ENDS + ", confidence double, metadata string", **RELATION))
    return m.with_(relationships=rel), _rows(seen)[0]


@tool("deleteEntities")
def _(m, a):
    return changes.delete_entities(m, _names(a["entityNames"])), {"deleted": True}


@tool("deleteRelations")
def _(m, a):
    return m.with_(relationships=changes.delete_relations(m.relationships, _items(a["relations"], ENDS, **RELATION))), {"deleted": True}


@tool("deleteObservations")
def _(m, a):
    gone = [{"name": d["entityName"], "observation": o} for d in a["deletions"] for o in d["observations"]]
    return m.with_(entities=changes.delete_observations(m.entities, _items(gone, "name string, observation string"))), {"deleted": True}


@tool("readGraph")
def _(m, a):
    return m, {"entities": _rows(m.entities.select("name", "entity_type", "observations")), "relations": _rows(graph.named_edges(m).select("from_name", "to_name", "relation_type"))}


@tool("openNodes")
def _(m, a):
    nodes, edges = graph.open_nodes(m, _names(a["names"]))
    return m, {"entities": _rows(nodes.select("name", "entity_type", "observations")), "relations": _rows(graph.named_edges(m.with_(relationships=edges)).select("from_name", "to_name", "relation_type"))}


@tool("getNeighbors")
def _(m, a):
    seeds = m.entities.join(_names(a["entityNames"]), "name", "left_semi").select("id")
    nodes, edges = graph.neighbours(m, seeds, a.get("depth") or 1, a.get("relationType"))
    return m, {"entities": _rows(nodes), "relations": _rows(edges.select("source_entity", "target_entity", "relation_type", "depth"))}


@tool("storeDocument")
def _(m, a):
    items = _items([{**a, "created_at": _today()}], "id string, content string, metadata string, created_at string")
    return changes.store_documents(m, items.withColumn("metadata", F.coalesce("metadata", F.lit("{}")))), {"id": a["id"], "stored": True}


@tool("chunkDocument")
def _(m, a):
    own = m.documents.filter(F.col("id") == a["documentId"])
    if own.isEmpty():
        raise ValueError(f"no such document: {a['documentId']}")
    ends = bpe_ends() if os.path.exists(TOKENIZER) else chunking.word_ends
    new = chunking.chunk_texts(own, "id", "content", a.get("maxTokens") or 800, a.get("overlap") or 160, ends)
    new = new.select(F.concat("id", F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.lit("document").alias("chunk_type"), F.col("id").alias("document_id"), "chunk_index", "text", "start_pos", "end_pos", "start_token", "end_token")
    m = changes.clean_document(m, _names([a["documentId"]], "document_id"))
    return m.with_(chunks=m.chunks.unionByName(new, allowMissingColumns=True)), _rows(new.select("chunk_id", "start_pos", "end_pos"))


@tool("embedChunks")
def _(m, a):
    own = m.chunks.filter(F.col("document_id") == a["documentId"])
    if own.isEmpty():
        raise ValueError(f"no chunks of document: {a['documentId']}")
    found = embedding.embed_chunks(own).withColumnRenamed("embedding", "_new").withColumn("_new", F.col("_new").cast("array<float>"))
    base = m.chunks if "embedding" in m.chunks.columns else m.chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    chunks = base.join(found, "chunk_id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")
    links = linking.auto_links(own, m.entities)
    return changes.add_links(m.with_(chunks=chunks), links), {"embedded": found.count(), "linked": links.select("entity_id").distinct().count()}


@tool("embedAllEntities")
def _(m, a):
    vectors = materialise(embedding.embed_entities(m.entities), "entity_vectors")
    return m.with_(entity_vectors=vectors), {"embedded": vectors.count()}


@tool("generateGraphChunks")
def _(m, a):
    m = changes.clean_graph_chunks(m)
    new = chunking.entity_chunks(m.entities).unionByName(chunking.relationship_chunks(graph.named_edges(m)), allowMissingColumns=True)
    return m.with_(chunks=m.chunks.unionByName(new, allowMissingColumns=True)), {"chunks": new.count()}


@tool("embedGraphChunks")
def _(m, a):
    own = m.chunks.filter("chunk_type IN ('entity', 'relationship')")
    found = embedding.embed_chunks(own).withColumnRenamed("embedding", "_new").withColumn("_new", F.col("_new").cast("array<float>"))
    base = m.chunks if "embedding" in m.chunks.columns else m.chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    chunks = base.join(found, "chunk_id", "left").withColumn("embedding", F.coalesce("_new", "embedding")).drop("_new")
    return m.with_(chunks=chunks), {"embedded": found.count()}


@tool("extractTerms")
def _(m, a):
    found = m.documents.filter(F.col("id") == a["documentId"]).select(terms(F.col("content"), a.get("minLength") or 3, a.get("includeCapitalized", True), tuple(a.get("customPatterns") or ())).alias("t")).first()
    if found is None:
        raise ValueError(f"no such document: {a['documentId']}")
    return m, {"terms": found["t"]}


@tool("linkEntitiesToDocument")
def _(m, a):
    if m.documents.filter(F.col("id") == a["documentId"]).isEmpty():
        raise ValueError(f"no such document: {a['documentId']}")
    links = linking.name_links(m.chunks.filter(F.col("document_id") == a["documentId"]), m.entities.join(_names(a["entityNames"]), "name", "left_semi"))
    return changes.add_links(m, links), {"links": _rows(links)}


@tool("deleteDocuments")
def _(m, a):
    ids = a["documentIds"]
    out, report = changes.delete_documents(m, _names([ids] if isinstance(ids, str) else ids, "id"))
    rows = _rows(report)
    gone = sum(r["deleted"] for r in rows)
    return out, {"results": rows, "summary": {"deleted": gone, "failed": len(rows) - gone, "total": len(rows)}}


@tool("listDocuments")
def _(m, a):
    columns = ["id", "created_at"] + (["metadata"] if a.get("includeMetadata", True) else [])
    return m, {"documents": _rows(m.documents.orderBy(F.desc("created_at"), "id").select(*columns))}


def _variants(m: Memory, a: dict) -> DataFrame:
    """(query, variant, text) of one query: in its own words, and translated where the dictionary or native names allow it."""
    known = crosslingual.load_dictionary(a["dictionary"]) if a.get("dictionary") else {"native-en": {}, "en-native": {}}
    for native, name in m.entities.transform(crosslingual.native_names).join(_names(a["query"].split(), "w"), F.instr(F.lower("name"), F.lower("w")) + F.instr("native", F.col("w")) > 0, "left_semi").collect():
        known["native-en"].setdefault(native, name)
        known["en-native"].setdefault(name, native)
    return _session().createDataFrame([(1, i, t) for i, t in enumerate(crosslingual.variants(a["query"], known))], "query long, variant int, text string")


@tool("searchNodes")
def _(m, a):
    asks = materialise(embedding.with_embedding(_variants(m, a), "text", "v", query=True), "asks")
    vectors = m.entity_vectors if m.entity_vectors is not None else materialise(embedding.embed_entities(m.entities), "vectors")
    nodes, edges = search.nodes_near(m, vectors, asks, a.get("limit") or 10)
    hits = nodes.join(m.entities.select(F.col("id").alias("entity_id"), "entity_type", "observations", "created_at"), "entity_id")
    for key, keep in (("since", F.col("created_at") >= a.get("since")), ("until", F.col("created_at") <= a.get("until"))):
        hits = hits.filter(keep) if a.get(key) else hits
    left = hits.select("entity_id")
    for end in ("source_entity", "target_entity"):
        edges = edges.join(left.withColumnRenamed("entity_id", end), end, "left_semi")
    return m, {"entities": _rows(hits.orderBy("rank").select("name", "entity_type", "observations", "similarity")), "relations": _rows(edges.select("source_entity", "relation_type", "target_entity"))}


@tool("hybridSearch")
def _(m, a):
    found = search.search(m, _variants(m, a), a.get("limit", 5), a.get("useGraph", True))
    texts = m.chunks.select("chunk_id", "text")
    return m, {"results": _rows(found.join(texts, "chunk_id").orderBy("rank").drop("query"))}


@tool("getDetailedContext")
def _(m, a):
    found = _rows(chunking.context(m.chunks).filter(F.col("chunk_id") == a["chunkId"]).select("chunk_id", "document_id", "text", "before", "after"))
    if not found:
        raise ValueError(f"no such chunk: {a['chunkId']}")
    return m, found[0] if a.get("includeSurrounding", True) else {k: v for k, v in found[0].items() if k not in ("before", "after")}


@tool("exportGraph")
def _(m, a):
    if a.get("path"):  # a large memory is written, not returned
        return m, {"path": a["path"], "metadata": store.export_json(m, a["path"])}
    data = {"entities": _rows(m.entities), "relations": _rows(m.relationships), "documents": _rows(m.documents)}
    about = {"exportedAt": datetime.now(UTC).isoformat(), "version": "1", "entityCount": len(data["entities"]), "relationCount": len(data["relations"]), "documentCount": len(data["documents"])}
    return m, {**data, "metadata": about}


@tool("importGraph")
def _(m, a):
    data = a["data"]
    ent = _items(data.get("entities") or [], "id string, name string, entity_type string, observations array<string>, metadata string, created_at string")
    rel = _items(data.get("relations") or [], "id string, source_entity string, target_entity string, relation_type string, confidence double, metadata string, created_at string")
    doc = _items(data.get("documents") or [], "id string, content string, metadata string, created_at string")
    fill = {"metadata": "{}", "created_at": _today()}
    other = Memory(
        ent.withColumn("observations", F.coalesce("observations", F.array().cast("array<string>"))).fillna(fill | {"entity_type": "CONCEPT"}).withColumnRenamed("n", "entity_no"),
        rel.fillna(fill | {"confidence": 1.0}).withColumnRenamed("n", "rel_no"), doc.fillna(fill).withColumnRenamed("n", "doc_id"), m.chunks.limit(0),
    )
    out, report = changes.import_memory(m, other, a.get("merge", True))
    return out, _rows(report)


@tool("getKnowledgeGraphStats")
def _(m, a):
    return m, {"totals": _rows(graph.totals(m)), "entities": _rows(graph.counts_by_type(m)), "relations": _rows(graph.counts_by_relation(m))}


@tool("getGraphMetrics")
def _(m, a):
    edges = analytics.simple_edges(m)
    everyone = m.entities.select("id")
    names = m.entities.select("id", "name")
    make = {
        "degree": lambda: analytics.degree_centrality(m, edges), "pagerank": lambda: analytics.pagerank(m, edges, rounds=100, tolerance=1e-6),
        "closeness": lambda: analytics.closeness(edges, everyone).join(names, "id"), "betweenness": lambda: analytics.betweenness(m, edges, everyone).join(names, "id"),
    }
    rows = None
    for metric in [x for x in (a.get("metrics") or make) if x in make]:
        part = make[metric]().select(F.lit(metric).alias("metric"), "name", "score")
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return m, []
    wanted = a.get("entityNames")
    return m, _rows(rows.join(_names(wanted), "name", "left_semi") if wanted else analytics.top_by_metric(rows, a.get("limit") or 10))


@tool("detectCommunities")
def _(m, a):
    edges = analytics.simple_edges(m)
    found = analytics.communities(m, edges, a.get("resolution") or 1.0)
    listed = found.join(m.entities.select("id", "name"), "id").groupBy("community", "size").agg(F.array_sort(F.collect_list("name")).alias("members"))
    return m, {"communities": _rows(listed.orderBy(F.desc("size"), "community")), "quality": _rows(analytics.modularity(edges, found.select("id", "community")))[0]}


@tool("analyzeGraphStructure")
def _(m, a):
    edges = analytics.simple_edges(m)
    sizes = analytics.component_sizes(m, edges)
    listed = {"componentSizes": [r["size"] for r in sizes.limit(a.get("limit") or 10).collect()], "isolatedEntities": [r["name"] for r in sizes.filter("isolated").join(m.entities.select(F.col("id").alias("component"), "name"), "component").orderBy("name").limit(a.get("limit") or 10).collect()]}
    return m, {r["measure"]: r["value"] for r in _rows(analytics.structure(m, edges))} | listed
