"""The whole search: variants of a query, vectors, full text, entities near the query, the graph around them, sentences."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import sentences, terms
from quillon.operators import embedding, fulltext, graph, hybrid, linking, vector
from quillon.schema import Memory
from quillon.session import materialise

#: Entities looked up around a query, and the similarity above which one counts as meant.
NEAR_ENTITIES, MEANT = 10, 0.4


def _nearest(vectors: DataFrame, asks: DataFrame, k: int, dim: int) -> DataFrame:
    """(query, id, distance): the ``k`` nearest (id string, v) of each variant of each query (query, variant, v), the best distance of all."""
    asked = asks.select(F.concat_ws("\0", F.lit("query"), F.col("query").cast("string"), F.col("variant").cast("string")).alias("id"), F.col("v"))
    found = vector.knn(vectors, asked, k, dim)
    return found.groupBy(F.split("query", "\0")[1].cast("long").alias("query"), "id").agg(F.min("distance").alias("distance"))


def merged_ranks(ranked: DataFrame) -> DataFrame:
    """(query, chunk_id, rank) of ranked hits (query, variant, chunk_id, rank): variants one after another, a chunk at its first."""
    first = ranked.groupBy("query", "chunk_id").agg(F.min(F.struct("variant", "rank")).alias("at"))
    order = Window.partitionBy("query").orderBy("at", "chunk_id")
    return first.select("query", "chunk_id", F.row_number().over(order).alias("rank"))


def nodes_near(m: Memory, entity_vectors: DataFrame, asks: DataFrame, limit: int = 10, dim: int = embedding.DIM) -> tuple[DataFrame, DataFrame]:
    """The ``limit`` entities nearest to each query over its variants (query, entity_id, name, similarity, rank), and the edges among them.

    Each variant looks for twice as many; an entity counts with its best distance.
    """
    found = _nearest(entity_vectors.select(F.col("entity_id").alias("id"), F.col("embedding").alias("v")), asks, 2 * limit, dim)
    order = Window.partitionBy("query").orderBy(F.round("distance", 9), "id")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    nodes = top.join(m.entities.select("id", "name"), "id").select("query", F.col("id").alias("entity_id"), "name", vector.similarity(F.col("distance")).alias("similarity"), "rank")
    ends = [nodes.select("query", F.col("entity_id").alias(e)) for e in ("source_entity", "target_entity")]
    edges = m.relationships.select("id", "source_entity", "target_entity", "relation_type")
    return nodes, edges.join(ends[0], "source_entity").join(ends[1], ["query", "target_entity"]).select("query", "id", "source_entity", "relation_type", "target_entity")


def chunk_names(m: Memory, chunks: DataFrame) -> DataFrame:
    """(chunk_id, name): the entities a chunk stands for; linked ones for a document's, its own for an entity's, both ends for a relationship's.

    Without a table of links those of ``chunks`` are made here.
    """
    own = m.entities.select(F.col("id").alias("entity_id"), "name")
    documents = chunks.filter("chunk_type = 'document'")
    links = m.links if m.links is not None else linking.auto_links(documents, m.entities.withColumn("observations", F.filter("observations", lambda o: o.isNotNull())))
    named = documents.select("chunk_id").join(links, "chunk_id").join(own, "entity_id").select("chunk_id", "name")
    named = named.unionByName(chunks.filter("chunk_type = 'entity'").select("chunk_id", "entity_id").join(own, "entity_id").select("chunk_id", "name"))
    if "relationship_id" in chunks.columns:
        ends = graph.named_edges(m).select(F.col("id").alias("relationship_id"), F.explode(F.array("from_name", "to_name")).alias("name"))
        named = named.unionByName(chunks.filter("chunk_type = 'relationship'").select("chunk_id", "relationship_id").join(ends, "relationship_id").select("chunk_id", "name"))
    return named.distinct()


def summaries(rows: DataFrame, queries: DataFrame | None, embedder: Callable[[list[str]], np.ndarray] = embedding.hashed) -> DataFrame:
    """(query, chunk_id, text, highlight, score) of candidates (query, chunk_id, chunk_type, text, names).

    Sentences are scored by their cosine to the query (query, text; None: 0) and what they hold; the best two (of a
    relationship's chunk one) sum it up, with the best one as highlight. A text without sentences is summed up by
    its start, with score 0.1.
    """
    said = rows.withColumn("said", sentences(F.col("text")))
    if queries is not None:
        each = said.select("query", "chunk_id", F.posexplode("said").alias("n", "sentence"))
        near = embedding.sentence_scores(each, queries, embedder).groupBy("query", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("n", "score"))).alias("near"))
        said = said.join(near, ["query", "chunk_id"], "left")
    else:
        said = said.withColumn("near", F.transform("said", lambda s, i: F.struct(i.alias("n"), F.lit(0.0).alias("score"))))
    scores = F.transform("near", lambda x: F.round(x["score"] + hybrid.importance(F.get("said", x["n"]), F.col("names")), 9))
    said = said.withColumn("scores", scores)
    best = F.when(F.col("chunk_type") == "relationship", hybrid.summary(F.col("said"), F.col("scores"), 1)).otherwise(hybrid.summary(F.col("said"), F.col("scores"), 2))
    return said.select("query", "chunk_id", F.when(F.size("said") > 0, best).otherwise(hybrid.start_of(F.col("text"))).alias("s")).select("query", "chunk_id", "s.*")


def titles(m: Memory, chunks: DataFrame) -> DataFrame:
    """(chunk_id, title, source_id): what a result is shown under; a left join with the documents."""
    about = m.documents.select(F.col("id").alias("document_id"), "metadata")
    field = lambda f: F.when(F.get_json_object("metadata", f) != "", F.get_json_object("metadata", f))
    kind = F.col("chunk_type")
    title = (
        F.when(kind == "document", F.coalesce(field("$.title"), field("$.name"), F.when(F.col("document_id") != "", F.col("document_id")), F.lit("Unknown Document")))
        .when(kind == "entity", F.lit("Knowledge Graph Entity")).when(kind == "relationship", F.lit("Knowledge Graph Relationship")).otherwise(F.lit("Unknown Source"))
    )
    relationship = F.col("relationship_id") if "relationship_id" in chunks.columns else F.lit(None)
    source = F.coalesce(F.when(kind == "document", F.col("document_id")).when(kind == "entity", F.col("entity_id")).when(kind == "relationship", relationship), F.lit(""))
    return chunks.join(about, "document_id", "left").select("chunk_id", title.alias("title"), source.alias("source_id"))


def search(
    m: Memory, variants: DataFrame, limit: int = 5, use_graph: bool = True, embedder: Callable[[list[str]], np.ndarray] = embedding.hashed, dim: int = embedding.DIM
) -> DataFrame:
    """(query, rank, chunk_id, chunk_type, title, source_id, names, summary, highlight, similarity, graph_boost, fts_boost, score).

    ``variants`` (query long, variant int, text): each query, variant 0 in its own words. Every variant looks for 3 x
    ``limit`` chunks of any kind by vector and by full text; the score is the larger of similarity and the relevance of
    the best sentence, plus the boosts of the graph and of the full-text rank.
    """
    chunks = materialise(m.chunks.filter("text IS NOT NULL").select(*[c for c in ("chunk_id", "chunk_type", "document_id", "entity_id", "relationship_id", "text") if c in m.chunks.columns]), "chunks")
    asks = materialise(embedding.with_embedding(variants.select("query", "variant", "text"), "text", "v", embedder, query=True), "asks")
    base = embedding.with_embedding(chunks.select(F.col("chunk_id").alias("id"), "text"), "text", "v", embedder).drop("text")  # read once, where the texts are
    near = _nearest(base, asks, 3 * limit, dim).withColumnRenamed("id", "chunk_id")
    tagged = asks.select((F.col("query") * 64 + F.col("variant")).alias("ask"), "text")
    lexical = fulltext.bm25(chunks, tagged, "ask", "text", 3 * limit).select(F.floor(F.col("ask") / 64).alias("query"), F.pmod("ask", F.lit(64)).cast("int").alias("variant"), "chunk_id", "rank")
    found = materialise(hybrid.pool(near, merged_ranks(lexical), "query"), "pool")
    pool = chunks.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
    names = materialise(chunk_names(m, pool).groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("names")), "names")
    empty = F.array().cast("array<string>")
    rows = found.join(pool, "chunk_id").join(names, "chunk_id", "left").withColumn("names", F.coalesce("names", empty))
    first = asks.filter("variant = 0").select("query", F.col("text").alias("question"))
    if use_graph:
        vectors = m.entity_vectors if m.entity_vectors is not None else embedding.embed_entities(m.entities, embedder)
        around = _nearest(vectors.select(F.col("entity_id").alias("id"), F.col("embedding").alias("v")), asks, NEAR_ENTITIES, dim)
        meant = around.filter(vector.similarity(F.round("distance", 9)) > MEANT).select("query", "id")
        matched = meant.join(m.entities.select("id", "name"), "id").groupBy("query").agg(F.collect_set("name").alias("matched"))
        linked = meant.join(graph.one_hop(m), "id").groupBy("query").agg(F.collect_set("connected").alias("connected"))
        rows = rows.join(first, "query").join(matched, "query", "left").join(linked, "query", "left")
        scores = F.transform("names", lambda n: hybrid.entity_score(n, F.col("question"), terms(F.col("question")), F.coalesce("matched", empty), F.coalesce("connected", empty)))
        rows = rows.withColumn("boost", hybrid.graph_boost(F.col("chunk_type"), scores)).drop("question", "matched", "connected")
    else:
        rows = rows.withColumn("boost", F.lit(0.0))
    rows = materialise(rows, "rows")
    told = summaries(rows.select("query", "chunk_id", "chunk_type", "text", "names"), first.withColumnRenamed("question", "text"), embedder)
    told = told.select("query", "chunk_id", F.col("text").alias("summary"), "highlight", F.col("score").alias("relevance"))
    scored = hybrid.top(hybrid.final_score(rows.drop("text").join(told, ["query", "chunk_id"]), "relevance"), "query", limit)
    shown = scored.join(titles(m, pool), "chunk_id")
    fts = F.coalesce(hybrid.lexical_boost(F.col("fts_rank")), F.lit(0.0)).alias("fts_boost")
    return shown.select("query", "rank", "chunk_id", "chunk_type", "title", "source_id", "names", "summary", "highlight", vector.similarity(F.col("distance")).alias("similarity"), F.col("boost").alias("graph_boost"), fts, "score")
