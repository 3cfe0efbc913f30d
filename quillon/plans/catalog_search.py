"""Search queries: nearest neighbours, BM25, boosts, hybrid scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import terms
from quillon.operators import crosslingual, embedding, fulltext, graph, hybrid, search, vector
from quillon.plans.catalog import query
from quillon.schema import memory
from quillon.session import materialise, spread, table


@query
def knn_top5(spark, directory):
    """The 5 nearest of every 50th vector."""
    base = table(spark, directory, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = vector.knn(base, base.filter("id % 50 = 0"), 5, 64)
    return found.select("query", "id", "rank", F.round("distance", 6).alias("distance"))


def _vectors(m, kind: str) -> DataFrame:
    """Vectors (id, v) of chunks of a kind that can be searched."""
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return m.chunks.filter((F.col("chunk_type") == kind) & fine).select("chunk_id", "chunk_no", "entity_id", v.alias("v"))


@query
def search_nodes(spark, directory):
    """The 10 entities nearest to every 50th entity chunk, with their similarity."""
    m = memory(spark, directory)
    base = _vectors(m, "entity").select(F.col("chunk_no").alias("id"), "v", "entity_id")
    found = vector.knn(base.select("id", "v"), base.filter("id % 50 = 0").select("id", "v"), 10, 64)
    named = found.join(base.select("id", "entity_id"), "id")
    return named.select("query", "entity_id", "rank", F.round(vector.similarity(F.col("distance")), 6).alias("similarity"))


@query
def matched_and_connected(spark, directory):
    """Entities of more than 0.4 similarity to every 50th entity chunk, and the names one edge away."""
    m = memory(spark, directory)
    base = _vectors(m, "entity").select(F.col("chunk_no").alias("id"), "v", "entity_id")
    found = vector.knn(base.select("id", "v"), base.filter("id % 50 = 0").select("id", "v"), 10, 64)
    near = found.filter(vector.similarity(F.round("distance", 9)) > 0.4).join(base.select("id", "entity_id"), "id")
    names = m.entities.select(F.col("id").alias("entity_id"), "name")
    matched = near.join(names, "entity_id").select("query", "name", F.lit("matched").alias("how")).distinct()
    hop = near.select("query", "entity_id").distinct().join(graph.one_hop(m).withColumnRenamed("id", "entity_id"), "entity_id")
    return matched.unionByName(hop.select("query", F.col("connected").alias("name"), F.lit("connected").alias("how")).distinct())


@query
def temporal_filter(spark, directory):
    """Of the entities nearest to every 50th entity chunk those created in a window: filtered behind the limit, as text."""
    top = search_nodes(spark, directory).join(memory(spark, directory).entities.select(F.col("id").alias("entity_id"), "created_at"), "entity_id")
    return top.filter((F.col("created_at") >= "2024-06-01") & (F.col("created_at") <= "2024-12-31")).select("query", "entity_id", "created_at")


@query
def list_documents(spark, directory):
    """All documents, the latest first."""
    m = memory(spark, directory)
    return m.documents.select("id", "created_at", "metadata").orderBy(F.desc("created_at"), "id")


@query
def best_per_chunk(spark, directory):
    """The nearest hit of each chunk in each session."""
    hits = table(spark, directory, "search_results").filter("session_id IS NOT NULL AND chunk_id IS NOT NULL AND distance IS NOT NULL")
    best = vector.best_per_key(hits.select("session_id", "chunk_id", "distance", "result_no"), ["session_id", "chunk_id"], "distance")
    return best


@query
def similarity_threshold(spark, directory):
    hits = table(spark, directory, "search_results").dropDuplicates(["result_no"])
    near = vector.similarity(F.col("distance"))
    return hits.filter(near > 0.4).select("result_no", F.round(near, 6).alias("similarity"))


@query
def session_top5(spark, directory):
    """The 5 results of the highest score of each session."""
    hits = table(spark, directory, "search_results").dropDuplicates(["result_no"]).filter("session_id IS NOT NULL AND hybrid_score IS NOT NULL")
    order = Window.partitionBy("session_id").orderBy(F.desc("hybrid_score"), "result_no")
    return hits.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("session_id", "rank", "result_no")


def _questions(m) -> DataFrame:
    """Every 50th entity asks with its name."""
    return m.entities.filter("entity_no % 50 = 0").select(F.col("entity_no").alias("query"), "name")


@query
def bm25_top15(spark, directory):
    m = memory(spark, directory)
    found = fulltext.bm25(m.chunks, _questions(m), "query", "name")
    return found.select("query", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query
def lexical_boost(spark, directory):
    m = memory(spark, directory)
    found = fulltext.bm25(m.chunks, _questions(m), "query", "name")
    return found.select("query", "chunk_id", F.round(hybrid.lexical_boost(F.col("rank")), 9).alias("boost"))


@query
def document_frequencies(spark, directory):
    """Chunks and occurrences of every term of the full-text index."""
    posts, _ = fulltext.postings(memory(spark, directory).chunks)
    return posts.groupBy("term").agg(F.countDistinct("chunk_id").alias("chunks"), F.count("*").alias("n"))


def _chunk_names(spark, directory) -> DataFrame:
    """(chunk_id, name): entities shown with a chunk."""
    shown = table(spark, directory, "search_results").filter("chunk_id IS NOT NULL").select("chunk_id", F.explode("entities").alias("name"))
    return shown.filter("name <> ''").distinct()


def _variants(m) -> DataFrame:
    """(query, variant, text): every 50th entity asks with its name, and with its other name where one is known."""
    asks = _questions(m).withColumnRenamed("name", "text")
    pairs = crosslingual.native_names(m.entities).select(F.col("name").alias("term"), F.col("native").alias("other")).groupBy("term").agg(F.min("other").alias("other"))
    return crosslingual.variant_rows(asks, "query", "text", pairs)


@query
def graph_boost(spark, directory):
    """Boost of every entity chunk for the query of its own name: the chunk's kind, and what the graph says of its entity."""
    m = memory(spark, directory)
    own = m.chunks.filter("chunk_type = 'entity'").select("chunk_id", "entity_id")
    asked = own.join(m.entities.select(F.col("id").alias("entity_id"), "name", "entity_no"), "entity_id")
    hops = graph.one_hop(m).groupBy("id").agg(F.collect_set("connected").alias("connected"))
    asked = asked.join(hops.withColumnRenamed("id", "entity_id"), "entity_id", "left")
    empty = F.array().cast("array<string>")
    score = hybrid.entity_score(F.col("name"), F.lower("name"), terms(F.col("name")), empty, F.coalesce("connected", empty))
    return asked.select("chunk_id", F.round(hybrid.graph_boost(F.lit("entity"), F.array(score)), 9).alias("boost"))


@query
def hybrid_search(spark, directory):
    """The 5 best chunks of any kind for the name of every 50th entity: variants, vectors, full text, graph and sentences."""
    m = memory(spark, directory)
    found = search.search(m, _variants(m))
    return found.select("query", "rank", "chunk_id", "title", F.round("similarity", 6).alias("similarity"), F.round("graph_boost", 6).alias("graph_boost"), F.round("score", 6).alias("score"))


@query
def nodes_near(spark, directory):
    """The edges among the 10 entities nearest to each of the queries of hybrid_search."""
    m = memory(spark, directory)
    asks = materialise(embedding.with_embedding(_variants(m), "text", "v", query=True), "asks")
    _, edges = search.nodes_near(m, embedding.embed_entities(m.entities), asks)
    return edges.select("query", "id")


@query
def content_summaries(spark, directory):
    """The best sentences of every document chunk, weighed by the names shown with it."""
    m = memory(spark, directory)
    names = _chunk_names(spark, directory).groupBy("chunk_id").agg(F.collect_set("name").alias("names"))
    rows = spread(m.chunks.filter("chunk_type = 'document' AND text IS NOT NULL").select("chunk_id", "chunk_type", "text")).join(names, "chunk_id", "left")
    rows = rows.withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).withColumn("query", F.lit(0))
    return search.summaries(rows, None).select("chunk_id", "text", "highlight", "score")


@query
def native_names(spark, directory):
    return crosslingual.native_names(memory(spark, directory).entities)


@query
def query_variants(spark, directory):
    """Names of entities asked about, and the same in the native names that observations give."""
    m = memory(spark, directory)
    pairs = crosslingual.native_names(m.entities).select(F.col("name").alias("term"), F.col("native").alias("other")).groupBy("term").agg(F.min("other").alias("other"))
    return crosslingual.variant_rows(m.entities.select("id", F.concat(F.lit("about "), "name").alias("text")), "id", "text", pairs)


@query
def embed_chunks(spark, directory):
    """The parts other than 0 of the default embedding of every chunk."""
    found = embedding.embed_chunks(memory(spark, directory).chunks)
    return found.select("chunk_id", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0").select("chunk_id", "dim", F.round("value", 8).alias("value"))


@query
def embed_entities(spark, directory):
    found = embedding.embed_entities(memory(spark, directory).entities)
    return found.select("entity_id", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0").select("entity_id", "dim", F.round("value", 8).alias("value"))


@query
def connected_by_terms(spark, directory):
    """Names one edge away from the entities that results show, for each of the shown names; never the name itself."""
    m = memory(spark, directory)
    shown = table(spark, directory, "search_results").select(F.explode("entities").alias("name")).filter("name <> ''").distinct()
    known = m.entities.join(shown, "name").select("id", "name")
    return graph.one_hop(m).join(known, "id").filter("connected <> name").select("name", "connected").distinct()
