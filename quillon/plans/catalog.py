"""Registered queries of the engine's own operators over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import analytics, graph
from quillon.schema import memory
from quillon.session import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query by its function's name."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        prepare(spark)
        return f(spark, directory)

    QUERIES[f.__name__] = run
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quillon.plans import catalog_changes, catalog_search, catalog_text  # noqa: F401

    return dict(QUERIES)


@query
def stats_by_type(spark, directory):
    return graph.counts_by_type(memory(spark, directory))


@query
def relation_stats(spark, directory):
    return graph.counts_by_relation(memory(spark, directory))


@query
def totals(spark, directory):
    return graph.totals(memory(spark, directory))


@query
def read_graph(spark, directory):
    return graph.named_edges(memory(spark, directory)).select("id", "from_name", "relation_type", "to_name", "confidence")


@query
def list_entities(spark, directory):
    return memory(spark, directory).entities.select("id", "name", "entity_type", F.size("observations").alias("observations"))


def _shown(spark, directory):
    return table(spark, directory, "search_results").select(F.explode("entities").alias("name")).filter("name <> ''").distinct()


@query
def open_nodes(spark, directory):
    nodes, _ = graph.open_nodes(memory(spark, directory), _shown(spark, directory))
    return nodes.select("id", "name", "entity_type")


@query
def open_nodes_edges(spark, directory):
    _, edges = graph.open_nodes(memory(spark, directory), _shown(spark, directory))
    return edges.select("id", "source_entity", "relation_type", "target_entity")


@query
def one_hop_connected(spark, directory):
    return graph.one_hop(memory(spark, directory))


@query
def relation_touches(spark, directory):
    """Relationships that touch each entity: an OR over the ends as an equi-join."""
    m = memory(spark, directory)
    touching = graph.both_ways(m.relationships).filter("a <> b").unionByName(
        m.relationships.filter("source_entity = target_entity").select(F.col("source_entity").alias("a"), F.col("target_entity").alias("b"), "relation_type")
    )
    per = touching.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    return m.entities.select("id").join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def _seed(m):
    """Entities named in most relationships are hubs; the walk starts at the first person stored."""
    return m.entities.filter("upper(entity_type) = 'PERSON'").agg(F.min_by("id", "entity_no").alias("id"))


@query
def neighbors_depth3(spark, directory):
    m = memory(spark, directory)
    nodes, _ = graph.neighbours(m, _seed(m), 3)
    return nodes


@query
def neighbors_edges_depth2(spark, directory):
    m = memory(spark, directory)
    _, edges = graph.neighbours(m, _seed(m), 2)
    return edges.select("id", "depth")


@query
def neighbors_by_type(spark, directory):
    m = memory(spark, directory)
    nodes, _ = graph.neighbours(m, _seed(m), 4, "USES")
    return nodes


@query
def shortest_paths(spark, directory):
    m = memory(spark, directory)
    return graph.shortest_paths(m, _seed(m), 2).select("id", "depth", F.array_join("path", ">").alias("path"))


def _simple(spark, directory):
    m = memory(spark, directory)
    return m, analytics.simple_edges(m)


@query
def simple_edges(spark, directory):
    return _simple(spark, directory)[1]


@query
def degree_centrality(spark, directory):
    out = analytics.degree_centrality(*_simple(spark, directory))
    return out.select("id", "name", F.round("score", 8).alias("score"))


@query
def pagerank(spark, directory):
    out = analytics.pagerank(*_simple(spark, directory))
    return out.select("id", "name", F.round("score", 10).alias("score"))


@query
def connected_components(spark, directory):
    from quillon.operators.components import components

    m, edges = _simple(spark, directory)
    found = components(edges, "lo", "hi").withColumnRenamed("node", "id")
    return m.entities.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query
def component_sizes(spark, directory):
    return analytics.component_sizes(*_simple(spark, directory))


@query
def clustering(spark, directory):
    return analytics.clustering(_simple(spark, directory)[1]).select("id", F.round("score", 8).alias("score"))


@query
def degree_distribution(spark, directory):
    return analytics.degrees(*_simple(spark, directory)).groupBy("degree").agg(F.count("*").alias("n"))


@query
def relation_histogram(spark, directory):
    """Types of the surviving simple edges; a missing type is UNKNOWN."""
    kind = F.coalesce(F.when(F.col("relation_type") != "", F.col("relation_type")), F.lit("UNKNOWN"))
    return _simple(spark, directory)[1].groupBy(kind.alias("relation_type")).agg(F.count("*").alias("n"))


@query
def structure(spark, directory):
    m, edges = _simple(spark, directory)
    return analytics.structure(m, edges)


@query
def modularity_by_type(spark, directory):
    m, edges = _simple(spark, directory)
    return analytics.modularity(edges, m.entities.select("id", F.col("entity_type").alias("community")))


@query
def communities(spark, directory):
    return analytics.communities(*_simple(spark, directory))


@query
def closeness(spark, directory):
    m, edges = _simple(spark, directory)
    return analytics.closeness(edges, m.entities.select("id")).select("id", F.round("score", 8).alias("score"))


@query
def betweenness(spark, directory):
    m, edges = _simple(spark, directory)
    return analytics.betweenness(m, edges, m.entities.select("id")).select("id", F.round("score", 8).alias("score"))


@query
def top_metrics(spark, directory):
    m, edges = _simple(spark, directory)
    both, everyone, names = None, m.entities.select("id"), m.entities.select("id", "name")
    made = {
        "degree": analytics.degree_centrality(m, edges), "pagerank": analytics.pagerank(m, edges),
        "closeness": analytics.closeness(edges, everyone).join(names, "id"), "betweenness": analytics.betweenness(m, edges, everyone).join(names, "id"),
    }
    for name, df in made.items():
        part = df.select(F.lit(name).alias("metric"), "name", "score")
        both = part if both is None else both.unionByName(part)
    return analytics.top_by_metric(both.withColumn("score", F.round("score", 9)), 10)
