"""Reads of the property graph: joins of edges and nodes, counts, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.schema import Memory
from quillon.session import materialise


def named_edges(m: Memory) -> DataFrame:
    """Edges with the names of both ends; edges with a missing end vanish."""
    a = m.entities.select(F.col("id").alias("source_entity"), F.col("name").alias("from_name"))
    b = m.entities.select(F.col("id").alias("target_entity"), F.col("name").alias("to_name"))
    return m.relationships.join(a, "source_entity").join(b, "target_entity")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, relation_type) in both directions: an OR over the ends becomes an equi-join."""
    there = edges.select(F.col("source_entity").alias("a"), F.col("target_entity").alias("b"), "relation_type")
    back = edges.select(F.col("target_entity").alias("a"), F.col("source_entity").alias("b"), "relation_type")
    return there.unionByName(back)


def counts_by_type(m: Memory) -> DataFrame:
    """Entities of each type, and in all (type null), in one pass."""
    return m.entities.rollup("entity_type").agg(F.count("*").alias("n"))


def counts_by_relation(m: Memory) -> DataFrame:
    return m.relationships.rollup("relation_type").agg(F.count("*").alias("n"))


def totals(m: Memory) -> DataFrame:
    """(what, n): entities, relationships, documents and chunks held."""
    tables = {"entities": m.entities, "relationships": m.relationships, "documents": m.documents, "chunks": m.chunks}
    out = None
    for what, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def open_nodes(m: Memory, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of the given (name), and the edges with both ends among them."""
    nodes = m.entities.join(names.select("name").distinct(), "name", "left_semi")
    ids = nodes.select("id")
    edges = m.relationships.join(ids.withColumnRenamed("id", "source_entity"), "source_entity", "left_semi")
    return nodes, edges.join(ids.withColumnRenamed("id", "target_entity"), "target_entity", "left_semi")


def one_hop(m: Memory) -> DataFrame:
    """(id, connected): names one edge away, each once; a loop gives the entity itself."""
    near = both_ways(m.relationships).select("a", "b").distinct()
    return near.join(m.entities.select(F.col("id").alias("b"), F.col("name").alias("connected")), "b").join(m.entities.select(F.col("id").alias("a")), "a").select(F.col("a").alias("id"), "connected").distinct()


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None, paths: bool = False) -> DataFrame:
    """(seed, node, depth[, paths]) of every node within ``depth`` edges (both ways) of each seed, breadth first.

    Each level joins the frontier with the edges and drops what is already reached, so that a node is expanded
    once a seed. ``paths`` counts the shortest paths. Without ``depth`` the search runs until nothing is new.
    """
    links = materialise(both_ways(edges).select("a", "b").filter("a <> b").distinct(), "links")
    level = materialise(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(1.0).alias("paths")).distinct(), "level")
    reached, d = level, 0
    while depth is None or d < depth:
        d += 1
        step = level.join(links, level["node"] == links["a"]).groupBy("seed", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))
        level = materialise(step.join(reached, ["seed", "node"], "left_anti").select("seed", "node", F.lit(d).alias("depth"), "paths"), "level")
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached if paths else reached.drop("paths")


def neighbours(m: Memory, seeds: DataFrame, depth: int = 1, relation_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, depth) within ``depth`` (1 to 5) hops of any seed (id), and the edges among them."""
    depth = min(5, max(1, depth or 1))
    edges = m.relationships if relation_type is None else m.relationships.filter(F.col("relation_type") == relation_type)
    known = m.entities.select("id")
    edges = edges.join(known.withColumnRenamed("id", "source_entity"), "source_entity", "left_semi").join(known.withColumnRenamed("id", "target_entity"), "target_entity", "left_semi")
    found = bfs(edges, seeds.join(known, "id", "left_semi").select("id"), depth).groupBy("node").agg(F.min("depth").alias("depth"))
    nodes = materialise(found.join(m.entities.select(F.col("id").alias("node"), "name"), "node").select(F.col("node").alias("id"), "name", "depth"), "nodes")
    ends = [nodes.select(F.col("id").alias(e), F.col("depth").alias(f"_{e}")) for e in ("source_entity", "target_entity")]
    among = edges.join(ends[0], "source_entity").join(ends[1], "target_entity")
    return nodes, among.withColumn("depth", F.greatest("_source_entity", "_target_entity")).drop("_source_entity", "_target_entity")


def shortest_paths(m: Memory, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(id, depth, path): one path of ids to each node from the nearest seed, the smallest of equals."""
    links = materialise(both_ways(m.relationships).select("a", "b").filter("a <> b").distinct(), "links")
    level = seeds.select("id", F.lit(0).alias("depth"), F.array("id").alias("path")).distinct()
    reached = level = materialise(level, "level")
    for d in range(1, depth + 1):
        step = level.join(links, level["id"] == links["a"]).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        step = step.join(reached.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path"))
        level = materialise(step.select("id", F.lit(d).alias("depth"), "path"), "level")
        reached = reached.unionByName(level)
    return reached
