"""Graph analytics over simple undirected edges: centralities, structure, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import paths
from quillon.operators.components import components
from quillon.operators.graph import bfs
from quillon.schema import Memory, first_by
from quillon.session import discard, materialise


def simple_edges(m: Memory) -> DataFrame:
    """(lo, hi, relation_type): each linked pair once, without loops, with the type of its first edge."""
    ids = m.entities.select("id")
    rows = m.relationships.join(ids.withColumnRenamed("id", "source_entity"), "source_entity", "left_semi").join(ids.withColumnRenamed("id", "target_entity"), "target_entity", "left_semi")
    rows = rows.filter("source_entity <> target_entity").select(F.least("source_entity", "target_entity").alias("lo"), F.greatest("source_entity", "target_entity").alias("hi"), "relation_type", "rel_no")
    pair = rows.withColumn("pair", F.struct("lo", "hi"))
    return first_by(pair.select("pair", "relation_type", "rel_no"), "pair", "rel_no").select("pair.lo", "pair.hi", "relation_type")


def ends(edges: DataFrame) -> DataFrame:
    """(a, b) of simple edges in both directions."""
    return edges.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(edges.select(F.col("hi").alias("a"), F.col("lo").alias("b")))


def degrees(m: Memory, edges: DataFrame) -> DataFrame:
    """(id, name, degree) of every entity, 0 for isolated ones."""
    per = ends(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
    return m.entities.select("id", "name").join(per, "id", "left").select("id", "name", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_centrality(m: Memory, edges: DataFrame) -> DataFrame:
    n = m.entities.count()
    return degrees(m, edges).select("id", "name", (F.col("degree") / F.lit(max(1, n - 1))).alias("score"))


def pagerank(m: Memory, edges: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, name, score): PageRank over undirected edges; the rank of isolated nodes is shared by all.

    Rounds go on until the ranks change less than ``tolerance`` a node in all, at most ``rounds`` times (None: exactly
    ``rounds``). Links and ranks are bucketed by node: a round shuffles only the shares that flow along the links.
    """
    n = m.entities.count()
    links = materialise(ends(edges), "links", by="a")
    degree = links.groupBy("a").agg(F.count("*").alias("d"))
    start = m.entities.select(F.col("id").alias("a"), "name").join(degree, "a", "left").withColumn("r", F.lit(1.0 / max(1, n))).withColumn("moved", F.lit(0.0))
    ranks = materialise(start, "ranks", by="a")
    for _ in range(rounds):
        loose = ranks.filter("d IS NULL").agg(F.coalesce(F.sum("r"), F.lit(0.0))).first()[0]
        given = ranks.filter("d IS NOT NULL").select("a", (F.col("r") / F.col("d")).alias("share"))
        got = links.join(given, "a").groupBy(F.col("b").alias("a")).agg(F.sum("share").alias("got"))
        new = alpha * (F.coalesce("got", F.lit(0.0)) + loose / n) + (1 - alpha) / n
        step = ranks.join(got, "a", "left").select("a", "name", "d", new.alias("r"), F.abs(new - F.col("r")).alias("moved"))
        step = materialise(step, "ranks", by="a")
        discard(ranks)
        ranks = step
        if tolerance is not None and (ranks.agg(F.sum("moved")).first()[0] or 0.0) < n * tolerance:
            break
    discard(links)
    return ranks.select(F.col("a").alias("id"), "name", F.col("r").alias("score"))


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("lo").alias("source_entity"), F.col("hi").alias("target_entity"), F.lit("").alias("relation_type"))


#: Edges of a graph that tasks hold as a whole (16 bytes each); a larger one is searched by joins.
HELD = 4_000_000
#: Most rows (source, node) that one batch of sources may reach; larger sets of sources are searched batch by batch.
REACHED = 200_000_000


def _batches(edges: DataFrame, sources: DataFrame, most: int) -> list[DataFrame]:
    """The sources in batches, by hash, whose searches reach at most about ``most`` rows each."""
    nodes = ends(edges).select("a").distinct().count()
    parts = max(1, -(-sources.count() * nodes // most))
    return [sources.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == p) for p in range(parts)] if parts > 1 else [sources]


def closeness(edges: DataFrame, sources: DataFrame, most: int = REACHED, held: int = HELD) -> DataFrame:
    """(id, score) of the sources (id): reached nodes over the sum of their distances; 0 if nothing is reached."""
    out, edges = None, materialise(edges.select("lo", "hi"), "edges")
    if edges.count() <= held:
        per = paths.reach(edges, sources)
        return materialise(per.select("id", F.when(F.col("s") > 0, F.col("n") / F.col("s")).otherwise(0.0).alias("score")), "closeness")
    for batch in _batches(edges, sources, most):
        found = bfs(_directed(edges), batch, None)
        per = found.groupBy(F.col("seed").alias("id")).agg((F.count("*") - 1).alias("n"), F.sum("depth").alias("s"))
        per = materialise(per.select("id", F.when(F.col("s") > 0, F.col("n") / F.col("s")).otherwise(0.0).alias("score")), "closeness")
        out = per if out is None else out.unionByName(per)
    return out


def betweenness(m: Memory, edges: DataFrame, sources: DataFrame, most: int = REACHED, held: int = HELD) -> DataFrame:
    """(id, score): shortest paths from the sources (id) that run through a node, normalised as for all sources.

    With all entities as sources this is exact; with some it estimates by their share of all. Path counts come
    from a breadth-first search of a batch of sources at once; the shares then flow back level by level. Tasks hold
    a graph of up to ``held`` edges as a whole; the results are the same.
    """
    per, edges = None, materialise(edges.select("lo", "hi"), "edges")
    if edges.count() <= held:
        per = materialise(paths.through(edges, sources), "flows")
    else:
        for batch in _batches(edges, sources, most):
            part = _flows(edges, batch)
            per = part if per is None else per.unionByName(part)
    n, k = m.entities.count(), sources.select("id").distinct().count()
    scale = n / max(1, k) / max(1, (n - 1) * (n - 2))
    per = per.groupBy("id").agg(F.sum("s").alias("s"))
    return m.entities.select("id").join(per, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) * scale).alias("score"))


def _flows(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, s): what flows through each node from the sources."""
    found = materialise(bfs(_directed(edges), sources, None, paths=True), "found")
    links = ends(edges)
    deepest = found.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    flow = materialise(found.filter(F.col("depth") == deepest).select("seed", "node", "depth", "paths", F.lit(0.0).alias("flow")), "flow")
    total = flow
    for d in range(deepest - 1, 0, -1):
        below = flow.select("seed", F.col("node").alias("b"), ((1 + F.col("flow")) / F.col("paths")).alias("part"))
        back = below.join(links, "b").select("seed", F.col("a").alias("node"), "part").groupBy("seed", "node").agg(F.sum("part").alias("part"))
        here = found.filter(F.col("depth") == d).join(back, ["seed", "node"], "left")
        flow = materialise(here.select("seed", "node", "depth", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("flow")), "flow")
        total = total.unionByName(flow)
    return materialise(total.filter("depth > 0").groupBy(F.col("node").alias("id")).agg(F.sum("flow").alias("s")), "flows")


def top_by_metric(metrics: DataFrame, limit: int = 10) -> DataFrame:
    """(metric, rank, name, score) of the highest scores of each metric; ties by name."""
    order = Window.partitionBy("metric").orderBy(F.desc("score"), "name")
    ranked = metrics.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit).select("metric", "rank", "name", F.round("score", 4).alias("score"))


def component_sizes(m: Memory, edges: DataFrame) -> DataFrame:
    """(component, size, isolated): every component by its smallest id, the largest first; isolated entities are components of one."""
    found = components(edges, "lo", "hi").withColumnRenamed("node", "id")
    per = m.entities.select("id").join(found, "id", "left").groupBy(F.coalesce("component", "id").alias("component")).agg(F.count("*").alias("size"), F.first(F.col("component").isNull()).alias("isolated"))
    return per.orderBy(F.desc("size"), "component")


def structure(m: Memory, edges: DataFrame) -> DataFrame:
    """(measure, value): nodes, edges, density, degrees (median: the upper one), components, isolated, clustering."""
    d = degrees(m, edges)
    n, e = m.entities.count(), edges.count()
    middle = d.groupBy("degree").agg(F.count("*").alias("k")).toPandas().sort_values("degree")
    upper = middle["degree"].iloc[int((middle["k"].cumsum() > n // 2).to_numpy().argmax())] if len(middle) else 0
    parts = components(edges, "lo", "hi").groupBy("component").count().agg(F.count("*"), F.max("count"), F.sum("count")).first()
    linked = parts[2] or 0
    per = clustering(edges)
    mean = per.agg(F.avg("score")).first()[0] or 0.0
    low, high, avg = d.agg(F.min("degree"), F.max("degree"), F.round(F.avg("degree"), 2)).first()
    rows = [
        ("nodes", float(n)), ("edges", float(e)), ("density", round(2 * e / (n * (n - 1)), 4) if n > 1 else 0.0), ("degree_min", float(low or 0)), ("degree_max", float(high or 0)),
        ("degree_avg", float(avg or 0)), ("degree_median", float(upper)), ("components", float((parts[0] or 0) + n - linked)), ("largest", float(max(parts[1] or 0, min(1, n)))),
        ("isolated", float(n - linked)), ("clustering", round(mean, 4)),
    ]
    return m.entities.sparkSession.createDataFrame(rows, "measure string, value double")


def clustering(edges: DataFrame) -> DataFrame:
    """(id, score) of nodes with at least two neighbours: linked pairs of neighbours over all pairs.

    Triangles are listed once, from the end of lower degree, so that hubs don't pair their neighbours.
    """
    degree = ends(edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("d"))
    da, db = (degree.select(F.col("id").alias(c), F.col("d").alias(f"d{c}")) for c in ("lo", "hi"))
    ranked = edges.join(da, "lo").join(db, "hi")
    first = F.struct("dlo", "lo") < F.struct("dhi", "hi")
    out = materialise(ranked.select(F.when(first, F.col("lo")).otherwise(F.col("hi")).alias("u"), F.when(first, F.col("hi")).otherwise(F.col("lo")).alias("v")), "oriented")
    wedges = out.alias("x").join(out.alias("y"), F.col("x.u") == F.col("y.u")).filter("x.v < y.v").select(F.col("x.u").alias("u"), F.col("x.v").alias("lo"), F.col("y.v").alias("hi"))
    closed = wedges.join(edges.select("lo", "hi"), ["lo", "hi"], "left_semi")
    corners = closed.select(F.explode(F.array("u", "lo", "hi")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    pairs = F.col("d") * (F.col("d") - 1) / 2
    return degree.filter("d >= 2").join(corners, "id", "left").select("id", (F.coalesce("t", F.lit(0)) / pairs).alias("score"))


def modularity(edges: DataFrame, groups: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity, cross_edges, communities) of a partition (id, community); 0 without edges."""
    a, b = (groups.select(F.col("id").alias(c), F.col("community").alias(f"c{c}")) for c in ("lo", "hi"))
    placed = edges.join(a, "lo").join(b, "hi")
    inside = placed.filter("clo = chi").groupBy(F.col("clo").alias("c")).agg(F.count("*").alias("l"))
    degree = placed.select(F.explode(F.array("clo", "chi")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    total = edges.agg(F.count("*").alias("m"))
    terms = degree.join(inside, "c", "left").crossJoin(F.broadcast(total))  # one row
    q = terms.agg(F.coalesce(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - resolution * F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))), F.lit(0.0)).alias("modularity"))
    crossing = placed.filter("clo <> chi").agg(F.count("*").alias("cross_edges"))
    many = groups.agg(F.countDistinct("community").alias("communities"))
    return q.crossJoin(F.broadcast(crossing)).crossJoin(F.broadcast(many)).select(F.round("modularity", 4).alias("modularity"), "cross_edges", "communities")


def communities(m: Memory, edges: DataFrame, resolution: float = 1.0, levels: int = 4, rounds: int = 8) -> DataFrame:
    """(id, community): Louvain by rounds in which every node may move to the neighbouring community of highest gain.

    All nodes look at the same state; to keep two from swapping places, a round moves only the nodes of one half
    (by hash). The communities of a level are the nodes of the next. Isolated nodes stay alone; ties go to the
    smaller community. A level ends when both halves stay, or after ``rounds``; there are at most ``levels``.
    """
    total = float(edges.count())
    member = m.entities.select("id", F.col("id").alias("node"))
    graph = materialise(ends(edges).select("a", "b", F.lit(1.0).alias("w")), "graph")
    for level in range(levels if total else 0):
        weight = materialise(graph.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k")), "weight")
        place = materialise(weight.select("node", "k", F.col("node").alias("c")), "place")
        moved_any = False
        for r in range(rounds):
            held = place.groupBy("c").agg(F.sum("k").alias("held"))
            to = graph.filter("a <> b").join(place.select(F.col("node").alias("b"), "c"), "b").groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("w"))
            options = to.join(place.select("node", "k", F.col("c").alias("own")), "node").join(held, "c")
            stay = place.select("node", "c", F.lit(0.0).alias("w"), "k", F.col("c").alias("own")).join(held, "c")
            every = options.select("node", "c", "w", "k", "own", "held").unionByName(stay.select("node", "c", "w", "k", "own", "held"))
            every = every.groupBy("node", "c", "k", "own", "held").agg(F.sum("w").alias("w"))
            others = F.col("held") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
            gain = F.round(F.col("w") - resolution * F.col("k") * others / (2 * total), 9)
            best = every.withColumn("gain", gain).groupBy("node").agg(F.min_by("c", F.struct(-F.col("gain"), F.col("c") != F.col("own"), "c")).alias("new"))
            half = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(2)) == r % 2
            step = place.join(best, "node", "left").withColumn("next", F.when(half, F.coalesce("new", "c")).otherwise(F.col("c")))
            step = materialise(step.select("node", "k", F.col("next").alias("c"), (F.col("next") != F.col("c")).alias("moved")), "place")
            moved = step.filter("moved").count()
            place, moved_any = step.drop("moved"), moved_any or moved > 0
            if not moved and r % 2:
                break
        member = materialise(member.join(place.select("node", "c"), "node", "left").select("id", F.coalesce("c", "node").alias("node")), "member")
        if not moved_any:
            break
        a, b = (place.select(F.col("node").alias(x), F.col("c").alias(f"c{x}")) for x in ("a", "b"))
        graph = materialise(graph.join(a, "a").join(b, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "graph")
    size = member.groupBy("node").agg(F.count("*").alias("size"))
    return member.join(size, "node").select("id", F.col("node").alias("community"), "size")
