import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import analytics, graph
from quillon.operators.components import components
from quillon.schema import Memory

# loop, reversed duplicate, parallel edge of another type, isolated node, id that begins another
NODES = ["a", "ab", "b", "c", "d", "e", "f", "lone"]
EDGES = [("a", "ab", "X"), ("ab", "a", "X"), ("a", "ab", "Y"), ("ab", "b", "X"), ("b", "c", "X"), ("c", "a", "Y"), ("c", "c", "X"), ("d", "e", "X"), ("e", "f", "X")]


@pytest.fixture(scope="module")
def memory(spark):
    ent = spark.createDataFrame([(n, n.upper(), "T", [], "{}", "2024-01-01", i) for i, n in enumerate(NODES)], "id string, name string, entity_type string, observations array<string>, metadata string, created_at string, entity_no long")
    rel = spark.createDataFrame([(f"r{i}", s, t, k, 1.0, "{}", "2024-01-01", i) for i, (s, t, k) in enumerate(EDGES)], "id string, source_entity string, target_entity string, relation_type string, confidence double, metadata string, created_at string, rel_no long")
    none = spark.createDataFrame([], "id string, content string, metadata string, created_at string, doc_id long")
    return Memory(ent, rel, none, spark.createDataFrame([], "chunk_id string, document_id string"))


def neighbours_of(edges):
    near = {n: set() for n in NODES}
    for s, t, _ in edges:
        if s != t:
            near[s].add(t)
            near[t].add(s)
    return near


def distances(near, start):
    seen, level, d = {start: 0}, [start], 0
    while level:
        d += 1
        level = [n for n in {y for x in level for y in near[x]} if n not in seen]
        seen |= dict.fromkeys(level, d)
    return seen


def test_simple_edges_keep_first_type(memory):
    rows = {(r.lo, r.hi): r.relation_type for r in analytics.simple_edges(memory).collect()}
    assert rows == {("a", "ab"): "X", ("ab", "b"): "X", ("b", "c"): "X", ("a", "c"): "Y", ("d", "e"): "X", ("e", "f"): "X"}


def test_neighbours(spark, memory):
    nodes, edges = graph.neighbours(memory, spark.createDataFrame([("a",)], "id string"), 2)
    assert {r.id: r.depth for r in nodes.collect()} == {"a": 0, "ab": 1, "c": 1, "b": 2}
    assert {r.id for r in edges.collect()} == {"r0", "r1", "r2", "r3", "r4", "r5", "r6"}
    typed, _ = graph.neighbours(memory, spark.createDataFrame([("a",)], "id string"), 9, "Y")
    assert {r.id for r in typed.collect()} == {"a", "ab", "c"}


def test_components(memory):
    found = {r.node: r.component for r in components(analytics.simple_edges(memory), "lo", "hi").collect()}
    assert found == {"a": "a", "ab": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    assert {r.component for r in components(chain, "u", "v").collect()} == {0}
    assert components(chain.limit(0), "u", "v").count() == 0


def test_centralities_against_brute_force(memory):
    edges = analytics.simple_edges(memory)
    near = neighbours_of(EDGES)
    n = len(NODES)
    everyone = memory.entities.select("id")
    close = {r.id: r.score for r in analytics.closeness(edges, everyone).collect()}
    for v in NODES:
        d = distances(near, v)
        assert close[v] == pytest.approx((len(d) - 1) / sum(d.values()) if len(d) > 1 else 0)

    def paths(s, t):
        todo, out, short = [[s]], [], distances(near, s).get(t)
        while todo and short is not None:
            p = todo.pop()
            if len(p) - 1 == short:
                out += [p] if p[-1] == t else []
            else:
                todo += [[*p, y] for y in near[p[-1]] if y not in p]
        return out

    want = dict.fromkeys(NODES, 0.0)
    for s, t in itertools.permutations(NODES, 2):
        found = paths(s, t)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found)
    got = {r.id: r.score for r in analytics.betweenness(memory, edges, everyone).collect()}
    for v in NODES:
        assert got[v] == pytest.approx(want[v] / ((n - 1) * (n - 2)))
    ranks = [r.score for r in analytics.pagerank(memory, edges, rounds=100, tolerance=1e-9).collect()]
    assert sum(ranks) == pytest.approx(1)


def test_a_graph_held_by_tasks_gives_the_same_centralities(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(70)} | {(50, 51), (51, 52), (53, 54)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "lo string, hi string")
    everyone = spark.range(60).select(F.concat(F.lit("n"), "id").alias("id"))
    m = Memory(everyone, None, None, None)
    for f in (lambda h: analytics.closeness(edges, everyone, held=h), lambda h: analytics.betweenness(m, edges, everyone, held=h)):
        held, joined = ({r.id: r.score for r in f(h).collect()} for h in (1000, 0))
        assert len(held) == 60 and max(held.values()) > 0
        assert held == pytest.approx(joined, abs=1e-12)


def test_structure_and_modularity(memory):
    edges = analytics.simple_edges(memory)
    found = {r.measure: r.value for r in analytics.structure(memory, edges).collect()}
    assert (found["nodes"], found["edges"], found["components"], found["largest"], found["isolated"]) == (8, 6, 3, 4, 1)
    assert found["clustering"] == 0 and found["degree_median"] == 2
    parts = analytics.communities(memory, edges)
    row = analytics.modularity(edges, parts.select("id", "community")).first()
    alone = analytics.modularity(edges, memory.entities.select("id", F.col("id").alias("community"))).first()
    assert row.modularity > max(0.3, alone.modularity)
    assert analytics.modularity(edges.limit(0), parts.select("id", "community")).first().modularity == 0
