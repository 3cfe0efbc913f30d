"""Shortest paths from many sources at once, over a graph that fits a task: searches of a batch of sources share each step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values (nodes and links by sources, 8 bytes each) that a batch of sources may hold, and most sources or words of bits of a batch.
VALUES, SOURCES, WORDS = 1 << 22, 32, 8


class Links:
    """Links of a graph both ways, nodes numbered in the order of their keys."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.keys = np.unique(np.r_[a, b])
        start, end = np.searchsorted(self.keys, np.r_[a, b]), np.searchsorted(self.keys, np.r_[b, a])
        self.to = end[np.argsort(start, kind="stable")].astype(np.int32)
        self.at = np.r_[0, np.cumsum(np.bincount(start, minlength=len(self.keys)))]
        self.size = len(self.keys) + len(self.to)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of nodes, -1 for those without links."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return np.where(self.keys[place] == keys, place, -1) if len(self.keys) else np.full(len(keys), -1)

    def step(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that those given link to, the links' starts (places in ``nodes``) in the order of their ends, and where each end's links begin."""
        times = self.at[nodes + 1] - self.at[nodes]
        who = np.repeat(np.arange(len(nodes)), times)
        end = self.to[np.repeat(self.at[nodes] - np.cumsum(times) + times, times) + np.arange(len(who))]
        order = np.argsort(end, kind="stable")
        end = end[order]
        first = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        return end[first], who[order], first


def distances(links: Links, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many nodes each source reaches, and the sum of their distances; a bit a source, 64 sources a word."""
    n, words = len(links.keys), -(-len(sources) // 64)
    many, far = np.zeros(64 * words, np.int64), np.zeros(64 * words, np.int64)
    seen = np.zeros((n, words), np.uint64)
    place = np.arange(len(sources))
    np.bitwise_or.at(seen, (sources, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    nodes, d = np.unique(sources), 0
    front = seen[nodes]
    while len(nodes):
        d += 1
        rows, who, first = links.step(nodes)
        new = np.bitwise_or.reduceat(front[who], first, axis=0) & ~seen[rows]
        some = new.any(axis=1)
        nodes, front = rows[some], new[some]
        seen[nodes] |= front
        for at in range(0, len(front), 4096):
            got = np.unpackbits(front[at : at + 4096].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            many += got
            far += d * got
    return many[: len(sources)], far[: len(sources)]


def flows(links: Links, sources: np.ndarray) -> np.ndarray:
    """What flows through each node on the shortest paths from the sources, the ends left out.

    A pair of a source and a node is a cell of its own; the links of a level on shortest paths are kept for the way back.
    """
    n, k = len(links.keys), len(sources)
    front = np.arange(k) * n + sources
    fresh, paths, flow = np.ones(n * k, bool), np.zeros(n * k), np.zeros(n * k)
    fresh[front], paths[front] = False, 1
    levels = []
    while len(front):
        node = front % n
        times = links.at[node + 1] - links.at[node]
        ends = np.cumsum(times)
        to = links.to[np.repeat(links.at[node] - ends + times, times) + np.arange(ends[-1])] + np.repeat(front - node, times)
        new = fresh[to]
        to, come = to[new], np.repeat(front, times)[new]
        got = np.bincount(to, paths[come], n * k)
        front = np.flatnonzero(got)
        paths[front], fresh[front] = got[front], False
        levels.append((come, to))
    for come, to in levels[:0:-1]:  # the sources themselves are no inner nodes
        if len(to):
            flow += np.bincount(come, (1 + flow[to]) / paths[to], n * k) * paths
    return flow.reshape(k, n).sum(axis=0)


def links_of(edges: DataFrame, sources: DataFrame) -> tuple[Links, int]:
    """The links of edges (lo, hi) by 64-bit keys of the ids, and the seed that keeps the keys of all ids apart."""
    ids, seed = edges.select(F.explode(F.array("lo", "hi")).alias("id")).unionByName(sources.select("id")).distinct(), 42
    while ids.groupBy(F.xxhash64(F.lit(seed), "id")).count().filter("count > 1").limit(1).count():
        seed += 1
    once = edges.filter("lo <> hi").select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct()
    pairs = once.select(F.xxhash64(F.lit(seed), "lo").alias("a"), F.xxhash64(F.lit(seed), "hi").alias("b")).toArrow()
    return Links(pairs.column("a").to_numpy(), pairs.column("b").to_numpy()), seed


def _dealt(sources: DataFrame, seed: int) -> DataFrame:
    """(id, key) of the sources, in four parts a core."""
    parts = 4 * sources.sparkSession.sparkContext.defaultParallelism
    return sources.select("id", F.xxhash64(F.lit(seed), "id").alias("key")).distinct().repartition(parts, "key")


def reach(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, n, s) of each source (id): the nodes it reaches, and the sum of their distances."""
    links, seed = links_of(edges, sources)
    shared = edges.sparkSession.sparkContext.broadcast(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        step = 64 * max(1, min(WORDS, VALUES // max(1, g.size)))
        for batch in batches:
            own = g.find(batch.column(1).to_numpy())
            n, s = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            held = np.flatnonzero(own >= 0)
            for at in range(0, len(held), step):
                part = held[at : at + step]
                n[part], s[part] = distances(g, own[part])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(s)], names=["id", "n", "s"])

    return _dealt(sources, seed).mapInArrow(run, "id string, n long, s long")


def through(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, s) of each node of the edges: what flows through it on the shortest paths from the sources (id)."""
    links, seed = links_of(edges, sources)
    shared = edges.sparkSession.sparkContext.broadcast(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        step, total = max(1, min(SOURCES, VALUES // max(1, g.size))), np.zeros(len(g.keys))
        for batch in batches:
            own = g.find(batch.column(1).to_numpy())
            own = own[own >= 0]
            for at in range(0, len(own), step):
                total += flows(g, own[at : at + step])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g.keys[some]), pa.array(total[some])], names=["key", "s"])

    got = _dealt(sources, seed).mapInArrow(run, "key long, s double").groupBy("key").agg(F.sum("s").alias("s"))
    ids = edges.select(F.explode(F.array("lo", "hi")).alias("id")).distinct().withColumn("key", F.xxhash64(F.lit(seed), "id"))
    return ids.join(got, "key").select("id", "s")
