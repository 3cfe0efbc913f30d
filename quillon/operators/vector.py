"""Exact nearest neighbours of a stated set of queries, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries up to this many are broadcast; more meet the vectors in blocks that are shuffled.
SENT = 50_000
#: Rows that are gathered before the best of each query are kept of them.
HELD = 500_000


class Best:
    """The ``k`` rows of the smallest values of each query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.worst = k, np.full(queries, np.inf)
        self.rows: list[pd.DataFrame] = []
        self.size = 0

    def add(self, q: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        self.rows.append(pd.DataFrame({"q": q, "id": ids, "value": value}))
        self.size += len(q)
        if self.size > HELD + self.k * len(self.worst):
            self.cut()

    def cut(self) -> pd.DataFrame:
        found = pd.concat(self.rows) if self.rows else pd.DataFrame({"q": [], "id": [], "value": []})
        found = found.assign(r=found["value"].round(9)).sort_values(["q", "r", "id"])
        rank = found.groupby("q").cumcount()
        last = found[rank == self.k - 1]
        self.worst[last["q"].to_numpy(dtype=np.int64)] = last["r"]
        found = found[rank < self.k].drop(columns="r")
        self.rows, self.size = [found], len(found)
        return found


def few(df: DataFrame) -> DataFrame:
    """At most two partitions a core, where each task passes on rows of every query; nothing is shuffled for it."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def _blocks(df: DataFrame, name: str, size: int) -> DataFrame:
    rows = max(1, -(-df.count() // size))
    packed = df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(rows))).groupBy("_b").agg(F.collect_list(F.struct("id", "v")).alias("_l"))
    return packed.select(F.transform("_l", lambda x: x["id"]).alias(f"{name}_ids"), F.flatten(F.transform("_l", lambda x: x["v"])).alias(f"{name}_v"))


def knn(base: DataFrame, queries: DataFrame, k: int, dim: int, block: int = 2048) -> DataFrame:
    """(query, id, distance, rank) of the ``k`` nearest base vectors (id, v) by L2 distance for each query (id, v).

    Every query is held against every base vector, block by block. Up to SENT queries are broadcast, so that vectors stay
    where they are and a task passes on its own ``k`` best of each query. A query is never its own neighbour; ties go to the smaller id; vectors that are null or of another length are left out.
    """
    fine = lambda df: df.filter(F.col("id").isNotNull() & (F.size("v") == dim)).select("id", F.col("v").cast("array<double>").alias("v"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qi, qv, bi, bv in zip(batch["q_ids"], batch["q_v"], batch["b_ids"], batch["b_v"], strict=True):
                q, b = np.asarray(qv).reshape(-1, dim), np.asarray(bv).reshape(-1, dim)
                d = np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * q @ b.T))
                bi, qi = np.asarray(bi), np.asarray(qi)
                d[qi[:, None] == bi[None]] = np.inf
                order = np.argsort(bi, kind="stable")
                near = order[np.argsort(d[:, order].round(9), axis=1, kind="stable")[:, :k]]
                got = np.take_along_axis(d, near, 1)
                use = np.isfinite(got)
                yield pd.DataFrame({"query": np.repeat(qi, near.shape[1])[use.ravel()], "id": bi[near][use], "distance": got[use]})

    def near(q_ids: np.ndarray, q: np.ndarray, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, square = Best(len(q_ids), k), (q * q).sum(1)
        for batch in batches:
            for a in range(0, len(batch), block):
                bi, b = batch["id"].to_numpy()[a : a + block], np.stack(batch["v"].to_numpy()[a : a + block])
                for s in range(0, len(q_ids), block // 2):
                    own = slice(s, s + block // 2)
                    d = np.sqrt(np.maximum(0, square[own][:, None] + (b * b).sum(1)[None] - 2 * q[own] @ b.T))
                    if len(bi) > k:
                        # the k-th but one, as one of them may be the query itself
                        best.worst[own] = np.minimum(best.worst[own], np.partition(d, k, axis=1)[:, k].round(9))
                    r, m = np.nonzero(d <= best.worst[own][:, None] + 1e-9)
                    other = q_ids[own][r] != bi[m]
                    best.add(r[other] + s, bi[m[other]], d[r[other], m[other]])
        found = best.cut()
        if len(found):
            yield pd.DataFrame({"query": q_ids[found["q"].to_numpy(dtype=np.int64)], "id": found["id"], "distance": found["value"]})

    order = Window.partitionBy("query").orderBy(F.round("distance", 9), "id")
    asked = fine(queries).limit(SENT + 1).toPandas()
    if len(asked) <= SENT:
        shared = base.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), np.stack(asked["v"].to_numpy()) if len(asked) else np.zeros((0, dim))))
        best = few(fine(base)).mapInPandas(lambda batches: near(*shared.value, batches), f"query {kind}, id {kind}, distance double")
        return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    pairs = _blocks(fine(queries), "q", block // 2).crossJoin(_blocks(fine(base), "b", block))  # blocks, not rows
    best = pairs.mapInPandas(run, f"query {kind}, id {kind}, distance double")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similarity(distance: Column) -> Column:
    """Similarity of unit vectors by their L2 distance, never below 0."""
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def best_per_key(df: DataFrame, keys: list[str], distance: str) -> DataFrame:
    """The row of the smallest distance of each key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(distance, *[c for c in rest if c != distance])).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
