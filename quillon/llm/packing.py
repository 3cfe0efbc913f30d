"""Problem 8: filling containers of fixed capacity, with optimal length buckets and token-budget batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import TOKENIZER, salted_rank, token_count
from quillon.session import materialise, spread

#: Buckets of lengths for each capacity, and items of one size that are ranked in one group.
BUCKETS, SALT_ROWS = 32, 100_000


def counted(df: DataFrame, key: str, text: str, extra: tuple[str, ...] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, extra..., tokens) of each key with a text of at least one token, written once."""
    texts = df.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.col(text).alias("_text"), *[F.col(c) for c in extra])
    rows = spread(texts).withColumn("tokens", token_count(tokenizer)("_text")).filter("tokens > 0")
    return materialise(rows.groupBy("key").agg(F.max("tokens").alias("tokens"), *[F.min(c).alias(c) for c in extra]), "tokens")


def boundaries(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` length buckets with the least padding in all, by dynamic programming.

    The padding of a bucket is its bound times its items less their lengths. The best last cut never moves left
    as items are added, so each layer is solved by halving.
    """
    m = len(sizes)
    if m <= buckets:
        return sizes
    items, total = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * sizes)]
    best = sizes * items[1:] - total[1:]
    cuts = []
    for _ in range(1, buckets):
        new, cut = np.empty(m, np.int64), np.zeros(m, np.int64)
        todo = [(0, m - 1, 0, m - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j) + 1)
            before = np.where(i > 0, best[np.maximum(i - 1, 0)], 0)
            cost = before + sizes[j] * (items[j + 1] - items[i]) - (total[j + 1] - total[i])
            k = int(cost.argmin())
            new[j], cut[j] = cost[k], i[k]
            todo += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        best = new
        cuts.append(cut)
    bounds, j = [], m - 1
    for cut in reversed(cuts):
        bounds.append(sizes[j])
        j = int(cut[j]) - 1
        if j < 0:
            break
    if j >= 0:
        bounds.append(sizes[j])
    return np.array(sorted(bounds))


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS, across: bool = True) -> list[tuple[int, int, int, int, int, int]]:
    """Batches for a histogram: rows (size, first rank, items a container, first container, containers, bucket).

    Buckets are filled from the longest: a batch opens with a bucket's longest items and takes the longest that
    still fit the token budget, of its own bucket and, with ``across``, of the shorter ones. One step plans all
    containers that are filled alike.
    """
    bounds = boundaries(sizes, counts, buckets)
    bucket = np.searchsorted(bounds, sizes)
    left, used = counts.astype(np.int64).copy(), np.zeros(len(sizes), np.int64)
    rows, container, top = [], 0, len(sizes) - 1
    while True:
        while top >= 0 and not left[top]:
            top -= 1
        if top < 0:
            return rows
        budget, at, take = capacity, top, []
        floor = 0 if across else int(np.searchsorted(bucket, bucket[top]))
        while at >= floor and budget > 0:
            at = min(at, int(np.searchsorted(sizes, budget, side="right")) - 1)
            while at >= floor and not left[at]:
                at -= 1
            if at < floor:
                break
            n = int(min(left[at], budget // sizes[at]))
            take.append((at, n))
            budget -= n * int(sizes[at])
            at -= 1
        times = int(min(left[i] // n for i, n in take))
        for i, n in take:
            rows.append((int(sizes[i]), int(used[i]), n, container, times, int(bounds[bucket[top]])))
            used[i] += n * times
            left[i] -= n * times
        container += times


def pack(counts: DataFrame, limits: DataFrame, buckets: int = BUCKETS, across: bool = True) -> DataFrame:
    """Containers for items (key, tokens) under each capacity of ``limits`` (pack_name, capacity_tokens).

    Returns (pack_name, container, bucket, key, piece, start_token, tokens): the items of container ``container``,
    never more than its capacity. An item over the capacity is cut into pieces of the capacity and a rest; no
    other is cut. ``bucket`` is the length bucket that the container's longest item belongs to.

    Only the histogram of sizes reaches the driver: at most ``capacity`` rows a pack. Items of equal size are
    alike; which one goes where is decided by the key. Null and non-positive sizes, null keys and limits without
    a name or with a capacity below 1 give no row; repeated rows of a key are items of their own; empty tables
    give an empty result.
    """
    spark = counts.sparkSession
    packs = F.broadcast(limits.filter("pack_name IS NOT NULL AND capacity_tokens > 0").groupBy("pack_name").agg(F.max("capacity_tokens").cast("int").alias("capacity")))
    items = counts.filter("key IS NOT NULL AND tokens > 0").select("key", F.col("tokens").alias("_all")).crossJoin(packs)  # a few capacities
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("_all") - 1) / F.col("capacity")).cast("int"))))
    start = F.col("piece") * F.col("capacity")
    items = items.select("pack_name", "capacity", "key", "piece", start.alias("start_token"), F.least("capacity", F.col("_all") - start).cast("int").alias("tokens"))
    histogram = items.groupBy("pack_name", "capacity", "tokens").agg(F.count("*").alias("n")).toPandas().sort_values("tokens")
    rows = []
    for (name, capacity), own in histogram.groupby(["pack_name", "capacity"]):
        rows += [(name, *r) for r in plan(own["tokens"].to_numpy(np.int64), own["n"].to_numpy(np.int64), int(capacity), buckets, across)]
    frame = pd.DataFrame(rows, columns=["pack_name", "tokens", "first", "each", "base", "containers", "bucket"])
    most = int(histogram["n"].max()) if len(histogram) else 1
    ranked = salted_rank(items, ["pack_name", "tokens"], [F.col("key"), F.col("piece")], "_rank", max(1, -(-most // SALT_ROWS)))
    shared = spark.sparkContext.broadcast(frame.sort_values(["pack_name", "tokens", "first"]).reset_index(drop=True))
    kind = counts.schema["key"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = shared.value
        names = {n: i for i, n in enumerate(steps["pack_name"].unique())}
        kind_of = lambda f: f["pack_name"].map(names).to_numpy(np.int64) * (1 << 32) + f["tokens"].to_numpy(np.int64)
        # one sorted number for (pack, size, first rank): the step of an item is the last that isn't behind it
        at, first = kind_of(steps), steps["first"].to_numpy(np.int64)
        heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
        group, span = np.searchsorted(at[heads], at), most + 1
        keys = group * span + first
        for batch in batches:
            own, rank = kind_of(batch), batch["_rank"].to_numpy(np.int64)
            step = np.searchsorted(keys, np.searchsorted(at[heads], own) * span + rank, side="right") - 1
            met = steps.iloc[step]
            container = met["base"].to_numpy() + (rank - first[step]) // met["each"].to_numpy()
            yield batch.assign(container=container, bucket=met["bucket"].to_numpy())[["pack_name", "container", "bucket", "key", "piece", "start_token", "tokens"]]

    chosen = ranked.select("pack_name", "key", "piece", "start_token", "tokens", "_rank")
    return chosen.mapInPandas(place, f"pack_name string, container long, bucket int, key {kind}, piece int, start_token int, tokens int")


def fill(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(pack_name, capacity, containers, least, tokens, fill): how full the containers are; ``least`` is a bound no packing can beat."""
    packs = F.broadcast(limits.select("pack_name", F.col("capacity_tokens").alias("capacity")))
    sums = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("t")).groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    out = sums.join(packs, "pack_name")
    return out.select("pack_name", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill"))
