"""Problem 9: mixing sources to target shares, by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import salted_rank

#: Tokens of a budget that are left to the exact knapsack.
WINDOW = 32768


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum is the largest within ``budget``: bounded knapsack.

    The reachable sums are bits of one integer; counts are split into powers of two; the choice is read back
    from the sums reachable before each part.
    """
    taken, mask = np.zeros(len(lengths), np.int64), (1 << (budget + 1)) - 1
    reach, trail = 1, []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        part, count = 1, min(count, budget // length)
        while count > 0 and not reach >> budget & 1:
            n = min(part, count)
            trail.append((i, n, n * length, reach))
            reach |= reach << n * length & mask
            count, part = count - n, part * 2
    rest = reach.bit_length() - 1
    for i, n, size, before in reversed(trail):
        if not before >> rest & 1:
            taken[i] += n
            rest -= size
    return taken


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take for a budget: a proportional share of every length, then the exact rest."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.astype(np.int64)
    if budget <= 0:
        return np.zeros(len(lengths), np.int64)
    share = np.floor(counts * (budget / total)).astype(np.int64)
    rest = budget - int((lengths * share).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest > WINDOW and share[i] < counts[i]:
            n = min(int(counts[i] - share[i]), max(0, (rest - WINDOW // 2) // int(lengths[i])), 1 + int(counts[i]) // 8)
            share[i] += n
            rest -= n * int(lengths[i])
    while rest > WINDOW:  # few long documents: take the longest that fit
        open_ = np.flatnonzero((share < counts) & (lengths <= rest))
        if not len(open_):
            break
        i = open_[-1]
        share[i] += 1
        rest -= int(lengths[i])
    return share + knapsack(lengths, counts - share, min(rest, WINDOW))


def budgets(sizes: pd.DataFrame, targets: pd.DataFrame, total: int | None) -> dict[str, int]:
    """Token budget of each source: its share of ``total``, or of the largest total that all sources can reach."""
    held = sizes.assign(t=sizes["tokens"] * sizes["n"]).groupby("source")["t"].sum()
    able = {r.source: int(held.get(r.source, 0)) * max(0, int(r.max_repeats)) for r in targets.itertuples()}
    live = [r for r in targets.itertuples() if able[r.source] > 0 and r.target_share > 0]
    if not live:
        return {}
    weight = sum(r.target_share for r in live)
    most = min(able[r.source] * weight / r.target_share for r in live)
    goal = most if total is None else min(total, most)
    return {r.source: int(goal * r.target_share / weight + 1e-6) for r in live}


CHOICE = "source string, tokens int, passes int, extra long"


def mix(counts: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 42) -> DataFrame:
    """A selection of documents (key, source, tokens) in which each source has its target share of the tokens.

    ``targets`` is (source, target_share, max_repeats), a table of a few rows. Returns (key, source, tokens, times)
    for the documents used; ``times`` never exceeds the source's max_repeats. A source whose budget is larger than
    all its documents is used as a whole as often as that fits; the rest of the budget is met to the token where
    any choice of lengths can, by documents drawn by a seeded hash within each length.

    Only the number of documents of each length and source reaches the driver. Documents without key, source or
    tokens and of sources without a target aren't used; a source without documents leaves its share to the
    others; repeated rows of a key are documents of their own; empty tables give an empty result.
    """
    spark = counts.sparkSession
    goal = targets.filter("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").dropDuplicates(["source"])
    usable = counts.filter("key IS NOT NULL AND source IS NOT NULL AND tokens > 0").select("key", "source", "tokens")
    usable = usable.join(F.broadcast(goal.select("source")), "source", "left_semi")
    sizes = usable.groupBy("source", "tokens").agg(F.count("*").alias("n")).toPandas().sort_values(["source", "tokens"])
    wanted = goal.toPandas()
    repeats = dict(zip(wanted["source"], wanted["max_repeats"], strict=True))
    rows = []
    for source, budget in budgets(sizes, wanted, total).items():
        own = sizes[sizes["source"] == source]
        lengths, n = own["tokens"].to_numpy(np.int64), own["n"].to_numpy(np.int64)
        passes = min(int(repeats[source]), budget // int((lengths * n).sum()))
        rest = budget - passes * int((lengths * n).sum())
        extra = choose(lengths, n, rest) if passes < repeats[source] else np.zeros(len(n), np.int64)
        rows += [(source, int(a), passes, int(b)) for a, b in zip(lengths, extra, strict=True)]
    chosen = F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=["source", "tokens", "passes", "extra"]), CHOICE) if rows else spark.createDataFrame([], CHOICE))
    ranked = salted_rank(usable, ["source", "tokens"], [F.xxhash64(F.lit(seed), "key"), F.col("key")], "_rank")
    times = F.col("passes") + (F.col("_rank") < F.col("extra")).cast("int")
    return ranked.join(chosen, ["source", "tokens"]).select("key", "source", "tokens", times.alias("times")).filter("times > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, share, tokens, documents, most_used) reached by a selection, with every target."""
    per = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count("*").alias("documents"), F.max("times").alias("most_used"))
    total = per.agg(F.sum("tokens").alias("total"))
    out = targets.select("source", "target_share").join(per, "source", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)), 9).alias("share"), zero("tokens"), zero("documents"), zero("most_used"))
