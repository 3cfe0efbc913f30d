"""Hybrid scoring: reciprocal ranks, graph boosts and the final score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.vector import similarity

RRF, CAP, DECAY = 60, 0.4, 0.5
# Boosts of an entity of a result.
MATCHED, TERM, CONTAINED, WORD, CONNECTED = 0.3, 0.3, 0.2, 0.15, 0.15
# Words that mark an important sentence.
WEIGHTY = ["important", "key", "main", "primary", "essential", "critical", "significant"]
BASE = {"entity": 0.15, "relationship": 0.25}


def lexical_boost(rank: Column) -> Column:
    return 1 / (RRF + rank)


def entity_score(name: Column, query: Column, query_terms: Column, matched: Column, connected: Column) -> Column:
    """Boost of one entity name for a query, by the first rule that holds, more if it is one edge from a matched entity."""
    low, ask = F.lower(name), F.lower(query)
    asked = F.transform(query_terms, F.lower)
    words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) >= 3)
    own = (
        F.when(F.array_contains(matched, name), MATCHED)
        .when(F.array_contains(asked, low), TERM)
        .when(F.contains(ask, low) | F.contains(low, ask), CONTAINED)
        .when(F.exists(words, lambda w: F.contains(ask, w)), WORD)
        .otherwise(0.0)
    )
    return own + F.when(F.array_contains(connected, name), CONNECTED).otherwise(0.0)


def decayed(scores: Column) -> Column:
    """Sum of the positive scores, the largest first, each weighing half of the one before; at most 0.4."""
    order = F.array_sort(F.filter(scores, lambda s: s > 0), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    weighed = F.transform(order, lambda s, i: s * F.pow(F.lit(DECAY), i))
    return F.least(F.lit(CAP), F.aggregate(weighed, F.lit(0.0), lambda a, s: a + s))


def graph_boost(chunk_type: Column, scores: Column) -> Column:
    base = F.when(chunk_type == "entity", BASE["entity"]).when(chunk_type == "relationship", BASE["relationship"]).otherwise(0.0)
    return base + decayed(scores)


def pool(near: DataFrame, lexical: DataFrame, query: str) -> DataFrame:
    """Candidates (query, chunk_id, distance, rank) of either leg; those without a vector have distance 2."""
    a = near.select(query, "chunk_id", "distance")
    b = lexical.select(query, "chunk_id", F.col("rank").alias("fts_rank"))
    return a.join(b, [query, "chunk_id"], "full_outer").select(query, "chunk_id", F.coalesce("distance", F.lit(2.0)).alias("distance"), "fts_rank")


def final_score(candidates: DataFrame, relevance: str | None = None, use_graph: bool = True) -> DataFrame:
    """Adds score: the larger of similarity and relevance, and the boosts (boost, fts_rank)."""
    near = similarity(F.col("distance"))
    own = near if relevance is None else F.greatest(near, F.coalesce(F.col(relevance), F.lit(0.0)))
    boost = F.coalesce("boost", F.lit(0.0)) if use_graph else F.lit(0.0)
    return candidates.withColumn("score", own + boost + F.coalesce(lexical_boost(F.col("fts_rank")), F.lit(0.0)))


def top(candidates: DataFrame, query: str, limit: int = 5) -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def importance(text: Column, names: Column) -> Column:
    """Boost of a sentence: 0.1 an entity name it holds, 0.05 for a number, 0.03 once for a word of weight."""
    low = F.lower(text)
    held = F.size(F.filter(names, lambda n: F.contains(low, F.lower(n))))
    weighty = "|".join(WEIGHTY)
    return 0.1 * held + F.when(text.rlike(r"(?<![0-9A-Za-z_])[0-9]+"), 0.05).otherwise(0.0) + F.when(low.rlike(weighty), 0.03).otherwise(0.0)


def summary(sentences: Column, scores: Column, most: int = 2) -> Column:
    """struct(text, highlight, score): the best sentences, no two of them neighbours, in their own order; the best one, and its score."""
    order = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    start = F.array().cast("array<int>")
    near = lambda acc, i: F.exists(acc, lambda j: F.abs(j - i) <= 1)
    picked = F.aggregate(order, start, lambda acc, x: F.when((F.size(acc) >= most) | near(acc, x["i"]), acc).otherwise(F.concat(acc, F.array(x["i"]))))
    text = F.array_join(F.transform(F.array_sort(picked), lambda i: F.get(sentences, i)), " [...] ")
    best = F.get(sentences, F.get(order, F.lit(0))["i"])
    return F.struct(text.alias("text"), best.alias("highlight"), F.coalesce(F.array_max(scores), F.lit(0.1)).alias("score"))


def start_of(text: Column, most: int = 150, highlight: int = 100) -> Column:
    """struct(text, highlight, score): what stands for a text without sentences, its start, with score 0.1."""
    start = lambda n: F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "...").otherwise(""))
    return F.struct(start(most).alias("text"), start(highlight).alias("highlight"), F.lit(0.1).cast("double").alias("score"))
