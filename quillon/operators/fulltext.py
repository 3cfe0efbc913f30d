"""Full-text search: postings with positions and BM25 over quoted terms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators.vector import Best, few
from quillon.session import materialise, spread

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Tables of the terms asked for up to this many rows are broadcast, larger ones joined by a shuffle.
SMALL_ROWS = 1_000_000
#: Queries up to this many are scored chunk by chunk in tasks, so many scores at once.
SCORED, BLOCK = 50_000, 1 << 22


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters without."""
    pairs = []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.category(x) == "Mn" for x in base[1:]):
            pairs.append((chr(c), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower-cased, marks of Latin letters removed."""
    return F.translate(F.regexp_replace(F.lower(text), "[̀-ͯ]", ""), *_accents())


def split(text: Column) -> Column:
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}\x{E000}-\x{F8FF}]+"), lambda t: t != "")


def postings(chunks: DataFrame, with_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """(term, chunk_id, field, pos) of every token, and (chunk_id, length) of every chunk; the id is a field of its own."""
    fields = F.array(split(F.coalesce("text", F.lit(""))), split(F.col("chunk_id")) if with_id else F.array().cast("array<string>"))
    rows = chunks.select("chunk_id", F.posexplode(fields).alias("field", "terms"))
    lengths = rows.groupBy("chunk_id").agg(F.sum(F.size("terms")).alias("length"))
    return rows.select("chunk_id", "field", F.posexplode("terms").alias("pos", "term")), lengths


def phrases(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, phrase, k, term, size): the quoted terms of a query; a term with punctuation is a phrase of tokens."""
    clean = F.filter(F.split(F.regexp_replace(text, r'["*()\-]', " "), r"\s+"), lambda t: t != "")
    each = queries.select(query, F.posexplode(clean).alias("phrase", "word"))
    parts = each.select(query, "phrase", split(F.col("word")).alias("terms")).filter(F.size("terms") > 0)
    return parts.select(query, "phrase", F.size("terms").alias("size"), F.posexplode("terms").alias("k", "term"))


def _scored(chunks: DataFrame, asked: pd.DataFrame, kind: str, query: str, limit: int, with_id: bool) -> DataFrame:
    """``bm25`` for terms ``asked`` (query, phrase, size, k, term) that fit a task."""
    wanted = asked.sort_values("k").groupby([query, "phrase"])["term"].agg(" ".join).reset_index(name="words") if len(asked) else pd.DataFrame({query: [], "words": []})
    word, words = pd.factorize(wanted["words"])
    who, ids = pd.factorize(wanted[query])
    times = pd.DataFrame({"word": word, "who": who}).value_counts(["word", "who"]).reset_index(name="n").sort_values(["word", "who"])
    ends = np.searchsorted(times["word"], np.arange(len(words) + 1))
    starting: dict[str, list[tuple[int, list[str]]]] = {}
    for i, w in enumerate(words):
        parts = w.split(" ")
        starting.setdefault(parts[0], []).append((i, parts))
    context = chunks.sparkSession.sparkContext
    looked = context.broadcast(starting)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = looked.value
        for batch in batches:
            held, often = [], []
            for fields in batch["fields"]:
                found: dict[int, int] = {}
                for tokens in fields:
                    for at, t in enumerate(tokens):
                        for i, parts in known.get(t, ()):
                            if len(parts) == 1 or list(tokens[at : at + len(parts)]) == parts:
                                found[i] = found.get(i, 0) + 1
                held.append(list(found))
                often.append(list(found.values()))
            length = [sum(map(len, fields)) for fields in batch["fields"]]
            yield pd.DataFrame({"chunk_id": batch["chunk_id"], "length": length, "words": held, "f": often})

    fields = F.array(split(F.coalesce("text", F.lit(""))), split(F.col("chunk_id")) if with_id else F.array().cast("array<string>"))
    hits = spread(chunks.select("chunk_id", "text")).select("chunk_id", fields.alias("fields")).mapInPandas(count, "chunk_id string, length int, words array<int>, f array<int>")
    hits = materialise(hits, "hits")
    n, mean = hits.agg(F.count("*"), F.avg("length")).first()
    df = np.zeros(len(words))
    for w, c in hits.select(F.explode("words").alias("w")).groupBy("w").count().toLocalIterator():
        df[w] = c
    idf = np.log((n - df + 0.5) / (df + 0.5)) if n else df
    weights = context.broadcast((np.where(idf <= 0, FLOOR, idf), times["who"].to_numpy(), times["n"].to_numpy(), ends, ids.to_numpy() if hasattr(ids, "to_numpy") else np.asarray(ids)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, who, times, ends, ids = weights.value
        best, block = Best(len(ids), limit), max(16, BLOCK // max(1, len(ids)))
        for batch in batches:
            for a in range(0, len(batch), block):
                part = batch.iloc[a : a + block]
                size = part["words"].map(len).to_numpy()
                if not size.sum():
                    continue
                w, f = (np.concatenate(part[c].to_numpy()).astype(np.int64) for c in ("words", "f"))
                row = np.repeat(np.arange(len(part)), size)
                long = part["length"].to_numpy()[row]
                value = -idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * long / mean))
                many = ends[w + 1] - ends[w]
                at = np.repeat(ends[w], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                total = np.bincount(who[at] * len(part) + np.repeat(row, many), np.repeat(value, many) * times[at], len(ids) * len(part)).reshape(len(ids), -1)
                q, m = np.nonzero((total < 0) & (total <= best.worst[:, None] + 1e-9))
                best.add(q, part["chunk_id"].to_numpy()[m], total[q, m])
        found = best.cut()
        if len(found):
            yield pd.DataFrame({query: ids[found["q"].to_numpy(dtype=np.int64)], "chunk_id": found["id"], "score": found["value"]})

    found = few(hits.filter(F.size("words") > 0)).mapInPandas(score, f"`{query}` {kind}, chunk_id string, score double")
    order = Window.partitionBy(query).orderBy(F.round("score", 9), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def bm25(chunks: DataFrame, queries: DataFrame, query: str, text: str, limit: int = 15, with_id: bool = True, small: int = SMALL_ROWS) -> DataFrame:
    """(query, chunk_id, score, rank) of the ``limit`` chunks with the lowest (best) score of each query.

    Every occurrence of a term in the query counts; a phrase has a document frequency of its own; a term in more
    than half of the chunks weighs 1e-6. Ties go to the smaller chunk id. Terms asked for in at most ``small`` rows are
    broadcast, and up to SCORED queries are scored in the tasks that hold the texts, which pass on their own best of each
    query: neither texts nor pairs of queries and chunks are shuffled. ``chunks`` has a row a chunk.
    """
    asked = phrases(queries, query, text)
    if 0 < small:
        rows = asked.limit(small + 1).toPandas()
        if len(rows) <= small and rows[query].nunique() <= SCORED:
            return _scored(chunks, rows, queries.schema[query].dataType.simpleString(), query, limit, with_id)
    posts, lengths = postings(chunks, with_id)
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    asked = materialise(asked, "asked")
    sent = F.broadcast if asked.count() <= small else lambda df: df
    marks = asked.groupBy(query, "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"]), " ").alias("words"), F.first("size").alias("size"))
    wanted = marks.groupBy(query, "words", "size").agg(F.count("*").alias("times"))
    parts = wanted.select("words", "size").distinct().select("words", "size", F.posexplode(F.split("words", " ")).alias("k", "term"))
    hits = posts.join(sent(parts), "term").groupBy("words", "size", "chunk_id", "field", (F.col("pos") - F.col("k")).alias("start")).agg(F.count("*").alias("met")).filter("met = size")
    freq = hits.groupBy("words", "chunk_id").agg(F.count("*").alias("f"))
    df = freq.groupBy("words").agg(F.count("*").alias("df"))
    weighed = df.crossJoin(F.broadcast(stats)).withColumn("idf", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))  # one row of totals
    weighed = weighed.select("words", "mean", F.when(F.col("idf") <= 0, FLOOR).otherwise(F.col("idf")).alias("idf"))
    scored = freq.join(sent(weighed), "words").join(lengths, "chunk_id")
    part = -F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    total = scored.select("words", "chunk_id", part.alias("part")).join(sent(wanted), "words").groupBy(query, "chunk_id").agg(F.sum(F.col("part") * F.col("times")).alias("score"))
    best = Window.partitionBy(query).orderBy(F.round("score", 9), "chunk_id")
    return total.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
