"""Problem 5: items that appear together, by heavy-light decomposition."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise

#: Rows whose heavy items form one bit matrix, and light pairs or probes held at once in a task.
BLOCK_ROWS = 65536
BLOCK_PAIRS = 1 << 20
#: Items of a list that are paired in one row; a longer list is cut into blocks of so many, and each two of them are a row.
LIST_ITEMS = 1024
#: Bits of the table of the items that are frequent enough, which is broadcast: 1 MB whatever the number of items.
KEPT_BITS = 1 << 23


def heavy_pairs(rows: np.ndarray, items: np.ndarray, n_rows: int, n_items: int) -> np.ndarray:
    """Rows shared by each two heavy items: popcounts over a bit matrix of items x rows."""
    bits = np.zeros((n_items, -(-n_rows // 64) * 64), dtype=np.uint8)
    bits[items, rows] = 1
    words = np.packbits(bits, axis=1).view(np.uint64)
    out = np.zeros((n_items, n_items), dtype=np.int64)
    for i in np.flatnonzero(words.any(axis=1)):
        out[i, i + 1 :] = np.bitwise_count(words[i + 1 :] & words[i]).sum(axis=1, dtype=np.int64)
    return out


def mixed_pairs(heavy_rows: np.ndarray, heavy: np.ndarray, rows: np.ndarray, items: np.ndarray, n_rows: int, n_items: int) -> Iterator[tuple]:
    """(light item, heavy item, rows): each light item's list of rows probes the rows' heavy bits."""
    bits = np.zeros((n_rows, n_items), dtype=np.uint8)
    bits[heavy_rows, heavy] = 1
    order = np.argsort(items, kind="stable")
    rows, items = rows[order], items[order]
    step = max(1, 16 * BLOCK_PAIRS // max(1, n_items))
    for at in range(0, len(rows), step):
        part = items[at : at + step]
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        counts = np.add.reduceat(bits[rows[at : at + step]], starts, axis=0, dtype=np.int64)
        i, j = np.nonzero(counts)
        yield part[starts][i], j, counts[i, j]


def light_pairs(lengths: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of light items of each row, in blocks; ``items`` holds the rows' lists one after another."""
    starts = np.cumsum(lengths) - lengths
    for m in np.unique(lengths[lengths > 1]):
        at = starts[lengths == m]
        for first in range(m - 1):
            width = m - 1 - first
            step = max(1, BLOCK_PAIRS // width)
            for k in range(0, len(at), step):
                base = at[k : k + step, None]
                for w in range(0, width, BLOCK_PAIRS):
                    other = base + np.arange(first + 1 + w, min(m, first + 1 + w + BLOCK_PAIRS))
                    yield np.repeat(items[base[:, 0] + first], other.shape[1]), items[other.ravel()]


class Tally:
    """Counts of pairs of 64-bit ids; compacted whenever enough new ones came in."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((np.minimum(a, b), np.maximum(a, b), n))
        self.size += len(a)

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        a, b, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        out = (a[starts], b[starts], np.add.reduceat(n, starts) if len(a) else n)
        self.parts, self.size = [out], 0
        return out


def cross_pairs(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of an item of one block and one of another, in parts."""
    step = max(1, BLOCK_PAIRS // max(1, len(right)))
    for at in range(0, len(left), step):
        part = left[at : at + step]
        yield np.repeat(part, len(right)), np.tile(right, len(part))


def pair_counter(heavy: np.ndarray, kept: np.ndarray | None = None):
    """A mapInArrow function: rows (ids, others) of item ids to partial counts of pairs.

    Pairs are those within ``ids``, or, where ``others`` isn't null, of one of either. Items whose bit in ``kept`` isn't
    set are left out before.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_ab", pa.int64())])

    def out(a, b, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    def fine(items: np.ndarray) -> np.ndarray:
        if kept is None:
            return np.ones(len(items), bool)
        cell = items & (8 * len(kept) - 1)
        return (kept[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)

    def full(tally: Tally) -> Iterator[pa.RecordBatch]:
        """Compacts a tally that grew; hands its counts on if that doesn't help."""
        if tally.size > 4 * BLOCK_PAIRS:
            a, b, n = tally.compact()
            if len(a) > 2 * BLOCK_PAIRS:
                tally.parts, tally.size = [], 0
                yield out(a, b, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, tally = np.zeros((len(heavy), len(heavy)), dtype=np.int64), Tally()
        for batch in batches:
            crossed = pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(crossed).tolist():
                left, right = (batch.column(c)[i].values.to_numpy() for c in (0, 1))
                for a, b in cross_pairs(left[fine(left)], right[fine(right)]):
                    tally.add(a, b, np.ones(len(a), np.int64))
                    yield from full(tally)
            batch = batch.filter(pa.array(~crossed))
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                lists = batch.column(0).slice(at, BLOCK_ROWS)
                items = lists.flatten().to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                use = fine(items)
                items, rows = items[use], rows[use]
                place = np.minimum(np.searchsorted(heavy, items), max(0, len(heavy) - 1))
                is_heavy = heavy[place] == items if len(heavy) else np.zeros(len(items), bool)
                light_rows, light = rows[~is_heavy], items[~is_heavy]
                if len(heavy):
                    dense += heavy_pairs(rows[is_heavy], place[is_heavy], len(lists), len(heavy))
                    for l, h, n in mixed_pairs(rows[is_heavy], place[is_heavy], light_rows, light, len(lists), len(heavy)):
                        tally.add(l, heavy[h], n)
                        yield from full(tally)
                for a, b in light_pairs(np.bincount(light_rows, minlength=len(lists)), light):
                    tally.add(a, b, np.ones(len(a), np.int64))
                    yield from full(tally)
        i, j = np.nonzero(dense)
        yield out(np.minimum(heavy[i], heavy[j]), np.maximum(heavy[i], heavy[j]), dense[i, j])
        yield out(*tally.compact())

    return count


def pairs_together(
    df: DataFrame, key: str, items: str, min_count: int = 1, min_lift: float = 0.0, heavy_items: int = 256, seed: int = 42, list_items: int = LIST_ITEMS
) -> DataFrame:
    """How many records show both of two items, and how much more often than chance.

    Returns (name_a, name_b, n_ab, n_a, n_b, n, lift) with name_a < name_b by code points, for pairs with
    n_ab >= ``min_count`` and lift = n_ab * n / (n_a * n_b) >= ``min_lift``. The ``heavy_items`` most frequent
    items are counted in dense bit matrices, pairs of two others by hash, and mixed pairs by probing the heavy
    bits with the other item's list of rows; the partial counts of all three are united. Items in fewer than ``min_count``
    records form no pairs (they are told by a bit table; those that share a bit with others go at the end). A list of more
    than ``list_items`` items is cut into blocks, and each two blocks are a row of their own.

    A record is a value of ``key``: repeated rows of a key count once, rows without a key are skipped. Null and
    empty items are ignored and an item counts once a record; records with a null or empty list count in n.
    Ties in frequency at the heavy border change only where a pair is counted. An empty table gives no rows.
    """
    spark = df.sparkSession
    names = F.array_distinct(F.filter(F.col(items), lambda x: x.isNotNull() & (x != "")))
    records = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.first(names, ignorenulls=True).alias("_names"))
    records = materialise(records.select(F.coalesce("_names", F.array().cast("array<string>")).alias("_names")), "records")
    named = records.select(F.explode("_names").alias("name")).groupBy("name").agg(F.count("*").alias("n_x"))
    named = materialise(named.filter(F.col("n_x") >= min_count), "names")
    while named.groupBy(F.xxhash64(F.lit(seed), "name")).count().filter("count > 1").limit(1).count():
        seed += 1  # two names share an id: take other ids
    named = named.withColumn("id", F.xxhash64(F.lit(seed), "name"))
    top = named.orderBy(F.desc("n_x"), "name").limit(heavy_items).select("id").collect()
    heavy = np.sort(np.array([r[0] for r in top], dtype=np.int64))
    n = records.count()
    kept = None
    if min_count > 1:
        cells = named.select(F.col("id").bitwiseAND(KEPT_BITS - 1).cast("int").alias("c")).distinct()
        bytes_of = cells.groupBy(F.shiftright("c", 3).alias("at")).agg(F.sum(F.expr("shiftleft(1, c & 7)")).cast("int").alias("bits")).toArrow()
        kept = np.zeros(KEPT_BITS // 8, dtype=np.uint8)
        kept[bytes_of.column("at").to_numpy()] = bytes_of.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(kept)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_names") - 1) / list_items).cast("int")), lambda i: F.transform(F.slice("_names", i * list_items + 1, F.lit(list_items)), lambda x: F.xxhash64(F.lit(seed), x)))
    none = F.lit(None).cast("array<bigint>")
    some = records.filter(F.size("_names") > 1)
    short = some.filter(F.size("_names") <= list_items).select(F.transform("_names", lambda x: F.xxhash64(F.lit(seed), x)).alias("ids"), none.alias("others"))
    long = some.filter(F.size("_names") > list_items).select(F.posexplode(blocks).alias("i", "ids"), blocks.alias("all"))
    pieces = long.select("ids", F.explode(F.concat(F.array(none), F.slice("all", F.col("i") + 2, F.size("all")))).alias("others"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = short.unionByName(pieces.repartition(parts, F.xxhash64("ids", "others")))

    def counted(batches):
        yield from pair_counter(heavy, shared.value)(batches)

    counts = ids.mapInArrow(counted, "a long, b long, n_ab long").groupBy("a", "b").agg(F.sum("n_ab").alias("n_ab"))
    pairs = counts.filter(F.col("n_ab") >= min_count)
    side = [named.select(F.col("id").alias(x), F.col("name").alias(f"_{x}"), F.col("n_x").alias(f"_n_{x}")) for x in "ab"]
    joined = pairs.join(side[0], "a").join(side[1], "b")
    swap = F.col("_a") > F.col("_b")
    out = joined.select(
        F.least("_a", "_b").alias("name_a"),
        F.greatest("_a", "_b").alias("name_b"),
        "n_ab",
        F.when(swap, F.col("_n_b")).otherwise(F.col("_n_a")).alias("n_a"),
        F.when(swap, F.col("_n_a")).otherwise(F.col("_n_b")).alias("n_b"),
        F.lit(n).cast("long").alias("n"),
    )
    out = out.withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
    if not min_lift:
        return out
    # products of counts of billions of records don't fit 64 bits
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    return out.filter(wide("n_ab") * wide("n") >= F.lit(Decimal(str(min_lift))).cast("decimal(9,6)") * (wide("n_a") * wide("n_b")).cast("decimal(28,0)"))
