"""Problem 2: the most similar vectors, by score-aware (anisotropic) quantisation and four-bit table scans.

Unit vectors are assigned to k-means cells; the residual is quantised in two-dimensional subspaces to sixteen
codewords each (four bits), under a loss that weighs the part of the error parallel to the vector more than the
rest, as that part is what changes a large inner product. A query is scored against the codes of the cells it
probes by adding entries of its lookup tables; the best are reranked with the exact vectors. A cell that holds many codes is divided again, inside its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.session import materialise, spread

#: The index is fitted on at most this many vectors; every vector is indexed.
FIT_ROWS = 65536
#: Vectors a cell should hold, and most cells that are fitted on the sample and sent to the tasks.
CELL_ROWS, MAX_CELLS = 256, 4096
#: Codes from which a cell is divided where it is scanned, into so many, and each of these again.
SPLIT_ROWS, FAN = 2048, 64
#: Vectors of an index part (a shuffle partition of the scan).
PART_ROWS = 12288
#: Scores held at once in a scan, and rows encoded at once.
BLOCK, SLICE = 1 << 21, 4096
#: Queries of a part that are held against its cells at once.
ASKS = 8192


@dataclass
class Index:
    """What the tasks need: at most MAX_CELLS centroids and 16 codewords a subspace."""

    centroids: np.ndarray  # cells x dim
    part: np.ndarray  # part of each cell
    books: np.ndarray  # subspaces x 16 x 2
    weight: float  # of the parallel error, over that of the orthogonal
    spread: float  # dimensions that vectors of a cell scatter in
    error: float  # mean length of the error of a code
    split: int  # codes from which a cell is divided

    def reach(self, radius: float) -> float:
        """How far a vector within the radius can be expected to lie along a line, by the distance of the line's ends.

        At most the radius, and hardly more than 3.5 deviations of a step scattered over the dimensions of a cell.
        """
        return min(1.0, 3.5 / max(1.0, self.spread) ** 0.5) * radius

    def decode(self, cell: int, packed: np.ndarray) -> np.ndarray:
        """The vectors that the codes (two a byte) of a cell stand for."""
        codes = np.stack([packed & 15, packed >> 4], axis=2).reshape(len(packed), -1)
        return self.centroids[cell] + self.books[np.arange(codes.shape[1]), codes].reshape(len(packed), -1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.centroids.T, axis=1)

    def encode(self, x: np.ndarray, cell: np.ndarray, sweeps: int = 2) -> np.ndarray:
        return _encode(x, x - self.centroids[cell], self.books, self.weight, sweeps)


def _encode(x: np.ndarray, target: np.ndarray, books: np.ndarray, weight: float, sweeps: int) -> np.ndarray:
    """Codes (rows x subspaces) by coordinate descent on |r|^2 + (weight - 1) <r, x>^2."""
    if len(x) > SLICE:
        return np.concatenate([_encode(x[a : a + SLICE], target[a : a + SLICE], books, weight, sweeps) for a in range(0, len(x), SLICE)])
    n, subs = len(x), len(books)
    xs, ts, words = x.reshape(n, subs, 2), target.reshape(n, subs, 2), books.transpose(0, 2, 1)
    # products with all codewords, once for all sweeps (subspaces x rows x 16); |target|^2 is the same for each
    along = xs.transpose(1, 0, 2) @ words
    apart = (books**2).sum(-1)[:, None, :] - 2 * (ts.transpose(1, 0, 2) @ words)
    codes = np.argmin(apart, axis=2).T.astype(np.uint8)
    row = np.arange(n)
    parallel = (ts * xs).sum((1, 2)) - along[np.arange(subs), row[:, None], codes].sum(1)
    for _ in range(sweeps):
        for s in range(subs):
            away = parallel + along[s, row, codes[:, s]]
            codes[:, s] = np.argmin(apart[s] + (weight - 1) * (away[:, None] - along[s]) ** 2, axis=1)
            parallel = away - along[s, row, codes[:, s]]
    return codes


def _train(x: np.ndarray, target: np.ndarray, weight: float, rounds: int = 4) -> np.ndarray:
    """Codewords: start at quantiles of each subspace's norm and angle, then alternate assignment and least squares."""
    n, subs = len(x), x.shape[1] // 2
    ts = target.reshape(n, subs, 2)
    spread_of = ts.std(axis=0) + 1e-6
    grid = np.array([-1.5, -0.45, 0.45, 1.5], dtype=np.float32)
    books = (np.stack(np.meshgrid(grid, grid), -1).reshape(16, 2)[None] * spread_of[:, None, :]).astype(np.float32)
    xs = x.reshape(n, subs, 2)
    for _ in range(rounds):
        codes = _encode(x, target, books, weight, 1)
        for s in range(subs):
            others = ((ts - books[np.arange(subs), codes]) * xs).sum((1, 2)) + (books[s][codes[:, s]] * xs[:, s]).sum(-1)
            left = np.eye(2) + (weight - 1) * xs[:, s, :, None] * xs[:, s, None, :]
            right = ts[:, s] + (weight - 1) * others[:, None] * xs[:, s]
            for c in range(16):
                own = codes[:, s] == c
                if own.sum() > 2:
                    books[s, c] = np.linalg.solve(left[own].sum(0) + 1e-6 * np.eye(2), right[own].sum(0))
    return books


def fit(sample: np.ndarray, rows: int, threshold: float = 0.2, seed: int = 42) -> Index:
    """Fit cells, parts and codewords on a sample of unit vectors of a collection of ``rows``."""
    rng = np.random.default_rng(seed)
    cells = int(min(len(sample), max(1, min(rows // CELL_ROWS, MAX_CELLS))))
    centroids = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(6):
        near = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids).astype(np.float32)
    near = np.argmax(sample @ centroids.T, axis=1)
    sizes = np.bincount(near, minlength=cells) + 1e-3
    order, todo = [], [(np.arange(cells), max(1, -(-rows // PART_ROWS)))]
    while todo:  # halve the cells along their widest direction until each part has its share
        own, parts = todo.pop()
        if parts == 1 or len(own) == 1:
            order.append(own)
            continue
        centred = centroids[own] - centroids[own].mean(0)
        along = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0])
        cut = int(np.searchsorted(np.cumsum(sizes[own[along]]), sizes[own].sum() * (parts // 2) / parts))
        cut = min(max(cut, 1), len(own) - 1)
        todo += [(own[along[:cut]], parts // 2), (own[along[cut:]], parts - parts // 2)]
    part = np.empty(cells, dtype=np.int32)
    for i, own in enumerate(order):
        part[own] = i
    dim = sample.shape[1]
    weight = float((dim - 1) * threshold**2 / (1 - threshold**2))
    books = _train(sample, sample - centroids[near], max(1.0, weight))
    left = (sample - centroids[near]).astype(np.float64)
    around = left.T @ left
    codes = _encode(sample, sample - centroids[near], books, max(1.0, weight), 2)
    wrong = left.reshape(len(left), -1, 2) - books[np.arange(len(books)), codes]
    error = float(np.sqrt((wrong**2).sum() / len(left)))
    return Index(centroids, part, books, max(1.0, weight), float(np.trace(around) ** 2 / max((around**2).sum(), 1e-12)), error, SPLIT_ROWS)


def _unit(batch: pa.RecordBatch, name: str) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False)
    x = x.reshape(batch.num_rows, -1).astype(np.float64) if batch.num_rows else np.zeros((0, 1))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _whole(index: Index, probes: int | None, radius: float | None) -> bool:
    """Whether a query scans all codes."""
    return radius is None if probes is None else probes >= len(index.centroids)


ROUTED = "part int, query boolean, id long, cells binary, scale float, code binary"


def _route(index: Index, probes: int | None, radius: float | None):
    """mapInArrow: vectors to index rows (cell and code), and to one query row for each part they probe.

    Where every part is scanned, both kinds of rows carry the vector itself, and are reranked in place. With a
    radius and no number of probes, a vector probes every cell that passes the gate.
    """
    cells = len(index.centroids)
    every = _whole(index, probes, radius)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = np.sqrt(np.maximum(0, 2 - 2 * index.centroids @ index.centroids.T)) if radius is not None and not every else None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                yield from one(batch.slice(at, 4096), between)

    def one(batch: pa.RecordBatch, between: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        x, ids = _unit(batch, "vector"), batch.column("id").to_numpy(zero_copy_only=False)
        near = x @ index.centroids.T
        cell = np.argmax(near, axis=1)
        codes = index.encode(x, cell)
        packed = np.ascontiguousarray(codes[:, ::2] | codes[:, 1::2] << 4)
        raw = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(x), -1)
        load = np.concatenate([packed, raw.view(np.uint8)], axis=1) if every else packed
        yield rows(index.part[cell], False, ids, [c.tobytes() for c in cell.astype(np.int32)], np.zeros(len(x)), [c.tobytes() for c in load])
        ask = np.flatnonzero(batch.column("ask").to_numpy(zero_copy_only=False))
        if not len(ask):
            return
        scale = np.abs(x[ask]).max(axis=1) / 127
        small = np.rint(x[ask] / scale[:, None]).astype(np.int8)
        if every:
            parts = index.part.max() + 1
            who, where = np.repeat(np.arange(len(ask)), parts), np.tile(np.arange(parts), len(ask))
            lists = [b""] * len(who)
            yield rows(where, True, ids[ask][who], lists, np.zeros(len(who)), [raw[ask[w]].tobytes() for w in who])
            return
        else:
            if probes is None or probes >= cells:
                top = np.broadcast_to(np.arange(cells), (len(ask), cells))
            else:
                top = np.argpartition(-near[ask], probes - 1, axis=1)[:, :probes]
            use = np.ones(top.shape, dtype=bool)
            if radius is not None:
                # a neighbour within the radius crosses to the cell only if its step along the line of the two centroids is that long
                best = cell[ask]
                gap = near[ask, best][:, None] - np.take_along_axis(near[ask], top, 1)
                use = gap <= index.reach(radius) * np.take_along_axis(between[best], top, 1) + 1e-6
            who, k = np.nonzero(use)
            cell_of = top[who, k].astype(np.int32)
            order = np.lexsort((cell_of, index.part[cell_of], who))
            who, cell_of = who[order], cell_of[order]
            where = index.part[cell_of]
            starts = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (where[1:] != where[:-1])])
            lists = [c.tobytes() for c in np.split(cell_of, starts[1:])]
            who, where = who[starts], where[starts]
        yield rows(where, True, ids[ask][who], lists, scale[who], [small[w].tobytes() for w in who])

    def rows(part, query, ids, lists, scale, code) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(np.full(len(ids), query)), pa.array(ids, pa.int64()), pa.array(lists, pa.binary()), pa.array(scale, pa.float32()), pa.array(code, pa.binary())],
            names=["part", "query", "id", "cells", "scale", "code"],
        )

    return route


def _tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Lookup tables (bytes of a code x queries x 256): scores of each two codewords packed in a byte."""
    n, subs = len(queries), len(books)
    four = np.einsum("qsd,scd->sqc", queries.reshape(n, subs, 2), books)
    value = np.arange(256)
    return np.ascontiguousarray(four[::2][:, :, value & 15] + four[1::2][:, :, value >> 4], dtype=np.float32)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


SCANNED = "q long, id long, score float, distance double"
#: Table entries are added as whole numbers of this fraction.
STEP = 2048


@dataclass
class Node:
    """Codes from ``start`` to ``end``, divided among children by the nearest of ``centroids``."""

    start: int
    end: int
    centroids: np.ndarray | None = None
    children: list[Node] | None = None


def _divide(index: Index, cell: int, codes: np.ndarray, ids: np.ndarray, start: int, end: int) -> Node:
    """Divide a stretch of a cell's codes until few are left, and put them in that order (in place).

    A stretch that hardly divides, as codes are equal, stays whole.
    """
    n = end - start
    if n <= index.split:
        return Node(start, end)
    x = index.decode(cell, codes[np.unique(np.linspace(start, end - 1, FAN * 64).astype(int))])
    centroids = x[:: max(1, len(x) // FAN)][:FAN].copy()
    for _ in range(4):
        sums = np.zeros_like(centroids)
        np.add.at(sums, np.argmax(x @ centroids.T, axis=1), x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids).astype(np.float32)
    own = np.concatenate([np.argmax(index.decode(cell, codes[a : min(end, a + 8192)]) @ centroids.T, axis=1) for a in range(start, end, 8192)])
    sizes = np.bincount(own, minlength=len(centroids))
    if sizes.max() > 0.9 * n:
        return Node(start, end)
    order = np.argsort(own, kind="stable")
    codes[start:end], ids[start:end] = codes[start:end][order], ids[start:end][order]
    ends = start + np.cumsum(sizes)
    return Node(start, end, centroids, [_divide(index, cell, codes, ids, int(b - m), int(b)) for b, m in zip(ends, sizes, strict=True)])


def _leaves(node: Node, x: np.ndarray, rows: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, int, int]]:
    """(queries, start, end): the undivided stretches that can hold a neighbour, with the queries (rows of ``x``) they may be of."""
    if node.children is None:
        yield rows, node.start, node.end
        return
    near = x[rows] @ node.centroids.T
    best = np.argmax(near, axis=1)
    between = np.sqrt(np.maximum(0, ((node.centroids[:, None] - node.centroids[None]) ** 2).sum(-1)))
    use = near[np.arange(len(rows)), best][:, None] - near <= reach * between[best] + 1e-6
    for i, child in enumerate(node.children):
        if child.end > child.start and use[:, i].any():
            yield from _leaves(child, x, rows[use[:, i]], reach)


def _scan(index: Index, keep: int | None, least: float | None, k: int, whole: bool, radius: float | None = None):
    """mapInArrow over a part: queries against the codes of the cells they probe, or of all (``whole``), reranked then.

    ``keep`` codes of a part at most stay for a query; None: all that reach the score ``least``. With a radius, crowded
    cells are divided, and of their stretches those that a neighbour can be in are scanned.
    """
    # codes are put in their stretch by what they stand for, so their error counts as well
    reach = None if radius is None else index.reach(float(np.hypot(radius, index.error)))
    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float32()), ("distance", pa.float64())])
    width = index.books.shape[0] // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        for part in np.unique(t.column("part").to_numpy()):
            yield from of(t.filter(pa.compute.equal(t.column("part"), int(part))))

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = t.filter(t.column("query")).combine_chunks()
        base = t.filter(pa.compute.invert(t.column("query"))).combine_chunks()
        if not asks.num_rows or not base.num_rows:
            return
        cell = np.frombuffer(b"".join(base.column("cells").to_pylist()), dtype=np.int32)
        load = np.frombuffer(b"".join(base.column("code").to_pylist()), dtype=np.uint8).reshape(len(cell), -1)
        ids = base.column("id").to_numpy()
        order = np.lexsort((ids, cell))
        cell, load, ids = cell[order], load[order], ids[order]
        q_ids, raw = asks.column("id").to_numpy(), b"".join(asks.column("code").to_pylist())
        if whole:
            yield from all_of(cell, load, ids, q_ids, np.frombuffer(raw, dtype=np.float32).reshape(len(q_ids), -1))
        else:
            small = np.frombuffer(raw, dtype=np.int8).reshape(len(q_ids), -1)
            yield from some_of(cell, load, ids, q_ids, small, asks.column("scale").to_numpy(), asks.column("cells").to_pylist())

    def all_of(cell, load, ids, q_ids, queries) -> Iterator[pa.RecordBatch]:
        codes = np.ascontiguousarray(load[:, :width].T)
        exact = _unit_rows(np.ascontiguousarray(load[:, width:]).view(np.float32))
        for at in range(0, len(q_ids), 512):
            x, own = _unit_rows(queries[at : at + 512]), q_ids[at : at + 512]
            tables = np.rint(_tables(x.astype(np.float32), index.books) * STEP).astype(np.int16)
            near = np.rint(x @ index.centroids.T * STEP).astype(np.int16)
            best_score, best = np.zeros((len(x), 0), np.int16), np.zeros((len(x), 0), np.int64)
            for a in range(0, len(ids), 4096):
                b = min(a + 4096, len(ids))
                score = np.take(near, cell[a:b], axis=1)
                for byte in range(width):
                    score += np.take(tables[byte], codes[byte, a:b], axis=1)
                top = np.argpartition(-score, min(keep, b - a) - 1, axis=1)[:, :keep]
                best_score = np.concatenate([best_score, np.take_along_axis(score, top, 1)], axis=1)
                best = np.concatenate([best, top + a], axis=1)
                if best.shape[1] > keep:
                    top = np.argpartition(-best_score, keep - 1, axis=1)[:, :keep]
                    best_score, best = np.take_along_axis(best_score, top, 1), np.take_along_axis(best, top, 1)
            distance = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("qd,qkd->qk", x, exact[best])))
            distance[ids[best] == own[:, None]] = np.inf
            for i in range(len(x)):
                first = np.lexsort((ids[best[i]], distance[i].round(6)))[:k]
                first = first[np.isfinite(distance[i, first])]
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, own[i])), pa.array(ids[best[i, first]]), pa.array((best_score[i, first] / STEP).astype(np.float32)), pa.array(distance[i, first])], schema=schema
                )

    def some_of(cell, codes, ids, q_ids, small, scale, lists) -> Iterator[pa.RecordBatch]:
        present, starts = np.unique(cell, return_index=True)
        ends = np.r_[starts[1:], len(cell)]
        nodes = [Node(int(a), int(b)) if reach is None else _divide(index, int(c), codes, ids, int(a), int(b)) for c, a, b in zip(present, starts, ends, strict=True)]
        for at in range(0, len(q_ids), ASKS):
            x, own = small[at : at + ASKS] * scale[at : at + ASKS, None].astype(np.float32), q_ids[at : at + ASKS]
            probed = [np.frombuffer(c, dtype=np.int32) for c in lists[at : at + ASKS]]
            who, wanted = np.repeat(np.arange(len(x)), [len(p) for p in probed]), np.concatenate(probed)
            by = np.argsort(wanted, kind="stable")
            who, wanted = who[by], wanted[by]
            found = []
            for c, node in zip(present, nodes, strict=True):
                lo, hi = np.searchsorted(wanted, (c, c + 1))
                if lo == hi:
                    continue
                for rows, a, b in _leaves(node, x, who[lo:hi], reach or 0.0):
                    step = max(1, BLOCK // len(rows))
                    for s in range(a, b, step):
                        block = slice(s, min(b, s + step))
                        found.append(best_of(x[rows] @ index.decode(int(c), codes[block]).T, rows, ids[block], own))
            if found:
                q, i, s = (np.concatenate(f) for f in zip(*found, strict=True))
                o = np.lexsort((i, -s, q))
                q, i, s = q[o], i[o], s[o]
                use = np.arange(len(q)) - np.searchsorted(q, q) < keep if keep is not None else np.ones(len(q), bool)
                yield pa.RecordBatch.from_arrays([pa.array(q[use]), pa.array(i[use]), pa.array(s[use], pa.float32()), pa.nulls(int(use.sum()), pa.float64())], schema=schema)

    def best_of(score, rows, ids, own) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # a cell's queries are about as many as its codes: fewer products with decoded codes than entries of tables
        if least is not None:
            r, m = np.nonzero(score >= least)
        elif len(ids) > keep:
            m = np.argpartition(-score, keep - 1, axis=1)[:, :keep].ravel()
            r = np.repeat(np.arange(len(rows)), keep)
        else:
            r, m = np.repeat(np.arange(len(rows)), len(ids)), np.tile(np.arange(len(ids)), len(rows))
        other = own[rows[r]] != ids[m]
        r, m = r[other], m[other]
        return own[rows[r]], ids[m], score[r, m]

    return scan


def usable(vector: str, dim: int) -> Column:
    """Vectors of ``dim`` finite values that aren't all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)


def nearest(
    df: DataFrame,
    key: str,
    vector: str,
    k: int = 10,
    dim: int = 64,
    ask: Column | None = None,
    radius: float | None = None,
    probes: int | None = None,
    rerank: int = 256,
    slack: float = 0.2,
) -> DataFrame:
    """The ``k`` vectors nearest to each asking row, at most ``radius`` away, as (key_a, key_b, distance, rank).

    ``ask`` selects the asking rows (all by default). ``probes`` is the number of cells a query scans; None scans
    all codes or, with a radius, every cell that can be expected to hold a neighbour. The ``rerank`` best codes of a query (or, with a radius, those whose score is at most ``slack``
    short of it) are compared with the exact vectors (without a radius half as many of each part of the index); distances are those of the vectors scaled to length 1.
    Equal vectors are indexed once and share their neighbours; of a group of equals the ``k`` + 1 smallest keys
    stand for it, so that a group of any size stays cheap and no nearer row is lost (ties go to smaller keys).

    Rows without a key and vectors that are null, of another length, not finite or all zero are no vectors:
    they neither ask nor are found. Repeated rows of a key count once. An empty table gives no rows.
    """
    if dim % 4:
        raise ValueError("dim must be a multiple of 4")
    good = df.filter(F.col(key).isNotNull() & usable(vector, dim)).select(
        F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("vector"), (F.lit(True) if ask is None else F.coalesce(ask, F.lit(False))).alias("ask")
    )
    # 128 bits stand for a vector, so that two of them are never taken for one
    good = good.withColumn("h", F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b")))
    groups = good.groupBy("h").agg(F.min("key").alias("id"), F.first("vector").alias("vector"), F.max("ask").alias("ask"), F.count("*").alias("size"))
    groups = materialise(groups, "vectors")
    rows = groups.count()
    if not rows:
        return good.select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    share = min(1.0, FIT_ROWS / rows, 32 * max(1, min(rows // CELL_ROWS, MAX_CELLS)) / rows if rows > 4096 else 1.0)
    picked = groups.filter(F.pmod(F.xxhash64("h.a"), F.lit(1 << 20)) < int(share * (1 << 20))).select("vector").toArrow()
    sample = np.concatenate([_unit(b, "vector") for b in picked.to_batches() if b.num_rows])
    index = fit(sample, rows)
    parts = int(index.part.max()) + 1
    routed = spread(groups.select("id", "vector", F.coalesce("ask", F.lit(False)).alias("ask"))).mapInArrow(_route(index, probes, radius), ROUTED)
    least = None if radius is None else 1 - radius * radius / 2 - slack
    whole = _whole(index, probes, radius)
    keep = rerank // 2 if whole or radius is None else None  # of a part; with a radius every code within the slack
    found = routed.repartitionById(parts, F.col("part")).mapInArrow(_scan(index, keep, least, k + 1, whole, radius), SCANNED)
    if whole:
        exact = found.select("q", "id", "distance")
    else:
        if radius is None:
            first = Window.partitionBy("q").orderBy(F.desc("score"), "id")
            found = found.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= rerank).drop("r")
        vectors = groups.select("id", F.col("vector").cast("array<double>").alias("v"))
        both = found.join(vectors.withColumnRenamed("v", "b"), "id").join(vectors.select(F.col("id").alias("q"), F.col("v").alias("a")), "q")

        def dot(x: str, y: str) -> Column:
            return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

        exact = both.select("q", "id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot("a", "b") / F.sqrt(dot("a", "a") * dot("b", "b")))).alias("distance"))
    if radius is not None:
        exact = exact.filter(F.col("distance") <= radius)
    own = good.select("key", "ask", "h").distinct().join(groups.select("h", "id"), "h")
    kept = own.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("key"))).filter(F.col("r") <= k + 1)
    asking = own.filter("ask").select(F.col("id").alias("q"), F.col("key").alias("key_a"))
    copies = groups.filter("size > 1").select(F.col("id").alias("q"), "id", F.lit(0.0).alias("distance"))
    found = asking.join(exact.unionByName(copies), "q").join(kept.select("id", F.col("key").alias("key_b")), "id").filter("key_a <> key_b")
    order = Window.partitionBy("key_a").orderBy(F.round("distance", 6), "key_b")
    return found.select("key_a", "key_b", "distance", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)
