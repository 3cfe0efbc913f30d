"""Problem 7: near-duplicate records, by prefix filtering under several global token orders.

Two sets with a Jaccard similarity of at least t share a token among the first |x| - ceil(t |x|) + 1 tokens of
each under *any* global order of the tokens. Candidates are formed under a first order that puts rare tokens
first; a candidate must also share prefix tokens under two further orders (ascending and descending hash)
before its sets are shuffled and compared. The records of a frequent token are dealt to blocks that meet two by
two; a very frequent one is replaced by its pairs with the prefix tokens of the second order before. Tokens are
hashes of runs of consecutive words.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.components import components
from quillon.operators.skew import HOT, look_up
from quillon.session import discard, materialise, spread

#: Cells of each of the two rows of a sketch of frequencies, a byte each: what is broadcast for it. It has up to GROWN times as
#: many where there are more tokens to tell apart, at any size of the data no more.
SKETCH, GROWN = 1 << 22, 8
#: Bits of a table of keys, which is broadcast: 8 MB at any size of the data. Cells of a table that one task fills.
KEY_BITS, FILLED = 1 << 26, 1 << 18
#: Records of a bucket of tokens, and candidates formed at once in a task.
BUCKET_RECORDS, BLOCK = 8192, 1 << 21
#: Tokens in more records than this have them dealt to blocks, in more than PAIRED times as many are paired with tokens of
#: the second order first. A list has at most MOST_BLOCKS blocks, which only makes the blocks of a longer one larger.
HOT_RECORDS, PAIRED, MOST_BLOCKS = 32768, 32, 64
#: Tables of keys up to this many rows (16 bytes each) are broadcast. Instead of larger ones a table of bits is, with at most
#: EXCEPT times as many keys (8 bytes each) that it holds wrongly.
SMALL_ROWS, EXCEPT = 1_000_000, 8
EPS = 1e-9


# Separators that no text holds: between the texts of a record, and between records.
PART, RECORD = "\U0010ffff", "\U0010fffe"
_DROP, _KEEP, _BLANK, _PART, _RECORD = range(5)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of every codepoint: letters and digits are kept, space, tab and line feed split words, the rest is dropped."""
    kinds = np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)], dtype=np.uint8)
    kinds[[0x20, 0x09, 0x0A]] = _BLANK
    kinds[[ord(PART), ord(RECORD)]] = _PART, _RECORD
    return kinds


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_sets(texts: list[str], kinds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets of runs of ``width`` words of records (their texts joined by PART), all records at once.

    Returns the size of each record's set, the sets one after another (52-bit hashes, sorted; those of records of
    different kinds differ), and two 64-bit hashes of each record's words in order. At most 4,096 records a call. Words are what lower-casing, splitting at blanks and dropping everything but
    letters and digits leaves.
    """
    codes = np.frombuffer(RECORD.join(texts).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _kinds()[codes]
    at = np.flatnonzero(kind == _KEEP)
    sizes, first, second = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if not len(at):
        return sizes, np.zeros(0, np.int64), first, second
    gap = np.cumsum(kind >= _BLANK, dtype=np.int32)[at]
    starts = np.flatnonzero(np.r_[True, gap[1:] != gap[:-1]])
    lengths = np.diff(np.r_[starts, len(at)])
    power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    word = _mix(np.add.reduceat(_mix(codes[at].astype(np.uint64) + np.uint64(1)) * power[place], starts))
    record = np.cumsum(kind == _RECORD, dtype=np.int32)[at[starts]]
    part = np.cumsum(kind >= _PART, dtype=np.int32)[at[starts]]
    heads = np.flatnonzero(np.r_[True, record[1:] != record[:-1]])
    ordinal = np.arange(len(word)) - np.repeat(heads, np.diff(np.r_[heads, len(word)])) + (part - part[heads].repeat(np.diff(np.r_[heads, len(word)]))).astype(np.int64) * 1_000_003
    for out, salt in ((first, 0x2545F4914F6CDD1D), (second, 0xD6E8FEB86659FD93)):
        out[record[heads]] = np.add.reduceat(_mix(word + ordinal.astype(np.uint64) * np.uint64(salt)), heads).view(np.int64)
    n = len(word) - width + 1
    if n < 1:
        return sizes, np.zeros(0, np.int64), first, second
    run = _mix(kinds.astype(np.uint64) + np.uint64(0xA0761D6478BD642F))[record[:n]]
    for d in range(width):
        run = _mix(run * np.uint64(0xD1342543DE82EF95) + word[d : d + n])
    same = part[:n] == part[width - 1 :]
    both = np.sort(record[:n][same].astype(np.uint64) << np.uint64(52) | run[same] >> np.uint64(12))
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    token = (both & np.uint64((1 << 52) - 1)).astype(np.int64)
    return np.bincount((both >> np.uint64(52)).astype(np.int64), minlength=len(texts)), token, first, second


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(kind, key, texts) of a batch in slices of some million characters."""
    kind, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
    texts, start, size = batch.column(2).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > 2_000_000 or i - start > 4000 or i + 1 == len(texts):
            yield kind[start : i + 1], key[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0


def signs(width: int, least: int):
    """mapInArrow: (kind, key, text) to two hashes of the words of each record with enough runs, and to partial counts of tokens.

    Both kinds of rows come from one pass over the texts: (kind, key, h, g) and (token, n), the other columns null.
    """
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("token", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for kind, key, texts in _slices(batch):
                sizes, tokens, first, second = token_sets(texts, kind, width)
                use = sizes >= max(least, 1)
                none = pa.nulls(int(use.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(kind[use].astype(np.int8)), *(pa.array(x[use]) for x in (key, first, second)), none, none], schema=schema)
                held.append(tokens[np.repeat(use, sizes)])
            if sum(map(len, held)) > 4 * BLOCK:
                yield counts(held)
                held = []
        if held:
            yield counts(held)

    def counts(held: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(held), return_counts=True)
        none = [pa.nulls(len(token), t) for t in (pa.int8(), pa.int64(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([*none, pa.array(token, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return run


def grade(n: int) -> int:
    """Frequencies in steps of a quarter of an octave; 0 for those that occur once."""
    return math.ceil(4 * math.log2(n)) if n > 1 else 0


def _filled(each: DataFrame, size: int, dtype: type, most: bool) -> np.ndarray:
    """A table of ``size`` entries out of rows (cell long, g int): the largest g of each cell, or the g united as bits.

    Stretches of the table are filled by tasks, so that the driver receives the table and nothing else.
    """

    def fill(t: pa.Table) -> pa.Table:
        part, cell, g = (t.column(c).to_numpy() for c in ("part", "cell", "g"))
        out = np.zeros(FILLED, dtype=dtype)
        (np.maximum if most else np.bitwise_or).at(out, cell & (FILLED - 1), g.astype(dtype))
        return pa.table({"part": pa.array(part[:1], pa.int32()), "load": pa.array([out.tobytes()], pa.binary())})

    parts = each.withColumn("part", F.shiftright("cell", FILLED.bit_length() - 1).cast("int"))
    found = parts.groupBy("part").applyInArrow(fill, "part int, load binary").toArrow()
    out = np.zeros(max(size, FILLED), dtype=dtype)
    for part, load in zip(found.column("part").to_pylist(), found.column("load").to_pylist(), strict=True):
        out[part * FILLED : (part + 1) * FILLED] = np.frombuffer(load, dtype=dtype)
    return out[:size]


def sketch_of(frequency: DataFrame, cells: int) -> np.ndarray:
    """Grades of frequencies (token, n) in a table of two rows of ``cells``: a cell holds the largest grade of its tokens.

    The table has the same size whatever there is to count.
    """
    bits = cells.bit_length() - 1
    low, high = F.col("token").bitwiseAND(cells - 1), F.shiftrightunsigned("token", bits).bitwiseAND(cells - 1) + cells
    each = frequency.filter("n > 1").select(F.explode(F.array(low, high)).alias("cell"), F.ceil(4 * F.log2("n")).cast("int").alias("g"))
    return _filled(each, 2 * cells, np.uint8, True)


def _bits_of(kind: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in a table of keys."""
    h = _mix(key.astype(np.int64).view(np.uint64) ^ _mix(kind.astype(np.uint64) + np.uint64(1)))
    return (h & np.uint64(KEY_BITS - 1)).astype(np.int64), (h >> np.uint64(26) & np.uint64(KEY_BITS - 1)).astype(np.int64)


def key_table(keys: DataFrame) -> np.ndarray:
    """Bits of all keys (kind, key), eight a byte."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bit in _bits_of(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))):
                yield pa.RecordBatch.from_arrays([pa.array(bit >> 3), pa.array((1 << (bit & 7)).astype(np.int32))], names=["cell", "g"])

    return _filled(keys.select("kind", "key").mapInArrow(cells, "cell long, g int"), KEY_BITS // 8, np.uint8, False)


def held(table: np.ndarray, kind: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each key is in a table of keys; of others some are held to be in it, too."""
    both = [table[b >> 3] >> (b & 7).astype(np.uint8) & 1 for b in _bits_of(kind, key)]
    return (both[0] & both[1]).astype(bool)


def _chosen(batches: Iterator[pa.RecordBatch], choose) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, ...) that ``choose`` (kind, key) says are to stay."""
    for batch in batches:
        if batch.num_rows:
            yield batch.filter(pa.array(choose(*(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)))))


def grades(sketch: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Grade of each token: never too low, and too high only if more frequent tokens share both of its cells."""
    cells = len(sketch) // 2
    high = tokens.view(np.uint64) >> np.uint64(cells.bit_length() - 1)
    return np.minimum(sketch[tokens & (cells - 1)], sketch[(high & np.uint64(cells - 1)).astype(np.int64) + cells])


def sets_of(width: int):
    """mapInArrow: (kind, key, text) to (kind, key, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, key, texts in _slices(batch):
                sizes, tokens, _, _ = token_sets(texts, kind, width)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), lists], names=["kind", "key", "tokens"])

    return run


def prefix(n, share: float):
    """Length of the prefix that two sets of overlap ``share`` x n must meet in."""
    return n - np.ceil(share * n - EPS).astype(np.int64) + 1


def levels(n: np.ndarray) -> np.ndarray:
    """Size class of a record's parity bitmap: 256 bits up to 128 tokens, four times as many for four times as many."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 128) / 2 - EPS)).astype(np.int64)


def lists_of(key: np.ndarray, n: np.ndarray, tokens: np.ndarray, sketch: np.ndarray, t: float, least: int, hot: int, paired: int) -> tuple:
    """(record, list, place in the first order) of the lists that the records of a slice stand in.

    A record stands in the list of each prefix token of the first order that another record has, too. For a token in more than ``paired`` x ``hot``
    records these are the lists of the token with each prefix token of the second order, as similar records share
    both. A list of more than ``hot`` records, by the smaller frequency, is replaced by its blocks, two by two: the
    record's own block with every other, so that each two records meet.
    """
    record = np.repeat(np.arange(len(n)), n)
    starts = np.cumsum(n) - n
    second = np.arange(len(tokens)) - starts[record]  # tokens come sorted: their place in the second order
    often = grades(sketch, tokens)
    # 12 bits of the record (4,096 of a slice), 8 of the grade, 44 of the token
    order = np.argsort(record.astype(np.uint64) << np.uint64(52) | often.astype(np.uint64) << np.uint64(44) | tokens.view(np.uint64) >> np.uint64(8), kind="stable")
    at = np.arange(len(tokens))
    length = np.where(n >= max(least, 1), prefix(n, t), 0)
    first = order[(at - starts[record] < length[record]) & (often[order] > 0)]  # who is alone with a token meets nobody by it
    place = np.empty(len(tokens), np.int64)
    place[order] = at - starts[record]
    who, token, pos, size = record[first], tokens[first], place[first], often[first]
    crowded = size > grade(paired * hot)
    if crowded.any():
        other = np.flatnonzero((second < length[record]) & (often > 0))
        begin, end = np.searchsorted(record[other], who[crowded]), np.searchsorted(record[other], who[crowded], side="right")
        times = end - begin
        pick = other[np.repeat(begin, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        mixed = _mix(np.repeat(token[crowded], times).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tokens[pick].view(np.uint64)) >> np.uint64(12)
        size = np.r_[size[~crowded], np.minimum(np.repeat(size[crowded], times), often[pick])]
        who, pos = np.r_[who[~crowded], np.repeat(who[crowded], times)], np.r_[pos[~crowded], np.repeat(pos[crowded], times)]
        token = np.r_[token[~crowded], mixed.view(np.int64)]
    long = size > grade(hot)
    if not long.any():
        return who, token, pos
    blocks = np.where(long, np.minimum(MOST_BLOCKS, np.ceil(2.0 ** (size / 4) / hot)), 1).astype(np.int64)
    own = (_mix(key[who].astype(np.int64).view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
    rows = np.repeat(np.arange(len(who)), blocks)
    other = np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    keep = (blocks[rows] == 1) | (other != own[rows])  # two of one block meet in its pairs with any other
    rows, other = rows[keep], other[keep]
    cell = (np.minimum(own[rows], other) << 24) + np.maximum(own[rows], other) + 1
    cell = _mix(token[rows].view(np.uint64) ^ _mix(cell.view(np.uint64))) >> np.uint64(12)
    return who[rows], np.where(blocks[rows] > 1, cell.view(np.int64), token[rows]), pos[rows]


def postings(sketch: np.ndarray, t: float, width: int, least: int, buckets: int, hot: int, paired: int = PAIRED):
    """mapInArrow: (kind, key, text) to one row for each bucket that holds lists of the record.

    ``load`` holds the record's parity bitmap, then the lists (32 bits each) and their tokens' places in the first order.
    """
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int32()), ("load", pa.binary())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, key, texts in _slices(batch):
                n, tokens, _, _ = token_sets(texts, kind, width)
                if len(tokens):
                    yield one(kind, key, n, tokens)

    def one(kind: np.ndarray, key: np.ndarray, n: np.ndarray, tokens: np.ndarray) -> pa.RecordBatch:
        who, token, pos = lists_of(key, n, tokens, sketch, t, least, hot, paired)
        record = np.repeat(np.arange(len(n)), n)
        level = levels(n)
        bits = [b""] * len(n)
        for v in np.unique(level):
            own, size = np.flatnonzero(level == v), 256 * 4 ** int(v)
            inside = level[record] == v
            row = np.searchsorted(own, record[inside])
            marked = np.bincount(row * size + (tokens[inside] & (size - 1)), minlength=len(own) * size) & 1
            packed = np.packbits(marked.astype(np.uint8).reshape(len(own), size), axis=1)
            for r, b in zip(own, packed, strict=True):
                bits[r] = b.tobytes()
        bucket = ((token >> 32) & 0xFFFFF) % buckets
        by = np.lexsort((bucket, who))
        who, token, pos, bucket = who[by], token[by], pos[by], bucket[by]
        heads = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (bucket[1:] != bucket[:-1])]) if len(who) else np.zeros(0, np.int64)
        ends = np.r_[heads[1:], len(who)] if len(who) else heads
        names, places = token.astype(np.uint32).tobytes(), pos.astype(np.uint32).tobytes()
        load = [bits[w] + names[4 * a : 4 * b] + places[4 * a : 4 * b] for w, a, b in zip(who[heads].tolist(), heads.tolist(), ends.tolist(), strict=True)]
        columns = (bucket[heads].astype(np.int32), kind[who[heads]].astype(np.int8), key[who[heads]], n[who[heads]].astype(np.int32))
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(load, pa.binary())], schema=schema)

    return emit


def meet(t: float):
    """mapInArrow over buckets: pairs of records that share a prefix token and can still be similar enough."""
    schema = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])
    half = 2 * t / (1 + t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        for bucket in np.unique(table.column("bucket").to_numpy()):
            yield from one(table.filter(pa.compute.equal(table.column("bucket"), int(bucket))).combine_chunks())

    def one(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n, key, kind = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "key", "kind"))
        level = levels(n)
        maps = {}
        load = table.column("load").to_pylist()
        wide = 32 * 4**level
        packed = [b[:w] for b, w in zip(load, wide.tolist(), strict=True)]
        held = np.array([(len(b) - w) // 8 for b, w in zip(load, wide.tolist(), strict=True)])
        for v in np.unique(level):
            rows = np.flatnonzero(level >= v)
            width = 32 * 4 ** int(v)
            folded = np.zeros((len(rows), width), dtype=np.uint8)
            for u in np.unique(level[rows]):
                own = np.flatnonzero(level[rows] == u)
                raw = np.frombuffer(b"".join(packed[r] for r in rows[own]), dtype=np.uint8).reshape(len(own), -1, width)
                folded[own] = np.bitwise_xor.reduce(raw, axis=1)
            row_of = np.full(len(n), -1)
            row_of[rows] = np.arange(len(rows))
            maps[int(v)] = (row_of, folded.view(np.uint64))
        record = np.repeat(np.arange(len(n)), held)
        token = np.frombuffer(b"".join(b[w : w + 4 * h] for b, w, h in zip(load, wide.tolist(), held.tolist(), strict=True)), dtype=np.uint32).astype(np.int64)
        at = np.frombuffer(b"".join(b[w + 4 * h :] for b, w, h in zip(load, wide.tolist(), held.tolist(), strict=True)), dtype=np.uint32).astype(np.int64)
        order = np.lexsort((key[record], n[record], token))
        record, token, at = record[order], token[order], at[order]
        lists = np.cumsum(np.r_[0, token[1:] != token[:-1]]) if len(token) else token
        size, span = n[record], int(n.max()) * 4 + 4
        spot = lists * span + size
        last = np.searchsorted(spot, lists * span + np.minimum(np.floor(size / t + EPS), span - 1), side="right")
        here = np.arange(len(record))
        times = np.where(at < prefix(size, half), last - here - 1, 0)
        keep = np.flatnonzero(times > 0)
        ends = np.cumsum(times[keep])
        found, done = [], 0
        small, rest = size.astype(np.int32), (size - at).astype(np.int32)
        needed = np.ceil(t / (1 + t) * np.arange(2 * int(n.max()) + 1) - EPS).astype(np.int32)  # overlap, by the sum of both sizes
        while done < len(keep):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BLOCK)))
            x = np.repeat(keep[done:stop], times[keep[done:stop]])
            y = x + 1 + np.arange(len(x)) - np.repeat(ends[done:stop] - times[keep[done:stop]] - (ends[done - 1] if done else 0), times[keep[done:stop]])
            done = stop
            need = needed[small[x] + small[y]]
            fine = np.flatnonzero(np.minimum(rest[x], rest[y]) >= need)
            x, y, need = record[x[fine]], record[y[fine]], need[fine].astype(np.int64)
            most = n[x] + n[y] - 2 * need
            other = x != y
            x, y, most = x[other], y[other], most[other]
            common = np.minimum(level[x], level[y])
            for v in np.unique(common):
                row_of, bits = maps[int(v)]
                own = common == v
                p, q, m = x[own], y[own], most[own]
                for w in range(0, bits.shape[1], 4):  # a wide bitmap is compared in steps, dropping pairs as they fail
                    m = m - np.bitwise_count(bits[row_of[p], w : w + 4] ^ bits[row_of[q], w : w + 4]).sum(axis=1, dtype=np.int64)
                    p, q, m = p[m >= 0], q[m >= 0], m[m >= 0]
                found.append(np.minimum(p, q) * len(n) + np.maximum(p, q))
            if sum(map(len, found)) > BLOCK:
                found = [np.unique(np.concatenate(found))]
        if found:
            pair = np.unique(np.concatenate(found))
            p, q = pair // len(n), pair % len(n)
            p, q = p[key[p] != key[q]], q[key[p] != key[q]]  # a record that came twice is no pair
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind[p].astype(np.int8)), pa.array(np.minimum(key[p], key[q])), pa.array(np.maximum(key[p], key[q]))], schema=schema
            )

    return run


def _leaders(base: DataFrame, members: DataFrame, small: int) -> tuple[DataFrame, Broadcast | None]:
    """``base`` (kind, key, text) without the copies among ``members`` (kind, key, rep), and what was broadcast for it.

    Beyond ``small`` copies those are known by a table of bits; the representatives that it takes for copies are sent as keys.
    """
    copies = members.filter("key <> rep").select("kind", "key")
    if copies.count() <= small:
        return base.join(F.broadcast(copies), ["kind", "key"], "left_anti"), None
    table = base.sparkSession.sparkContext.broadcast(key_table(copies))
    taken = members.filter("key = rep").select("kind", "key").mapInArrow(lambda batches: _chosen(batches, lambda kind, key: held(table.value, kind, key)), "kind tinyint, key long")
    taken = materialise(taken, "taken")
    if taken.count() > EXCEPT * max(small, 1):
        return base.join(copies, ["kind", "key"], "left_anti"), table
    found = taken.toArrow()
    discard(taken)
    kinds, keys = (found.column(c).to_numpy() for c in ("kind", "key"))
    spared = {int(k): np.unique(keys[kinds == k]) for k in np.unique(kinds)}
    shared = base.sparkSession.sparkContext.broadcast((table.value, spared))
    table.destroy()

    def leads(kind: np.ndarray, key: np.ndarray) -> np.ndarray:
        bits, spared = shared.value
        stay = ~held(bits, kind, key)
        for k, own in spared.items():
            stay |= (kind == k) & (own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key)
        return stay

    return base.mapInArrow(lambda batches: _chosen(batches, leads), base.schema), shared


def near_duplicates(
    records: DataFrame, threshold: float = 0.8, width: int = 5, least: int = 1, hot: int = HOT_RECORDS, cells: int = SKETCH, small: int = SMALL_ROWS, paired: int = PAIRED
) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates among ``records`` (kind tinyint, key long, texts array<string>).

    Returns ``pairs`` (kind, a, b, similarity) with a < b between class representatives whose sets of runs of
    ``width`` words have a Jaccard similarity of at least ``threshold``, and ``members`` (kind, key, rep): the class,
    the records of equal words, of every record with at least ``least`` runs. Records of different kinds never meet.

    The first order is by grades of frequency out of a sketch of 2 x ``cells`` bytes, or up to GROWN times as many, whatever
    the number of tokens; tokens of a grade are ordered by hash. Tokens in more than ``hot`` records (by the sketch, which never
    says too few) are split by tokens of the second order and by blocks; no link is lost. Tables of at most ``small``
    keys are broadcast, larger ones as a table of bits, so that texts aren't shuffled for them.

    Null texts are left out; records without a key, without texts or with fewer than ``least`` runs are in no pair
    and no class; repeated rows of a key count once; an empty table gives two empty results.
    """
    spark = records.sparkSession
    base = records.filter(F.col("key").isNotNull()).select(
        F.col("kind").cast("tinyint").alias("kind"), F.col("key").cast("long").alias("key"), F.array_join("texts", PART).alias("text")
    )
    base = spread(base.filter(F.length("text") > 0))
    seen = materialise(base.mapInArrow(signs(width, least), "kind tinyint, key long, h long, g long, token long, n long"), "signs")
    prints = seen.filter("token IS NULL").select("kind", "key", "h", "g").distinct()
    lead = prints.groupBy("kind", "h", "g").agg(F.min("key").alias("rep"), F.count("*").alias("size"))
    many = prints.count()
    members = look_up(prints, lead, ["kind", "h", "g"], "key", "size", max(HOT, many // 1000))
    members = materialise(members.select("kind", "key", "rep"), "members")
    often = materialise(seen.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 1"), "often")
    discard(seen)
    tokens, most = often.count(), GROWN * cells
    while cells < most and tokens > cells // 4:
        cells *= 2
    sketch = sketch_of(often, cells)
    discard(often)
    shared = spark.sparkContext.broadcast(sketch)
    leaders, used = _leaders(base, members, small)
    buckets = max(12, many // BUCKET_RECORDS)

    def emit(batches):
        yield from postings(shared.value, threshold, width, least, buckets, hot, paired)(batches)

    routed = leaders.mapInArrow(emit, "bucket int, kind tinyint, key long, n int, load binary")
    met = routed.repartitionById(buckets, F.col("bucket")).mapInArrow(meet(threshold), "kind tinyint, a long, b long").distinct()
    met = materialise(met, "met")
    shared.destroy()
    if used is not None:
        used.destroy()
    ids = met.select("kind", F.explode(F.array("a", "b")).alias("key"))
    if met.count() <= small // 2:
        asked = base.join(F.broadcast(ids.distinct()), ["kind", "key"], "left_semi")
    else:  # some records that are in no pair come along; they meet none below
        wanted = spark.sparkContext.broadcast(key_table(ids))
        asked = base.mapInArrow(lambda batches: _chosen(batches, lambda kind, key: held(wanted.value, kind, key)), base.schema)
    sets = asked.mapInArrow(sets_of(width), "kind tinyint, key long, tokens array<long>").filter(F.size("tokens") >= max(least, 1))
    sets = materialise(sets.dropDuplicates(["kind", "key"]), "sets")

    def cut(down: bool) -> Column:
        """The prefix of a set under the second (ascending) or third (descending) order, 32 bits of each token."""
        size = F.size("tokens")
        length = size - F.ceil(F.lit(threshold) * size - EPS).cast("int") + 1
        part = F.slice("tokens", size - length + 1 if down else F.lit(1), length)
        return F.transform(part, lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))

    # the other orders are intersected on their prefixes alone; whole sets are shuffled for the candidates that are left
    heads = sets.select("kind", "key", cut(False).alias("up"), cut(True).alias("down"))
    ha, hb = (heads.select("kind", F.col("key").alias(x), F.col("up").alias(f"up_{x}"), F.col("down").alias(f"down_{x}")) for x in "ab")
    left = met.join(ha, ["kind", "a"]).join(hb, ["kind", "b"])
    left = left.filter(F.arrays_overlap("up_a", "up_b") & F.arrays_overlap("down_a", "down_b")).select("kind", "a", "b")
    sides = [sets.select("kind", F.col("key").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab"]
    both = left.join(sides[0], ["kind", "a"]).join(sides[1], ["kind", "b"])
    scored = both.withColumn("common", F.size(F.array_intersect("tokens_a", "tokens_b")))
    scored = scored.withColumn("either", F.size("tokens_a") + F.size("tokens_b") - F.col("common"))
    pairs = scored.filter(F.col("common") >= F.lit(threshold) * F.col("either") - EPS)
    return pairs.select("kind", "a", "b", (F.col("common") / F.col("either")).alias("similarity")), members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of keys (kind, a, b) behind pairs of representatives, and within classes; what they make isn't shuffled."""
    classes = members.groupBy("kind", "rep").agg(F.collect_list("key").alias("keys"))
    left, right = (classes.select("kind", F.col("rep").alias(r), F.col("keys").alias(k)) for r, k in (("a", "xs"), ("b", "ys")))
    links = pairs.select("kind", "a", "b").join(left, ["kind", "a"]).join(right, ["kind", "b"]).select("kind", "xs", "ys", F.lit(False).alias("own"))
    crowds = classes.filter(F.size("keys") > 1).select("kind", F.col("keys").alias("xs"), F.col("keys").alias("ys"), F.lit(True).alias("own"))
    met = links.unionByName(crowds).select("kind", "own", F.explode("xs").alias("x"), "ys").select("kind", "own", "x", F.explode("ys").alias("y"))
    found = met.filter("x < y OR (x > y AND NOT own)").select("kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # a key is in two classes only if it came again with other words
    return found.distinct() if members.groupBy("kind", "key").count().filter("count > 1").head(1) else found


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, key, rep, grp, links): every record's class, its group of linked classes, and its class's links to others.

    ``grp`` is the smallest representative that the class is connected to; classes without a link are groups of
    their own.
    """
    node = lambda c: F.struct("kind", F.col(c).alias("key"))
    edges = pairs.select(node("a").alias("x"), node("b").alias("y"))
    found = components(edges, "x", "y").select(F.col("node.kind").alias("kind"), F.col("node.key").alias("rep"), F.col("component.key").alias("grp"))
    links = pairs.select("kind", F.explode(F.array("a", "b")).alias("rep")).groupBy("kind", "rep").agg(F.count("*").alias("links"))
    joined = members.join(found, ["kind", "rep"], "left").join(links, ["kind", "rep"], "left")
    return joined.select("kind", "key", "rep", F.coalesce("grp", "rep").alias("grp"), F.coalesce("links", F.lit(0)).alias("links"))
