"""Links between chunks and the entities they name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import BOUNDARY, CJK
from quillon.session import discard, materialise

ALIAS = r"[0-9A-Za-z_\-]+\.[0-9A-Za-z_]{1,4}" + BOUNDARY
#: Characters of a run's end or start that are a key, the most that fit.
PARTS = (1, 2, 4, 8, 16)
#: Bits of the table of keys, which is broadcast: 8 MB whatever the number of names.
KEY_BITS = 1 << 26
_WHOLE, _START, _END, _PAIR, _SIGN = range(1, 6)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tagged(h: np.ndarray, kind: int, size: int = 0) -> np.ndarray:
    return _mix(h ^ np.uint64((kind << 8 | size) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)


class _Runs:
    """Runs of ASCII word characters and CJK characters of texts, by position in all of them one after another."""

    def __init__(self, texts: list[str]) -> None:
        codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.last = np.cumsum(lengths) - 1
        self.first = self.last - lengths + 1
        self.row = np.repeat(np.arange(len(texts)), lengths)
        word = ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 122)) | ((codes >= 65) & (codes <= 90)) | (codes == 95)
        change = np.flatnonzero(np.diff(np.r_[False, word, False].astype(np.int8)))
        self.start, self.end = change[::2], change[1::2]
        self.cjk = ((codes >= 0x3000) & (codes <= 0x9FFF)) | ((codes >= 0xAC00) & (codes <= 0xD7AF)) | ((codes >= 0xFF00) & (codes <= 0xFFEF))
        self.sign, self.codes = codes.astype(np.uint64), _mix(codes.astype(np.uint64) + np.uint64(1))
        most = int((self.end - self.start).max(initial=1))
        self.power = np.cumprod(np.full(max(most, PARTS[-1]), 0x9E3779B97F4A7C15, dtype=np.uint64))

    def whole(self, own: np.ndarray) -> np.ndarray:
        if not len(own):
            return np.zeros(0, np.int64)
        size = self.end[own] - self.start[own]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(self.start[own], size) + place
        return _tagged(np.add.reduceat(self.codes[at] * self.power[place], np.cumsum(size) - size), _WHOLE)

    def part(self, begin: np.ndarray, size: int, kind: int) -> np.ndarray:
        h = np.zeros(len(begin), np.uint64)
        for j in range(size):
            h += self.codes[begin + j] * self.power[j]
        return _tagged(h, kind, size)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.cjk[:-1] & self.cjk[1:])
        return at, _tagged(_mix(self.sign[at] << np.uint64(32) | self.sign[at + 1]), _PAIR)

    def signs(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.cjk)
        return at, _tagged(_mix(self.sign[at]), _SIGN)


def _slices(sizes: list[int], most: int = 1_000_000) -> Iterator[slice]:
    """Slices of a batch of some million characters."""
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held > most or i + 1 == len(sizes):
            yield slice(start, i + 1)
            start, held = i + 1, 0


def word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (entity_id, word, anywhere) to the keys of each word: what every text that holds it has.

    Runs inside a word, and all runs of one between boundaries, are runs of the text. A run that starts (ends) a word
    found anywhere is the end (start) of one of the text. CJK characters count two by two, alone only if no two are neighbours.
    """
    for batch in batches:
        word, anywhere = batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for part in _slices([len(w) for w in word]):
            runs, loose = _Runs(word[part]), anywhere[part]
            row = runs.row[runs.start]
            heads, tails = loose[row] & (runs.start == runs.first[row]), loose[row] & (runs.end == runs.last[row])
            inside = np.flatnonzero(~heads & ~tails)
            size = runs.end - runs.start
            out = [(row[inside], runs.whole(inside), size[inside])]
            fit = np.array(PARTS)[np.searchsorted(PARTS, size, side="right") - 1]
            for n in PARTS:
                own = np.flatnonzero(heads & ~tails & (fit == n))
                out.append((row[own], runs.part(runs.end[own] - n, n, _END), np.full(len(own), n)))
                own = np.flatnonzero(tails & ~heads & (fit == n))
                out.append((row[own], runs.part(runs.start[own], n, _START), np.full(len(own), n)))
            at, key = runs.pairs()
            out.append((runs.row[at], key, np.full(len(at), 2)))
            at, one = runs.signs()
            alone = ~np.isin(runs.row[at], runs.row[runs.pairs()[0]])
            out.append((runs.row[at][alone], one[alone], np.full(int(alone.sum()), 1)))
            who, key, size = (np.concatenate(x) for x in zip(*out, strict=True))
            own = batch.slice(part.start, part.stop - part.start).take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(key.astype(np.int64)), pa.array(size.astype(np.int32))], names=["entity_id", "word", "anywhere", "key", "size"])


def text_keys(bits: np.ndarray):
    """mapInArrow: (chunk_id, text) to (chunk_id, key), each key once a chunk, without those that no word has by the table ``bits``."""

    def known(key: np.ndarray) -> np.ndarray:
        low, high = key & (KEY_BITS - 1), (key >> 26) & (KEY_BITS - 1)
        both = [bits[c >> 3] >> (c & 7).astype(np.uint8) & 1 for c in (low, high)]
        return (both[0] & both[1]).astype(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _slices([len(t) for t in texts]):
                runs, out = _Runs(texts[part]), []
                row, size = runs.row[runs.start], runs.end - runs.start
                found = [(row, runs.whole(np.arange(len(row))))]
                for n in PARTS:
                    own = np.flatnonzero(size >= n)
                    found += [(row[own], runs.part(runs.end[own] - n, n, _END)), (row[own], runs.part(runs.start[own], n, _START))]
                found += [(runs.row[at], key) for at, key in (runs.pairs(), runs.signs())]
                for who, key in found:
                    use = known(key)
                    out.append(np.stack([who[use], key[use]]))
                who, key = np.unique(np.concatenate(out, axis=1), axis=1)
                ids = batch.column(0).slice(part.start, part.stop - part.start).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([ids, pa.array(key)], names=["chunk_id", "key"])

    return run


def _key_table(keys: DataFrame) -> np.ndarray:
    """Two bits of every key; the driver receives at most the bytes that are set."""
    low, high = (x.bitwiseAND(KEY_BITS - 1).cast("int") for x in (F.col("key"), F.shiftright("key", 26)))
    each = keys.select(F.explode(F.array(low, high)).alias("c")).distinct()
    found = each.groupBy(F.shiftright("c", 3).alias("at")).agg(F.sum(F.expr("shiftleft(1, c & 7)")).cast("int").alias("bits")).toArrow()
    out = np.zeros(KEY_BITS // 8, dtype=np.uint8)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out


def meetings(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, entity_id, word, anywhere): lower-cased texts (chunk_id, text) that have the key of a word (entity_id, word, anywhere).

    A word's key is the rarest among the words. Keys that no word has are left out by a bit table before anything is shuffled.
    """
    each = materialise(words.mapInArrow(word_keys, "entity_id string, word string, anywhere boolean, key long, size int"), "words")
    rare = each.groupBy("key").agg(F.count("*").alias("n"))
    chosen = each.join(rare, "key").groupBy("entity_id", "word", "anywhere").agg(F.min_by("key", F.struct("n", -F.col("size"), "key")).alias("key"))
    chosen = materialise(chosen, "chosen")
    discard(each)
    shared = texts.sparkSession.sparkContext.broadcast(_key_table(chosen))

    def keyed(batches):
        yield from text_keys(shared.value)(batches)

    return texts.mapInArrow(keyed, "chunk_id string, key long").join(chosen, "key").drop("key")


def word_links(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, entity_id): chunks whose lower-cased text holds a word (entity_id, word, anywhere), anywhere or between ASCII word boundaries.

    Only chunks and words that meet by a key are compared, so no chunk is held against all words.
    """
    texts = chunks.select("chunk_id", F.lower("text").alias("text")).filter("text IS NOT NULL AND chunk_id IS NOT NULL")
    both = texts.join(meetings(texts, words), "chunk_id").filter(F.expr("instr(text, word) > 0"))
    quoted = F.concat(F.lit(BOUNDARY + r"\Q"), F.col("word"), F.lit(r"\E" + BOUNDARY))
    return both.filter(F.col("anywhere") | F.regexp_like("text", quoted)).select("chunk_id", "entity_id").distinct()


def _named(entities: DataFrame, shortest: int, shortest_cjk: int) -> DataFrame:
    """(entity_id, word, anywhere) of names."""
    names = entities.select(F.col("id").alias("entity_id"), F.lower("name").alias("word")).filter("entity_id IS NOT NULL AND word IS NOT NULL")
    names = names.withColumn("anywhere", F.col("word").rlike(CJK))
    return names.filter(F.length("word") >= F.when(F.col("anywhere"), shortest_cjk).otherwise(shortest))


def name_links(chunks: DataFrame, entities: DataFrame, shortest: int = 1, shortest_cjk: int = 1) -> DataFrame:
    """(chunk_id, entity_id): chunks whose text holds an entity's name.

    A name with CJK characters is found anywhere, another as a whole word (by ASCII word characters), both in any case.
    """
    return word_links(chunks, _named(entities, shortest, shortest_cjk))


def aliases(entities: DataFrame) -> DataFrame:
    """(entity_id, alias): file-like words of at least 4 characters in an entity's observations, lower-cased."""
    words = F.flatten(F.transform("observations", lambda o: F.regexp_extract_all(o, F.lit(ALIAS), F.lit(0))))
    each = entities.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct(words)).alias("alias"))
    return each.filter(F.length("alias") >= 4).select("entity_id", F.lower("alias").alias("alias")).distinct()


def _aliased(entities: DataFrame) -> DataFrame:
    return entities.select("id", "observations").transform(aliases).select("entity_id", F.col("alias").alias("word"), F.lit(True).alias("anywhere"))


def alias_links(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, entity_id): chunks whose text holds an alias of an entity, in any case."""
    return word_links(chunks, _aliased(entities))


def auto_links(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(chunk_id, entity_id) by name or alias, for entities with names of at least 4 (with CJK characters 2) characters."""
    long_enough = F.length("name") >= F.when(F.col("name").rlike(CJK), 2).otherwise(4)
    own = entities.filter(long_enough)
    return word_links(chunks, _named(own, 1, 1).unionByName(_aliased(own)))
