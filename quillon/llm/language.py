"""Problem 3: the language of documents and of each stretch in them, by a byte convolutional network.

Filters of several widths slide over byte embeddings of fixed-length windows; their maxima feed a softmax. The
network is trained in numpy on a bounded sample of labelled texts and applied to all windows of all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.garbled import repair_line, suspects
from quillon.session import spread

#: The network is fitted on at most this many labelled texts; everything else covers all rows.
FIT_ROWS = 1000
WINDOW, WIDTHS, FILTERS, EMBEDDING = 64, (2, 3, 4), 24, 8
#: Nats by which a sentence must speak against the text's main language to be told apart from it.
EVIDENCE = 3.0
#: Least number of training steps, and every how many of the sampled texts one is held out for calibration.
STEPS, HELD_OUT = 300, 10

END = re.compile(r"[.!?…]+[\"”»’)\]]*(?=\s)|[。！？]+")
DATA_RUN = re.compile(r"[!-~]{60,}")


def sentences(line: str) -> Iterator[tuple[int, int]]:
    """Spans of the sentences of a line."""
    at = 0
    for m in END.finditer(line):
        yield at, m.end()
        at = m.end()
    if at < len(line):
        yield at, len(line)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which codepoints are letters (or numbers other than digits)."""
    return np.array([chr(c).isalnum() and not chr(c).isdecimal() for c in range(0x110000)])


def letters_of(texts: list[str]) -> np.ndarray:
    """Number of letters of each text."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    found = _letters()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    sums = np.r_[0, np.cumsum(found)]
    ends = np.cumsum(length)
    return sums[ends] - sums[ends - length]


def windows(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows of byte strings (zero-padded at the end), and the piece of each."""
    counts = np.array([max(1, -(-len(p) // WINDOW)) for p in pieces], dtype=np.int64)
    joined = b"".join(p + b"\0" * (int(c) * WINDOW - len(p)) for p, c in zip(pieces, counts, strict=True))
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, WINDOW), np.repeat(np.arange(len(pieces)), counts)


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # for each width: (width * EMBEDDING) x FILTERS
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray
    #: Evidence of n windows is divided by this, and by n to this power, before it becomes a probability.
    heat: float = 1.0
    power: float = 0.0

    @classmethod
    def random(cls, labels: list[str], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
        filters = [draw(w * EMBEDDING, FILTERS, k=(w * EMBEDDING) ** -0.5) for w in WIDTHS]
        n = len(WIDTHS) * FILTERS
        return cls(labels, draw(256, EMBEDDING, k=0.5), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(n, len(labels), k=n**-0.5), np.zeros(len(labels), np.float32))

    def __getstate__(self) -> dict:
        """What is sent to the tasks: without the tables, which each makes for itself."""
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.dense, self.dense_bias]

    def pool(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Pooled features, and for each width the patches and the place of each maximum."""
        e = self.embedding[x]
        found, patches, places = [], [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            steps = WINDOW - w + 1
            patch = np.concatenate([e[:, i : i + steps] for i in range(w)], axis=2)
            out = (patch.reshape(-1, w * EMBEDDING) @ f).reshape(len(x), steps, FILTERS)
            place = out.argmax(axis=1)
            found.append(np.maximum(0, np.take_along_axis(out, place[:, None], 1)[:, 0] + b))
            patches.append(patch)
            places.append(place)
        return np.concatenate(found, axis=1), patches, places

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Embedding and filters folded: what each pair of bytes adds to the filters of width 2, and at the front and back of the wider ones."""
        part = lambda k, i: self.embedding @ self.filters[k][i * EMBEDDING : (i + 1) * EMBEDDING]
        pairs = lambda a, b: (a[:, None] + b[None]).reshape(1 << 16, -1)
        front = np.concatenate([pairs(part(1, 0), part(1, 1)), pairs(part(2, 0), part(2, 1))], axis=1)
        back = np.concatenate([pairs(part(1, 2), np.zeros((256, FILTERS), np.float32)), pairs(part(2, 2), part(2, 3))], axis=1)
        return pairs(part(0, 0), part(0, 1)), front, back

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of the labels of windows, by adding rows of the tables."""
        if getattr(self, "_tables", None) is None:
            self._tables = self.tables()
        two, front, back = self._tables
        out, bias = np.empty((len(x), len(self.labels)), np.float32), np.concatenate(self.bias)
        for at in range(0, len(x), 128):
            own = np.ascontiguousarray(x[at : at + 128].T).astype(np.int32)  # places x windows
            pair = own << 8
            pair[:-1] += own[1:]
            wide = np.take(front, pair[: WINDOW - 2], axis=0)
            wide += np.take(back, pair[2:], axis=0)
            best = [np.take(two, pair[: WINDOW - 1], axis=0).max(axis=0), wide[:, :, :FILTERS].max(axis=0), wide[: WINDOW - 3, :, FILTERS:].max(axis=0)]
            z = np.maximum(0, np.concatenate(best, axis=1) + bias) @ self.dense + self.dense_bias
            z -= z.max(axis=1, keepdims=True)
            out[at : at + 128] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean cross-entropy, in the order of parameters()."""
        feature, patches, places = self.pool(x)
        z = feature @ self.dense + self.dense_bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.dense.T) * (feature > 0)
        size = self.embedding.size
        embedding, filters, bias = np.zeros(size), [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            d = back[:, k * FILTERS : (k + 1) * FILTERS]
            rows = np.arange(len(x))[:, None]
            patch = patches[k][rows, places[k]]
            filters.append(np.einsum("nf,nfk->kf", d, patch))
            bias.append(d.sum(axis=0))
            for i in range(w):
                step = d[:, :, None] * f[i * EMBEDDING : (i + 1) * EMBEDDING].T[None]
                cell = x[rows, places[k] + i].astype(np.int64)[:, :, None] * EMBEDDING + np.arange(EMBEDDING)
                embedding += np.bincount(cell.ravel(), step.ravel(), minlength=size)
        return [embedding.reshape(self.embedding.shape).astype(np.float32), *filters, *bias, feature.T @ p, p.sum(axis=0)]


def train(pieces: list[bytes], y: np.ndarray, labels: list[str], epochs: int = 6, seed: int = 42) -> Network:
    """Fit a network with Adam on the windows of labelled byte strings, in at least some hundred steps."""
    x, owner = windows(pieces)
    epochs = max(epochs, -(-STEPS * 128 // len(x)))
    y = y[owner]
    net, rng = Network.random(labels, seed), np.random.default_rng(seed)
    mean = [np.zeros_like(p) for p in net.parameters()]
    square = [np.zeros_like(p) for p in net.parameters()]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            part = order[at : at + 128]
            step += 1
            for p, g, m, s in zip(net.parameters(), net.gradients(x[part], y[part]), mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _normal(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _sentence_scores(net: Network, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of byte strings (the sum over their windows, normalised), and the calibrated log-probabilities.

    Equal strings are scored once.
    """
    if not pieces:
        return (np.zeros((0, len(net.labels)), np.float64),) * 2
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(p, len(known)) for p in pieces])
    x, owner = windows(list(known))
    out = np.zeros((len(known), len(net.labels)), np.float64)
    score = net.scores(x)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    out[owner[starts]] = np.add.reduceat(score.astype(np.float64), starts, axis=0)
    many = np.bincount(owner)[:, None]
    return _normal(out)[which], _normal(out / (net.heat * many**net.power))[which]


def calibrate(net: Network, pieces: list[bytes], y: np.ndarray) -> None:
    """Set heat and power so that held-out labelled strings are most likely; a grid of a few hundred points."""
    known, _ = _sentence_scores(net, pieces)
    _, owner = windows(pieces)
    many = np.bincount(owner)[:, None]
    grid = [(h, p) for h in np.geomspace(0.5, 20, 24) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    loss = lambda h, p: -_normal(known / (h * many**p))[np.arange(len(y)), y].mean()
    net.heat, net.power = min(grid, key=lambda g: loss(*g))


def _units(text: str, odd: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, sentence) of a text; lines of an ``odd`` one are read as repaired, data runs are left out."""
    at = 0
    for line in text.split("\n"):
        body = repair_line(line)[0] if odd else line
        if len(body) > 60:
            body = DATA_RUN.sub(lambda m: " " * len(m[0]), body)
        ratio = len(line) / len(body) if len(body) else 1.0
        for a, b in sentences(body):
            if b - a > 1:
                yield at + int(a * ratio), at + int(b * ratio), body[a:b]
        at += len(line) + 1


def fit(labelled: DataFrame, text: str, label: str, rows: int = FIT_ROWS, seed: int = 42) -> Network | None:
    """Fit a network on at most ``rows`` texts of a known label, chosen by hash.

    Wrong labels are expected: sentences that a first network confidently gives another label are left out of
    the second fit. Every HELD_OUT-th text is kept from it, to calibrate the confidence. None if no text has a label.
    """
    known = labelled.filter(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(text).alias("t"), F.col(label).alias("l"))
    count = known.count()
    if not count:
        return None
    keep = F.pmod(F.xxhash64(F.lit(seed), "t"), F.lit(1 << 20)) < int(min(1.0, rows / count) * (1 << 20))
    sample = known.filter(keep).orderBy(F.xxhash64(F.lit(seed), "t"), "l").limit(rows).toPandas()
    if sample.empty:
        sample = known.limit(rows).toPandas()
    labels = sorted(sample["l"].unique())
    pieces, y, held = [], [], []
    for i, (body, name, odd) in enumerate(zip(sample["t"], sample["l"], suspects(sample["t"].tolist()), strict=True)):
        for _, _, s in _units(body, odd):
            pieces.append(s)
            y.append(labels.index(name))
            held.append(i % HELD_OUT == 0)
    use = letters_of(pieces) >= 6
    if not use.any():
        return None
    y, held, pieces = np.array(y)[use], np.array(held)[use], [s.strip().encode() for s, u in zip(pieces, use, strict=True) if u]
    first = train(pieces, y, labels, 3, seed)
    p, _ = _sentence_scores(first, pieces)
    fine = p[np.arange(len(y)), y] >= np.log(0.05)
    if not fine.any():
        return first
    some = fine & ~held if (fine & ~held).any() else fine
    net = train([s for s, u in zip(pieces, some, strict=True) if u], y[some], labels, 6, seed)
    if (fine & held).any():
        calibrate(net, [s for s, u in zip(pieces, fine & held, strict=True) if u], y[fine & held])
    return net


SEGMENT = "segment int, start_pos int, end_pos int, lang string, confidence double, letters int"


def segments(df: DataFrame, key: str, text: str, net: Network | None) -> DataFrame:
    """Each stretch of a text in one language: (key, segment, start_pos, end_pos, lang, confidence, letters).

    Sentences are classified by their windows; one that doesn't speak clearly against the text's main language
    belongs to it. Neighbouring sentences of a language form a segment, whose confidence is the mean calibrated
    probability by letters. Without a network (no text had a label) nothing can be told apart and no row comes out. Lines garbled by a wrong encoding are read as repaired; their positions are proportional. Data
    runs hold no letters.

    Null and empty texts, texts without letters and rows without a key give no row; repeated rows are
    classified each for itself; an empty table gives an empty result. Other columns aren't read.
    """
    shared = df.sparkSession.sparkContext.broadcast(net)
    columns = [key, "segment", "start_pos", "end_pos", "lang", "confidence", "letters"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                yield pd.DataFrame(of(batch["_key"].iloc[at : at + 256].tolist(), batch["_text"].iloc[at : at + 256].tolist()), columns=columns)

    def of(keys: list, texts: list[str]) -> list[tuple]:
        spans, owner, pieces = [], [], []
        if shared.value is None:
            return []
        for i, (body, odd) in enumerate(zip(texts, suspects(texts), strict=True)):
            for a, b, s in _units(body, odd):
                spans.append((a, b))
                owner.append(i)
                pieces.append(s)
        letters = letters_of(pieces)
        use = np.flatnonzero(letters).tolist()
        spans, owner, letters, pieces = [spans[k] for k in use], [owner[k] for k in use], letters[use], [pieces[k].strip().encode() for k in use]
        score, sure_of = _sentence_scores(shared.value, pieces)
        own, weight = np.array(owner), letters.astype(np.float64)
        rows = []
        for i in np.unique(own) if len(own) else []:
            mine = np.flatnonzero(own == i) if len(texts) < 3 else np.arange(*np.searchsorted(own, (i, i + 1)))
            p, n = score[mine], weight[mine]
            first = p.argmax(axis=1)
            main = int(np.bincount(first, weights=n, minlength=p.shape[1]).argmax())
            clear = (p[np.arange(len(p)), first] - p[:, main] >= EVIDENCE) & (n >= 6)
            lang = np.where(clear, first, main)
            cuts = np.flatnonzero(np.r_[True, lang[1:] != lang[:-1]])
            for k, (a, b) in enumerate(zip(cuts, np.r_[cuts[1:], len(lang)], strict=True)):
                sure = float((np.exp(sure_of[mine[a:b], lang[a:b]]) * n[a:b]).sum() / n[a:b].sum())
                rows.append((keys[i], k, spans[mine[a]][0], spans[mine[b - 1]][1], shared.value.labels[lang[a]], round(sure, 6), int(n[a:b].sum())))
        return rows

    some = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_key").isNotNull() & (F.length("_text") > 0))
    return spread(some).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {SEGMENT}")


def languages(found: DataFrame, key: str, share: float = 0.15) -> DataFrame:
    """(key, lang, share, confidence) of the languages with at least ``share`` of a text's letters."""
    per = found.groupBy(key, "lang").agg(F.sum("letters").alias("letters"), (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("confidence"))
    total = per.groupBy(key).agg(F.sum("letters").alias("total"), F.collect_list(F.struct("lang", "letters", "confidence")).alias("langs"))
    each = total.select(key, "total", F.explode("langs").alias("x")).select(key, "x.lang", (F.col("x.letters") / F.col("total")).alias("share"), "x.confidence")
    return each.filter(F.col("share") >= share)


def relabel(df: DataFrame, key: str, label: str, aliases: DataFrame, found: DataFrame, share: float = 0.15) -> DataFrame:
    """(key, label, lang, langs, confidence, changed): labels filled or corrected by the languages found.

    ``aliases`` (alias, lang) gives the code of each written label. ``lang`` is the label's code if the text is in
    that language, else the language with most letters; a text without letters keeps its code. Ties go to the
    first code; repeated rows of a key count once; null keys are left out.
    """
    codes = F.broadcast(aliases.filter(F.col("alias").isNotNull()).groupBy("alias").agg(F.min("lang").alias("_code")))
    own = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_label")).join(codes, F.col("_label") == codes["alias"], "left").drop("alias")
    per = languages(found, key, share).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "lang", "confidence"))).alias("_found"))
    joined = own.join(per, key, "left")
    langs = F.coalesce(F.transform("_found", lambda x: x["lang"]), F.array().cast(T.ArrayType(T.StringType())))
    main = F.get("_found", F.lit(0))
    lang = F.when(F.array_contains(langs, F.col("_code")) | (F.size(langs) == 0), F.col("_code")).otherwise(main["lang"])
    case = F.col("_code").isNull() | ~F.array_contains(langs, F.col("_code")) | (F.size(langs) > 1)
    return joined.select(key, F.col("_label").alias("label"), lang.alias("lang"), langs.alias("langs"), main["confidence"].alias("confidence"), F.coalesce(case, F.lit(True)).alias("changed"))
