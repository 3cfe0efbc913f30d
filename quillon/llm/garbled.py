"""Problem 10: text read with the wrong encoding, by best-first search over encode, decode and unescape steps.

A character-plausibility cost (of characters, of two kinds of characters side by side, and of escapes) finds suspicious
stretches in one vectorised pass; only those are searched. A state of the search is a text; a step encodes it
with one encoding and decodes the bytes with another, or undoes escapes. States are visited once, the one of the
lowest cost first, to which each step on the way adds what it has to save; dearer states than the first are searched too.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import spread

# The encodings texts are read with by mistake, and those they are written in.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8-r", "gbk", "cp949", "cp932", "euc_jp"]
WRITTEN_IN = ["utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "gbk", "cp949", "cp932", "euc_jp", "mac_roman"]

# Kinds of characters.
(LETTER, PLAIN, LOW, UP, SIGN, OPEN, CLOSE, RU, RU_UP, CYR, GREEK, HAN, HAN_RARE, KANA, HALF, HANGUL, HANGUL_RARE, WIDE, BROKEN, SYMBOL, OTHER, CAPITAL, BLANK, LIKE) = range(24)

MULTIBYTE = {"gbk", "cp949", "cp932", "euc_jp"}

#: Most states that a search expands and most steps on the way to one, and the saving from which a repair counts.
EXPANSIONS, DEPTH, MARGIN = 24, 4, 2.0
#: States dearer than the best so far by more than this share of the first one's cost aren't queued.
DEARER = 0.25
#: Cost of the escape of a character beyond ASCII.
ESCAPED = 4.0


def _common(codec: str, first: range, second: range, keep) -> list[int]:
    """Codepoints of the two-byte characters of a codec in the given rows that satisfy ``keep``."""
    out = []
    for a in first:
        for b in second:
            try:
                c = bytes((a, b)).decode(codec)
            except UnicodeDecodeError:
                continue
            if len(c) == 1 and keep(ord(c)):
                out.append(ord(c))
    return out


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of each character of the basic plane, cost of each kind, and cost of two kinds side by side."""
    kind = np.full(0x10000, OTHER, dtype=np.uint8)
    kind[:0x80] = PLAIN
    kind[0x20] = BLANK
    kind[0x41:0x5B], kind[0x61:0x7B] = CAPITAL, LETTER
    kind[0x80:0xA0] = BROKEN
    kind[0xA0:0xC0] = SIGN
    for c in range(0xC0, 0x250):
        kind[c] = LOW if unicodedata.category(chr(c)) == "Ll" else UP if unicodedata.category(chr(c)) == "Lu" else SIGN
    kind[[ord(c) for c in "ÿþýðÞÝÐ"]] = np.where([c.islower() for c in "ÿþýðÞÝÐ"], LOW, UP)
    kind[0x180:0x218] = kind[0x21C:0x250] = SYMBOL
    kind[0x2B0:0x300] = SIGN
    kind[0x370:0x400] = GREEK
    kind[0x400:0x530] = CYR
    for c in "абвгдежзийклмнопрстуфхцчшщъыьэюяё":
        kind[ord(c)], kind[ord(c.upper())] = RU, RU_UP
    kind[0x2010:0x2040] = SIGN
    kind[[ord(c) for c in "¿¡«“‘„‹"]] = OPEN
    kind[[ord(c) for c in "»”’›…–—·"]] = CLOSE
    kind[[0xA0, 0x2007, 0x2009, 0x202F]] = CLOSE
    kind[0x20A0:0x2600] = SYMBOL
    kind[0x20AC] = kind[0x2122] = SIGN
    kind[[0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF, 0xAD]] = OTHER
    kind[0x2600:0x2C00] = OTHER
    kind[0x3000:0x3040] = WIDE
    kind[0x3200:0x3400] = SYMBOL
    kind[0x3040:0x3100] = KANA
    kind[0x3400:0xA000] = HAN_RARE
    kind[0xAC00:0xD7B0] = HANGUL_RARE
    kind[0xE000:0xF900] = BROKEN
    kind[0xFF00:0xFF61] = WIDE
    kind[0xFF61:0xFFA0] = HALF
    kind[0xFFFD] = BROKEN
    han = lambda c: 0x4E00 <= c < 0xA000
    kind[_common("gb2312", range(0xB0, 0xD8), range(0xA1, 0xFF), han)] = HAN
    kind[_common("euc_jp", range(0xB0, 0xD0), range(0xA1, 0xFF), han)] = HAN
    kind[_common("euc_kr", range(0xB0, 0xC9), range(0xA1, 0xFF), lambda c: 0xAC00 <= c < 0xD7B0)] = HANGUL
    base = np.zeros(24)
    for k, cost in {LOW: 0.6, UP: 0.9, SIGN: 1.5, OPEN: 0.5, CLOSE: 0.3, RU: 0.4, RU_UP: 0.5, CYR: 2.5, GREEK: 1.5, HAN: 0.5, HAN_RARE: 2.2, KANA: 0.4, HALF: 1.8, HANGUL: 0.5, HANGUL_RARE: 2.2, WIDE: 0.3, BROKEN: 5.0, SYMBOL: 2.5, OTHER: 0.6}.items():
        base[k] = cost
    pair = np.zeros((24, 24))
    latin, accents, signs = (LETTER, CAPITAL, LOW, UP), (LOW, UP), (SIGN, OPEN, BROKEN, SYMBOL)
    for a in accents:
        for b in signs:
            pair[a, b] += 1.5
    pair[UP, OTHER] = 1.5  # a soft hyphen is also the second byte of a letter
    pair[LOW, LOW] = pair[UP, UP] = 0.5
    pair[UP, LOW] = 1.2
    for a in latin:
        for b in (HAN, HAN_RARE, HANGUL, HANGUL_RARE, KANA):
            pair[a, b] += 0.8
            pair[b, a] += 0.8
    for a in (LETTER, LOW):
        pair[a, UP] += 1.5
        pair[a, RU_UP] += 1.5
    pair[RU, RU_UP] += 2.0
    pair[RU_UP, RU_UP] += 0.3
    for a in latin:
        for b in (SIGN, SYMBOL, OPEN):
            pair[a, b] += 1.5
        for b in (RU, RU_UP, CYR, GREEK, HALF):
            pair[a, b] += 2.2
            pair[b, a] += 2.2
    for a in (SIGN, SYMBOL, BROKEN):
        for b in latin:
            pair[a, b] += 1.0
        for b in signs:
            pair[a, b] += 1.0
        for b in (RU, RU_UP, CYR, HAN, HAN_RARE, HANGUL, KANA):
            pair[a, b] += 1.5
            pair[b, a] += 1.5
    for a in (UP, LOW):
        for b in (OPEN, CLOSE):
            pair[b, a] += 0.3
    for b in (CLOSE, OPEN):
        pair[UP, b] += 0.5
        pair[RU, b] += 0.3
        pair[RU_UP, b] += 1.5
        pair[b, RU] += 1.0
    pair[CLOSE, CLOSE] += 0.5
    for a in (HAN, HAN_RARE, KANA):
        pair[a, BLANK] += 0.6
        pair[BLANK, a] += 0.6
    pair[HAN_RARE, HAN_RARE] += 0.6
    pair[HANGUL_RARE, HANGUL_RARE] += 0.6
    for a in (HANGUL, HANGUL_RARE):
        for b in (HAN, HAN_RARE):
            pair[a, b] += 0.8
            pair[b, a] += 0.8
    for a in (HALF, KANA, HAN, HAN_RARE):
        pair[HALF, a] += 0.3
        pair[a, HALF] += 0.3
    pair[BROKEN, BROKEN] += 1.0
    return kind, base, pair


def char_costs(text: str) -> np.ndarray:
    """Cost of each character, with that of standing behind the one before it."""
    kind, base, pair = tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    k = np.where(codes < 0x10000, kind[np.minimum(codes, 0xFFFF)], OTHER)
    cost = base[k]
    cost[1:] += pair[k[:-1], k[1:]]
    return cost


def costs_of(texts: list[str], before: str = "", after: str = "") -> np.ndarray:
    """Costs of texts between their neighbours, with that of escapes."""
    kind, base, pair = tables()
    whole = [before + t + after for t in texts]
    length = np.array([len(t) for t in whole])
    codes = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    k = np.where(codes < 0x10000, kind[np.minimum(codes, 0xFFFF)], OTHER)
    cost = base[k]
    cost[1:] += pair[k[:-1], k[1:]]
    at = np.cumsum(length) - length
    first = at[(at > 0) & (length > 0)]
    cost[first] = base[k[first]]
    sums = np.cumsum(np.r_[0.0, cost])
    out = sums[at + length] - sums[at]
    for i, t in enumerate(texts):
        if "&" in t or "\\u" in t:
            out[i] += ESCAPED * sum(map(_is_escape, ESCAPE.finditer(t)))
    return out


def cost_of(text: str, before: str = "", after: str = "") -> float:
    """Cost of a text between its neighbours."""
    return float(costs_of([text], before, after)[0])


def _encode(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        if codec != "cp1252":
            return None
    try:  # bytes that the code page leaves open are read as control characters
        return b"".join(c.encode("latin-1") if "\x80" <= c <= "\x9f" else c.encode("cp1252") for c in text)
    except UnicodeEncodeError:
        return None


ESCAPE = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,31});|\\u[0-9a-fA-F]{4}")


def _opened(m: re.Match) -> str:
    new = chr(int(m[0][2:], 16)) if m[0][0] == "\\" else html.unescape(m[0])
    return new if len(new) == 1 and not new.isascii() and not "\ud800" <= new <= "\udfff" else m[0]


def _is_escape(m: re.Match) -> bool:
    """Whether a match stands for a character beyond ASCII; &amp; and the like are markup."""
    return _opened(m) != m[0]


def unescape(text: str) -> str:
    """Undo character references and \\u escapes of characters beyond ASCII."""
    return ESCAPE.sub(_opened, text) if "&" in text or "\\u" in text else text


def _bytes_of(state: str) -> Iterator[tuple[str, bytes]]:
    """The encodings that can have been read, with the bytes; equal bytes once."""
    seen: set[bytes] = set()
    for read in READ_AS:
        raw = _encode(state, read)
        if raw is not None and raw not in seen:
            seen.add(raw)
            yield read, raw


def _steps(state: str) -> Iterator[tuple[str, str, float]]:
    """(text, step, saving asked for) of the next states.

    Bytes that are valid UTF-8 are hardly so by chance; other encodings accept almost anything, so they
    have to save more, and short texts are left alone.
    """
    plain = unescape(state)
    if plain != state:
        yield plain, "unescape", 0.5
    signs = [c for c in state if c > "\x7f"]
    wide = len(signs)
    if all(c in LOOK_ALIKE for c in signs):
        return
    raws, certain = list(_bytes_of(state)), False
    for read, raw in raws:
        if read in MULTIBYTE and wide < 4:
            continue
        try:
            new = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if new != state:
            certain = True
            yield new, f"{read}>utf-8", 1.0
    if certain:
        return
    yield from _letters(state)
    if wide < 6:
        return
    for read, raw in raws:
        for written in WRITTEN_IN[1:]:
            if written != read:
                try:
                    yield raw.decode(written), f"{read}>{written}", max(6.0, 0.25 * wide)
                except UnicodeDecodeError:
                    pass


# Letters of other scripts that look like Latin ones; a word spelt with them is no case.
LOOK_ALIKE = set("асеорхуіјѕһԁԛԝАВЕКМНОРСТХУІЈЅοναιυρκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")


def _letters(state: str) -> Iterator[tuple[str, str, float]]:
    """For a few characters inside Latin words: one-byte encodings that turn all of them into accented small letters."""
    if not any(c.isascii() and c.isalpha() for c in state) and len(state) > 2:
        return
    wide = [c for c in state if c > "\x7f"]
    if not wide or all(c in LOOK_ALIKE for c in wide):
        return
    for read in ("cp1251", "cp437", "cp850", "mac_roman", "koi8-r"):
        raw = _encode(state, read)
        new = raw.decode("cp1252", "replace") if raw is not None else state
        if new != state and all(c in ACCENTED for c in new if c > "\x7f"):
            yield new, f"{read}>cp1252", 1.5


#: Fixed value: the small accented letters of the Latin-script languages.
ACCENTED = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüÿœß’")


@lru_cache(maxsize=4096)
def search(text: str, before: str = "", after: str = "") -> tuple[str, float, list[str]]:
    """The cheapest text reachable, its cost, and the steps that lead there: best first, each state once."""
    start = cost_of(text, before, after)
    best, least = (text, start, []), start
    heap, visited, tick = [(start, 0, text, [], 0.0)], {text}, 0
    for _ in range(EXPANSIONS):
        if not heap or heap[0][0] > least + DEARER * start:
            break
        _, _, state, steps, paid = heapq.heappop(heap)
        if len(steps) >= DEPTH:
            continue
        found = []
        for new, step, saving in _steps(state):
            if new not in visited:
                visited.add(new)
                found.append((new, step, paid + saving))
        for (new, step, asked), c in zip(found, costs_of([f[0] for f in found], before, after).tolist() if found else [], strict=True):
            total = c + asked
            if total < least:
                best, least = (new, c, [*steps, step]), total
            if total <= least + DEARER * start:
                tick += 1
                heapq.heappush(heap, (total, tick, new, [*steps, step], asked))
    return best


def search_lossy(text: str, before: str = "", after: str = "") -> tuple[str, float, list[str]]:
    """As search, for a text that lost bytes: what can't be encoded is dropped, what can't be decoded stays marked."""
    best = (text, cost_of(text, before, after), [])
    for read in sorted(READ_AS, key=lambda r: r not in MULTIBYTE):
        kept = text.replace("�", "")
        raw = kept.encode(read, "ignore")
        if len(raw) < len(text) / 2 or raw.isascii() or sum(c > "\x7f" for c in kept) < 6:
            continue
        new = raw.decode("utf-8", "replace")
        whole = sum("\x7f" < c != "�" for c in new)
        if whole >= max(4, 0.6 * new.count("�")):  # that much valid UTF-8 isn't chance
            return new, min(best[1] / 2, cost_of(new, before, after)), [f"{read}>utf-8 lossy"]
        likely = {"cp932": ["euc_jp"], "cp949": [], "gbk": [], "euc_jp": []}.get(read, WRITTEN_IN[5:9])
        for written in (w for w in likely if w != read):
            new = raw.decode(written, "replace")
            c = cost_of(new, before, after)
            if written not in ("cp932", "euc_jp"):
                c += 0.6 * sum("\u3040" <= x < "\u3100" for x in new)  # kana are written in Japanese encodings
            if new.replace("�", "") != kept and c < 0.6 * best[1]:
                best = (new, c, [f"{read}>{written} lossy"])
    return best


RUN = re.compile(r"[^\x00-\x7f]+(?:[ -~]{1,3}[^\x00-\x7f]+)*")
QUOTED = re.compile(r"(?<![^\s(\[\"'])[^\x00-\x7f\s]{2,4}(?![^\s.,:;!?)\]\"'])")
#: Fixed value: signs that never stand between blanks in running text.
NEVER_ALONE = set("’‘‚‛´`¨¸ˆ˜“”„‟‹›«»¿¡ºª")
WORD_RUN = re.compile(r"[^\x00-\x7f]+")
#: A character as dear as this, or a line or so many wide characters in a row as dear as that by character, is looked at.
HOT, HOT_LINE, WINDOW = 2.4, 0.9, 6


def _quotes(new: str) -> bool:
    """Whether what a token of its own stands for is quoted: a letter, or a sign that never stands alone in a text."""
    return len(new) == 1 and (new.isalpha() or new in NEVER_ALONE)


def _dense(text: str, cost: np.ndarray) -> np.ndarray:
    """First and last place of each WINDOW wide characters in a row that are dear by character."""
    wide = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) > 0x7F)
    if len(wide) < WINDOW:
        return np.zeros((0, 2), dtype=np.int64)
    sums = np.cumsum(np.r_[0.0, cost[wide]])
    at = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= HOT_LINE * WINDOW - 1e-9)
    return np.stack([wide[at], wide[at + WINDOW - 1]], axis=1)


def _dense_spans(line: str, cost: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of whole words in which wide characters are dear, without the cheap words at their ends."""
    spans = _dense(line, cost)
    if not len(spans):
        return []
    heads = np.flatnonzero(np.r_[True, spans[1:, 0] > spans[:-1, 1]])  # windows that overlap are one stretch
    out: list[tuple[int, int]] = []
    for a, b in zip(spans[heads, 0].tolist(), spans[np.r_[heads[1:], len(spans)] - 1, 1].tolist(), strict=True):
        dear = np.flatnonzero(cost[a : b + 1] >= HOT_LINE)
        if not len(dear):
            continue
        a, b = a + int(dear[0]), a + int(dear[-1]) + 1
        while a and not line[a - 1].isspace():
            a -= 1
        while b < len(line) and not line[b].isspace():
            b += 1
        if out and a <= out[-1][1] + 1:
            out[-1] = (min(a, out[-1][0]), max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans(line: str, cost: np.ndarray) -> list[list[tuple[int, int]]]:
    """Ways to choose what to repair in a line: all of it, all from the first to the last hot character, each run, each short run, each dense stretch."""
    hot = np.flatnonzero(cost >= HOT)
    ways = [[(0, len(line))]]
    if len(hot):
        ways.append([(max(0, int(hot[0]) - 1), int(hot[-1]) + 1)])
    ways += [[m.span() for m in RUN.finditer(line)], [m.span() for m in WORD_RUN.finditer(line)]]
    if dense := _dense_spans(line, cost):
        ways.append(dense)
    return ways


def repair_line(line: str) -> tuple[str, list[str], int, int]:
    """(line, steps, garbled stretches, those that look quoted) after the cheapest repair of a line.

    A line whose only garbled characters are a token of its own that stands for one letter or sign quotes them.
    """
    cost = char_costs(line)
    escapes = sum(map(_is_escape, ESCAPE.finditer(line))) if "&" in line or "\\u" in line else 0
    total, wide = float(cost.sum()) + ESCAPED * escapes, sum(c > "\x7f" for c in line)
    if not escapes and (not wide or total < MARGIN or (cost.max() < HOT and total < HOT_LINE * wide and not len(_dense(line, cost)))):
        return line, [], 0, 0
    bare = QUOTED.sub(lambda m: "x" if _quotes(search(m[0], " ", " ")[0]) else m[0], line)
    if bare != line and not repair_line(bare)[2]:
        return line, [], 1, 1
    best, least, how, count, quoted = line, total, [], 0, 0
    tried: set[tuple] = set()
    for way in _spans(line, cost):
        if tuple(way) in tried:
            continue
        tried.add(tuple(way))
        parts, at, steps, n, q = [], 0, [], 0, 0
        for a, b in way:
            before, after = line[a - 1 : a], line[b : b + 1]
            own = cost_of(line[a:b], before, after)
            new, c, did = search(line[a:b], before, after)
            if own - c < max(MARGIN * 0.75, 0.3 * own) and "�" in line[a:b]:
                new, c, did = search_lossy(line[a:b], before, after)
            if own - c >= max(MARGIN * 0.75, 0.3 * own) and new:
                q += bool(QUOTED.fullmatch(line[max(0, a - 1) : b + 1].strip() if len(line[a:b]) < 5 else "")) and _quotes(new)
                parts += [line[at:a], new]
                at, steps, n = b, steps + did, n + 1
        fixed = "".join(parts) + line[at:]
        c = cost_of(fixed)
        if n and c < least - 0.5:
            best, least, how, count, quoted = fixed, c, steps, n, q
            if c < 0.75 * sum(x > "\x7f" for x in fixed):
                break
    return best, list(dict.fromkeys(how)), count, quoted


def repair(text: str) -> tuple[str, bool, str, str]:
    """(text, whether it was garbled, 'none', 'partial' or 'full' repair, steps).

    Single letters and signs that stand alone, and lost characters beside such, are taken for quoted examples and left.
    """
    if not text or text.isascii() and "&" not in text and "\\u" not in text:
        return text, False, "none", ""
    lines, steps, strong, lost, found_lost = text.split("\n"), [], 0, 0, 0
    for i, line in enumerate(lines):
        if line.isascii() and not any(map(_is_escape, ESCAPE.finditer(line))):
            continue
        new, did, n, quoted = repair_line(line)
        if n > quoted:
            lines[i] = new
            steps += did
            strong += n - quoted
            found_lost += new.count("�")
        elif "�" in line:
            signs = [w for w in line.split() if w != "�" and "�" in w]
            if signs or not quoted:
                lost += 1
    if not strong and not lost:
        return text, False, "none", ""
    kind = "none" if not strong else "partial" if lost or found_lost else "full"
    return "\n".join(lines), True, kind, "; ".join(dict.fromkeys(steps))


def suspects(texts: list[str]) -> np.ndarray:
    """Which texts hold a line that could be worth a search: one vectorised pass over all of them."""
    found = np.array(["&" in t and any(map(_is_escape, ESCAPE.finditer(t))) or "\\u" in t and any(map(_is_escape, ESCAPE.finditer(t))) for t in texts], dtype=bool)
    some = [i for i, t in enumerate(texts) if not found[i] and not t.isascii()]
    at = 0
    while at < len(some):
        stop, size = at, 0
        while stop < len(some) and (stop == at or size + len(texts[some[stop]]) < 1_000_000):
            size += len(texts[some[stop]])
            stop += 1
        rows, at = some[at:stop], stop
        whole = "\n".join(texts[i] for i in rows)
        cost = char_costs(whole)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        length = np.array([len(texts[i]) for i in rows]) + 1
        owner = np.repeat(np.arange(len(rows)), length)[:-1]
        marks = np.bincount(owner[cost >= HOT], minlength=len(rows)) > 0
        spans = _dense(whole, cost)
        spans = spans[owner[spans[:, 0]] == owner[spans[:, 1]]]
        marks[owner[spans[:, 0]]] = True
        starts = np.r_[0, np.flatnonzero(codes == 10) + 1]
        starts = starts[starts < len(codes)]
        sums, wide = np.add.reduceat(cost, starts), np.add.reduceat((codes > 0x7F).astype(np.int64), starts)
        marks[owner[starts[(wide > 0) & (sums >= HOT_LINE * 0.8 * wide)]]] = True
        found[np.array(rows)[marks]] = True
    return found


def suspicious(text: str) -> bool:
    """Whether any line of a text could be worth a search."""
    return bool(suspects([text])[0])


def repair_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """The garbled texts of ``df``, restored where possible: (key, text, repaired, restored, steps).

    ``restored`` is 'full', 'partial' (bytes were lost) or 'none' (nothing could be restored); ``steps`` lists the
    conversions ("unescape" alone: only escapes were undone, no encoding was wrong). Texts that aren't garbled, empty and null texts and rows without a key give no row; repeated rows are
    repaired each for itself; an empty table gives an empty result. Other columns aren't read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            own = batch[suspects(batch["_text"].tolist())]
            for k, body in zip(own["_key"], own["_text"], strict=True):
                new, garbled, kind, steps = repair(body)
                if garbled:
                    rows.append((k, body, new, kind, steps))
            yield pd.DataFrame(rows, columns=[key, "text", "repaired", "restored", "steps"])

    some = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_key").isNotNull() & (F.length("_text") > 0))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, text string, repaired string, restored string, steps string"
    return spread(some).mapInPandas(run, schema)
