"""Problem 4: variant spellings of person and organisation names, by metric-space partitioning.

A name is parsed into keys (given name and surname, initial and surname, or words and kind of organisation). Keys of
a class and length are a cell; a cell with too many is divided by pivots, again and again: a key goes home to the
nearest pivot, and is copied to those it lies near, by the triangle inequality of the Damerau-Levenshtein metric, so
that every pair within the radius meets in the home cell of either key. Names are linked through their keys, and
connected links are one entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.lookalike import OTHER, one_form, skeleton
from quillon.operators.components import components
from quillon.operators.skew import HOT, look_up
from quillon.session import discard, materialise, spread

#: Home keys of a cell, pivots that divide a larger one, and how often a cell is divided before its keys are dealt to blocks.
CELL_KEYS, PIVOTS, LEVELS = 512, 16, 6
#: Tables of given names up to this many rows are broadcast.
SMALL_ROWS = 1_000_000

# Short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha sascha xander al", "andreas": "andi", "anthony": "tony", "benjamin": "ben benny benji", "catherine": "cathy kate kitty",
    "charles": "charlie chuck", "christina": "tina chris", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave", "dorothea": "dora thea dorothy dot",
    "edward": "ed eddie ted ned", "eleanor": "ellie nell nora", "elizabeth": "liz beth lizzie betty eliza lisa", "francisco": "paco pancho cisco kiko", "frederick": "fred freddy",
    "gabriele": "gabi gaby", "george": "georgie", "gregory": "greg", "henrietta": "hetty etta hattie henny", "isabella": "isa bella izzy bell", "james": "jim jimmy jamie",
    "johannes": "hannes hans jo", "john": "jack johnny", "jonathan": "jon nathan", "joseph": "joe joey", "katharina": "kathi kati kathy katja käthe", "leonardo": "leo nardo",
    "margaret": "maggie peggy meg marge greta", "matthew": "matt", "michael": "mike mick", "nicholas": "nick nicky", "nikolai": "kolya kolja nick niko", "patricia": "pat patty tricia trish",
    "rebecca": "becky", "richard": "dick rick rich", "robert": "bob rob bobby robbie bert", "samuel": "sam sammy", "stephen": "steve", "susanne": "susi sue", "theodora": "thea dora",
    "theodore": "ted theo teddy", "thomas": "tom tommy", "ulrike": "ulli uli rike", "victoria": "vicky vicki tori vic", "walter": "walt", "wilhelm": "willi", "william": "bill will billy willy liam",
    "zacharias": "zach zack zac",
}
# Titles, legal forms and kinds of organisations.
TITLES = set("dr mr mrs ms prof sir dame".split())
LEGAL = set("inc ltd limited llc gmbh ag bv sa co corp corporation company incorporated plc kg nv".split())
KINDS = "analytics engineering international laboratories logistics research software systems technologies solutions consulting services industries holdings partners group foundation institute".split()
SHORT = {"labs": "laboratories", "tech": "technologies", "intl": "international", "sys": "systems", "eng": "engineering"}
# Beginnings of surnames behind which a capital may follow.
PREFIXES = set("mc mac o' d' l' de del di du la le van von fitz st".split())

CANONICAL: dict[str, list[str]] = {}
for _full, _short in NICKNAMES.items():
    for _n in _short.split():
        CANONICAL.setdefault(_n, []).append(_full)


def distance(a: str, b: str, most: int | None = None) -> int:
    """Damerau-Levenshtein distance (insertions, deletions, substitutions, swaps, with edits between swapped letters): a metric."""
    if a == b:
        return 0
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    last: dict[str, int] = {}
    big = len(a) + len(b)
    h = [[big] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        h[i + 1][1] = i
    for j in range(len(b) + 1):
        h[1][j + 1] = j
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            row, col = last.get(b[j - 1], 0), column
            same = a[i - 1] == b[j - 1]
            if same:
                column = j
            h[i + 1][j + 1] = min(h[i][j] + (not same), h[i + 1][j] + 1, h[i][j + 1] + 1, h[row][col] + (i - row - 1) + 1 + (j - col - 1))
        last[a[i - 1]] = i
    return h[-1][-1]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codepoints of strings as the rows of a matrix (0 behind their ends), and their lengths."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros((len(words), int(length.max(initial=0))), dtype=np.uint32)
    out[np.arange(out.shape[1]) < length[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    return out, length


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Damerau-Levenshtein distance of each row of codes ``a`` to the same row of ``b``, all rows at once."""
    n, m, k = len(a), a.shape[1], b.shape[1]
    big, every = m + k, np.arange(n)
    h = np.full((k + 2, m + 2, n), big, dtype=np.int16)
    h[1:, 1] = np.arange(k + 1)[:, None]
    h[1, 1:] = np.arange(m + 1)[:, None]
    columns, other = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    above = np.zeros((m + 1, n), dtype=np.int16)  # the last row so far whose letter is that of each column
    for i in range(1, k + 1):
        column = np.zeros(n, dtype=np.int16)
        for j in range(1, m + 1):
            row, same = above[j], columns[j - 1] == other[i - 1]
            swap = h[row, column, every] + (i - row) + (j - column - 1)
            h[i + 1, j + 1] = np.minimum(np.minimum(h[i, j] + ~same, h[i + 1, j] + 1), np.minimum(h[i, j + 1] + 1, swap))
            column = np.where(same, np.int16(j), column)
            above[j] = np.where(same, np.int16(i), row)
    return h[lb + 1, la + 1, every].astype(np.int32)


def one_edit(a: str, b: str) -> bool:
    """Whether two strings are at most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    short = min(len(a), len(b))
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k in range(short) if a[k] != b[k]), short)
    j = next((k for k in range(short - i) if a[-1 - k] != b[-1 - k]), short - i)
    if len(a) != len(b):
        return i + j >= short
    middle = short - i - j
    return middle <= 1 or middle == 2 and a[i] == b[i + 1] and a[i + 1] == b[i]


@lru_cache(maxsize=1 << 16)
def kind_of(word: str) -> str | None:
    """The kind of organisation that a word stands for: itself, three or more of its first letters, or its first letter and later consonants."""
    if word in KINDS:
        return word
    if word in SHORT:
        return SHORT[word]
    if 2 <= len(word) <= 5 and word.isalpha():
        for k in KINDS:
            rest = iter(k)
            if len(word) > 2 and k.startswith(word) or k[0] == word[0] and not set(word[1:]) & set("aeiou") and all(c in rest for c in word):
                return k
    return None


@lru_cache(maxsize=1 << 16)
def _near_kind(word: str) -> str | None:
    """As kind_of, also for a word with one typing error."""
    return kind_of(word) or next((k for k in KINDS if len(word) > 5 and one_edit(word, k)), None)


@lru_cache(maxsize=1 << 16)
def _joined(word: str) -> tuple[str, str] | None:
    """(first word, kind) of a word that ends in a kind of organisation, with at most one typing error in it."""
    for k in KINDS:
        if word.endswith(k) and len(word) > len(k) + 3:
            return word[: -len(k)], k
    for k in KINDS:
        for cut in (len(k), len(k) - 1, len(k) + 1):
            if len(word) > cut + 4 and one_edit(word[-cut:], k):
                return word[:-cut], k
    return None


WORD = re.compile(r"[^\W\d_]+")
#: Characters of which one stands for a syllable or a word: a single other one makes another name.
DENSE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
INNER = re.compile(r"([^\W\d_]*[a-z'])(?=[A-Z])")


def _weigh(word: str) -> str:
    """A word in which every dense character stands twice, so that another one in its place is two edits."""
    return DENSE.sub(lambda m: m[0] * 2, word)


def _odd_capitals(word: str) -> bool:
    """Whether a capital follows a small letter that doesn't end a surname's beginning."""
    return any(m[1].lower() not in PREFIXES for m in INNER.finditer(word)) and word != "GmbH"


def _full(word: str) -> list[str]:
    """Full given names that a word can stand for, itself aside."""
    return CANONICAL.get(word, [])


COLUMNS = ["form", "first", "second", "comma", "kind", "kind_first", "fixed_1", "fixed_2", "full_1", "full_2", "full_nick"]
SCHEMA = "form string, first string, second string, comma boolean, kind string, kind_first boolean, fixed_1 boolean, fixed_2 boolean, full_1 array<string>, full_2 array<string>, full_nick array<string>"


def parse(name: str) -> tuple | None:
    """What a name can be, as a row of COLUMNS; None for codes, paths and other names of things.

    Forms: 'I' initial and surname, 'O' words and kind of organisation (the kind is empty where only a legal form
    tells), 'R' first word alone, 'W' three and more words, and '2': two words (or a given name of two and a surname),
    a person or an organisation, depending on which given names there are. Any script is read; digits only
    with a legal form.
    """
    text = skeleton(name)
    if OTHER.search(text):  # a name in another script stays in it
        text = one_form(name)[0].strip()
    text = re.sub(r"\b([A-Za-z])\.(?=[A-Za-z]\.)", r"\1", text)  # A.G. and B.V. are words
    nick = re.search(r"\(([^()]*)\)", text)
    plain = re.sub(r"\([^()]*\)", " ", text).strip()
    if not plain or re.search(r"[_/\\@:#]", plain):
        return None
    comma = "," in plain
    cased = [t for t in re.split(r"[\s,\-]+", plain) if t]
    tokens = [unicodedata.normalize("NFC", t.lower()) for t in cased]
    tokens = [t for t in tokens if t.rstrip(".") not in TITLES or len(tokens) < 2]
    tokens = tokens[1:] if tokens and tokens[0] == "the" else tokens
    bare = [t.rstrip(".") for t in tokens]
    legal = any(b in LEGAL for b in bare)
    core = [b for b in bare if b and b not in LEGAL]
    if not core:
        return None
    odd = any(map(_odd_capitals, cased))
    digits = any(c.isdigit() for c in plain)

    def row(form, first, second="", kind=None, kind_first=False, nick_of=""):
        first_word = first.split(" ")[0]
        return (
            form, _weigh(first), _weigh(second), comma, kind, kind_first, first_word in NICKNAMES, second in NICKNAMES,
            [" ".join([f, *first.split(" ")[1:]]) for f in _full(first_word)], _full(second), _full(nick_of),
        )

    kinds = [(i, k) for i, b in enumerate(core) if len(core) > 1 for k in [_near_kind(b)] if k]
    if legal or len(core) > 2 and kinds and kinds[-1][0] == len(core) - 1:  # an organisation, by its legal form or its last word
        if kinds and len(core) == 2:
            i, k = kinds[0] if comma and kinds[0][0] == 0 else kinds[-1]
            return row("O", core[1 - i], k)
        if kinds and kinds[-1][0] == len(core) - 1:
            return row("O", " ".join(core[:-1]), kinds[-1][1])
        if len(core) == 1 and (found := _joined(core[0])):
            return row("O", *found)
        return row("R", core[0]) if len(core) == 1 else row("O", " ".join(core))
    if digits or odd and not kinds:
        return None
    if len(core) == 1 and "." not in plain.strip("."):
        word = core[0]
        if found := _joined(word):
            return row("O", *found)
        if len(word) < 5 or not plain.lower() != plain.upper():
            return None
        return row("I", word[0], word[1:]) if plain.islower() else row("R", word)
    if len(core) == 1 and plain.count(".") == 1:
        core = plain.lower().split(".")
    if not all(WORD.fullmatch(c.replace("'", "").replace("’", "")) for c in core):
        return None
    initials = [c for c in core if len(c) == 1 and not DENSE.match(c)]
    words = [c for c in core if c not in initials]
    if len(words) == 1 and len(initials) == 1 and len(words[0]) > 1:
        return row("I", initials[0], words[0])
    if len(words) == 2 and len(initials) < 2:
        i, k = (kinds[0] if comma and kinds[0][0] == 0 else kinds[-1]) if kinds and not initials else (0, None)
        return row("2", words[0], words[1], k, k is not None and i == 0, nick[1].lower() if nick else "")
    if len(words) > 2:
        given = words[1:] + words[:1] if comma else words
        return row("W", " ".join(given[:-1]), given[-1])
    return None


def _divide(radius: int):
    """mapInPandas: rows with the pivots of their cell to a row in the home cell, and copies in the cells that they lie near."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                yield of(batch.iloc[at : at + 2048])

    def of(own: pd.DataFrame) -> pd.DataFrame:
        keys, pivots = own["key"].to_numpy(object), own["pivots"].tolist()
        many = np.array([len(p) for p in pivots])
        who = np.repeat(np.arange(len(own)), many)
        heads = np.cumsum(many) - many
        codes, length = _codes(keys.tolist())
        known: dict[str, int] = {}
        which = np.array([known.setdefault(x, len(known)) for p in pivots for x in p])
        others, lengths = _codes(list(known))
        d = distances(codes[who], length[who], others[which], lengths[which])
        near = np.flatnonzero(d <= np.minimum.reduceat(d, heads)[who] + 2 * radius)
        # home is the first of the nearest
        place = np.arange(len(who)) - heads[who]
        first = np.minimum.reduceat(d.astype(np.int64) * 64 + place, heads)
        home = own["home"].to_numpy(bool)[who] & (d.astype(np.int64) * 64 + place == first[who])
        cell, cls = own["cell"].to_numpy(object), own["cls"].to_numpy(object)
        return pd.DataFrame({"cls": cls[who[near]], "cell": [f"{c}.{w}" for c, w in zip(cell[who[near]], place[near].tolist(), strict=True)], "home": home[near], "key": keys[who[near]]})

    return run


def _join(radius: int):
    """mapInPandas over cells: exact radius join of home keys with all keys of the cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        for _, own in pd.concat(got).groupby("cell"):
            own = own.sort_values("home", ascending=False).drop_duplicates("key")
            keys, home = own["key"].to_numpy(object), own["home"].to_numpy(bool)
            codes, length = _codes(keys.tolist())
            place = np.where(codes > 0, codes % np.uint32(61), np.uint32(63)).astype(np.uint64)
            bits = np.bitwise_or.reduce(np.uint64(1) << place, axis=1, initial=0) & np.uint64((1 << 63) - 1)
            for at in range(0, int(home.sum()), 256):
                some = np.arange(at, min(at + 256, int(home.sum())))
                # an edit changes the set of letters by two at most, and the length by one
                fine = (np.bitwise_count(bits[some, None] ^ bits[None]) <= 2 * radius) & (np.abs(length[some, None] - length[None]) <= radius)
                fine &= ~(home[None] & (np.arange(len(keys))[None] <= some[:, None]))
                i, j = np.nonzero(fine)
                for k in range(0, len(i), 8192):
                    x, y = some[i[k : k + 8192]], j[k : k + 8192]
                    n = distances(codes[x], length[x], codes[y], length[y])
                    use = (n <= radius) & (n > 0)
                    a, b = keys[x[use]], keys[y[use]]
                    low = a < b
                    yield pd.DataFrame({"cls": own["cls"].iloc[0], "a": np.where(low, a, b), "b": np.where(low, b, a), "n": n[use]})

    return run


def radius_join(keys: DataFrame, radius: int = 1, cell_keys: int = CELL_KEYS, levels: int = LEVELS) -> DataFrame:
    """Pairs (cls, a, b, n), a < b, of keys (cls, key) of a class at a distance n of at most ``radius``.

    Keys of a class and length are a cell, in which those shorter by at most the radius are guests. While a cell has more
    than ``cell_keys`` keys at home, it is divided by up to PIVOTS of them (the first by hash); after ``levels``
    divisions its home keys are dealt to blocks, each with copies of all its keys. Null and empty keys are left out,
    repeated ones count once.
    """
    rows = keys.filter("cls IS NOT NULL AND length(key) > 0").select("cls", "key").distinct()
    step = F.explode(F.sequence(F.lit(0), F.lit(radius)))
    rows = rows.withColumn("step", step).select("cls", F.concat_ws("/", "cls", (F.length("key") + F.col("step")).cast("string")).alias("cell"), (F.col("step") == 0).alias("home"), "key")
    rows, done = materialise(rows, "cells"), []
    parts = max(keys.sparkSession.sparkContext.defaultParallelism, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    for level in range(levels + 1):
        sizes = rows.groupBy("cell").agg(F.count(F.when(F.col("home"), 1)).alias("at_home"), F.count("*").alias("size"))
        sizes = materialise(sizes, "sizes")
        big = sizes.filter(F.col("at_home") > cell_keys)
        done.append(rows.join(sizes.filter(F.col("at_home").between(1, cell_keys)).select("cell"), "cell", "left_semi").select("cls", "cell", "home", "key"))
        total = big.agg(F.sum("size")).first()[0]
        if not total:
            break
        crowd = max(HOT, total // 1000)
        if level == levels:
            blocks = look_up(rows, big, ["cell"], "key", "size", crowd).withColumn("blocks", F.ceil(F.col("at_home") / cell_keys))
            own = F.pmod(F.xxhash64("key"), F.col("blocks"))
            blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            done.append(blocks.select("cls", F.concat_ws("#", "cell", F.col("block").cast("string")).alias("cell"), (F.col("home") & (own == F.col("block"))).alias("home"), "key"))
            break
        hashed = F.xxhash64(F.lit(level), "key")
        picked = rows.filter("home").join(big.select("cell"), "cell", "left_semi").groupBy("cell", F.pmod(hashed, F.lit(PIVOTS)).alias("p")).agg(F.min_by("key", F.struct(hashed, "key")).alias("key"))
        pivots = big.join(picked.groupBy("cell").agg(F.sort_array(F.collect_list("key")).alias("pivots")), "cell")
        met = look_up(rows, pivots, ["cell"], "key", "size", crowd).select("cls", "cell", "home", "key", "pivots")
        rows = materialise(met.repartition(parts, "key").mapInPandas(_divide(radius), "cls string, cell string, home boolean, key string"), "cells")
    cells = done[0]
    for more in done[1:]:
        cells = cells.unionByName(more)
    return cells.repartition(parts, "cell").mapInPandas(_join(radius), "cls string, a string, b string, n int").distinct()


def given_names(parsed: DataFrame) -> DataFrame:
    """(word, n) of words that are given names: they stand first before at least three words (n), and before more than they follow.

    Short forms aren't among them; misspelt given names can be, and are told by a more frequent neighbour.
    """
    two = parsed.filter("form = '2' AND NOT comma AND kind IS NULL").select("first", "second", "full_1").distinct()
    leads = two.filter(F.size("full_1") == 0).groupBy(F.col("first").alias("word")).agg(F.count("*").alias("n"))
    follows = two.groupBy(F.col("second").alias("word")).agg(F.count("*").alias("m"))
    return leads.filter("n >= 3").join(follows, "word", "left").filter("m IS NULL OR n > m").select("word", "n")


def _resolved(parsed: DataFrame, given: DataFrame, small: bool) -> DataFrame:
    """(name, form, first, second): two words as a person 'P' or an organisation 'O', by the given names there are."""
    known = F.broadcast(given) if small else given
    for word in ("first", "second"):
        known_word = known.select(F.col("word").alias(word), F.lit(True).alias(f"is_{word}"))
        parsed = parsed.join(known_word, word, "left")
    lead = F.col("fixed_1") | F.coalesce("is_first", F.lit(False))
    follow = F.col("fixed_2") | F.coalesce("is_second", F.lit(False))
    firm = F.col("kind").isNotNull() & ~lead & ~follow
    short_1, short_2 = F.size("full_1") > 0, F.size("full_2") > 0
    swap = F.col("comma") | (follow & ~lead) | (short_2 & ~lead & ~short_1)
    own, sure, full = F.when(swap, F.col("second")).otherwise(F.col("first")), F.when(swap, follow).otherwise(lead), F.when(swap, F.col("full_2")).otherwise(F.col("full_1"))
    none = F.array().cast("array<string>")
    meant = F.array_distinct(F.concat(F.when(sure | (F.size(full) == 0), F.array(own)).otherwise(none), full, F.when(~sure, F.col("full_nick")).otherwise(none)))
    two = parsed.filter("form = '2'")
    firms = two.filter(firm).select("name", F.lit("O").alias("form"), F.when(F.col("kind_first"), F.col("second")).otherwise(F.col("first")).alias("first"), F.col("kind").alias("second"))
    people = two.filter(~firm).select("name", F.lit("P").alias("form"), F.explode(meant).alias("first"), F.when(swap, F.col("first")).otherwise(F.col("second")).alias("second"))
    # three words are a person's if the first is a given name
    three = parsed.filter("form = 'W'").join(known.select(F.col("word").alias("w"), F.lit(True).alias("is_w")), F.substring_index("first", " ", 1) == F.col("w"), "left")
    person = F.col("fixed_1") | F.coalesce("is_w", F.lit(False)) | (F.size("full_1") > 0)
    named = F.explode(F.array_distinct(F.concat(F.when((F.size("full_1") == 0) | F.col("fixed_1"), F.array("first")).otherwise(none), "full_1")))
    long = three.filter(person).select("name", F.lit("P").alias("form"), named.alias("first"), "second")
    words = three.filter(~person).select("name", F.lit("W").alias("form"), F.concat_ws(" ", "first", "second").alias("first"), F.lit("").alias("second"))
    return parsed.filter("form NOT IN ('2', 'W')").select("name", "form", "first", "second").unionByName(firms).unionByName(people).unionByName(long).unionByName(words)


def link_names(names: DataFrame, name: str = "name", radius: int = 1, small: int = SMALL_ROWS) -> DataFrame:
    """(name, entity) of the person and organisation names that are linked to another spelling.

    Spellings with the same key, or keys within ``radius`` typing errors, are linked; a surname or first word is held to be
    misspelt only if it or its other spelling has four letters or more, and a character of Chinese, Japanese or Korean
    counts as two. An initial stands for a given name, and a first word for an organisation, only if no other
    given name or kind fits it; three and more words without a legal form stand for an organisation that has one.
    ``entity`` is the smallest spelling of the group. Null and empty names and names of other things (codes, paths,
    compound identifiers) are left out; repeated names count once; an empty table gives an empty result.
    """
    strings = names.filter(F.length(name) > 0).select(F.col(name).alias("name")).distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(n, *k) for n in batch["name"] if (k := parse(n))], columns=["name", *COLUMNS])

    parsed = materialise(spread(strings).mapInPandas(read, f"name string, {SCHEMA}"), "parsed")
    given = materialise(given_names(parsed), "given")
    person = F.col("form").isin("P", "I")
    keys = materialise(_resolved(parsed, given, given.count() <= small).select(
        "name", "form", "first", "second",
        F.when(F.col("form") == "P", "person").when(F.col("form") == "O", "firm").alias("cls"), F.concat_ws(" ", "first", F.when(F.col("second") != "", F.col("second"))).alias("key"),
        F.when(person, "surname").when(F.col("form") == "W", "firm").otherwise("word").alias("part"), F.when(person, F.col("second")).otherwise(F.col("first")).alias("stem"),
    ), "keys")
    discard(parsed)
    whole = keys.filter("cls IS NOT NULL")
    wanted = whole.select("cls", "key").unionByName(keys.select(F.col("part").alias("cls"), F.col("stem").alias("key")))
    near = materialise(radius_join(wanted.unionByName(given.select(F.lit("given").alias("cls"), F.col("word").alias("key"))), radius), "near")
    # a given name with a neighbour four times as frequent is a misspelt one, and stands for no other person
    count = [given.select(F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab"]
    typed = near.filter("cls = 'given'").join(count[0], "a").join(count[1], "b")
    misspelt = typed.select(F.when(F.col("n_a") * 4 <= F.col("n_b"), F.col("a")).when(F.col("n_b") * 4 <= F.col("n_a"), F.col("b")).alias("first")).filter("first IS NOT NULL").distinct()
    usual = given.select(F.col("word").alias("first")).join(misspelt, "first", "left_anti").withColumn("sure", F.lit(True))
    target = whole.select("form", F.col("cls").alias("whole"), "key", "first", "second", "part", F.col("stem").alias("b")).distinct()
    target = target.join(F.broadcast(usual) if given.count() <= small else usual, "first", "left")
    target = target.withColumn("sure", F.coalesce("sure", F.col("first").isin(*NICKNAMES) | (F.col("form") != "P")))
    # a name of many words stands for an organisation that has a legal form, by all of them
    target = target.unionByName(target.filter("form = 'O'").withColumn("part", F.lit("firm")).withColumn("b", F.col("key")))
    typo = near.filter((F.col("cls").isin("surname", "word", "firm")) & (F.greatest(F.length("a"), F.length("b")) > 3)).select(F.col("cls").alias("part"), "a", "b")
    short = keys.filter("form IN ('I', 'R', 'W')").select(F.col("name").alias("short"), "form", F.col("first").alias("i"), "part", F.col("stem").alias("a"))
    around = typo.unionByName(typo.select("part", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(short.select("part", "a", F.col("a").alias("b")).distinct())
    met = short.join(around, ["part", "a"]).join(target.drop("form"), ["part", "b"])
    met = materialise(met.filter((F.col("form") != "I") | (F.substring("first", 1, 1) == F.col("i"))), "met")
    meaning = F.when(F.col("form") != "I", F.col("second")).when(F.col("sure"), F.col("first"))
    choices = met.groupBy("short").agg(F.countDistinct(meaning).alias("n"))
    clear = met.join(choices.filter("n = 1").select("short"), "short", "left_semi")
    node = lambda kind, value: F.concat(kind, F.lit(":"), value)
    links = near.filter("cls IN ('person', 'firm')").join(whole.select("cls", F.col("key").alias("a")).distinct(), ["cls", "a"], "left_semi").join(whole.select("cls", F.col("key").alias("b")).distinct(), ["cls", "b"], "left_semi")
    own = whole.select("name", node("cls", "key").alias("node"))
    # short forms of the same initial and stem belong together, whatever they stand for, unless that is unclear
    vague = choices.filter("n > 1").select("short")
    alike = short.filter("form <> 'W'").join(vague, "short", "left_anti").select(F.col("short").alias("name"), F.concat_ws(":", "form", F.when(F.col("form") == "I", F.col("i")).otherwise(""), "a").alias("node"))
    stands = own.unionByName(clear.select(F.col("short").alias("name"), node("whole", "key").alias("node"))).unionByName(alike)
    stands = materialise(stands.distinct(), "stands")
    # each name hangs on its first node; only nodes that something links to others go into the components
    hung = stands.groupBy("name").agg(F.min("node").alias("x"))
    tied = stands.join(hung, "name").filter("node <> x").select("x", F.col("node").alias("y"))
    groups = components(tied.unionByName(links.select(node("cls", "a").alias("x"), node("cls", "b").alias("y"))), "x", "y")
    named = hung.join(groups.withColumnRenamed("node", "x"), "x", "left").select("name", F.coalesce("component", "x").alias("component"))
    named = materialise(named, "members")
    first = named.groupBy("component").agg(F.min("name").alias("entity"), F.count("*").alias("n"))
    return named.join(first.filter("n > 1"), "component").select("name", "entity")


def pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b), name_a < name_b, of all spellings of an entity."""
    a, b = (linked.select("entity", F.col("name").alias(x)) for x in ("name_a", "name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()
