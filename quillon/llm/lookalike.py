"""Problem 6: one form for text that looks the same.

The script sets of a token's characters are intersected; an empty intersection is a mixed-script token, and a
token whose letters all look like those of its surroundings' script is a whole-script confusable. Both are spelt
in the consistent script. Width, composition, invisible characters and spaces are brought to one form as well.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise, spread

#: Tables of keys up to this many rows are broadcast.
SMALL_ROWS = 1_000_000

# Letters that look like a Latin letter, by script.
CYRILLIC = dict(zip("асеорхуіјѕһԁԛԝӏѵАВЕКМНОРСТУХІЈЅԚԜ", "aceopxyijshdqwlvABEKMHOPCTYXIJSQW", strict=True))
GREEK = dict(zip("οναιρυκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovaipukABEZHIKMNOPTYX", strict=True))
# Invisible characters, and spaces of another or no-break kind.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f"
# Letters of further scripts that look like a Latin letter.
FURTHER = dict(zip("օոսցհքԼՍՕᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᴀᴄᴏᴠᴡᴢꜱꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴıɑɡɩ", "onughpLUOABCDEHJKLMPRSTVWZacovwzsBPDTGKJCZFMNLSRVHWXYAEIOUiagi", strict=True))
# Names of the changes, in the order they are made.
CHANGES = ["invisible", "space", "width", "compatibility", "composition", "mixed_script", "whole_script"]

LATIN_CLASS, GREEK_CLASS, CYRILLIC_CLASS = "A-Za-zªºÀ-ÖØ-öø-ʸḀ-ỿ", "Ͱ-ͳͶ-ͽͿΆΈ-Ͽἀ-῿", "Ѐ-ҁҊ-ԯᲀ-ᲈ"
SCRIPTS = {"latin": re.compile(f"[{LATIN_CLASS}]"), "greek": re.compile(f"[{GREEK_CLASS}]"), "cyrillic": re.compile(f"[{CYRILLIC_CLASS}]")}
OTHER, LATIN = re.compile(f"[{GREEK_CLASS}{CYRILLIC_CLASS}]"), re.compile(f"[{LATIN_CLASS}]")
TOKEN = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(f"[{INVISIBLE}]")
SPACE = re.compile(f"[{SPACES}]")
WIDE = re.compile("[０-９Ａ-Ｚａ-ｚ]")
WIDE_FORM = re.compile("[！-～]")
EMOJI = re.compile("[←-⯿\ufe0f\U0001f000-\U0001faff]")
LIKE = {"cyrillic": CYRILLIC, "greek": GREEK}
ALL_LIKE = str.maketrans({**FURTHER, **CYRILLIC, **GREEK})


@lru_cache(maxsize=1)
def _compatible() -> tuple[re.Pattern, dict[int, str]]:
    """Letters and numbers that are another look of others (mathematical, circled, superscript, ligatures, half-width kana), and these.

    Taken from the compatibility decompositions; full-width forms and the ideographs' compatibility forms are no part.
    """
    table = {}
    for c in range(0x80, 0x20000):
        s = chr(c)
        tag = unicodedata.decomposition(s)
        if tag.startswith(("<font>", "<circle>", "<compat>", "<narrow>", "<sub>", "<super>")) and unicodedata.category(s)[0] in "LN":
            new = unicodedata.normalize("NFKC", s)
            if new != s and all(unicodedata.category(x)[0] in "LN" for x in new):
                table[c] = new
    # characters beyond the basic plane in a class of their own: one class of both is slow to search
    plane = "".join(chr(c) for c in table if c < 0x10000)
    beyond = "".join(f"{chr(c)}" for c in sorted({c & ~0xFF for c in table if c >= 0x10000}))
    return re.compile(f"[{plane}]|[{''.join(f'{b}-{chr(ord(b) + 0xFF)}' for b in beyond)}]"), table


def resolved(token: str) -> set[str]:
    """Scripts that all letters of a token can belong to; letters of scripts that aren't confused belong to each."""
    sets = [{s for s, p in SCRIPTS.items() if p.match(c)} for c in set(token)]
    return set.intersection(*[s for s in sets if s] or [set(SCRIPTS)])


def consistent(token: str) -> str:
    """A mixed-script token in the one script that can spell all of it, the Latin before the others; else unchanged."""
    for target in ("latin", "cyrillic", "greek"):
        out = []
        for c in token:
            own = next((s for s, p in SCRIPTS.items() if p.match(c)), target)
            if own != target:
                c = LIKE[own].get(c) if target == "latin" else next((k for k, v in LIKE[target].items() if own == "latin" and v == c), None)
            if c is None:
                break
            out.append(c)
        else:
            return "".join(out)
    return token


def _drop_hidden(text: str) -> str:
    """Without invisible characters; a joiner between two emoji stays."""

    def keep(m: re.Match) -> str:
        a, b = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        return m[0] if m[0] == "\u200d" and EMOJI.match(a) and EMOJI.match(b) else ""

    return HIDDEN.sub(keep, text)


def one_form(text: str) -> tuple[str, list[str]]:
    """The text in its one form, and the names of the changes (of CHANGES) that were needed."""
    changes = []

    def step(name: str, new: str) -> str:
        if new != text:
            changes.append(name)
        return new

    if text.isascii():
        return text, changes
    text = step("invisible", _drop_hidden(text)) if HIDDEN.search(text) else text
    text = step("space", SPACE.sub(" ", text)) if SPACE.search(text) else text
    if WIDE.search(text):  # punctuation of that width is usual in Chinese and Japanese and stays
        text = step("width", WIDE.sub(lambda m: chr(ord(m[0]) - 0xFEE0), text))
    pattern, table = _compatible()
    if pattern.search(text) and (new := text.translate(table)) != text:
        text = step("compatibility", new)
    if not unicodedata.is_normalized("NFC", text):
        text = step("composition", unicodedata.normalize("NFC", text))
    if OTHER.search(text) and LATIN.search(text):
        mixed = {t for t in TOKEN.findall(text) if OTHER.search(t) and not resolved(t)}
        if mixed:
            changes.append("mixed_script")
            text = TOKEN.sub(lambda m: consistent(m[0]) if m[0] in mixed else m[0], text)
    if OTHER.search(text):
        text = step("whole_script", "\n".join(map(_whole, text.split("\n"))))
    return text, changes


def _whole(line: str) -> str:
    """Tokens of look-alikes only, in a line that else is Latin, in Latin letters."""
    if not OTHER.search(line):
        return line
    tokens = TOKEN.findall(line)
    firm = {s for t in tokens for s, like in LIKE.items() if SCRIPTS[s].search(t) and any(SCRIPTS[s].match(c) and c not in like for c in t)}
    if not any(SCRIPTS["latin"].search(t) for t in tokens):
        return line

    def spell(m: re.Match) -> str:
        own = resolved(m[0])
        script = next(iter(own)) if len(own) == 1 else "latin"
        return "".join(LIKE[script][c] for c in m[0]) if script != "latin" and script not in firm and all(c in LIKE[script] for c in m[0]) else m[0]

    return TOKEN.sub(spell, line)


def skeleton(name: str) -> str:
    """What a name looks like: its one form with every look-alike letter as the Latin one, without blanks at its ends."""
    return look_of(one_form(name)[0])


def look_of(form: str) -> str:
    """What a text in its one form looks like."""
    if not form.isascii():
        form = WIDE_FORM.sub(lambda m: chr(ord(m[0]) - 0xFEE0), form).replace("\u3000", " ").translate(ALL_LIKE)
    return form.strip()


def forms(df: DataFrame, key: str, text: str, changed_only: bool = False) -> DataFrame:
    """(key, form, skeleton, changes) of texts: the one form, what it looks like, and the changes that led there.

    ``changes`` is empty where the text already has its form (such rows are left out with ``changed_only``).
    Null texts and rows without a key give no row, empty texts an empty form; repeated rows stay; an empty table gives
    an empty result. Other columns aren't read.
    """
    columns = [key, "form", "skeleton", "changes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, body in zip(batch["_key"], batch["_text"], strict=True):
                form, changes = one_form(body)
                if changes or not changed_only:
                    rows.append((k, form, look_of(form), changes))
            yield pd.DataFrame(rows, columns=columns)

    some = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_key").isNotNull() & F.col("_text").isNotNull())
    return spread(some).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, form string, skeleton string, changes array<string>")


def delivered_once(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) with each text of a key once; only the rows of repeated keys are shuffled with their texts."""
    rows = df.filter(F.col(key).isNotNull()).select(key, text)
    several = rows.groupBy(key).count().filter("count > 1").select(key)
    several = materialise(several, "repeated")
    several = F.broadcast(several) if several.count() <= SMALL_ROWS else several
    return rows.join(several, key, "left_anti").unionByName(rows.join(several, key, "left_semi").distinct())


def same_looking(df: DataFrame, key: str, name: str) -> DataFrame:
    """Pairs (key_a, key_b) with key_a < key_b of rows whose names look the same but differ in characters.

    Rows without key or name are left out; repeated rows of a key count once. Distinct names are compared once,
    whatever the number of rows that bear them, and only if their look has more than one spelling.
    """
    named = df.filter(F.col(key).isNotNull() & F.col(name).isNotNull()).select(F.col(key).alias("_k"), F.col(name).alias("_n")).distinct()
    looks = forms(named.select("_n").distinct().withColumn("_m", F.col("_n")), "_m", "_n").select(F.col("_m").alias("_n"), "skeleton")
    several = looks.groupBy("skeleton").count().filter("count > 1").select("skeleton")
    rows = named.join(looks.join(several, "skeleton", "left_semi"), "_n")
    a = rows.select("skeleton", F.col("_k").alias("key_a"), F.col("_n").alias("_a"))
    b = rows.select("skeleton", F.col("_k").alias("key_b"), F.col("_n").alias("_b"))
    return a.join(b, "skeleton").filter((F.col("key_a") < F.col("key_b")) & (F.col("_a") != F.col("_b"))).select("key_a", "key_b").distinct()
