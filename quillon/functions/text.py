"""Text expressions: slugs, dates in front of observations, terms, sentences, character classes, word boundaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"^\[\d{4}-\d{2}-\d{2}\]"
# ASCII word boundary; that of the JVM's regular expressions also knows other letters.
BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
# Fixed value: characters a trim removes.
BLANKS = r"[\s\u000B   -     　﻿]+"
# Prefixes of bookkeeping observations.
BOOKKEEPING = ["Source:", "Created:", "Type:", "Tags:", "Content length:"]
CJK = r"[　-鿿가-힯＀-￯]"


def slug(name: Column | str) -> Column:
    """Identity of an entity: 'entity_' and the lower-cased name with every other codepoint than letters and digits as '_'."""
    return F.concat(F.lit("entity_"), F.regexp_replace(F.lower(F.col(name) if isinstance(name, str) else name), r"[^\p{L}\p{N}]", "_"))


def strip_date(text: Column) -> Column:
    return F.regexp_replace(text, DATE + r"\s*", "")


def stamp(text: Column, today: str) -> Column:
    """Put a date in front of an observation that has none."""
    return F.when(text.rlike(DATE), text).otherwise(F.concat(F.lit(f"[{today}] "), text))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANKS}|{BLANKS}$", "")


def terms(text: Column, minimum: int = 3, capitalized: bool = True, patterns: tuple[str, ...] = ()) -> Column:
    """Capitalised phrases and acronyms, Hangul runs, and what further patterns find in any case, each once, in this order."""
    phrases = F.regexp_extract_all(text, F.lit(BOUNDARY + r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*" + BOUNDARY), F.lit(0))
    acronyms = F.regexp_extract_all(text, F.lit(BOUNDARY + r"[A-Z]{2,}" + BOUNDARY), F.lit(0))
    hangul = F.regexp_extract_all(text, F.lit(r"[가-힣]{2,}"), F.lit(0))
    latin = [F.filter(phrases, lambda t: F.length(t) >= minimum), acronyms] if capitalized else []
    own = [F.transform(F.filter(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)), lambda t: F.length(t) >= minimum), trim) for p in patterns]
    return F.array_distinct(F.concat(*latin, hangul, *own))


def sentences(text: Column) -> Column:
    """Sentences of more than 10 characters, without list marks."""
    parts = F.transform(F.split(text, r"[.!?]+"), trim)
    return F.transform(F.filter(parts, lambda s: F.length(s) > 10), lambda s: F.regexp_replace(s, r"^[-•]\s*", ""))


def tokens(text: Column) -> Column:
    """Search terms: runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\x{E000}-\x{F8FF}]+"), lambda t: t != "")


def embedding_text(kind: Column, name: Column, observations: Column) -> Column:
    """What stands for an entity when it is embedded: type, name and its telling observations."""
    telling = F.filter(observations, lambda o: ~F.exists(F.array(*map(F.lit, BOOKKEEPING)), lambda p: o.startswith(p)))
    return trim(F.concat(kind, F.lit(": "), name, F.lit(". "), F.array_join(telling, ". ")))


def normalise_query(text: Column, ascii_only: bool = False) -> Column:
    if ascii_only:
        text = F.regexp_replace(text, r"[^\x00-\x7F]+", " ")
    return trim(F.regexp_replace(text, BLANKS, " "))
