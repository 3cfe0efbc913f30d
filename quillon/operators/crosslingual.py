"""Query variants in another language, by a dictionary of terms."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NATIVE_NAME = r"한국어명:\s*(.+)"
HANGUL = re.compile("[가-힣]")


def load_dictionary(path: str) -> dict[str, dict[str, str]]:
    """The two maps of a dictionary file; empty if there is none or it can't be read."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        found = {}
    return {side: dict(found.get(side) or {}) for side in ("native-en", "en-native")}


def native_names(entities: DataFrame) -> DataFrame:
    """(native, name): native names given in observations of an entity."""
    said = entities.select("name", F.explode("observations").alias("o"))
    return said.select(F.trim(F.regexp_extract("o", NATIVE_NAME, 1)).alias("native"), "name").filter("native <> ''").distinct()


def translate(query: str, terms: dict[str, str]) -> str | None:
    """The query with every term replaced, the longest first; None if that changes nothing or leaves two letters."""
    out = query
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        if term:
            out = out.replace(term, terms[term])
    return out if out != query and len(out.strip()) > 2 else None


def variants(query: str, dictionary: dict[str, dict[str, str]]) -> list[str]:
    """The normalised query, and its translation if the dictionary has one."""
    plain = " ".join(query.split())
    native = bool(HANGUL.search(plain))
    english = not native and plain.isascii()
    other = translate(plain, dictionary["en-native"] if english else dictionary["native-en"])
    if other and native:
        other = " ".join(re.sub(r"[^\x00-\x7f]+", " ", other).split())
    return [plain] + ([other] if other and other != plain else [])


def variant_rows(queries: DataFrame, key: str, text: str, pairs: DataFrame) -> DataFrame:
    """(key, variant, text): each query, and its form with the terms of ``pairs`` (term, other) replaced.

    A term is looked up by its first word, so that no query is held against the whole dictionary; of terms that
    overlap the longer is replaced.
    """
    base = queries.select(key, F.col(text).alias("text"))
    words = base.select(key, "text", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    found = words.join(pairs.withColumn("word", F.element_at(F.split("term", r"\s+"), 1)), "word").filter(F.expr("instr(text, term) > 0"))
    listed = found.groupBy(key, "text").agg(F.array_sort(F.collect_set(F.struct((-F.length("term")).alias("n"), "term", "other"))).alias("l"))
    new = listed.select(key, F.aggregate("l", F.col("text"), lambda acc, x: F.replace(acc, x["term"], x["other"])).alias("new"), "text").filter("new <> text")
    return base.select(key, F.lit(0).alias("variant"), "text").unionByName(new.select(key, F.lit(1).alias("variant"), F.col("new").alias("text")))
