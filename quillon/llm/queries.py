"""Queries of the training-data operators over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import garbled, language, lookalike, mixing, neardup, neighbours, packing, split, together, variants
from quillon.session import prepare, table


def p1_split(spark: SparkSession, directory: str) -> DataFrame:
    """Pieces of every document over 1,200 codepoints."""
    return split.split_texts(table(spark, directory, "documents"), "doc_id", "text")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Oversized documents, and their stretches that can only be cut hard."""
    return split.oversized(p1_split(spark, directory), "doc_id")


def p2_knn(spark: SparkSession, directory: str) -> DataFrame:
    """The 10 nearest chunks of every chunk whose number is divisible by 50, against all chunks."""
    chunks = table(spark, directory, "chunks")
    found = neighbours.nearest(chunks, "chunk_no", "embedding", 10, ask=F.col("chunk_no") % 50 == 0)
    return found.select(F.col("key_a").alias("chunk_no"), F.col("key_b").alias("neighbour"), "rank", F.round("distance", 5).alias("distance"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of chunks at a distance of at most 0.30, from the 10 nearest of every chunk."""
    found = neighbours.nearest(table(spark, directory, "chunks"), "chunk_no", "embedding", 10, radius=0.30)
    return found.select(F.least("key_a", "key_b").alias("chunk_a"), F.greatest("key_a", "key_b").alias("chunk_b")).distinct()


def language_network(spark: SparkSession, directory: str) -> language.Network | None:
    """The network fitted on labelled documents."""
    labels = F.broadcast(table(spark, directory, "lang_labels").select(F.col("alias").alias("lang"), F.col("lang").alias("code")))
    return language.fit(table(spark, directory, "documents").join(labels, "lang"), "text", "code")


def p3_segments(spark: SparkSession, directory: str) -> DataFrame:
    """Every stretch of every chunk text in one language, with its confidence."""
    return language.segments(table(spark, directory, "chunks"), "chunk_no", "text", language_network(spark, directory)).distinct()


def p3_labels(spark: SparkSession, directory: str) -> DataFrame:
    """Every document with its label filled or corrected."""
    documents = table(spark, directory, "documents")
    found = language.segments(documents, "doc_id", "text", language_network(spark, directory))
    return language.relabel(documents, "doc_id", "lang", table(spark, directory, "lang_labels"), found)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents with a missing or wrong label or in several languages, with each language."""
    return p3_labels(spark, directory).filter("changed").select("doc_id", F.explode("langs").alias("lang"))


def p4_entities(spark: SparkSession, directory: str) -> DataFrame:
    """Every spelling of a person or organisation that has several, with the entity it means."""
    relations = table(spark, directory, "relations")
    names = table(spark, directory, "entities").select("name")
    for end in ("from_name", "to_name"):
        names = names.unionByName(relations.select(F.col(end).alias("name")))
    return variants.link_names(names)


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of spellings of the same person or organisation."""
    return variants.pairs(p4_entities(spark, directory))


def p5_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Every pair of names with the number of results that show both, and its lift."""
    found = together.pairs_together(table(spark, directory, "search_results"), "result_no", "entities")
    return found.withColumn("lift", F.round("lift", 6))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of names in at least 8 results together, and 6 times as often as chance."""
    found = together.pairs_together(table(spark, directory, "search_results"), "result_no", "entities", min_count=8, min_lift=6)
    return found.select("name_a", "name_b")


#: Changes that make a chunk a case: all but those that no character of its own shows.
SHOWN = ["invisible", "space", "width", "composition", "mixed_script"]


def p6_forms(spark: SparkSession, directory: str) -> DataFrame:
    """Chunk texts and entity names in their one form, with the changes made."""
    chunks = lookalike.forms(lookalike.delivered_once(table(spark, directory, "chunks"), "chunk_no", "text"), "chunk_no", "text")
    names = lookalike.forms(lookalike.delivered_once(table(spark, directory, "entities"), "entity_no", "name"), "entity_no", "name")
    both = chunks.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_no").alias("key"), "form", F.array_join("changes", ",").alias("changes"))
    return both.unionByName(names.select(F.lit("entity").alias("rec_kind"), F.col("entity_no").alias("key"), "form", F.array_join("changes", ",").alias("changes")))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of entities whose names look the same, and chunks with characters in another form."""
    pairs = lookalike.same_looking(table(spark, directory, "entities"), "entity_no", "name")
    odd = lookalike.forms(table(spark, directory, "chunks"), "chunk_no", "text", changed_only=True)
    odd = odd.filter(F.arrays_overlap("changes", F.array(*map(F.lit, SHOWN)))).select("chunk_no").distinct()
    found = pairs.select(F.lit("entity").alias("rec_kind"), "key_a", "key_b")
    return found.unionByName(odd.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_no").alias("key_a"), F.col("chunk_no").alias("key_b")))


def edited_copies(spark: SparkSession, directory: str, threshold: float = 0.6, width: int = 3, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates of documents by text and of entities by observations, dates in front removed."""
    documents = table(spark, directory, "documents").select(F.lit(0).cast("tinyint").alias("kind"), F.col("doc_id").alias("key"), F.array("text").alias("texts"))
    undated = F.transform("observations", lambda o: F.regexp_replace(o, r"^\[\d{4}-\d{2}-\d{2}\]\s*", ""))
    entities = table(spark, directory, "entities").select(F.lit(1).cast("tinyint").alias("kind"), F.col("entity_no").alias("key"), undated.alias("texts"))
    return neardup.near_duplicates(documents.unionByName(entities), threshold, width, least)


def _kind_name(column: str = "kind"):
    return F.when(F.col(column) == 0, "document").otherwise("entity").alias("rec_kind")


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of edited copies of documents and of entities."""
    pairs = neardup.expand(*edited_copies(spark, directory))
    return pairs.select(_kind_name(), F.col("a").alias("key_a"), F.col("b").alias("key_b"))


def p7_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Every document and entity with its class of equal words, its group of edited copies and its number of links."""
    found = neardup.groups(*edited_copies(spark, directory))
    return found.select(_kind_name(), "key", F.col("rep").alias("class_id"), F.col("grp").alias("group_id"), "links")


def p8_pack(spark: SparkSession, directory: str) -> DataFrame:
    """Every document's place in containers of each capacity."""
    counts = packing.counted(table(spark, directory, "documents"), "doc_id", "text")
    return packing.pack(counts, table(spark, directory, "pack_limits")).withColumnRenamed("key", "doc_id")


def p8_fill(spark: SparkSession, directory: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill(p8_pack(spark, directory), table(spark, directory, "pack_limits"))


def p9_mix(spark: SparkSession, directory: str) -> DataFrame:
    """The documents used, and how often, so that each source has its target share."""
    counts = packing.counted(table(spark, directory, "documents"), "doc_id", "text", ("source",))
    return mixing.mix(counts, table(spark, directory, "mix_targets")).withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The share that each source reaches."""
    return mixing.shares(p9_mix(spark, directory), table(spark, directory, "mix_targets"))


def p10_repair(spark: SparkSession, directory: str) -> DataFrame:
    """Garbled documents with the original text, where it can still be restored."""
    return garbled.repair_texts(table(spark, directory, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents read, as a whole or in part, with the wrong encoding."""
    return p10_repair(spark, directory).filter("steps <> 'unescape'").select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("p") and k[1].isdigit()}

    def ready(f):
        def run(spark, directory):
            prepare(spark)
            return f(spark, directory)

        return run

    return {k: ready(f) for k, f in found.items()}
