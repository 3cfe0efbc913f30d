"""Snapshots of a memory, export and import as JSON, and schema versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.schema import Memory
from quillon.session import filesystem

TABLES = ["entities", "relationships", "documents", "chunks", "links", "entity_vectors"]


def save(m: Memory, path: str) -> str:
    """Write a snapshot beside the earlier ones; it counts once the manifest names it."""
    name = f"snapshot-{uuid.uuid4().hex}"
    held = [t for t in TABLES if getattr(m, t) is not None]
    for t in held:
        getattr(m, t).write.parquet(f"{path}/{name}/{t}")
    spark = m.entities.sparkSession
    manifest = read_manifest(spark, path)
    manifest["snapshots"].append(name)
    manifest.setdefault("tables", {})[name] = held
    write_manifest(spark, path, manifest)
    return name


def load(spark: SparkSession, path: str, snapshot: str | None = None) -> Memory:
    """The latest snapshot, or the named one."""
    manifest = read_manifest(spark, path)
    name = snapshot or manifest["snapshots"][-1]
    return Memory(**{t: spark.read.parquet(f"{path}/{name}/{t}") for t in manifest["tables"][name]})


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest of a folder on any file system that Spark knows."""
    fs, place = filesystem(spark, f"{path}/manifests")
    names = sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
    if not names:
        return {"snapshots": [], "versions": []}
    return json.loads(spark.read.text(f"{path}/manifests/{names[-1]}", wholetext=True).first()[0])


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Add a newer manifest: written under another name, it counts once it is renamed."""
    fs, place = filesystem(spark, f"{path}/manifests")
    fs.mkdirs(place)
    number = fs.listStatus(place).__len__()
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-{uuid.uuid4().hex}.tmp")
    stream = fs.create(made)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    if not fs.rename(made, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{number:012d}.json")):
        raise RuntimeError("another writer was faster")


def export_rows(m: Memory) -> DataFrame:
    """(kind, json): every entity, relation and document as one JSON object."""
    parts = {
        "entity": m.entities.select("id", "name", F.col("entity_type").alias("entityType"), "observations", "metadata", "created_at"),
        "relation": m.relationships.select("id", "source_entity", "target_entity", F.col("relation_type").alias("relationType"), "confidence", "metadata", "created_at"),
        "document": m.documents.select("id", "content", "metadata", "created_at"),
    }
    out = None
    for kind, df in parts.items():
        rows = df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def export_json(m: Memory, path: str, version: str = "1") -> dict:
    """Write the export as JSON lines, a folder for each kind; returns its description, which is written too."""
    export_rows(m).write.partitionBy("kind").text(path)
    spark = m.entities.sparkSession
    n = {r["kind"]: r["n"] for r in spark.read.text(path).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    about = {"exportedAt": datetime.now(UTC).isoformat(), "version": version, **{f"{k}Count": n.get(k, 0) for k in ("entity", "relation", "document")}}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/kind=metadata")
    return about


def import_json(spark: SparkSession, path: str) -> Memory:
    """Read an export; missing fields get their defaults. Chunks and vectors aren't part of one."""
    line = spark.read.text(path).withColumnRenamed("value", "json")

    def of(kind: str, schema: str) -> DataFrame:
        return line.filter(F.col("kind") == kind).select(F.from_json("json", schema).alias("x")).select("x.*")

    ent = of("entity", "id string, name string, entityType string, observations array<string>, metadata string, created_at string")
    rel = of("relation", "id string, source_entity string, target_entity string, relationType string, confidence double, metadata string, created_at string")
    none = F.array().cast("array<string>")
    entities = ent.select("id", "name", F.coalesce("entityType", F.lit("CONCEPT")).alias("entity_type"), F.coalesce("observations", none).alias("observations"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), "created_at", F.xxhash64("id").alias("entity_no"))
    relationships = rel.select("id", "source_entity", "target_entity", F.col("relationType").alias("relation_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), "created_at", F.xxhash64("id").alias("rel_no"))
    documents = of("document", "id string, content string, metadata string, created_at string").withColumn("doc_id", F.xxhash64("id"))
    chunks = spark.createDataFrame([], "chunk_id string, chunk_type string, document_id string, entity_id string, chunk_index int, text string")
    return Memory(entities, relationships, documents.withColumn("metadata", F.coalesce("metadata", F.lit("{}"))), chunks)


@dataclass(frozen=True)
class Version:
    """A schema version: what it is and how a memory gets there from the one before."""

    number: int
    description: str
    up: Callable[[Memory], Memory]


def status(spark: SparkSession, path: str, versions: list[Version]) -> dict:
    """The current version (0: none), how many are pending, and each version with the time it was applied (None: not yet)."""
    done = {v["version"]: v["applied_at"] for v in read_manifest(spark, path)["versions"]}
    each = [{"version": v.number, "description": v.description, "applied": v.number in done, "applied_at": done.get(v.number)} for v in sorted(versions, key=lambda v: v.number)]
    return {"current": max(done, default=0), "pending": sum(not v["applied"] for v in each), "versions": each}


def migrate(spark: SparkSession, path: str, versions: list[Version]) -> int:
    """Apply the pending versions in order, each as a snapshot of its own; a failure leaves the last good one."""
    applied = 0
    for v, state in zip(sorted(versions, key=lambda v: v.number), status(spark, path, versions)["versions"], strict=True):
        if not state["applied"]:
            name = save(v.up(load(spark, path)), path)
            manifest = read_manifest(spark, path)
            manifest["versions"].append({"version": v.number, "snapshot": name, "applied_at": datetime.now(UTC).isoformat()})
            write_manifest(spark, path, manifest)
            applied += 1
    return applied


def roll_back(spark: SparkSession, path: str, target: int) -> list[int]:
    """Point at the snapshot of version ``target`` (0: the first snapshot) again; returns the versions undone."""
    manifest = read_manifest(spark, path)
    undone = sorted((v["version"] for v in manifest["versions"] if v["version"] > target), reverse=True)
    kept = [v for v in manifest["versions"] if v["version"] <= target]
    if undone:
        manifest["snapshots"].append(kept[-1]["snapshot"] if kept else manifest["snapshots"][0])
        manifest["versions"] = kept
        write_manifest(spark, path, manifest)
    return undone
