import pytest
from pyspark.sql import functions as F

from quillon.operators import changes
from quillon.schema import Memory
from quillon.sources import store
from quillon.streaming import ingest

ENT = "id string, name string, entity_type string, observations array<string>, metadata string, created_at string, entity_no long"
REL = "id string, source_entity string, target_entity string, relation_type string, confidence double, metadata string, created_at string, rel_no long"
ITEM = "n long, name string, entity_type string, observations array<string>"


def small(spark):
    ent = spark.createDataFrame([("entity_foo_bar", "Foo Bar", "CONCEPT", ["[2024-01-01] old"], "{}", "2024-01-01", 1), ("entity_x", "X", "TOOL", [], "{}", "2024-01-01", 2)], ENT)
    rel = spark.createDataFrame([("rel_entity_x_uses_entity_foo_bar", "entity_x", "entity_foo_bar", "USES", 0.5, "{}", "2024", 1)], REL)
    doc = spark.createDataFrame([("d", "text", "{}", "2024", 1)], "id string, content string, metadata string, created_at string, doc_id long")
    return Memory(ent, rel, doc, spark.createDataFrame([("d_chunk_0", "d", "text")], "chunk_id string, document_id string, text string"))


def test_upsert_rules(spark):
    m = small(spark)
    items = spark.createDataFrame([(1, "foo-bar", "TOOL", ["old", "new", "new"]), (2, "Foo Bar", "CONCEPT", ["new", None]), (3, "Y", None, None), (4, "X", "TOOL", [])], ITEM)
    ent, changed = changes.create_entities(m.entities, items, "2026-01-01")
    rows = {r.id: r for r in ent.collect()}
    assert rows["entity_foo_bar"].observations == ["[2024-01-01] old", "[2026-01-01] new", "[2026-01-01] new"]
    assert (rows["entity_foo_bar"].name, rows["entity_foo_bar"].entity_type) == ("Foo Bar", "TOOL")
    assert {r.id for r in changed.collect()} == {"entity_foo_bar", "entity_y"}
    again, none = changes.create_entities(ent, items, "2026-01-01")
    assert none.count() == 0 and again.count() == 3
    with pytest.raises(ValueError):
        changes.add_observations(m.entities, items.select("n", "name", "observations"), "2026-01-01")


def test_relation_rules(spark):
    m = small(spark)
    items = spark.createDataFrame([(1, "X", "Foo Bar", "uses"), (2, "X", "New", "USES"), (3, "X", "New", "uses")], "n long, from_name string, to_name string, relation_type string")
    out, new = changes.create_relations(m, items, "2026-01-01")
    assert [r.relation_type for r in new.collect()] == ["USES"]  # ids don't know case; the first is kept
    assert out.entities.count() == 3
    assert changes.delete_relations(out.relationships, items.filter("n = 1")).count() == 2  # deletion knows case
    ups = items.filter("n = 1").withColumn("confidence", F.lit(0.9)).withColumn("metadata", F.lit(None).cast("string"))
    rel, seen = changes.update_relations(m.relationships, ups)
    assert rel.first().confidence == 0.9 and seen.first().asDict() == {"updated": 1, "not_found": 0}
    assert changes.delete_entities(m, spark.createDataFrame([("x",), ("nobody",)], "name string")).relationships.count() == 0


def test_documents_and_import(spark):
    m = small(spark)
    new = spark.createDataFrame([(1, "d", "first", "{}", "2025"), (2, "d", "last", "{}", "2025")], "n long, id string, content string, metadata string, created_at string")
    out = changes.store_documents(m, new)
    assert [r.content for r in out.documents.collect()] == ["last"] and out.chunks.count() == 0
    _, report = changes.delete_documents(m, spark.createDataFrame([("d",), ("gone",)], "id string"))
    assert {tuple(r) for r in report.collect()} == {("d", True), ("gone", False)}
    same, counts = changes.import_memory(m, m)
    assert {r.what: (r.imported, r.skipped) for r in counts.collect()} == {"entities": (0, 2), "relations": (0, 1), "documents": (1, 0)}
    assert same.entities.count() == 2
    with pytest.raises(ValueError):
        changes.import_memory(m.with_(entities=m.entities.limit(0), relationships=m.relationships.limit(0)), m.with_(entities=m.entities.limit(0)))


def test_snapshots_versions_and_json(spark, tmp_path):
    m = small(spark)
    path = str(tmp_path / "memory")
    store.save(m, path)
    versions = [store.Version(1, "lower-case types", lambda x: x.with_(entities=x.entities.withColumn("entity_type", F.lower("entity_type"))))]
    assert store.status(spark, path, versions)["pending"] == 1
    assert store.migrate(spark, path, versions) == 1 and store.migrate(spark, path, versions) == 0
    assert {r.entity_type for r in store.load(spark, path).entities.collect()} == {"concept", "tool"}
    state = store.status(spark, path, versions)
    assert state["current"] == 1 and state["pending"] == 0 and state["versions"][0]["applied_at"]
    assert store.roll_back(spark, path, 0) == [1]
    assert {r.entity_type for r in store.load(spark, path).entities.collect()} == {"CONCEPT", "TOOL"}
    about = store.export_json(m, str(tmp_path / "json"))
    assert about["entityCount"] == m.entities.count() and about["exportedAt"]
    back = store.import_json(spark, str(tmp_path / "json"))
    assert [r.observations for r in back.entities.orderBy("id").collect()] == [["[2024-01-01] old"], []]
    assert back.relationships.first().confidence == 0.5 and back.documents.first().content == "text"


def test_stream_drops_repeated_deliveries(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (2, "2024-01-01 02:00:00")], "k long, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(source)
    stream = ingest.once(spark.readStream.schema(rows.schema).parquet(source), "k", "at")
    ingest.append_batches(stream, out, str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]
    counted = ingest.windowed_counts(spark.readStream.schema(rows.schema).parquet(source), "at", ["k"], "1 hour", "0 seconds")
    query = counted.writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("counted").count() >= 2
