import pytest

from quillon.schema import Memory
from quillon.tools import TOOLS, call_tool


def test_a_session_of_calls(spark):
    empty = Memory(
        spark.createDataFrame([], "id string, name string, entity_type string, observations array<string>, metadata string, created_at string, entity_no long"),
        spark.createDataFrame([], "id string, source_entity string, target_entity string, relation_type string, confidence double, metadata string, created_at string, rel_no long"),
        spark.createDataFrame([], "id string, content string, metadata string, created_at string, doc_id long"),
        spark.createDataFrame([], "chunk_id string, chunk_type string, document_id string, entity_id string, chunk_index int, text string, start_pos int, end_pos int, start_token int, end_token int"),
    )
    m, made = call_tool(empty, "createEntities", {"entities": [{"name": "Search Index", "entityType": "TOOL", "observations": ["kept in list.md"]}]})
    assert [r["name"] for r in made] == ["Search Index"]
    m, new = call_tool(m, "createRelations", {"relations": [{"from": "Search Index", "to": "Queue", "relationType": "USES"}]})
    assert len(new) == 1
    m, _ = call_tool(m, "storeDocument", {"id": "d", "content": "The Search Index waits for the queue. " * 30})
    m, pieces = call_tool(m, "chunkDocument", {"documentId": "d", "maxTokens": 100, "overlap": 20})
    assert len(pieces) > 2
    _, near = call_tool(m, "getNeighbors", {"entityNames": ["Search Index"]})
    assert {r["name"] for r in near["entities"]} == {"Search Index", "Queue"}
    _, hits = call_tool(m, "hybridSearch", {"query": "search index", "limit": 2})
    assert len(hits["results"]) == 2 and "Search Index" in hits["results"][0]["names"]
    _, links = call_tool(m, "linkEntitiesToDocument", {"documentId": "d", "entityNames": ["Search Index"]})
    assert len(links["links"]) >= 2
    m, made = call_tool(m, "embedChunks", {"documentId": "d"})
    assert made["embedded"] == len(pieces) and m.links.join(m.chunks.filter("text LIKE '%Search Index%'"), "chunk_id").count() == m.links.count() >= 2
    m, made = call_tool(m, "generateGraphChunks", {})
    assert made["chunks"] == 3 and call_tool(m, "embedGraphChunks", {})[1]["embedded"] == 3
    m, made = call_tool(m, "embedAllEntities", {})
    assert made["embedded"] == m.entity_vectors.count() == 2
    _, near = call_tool(m, "searchNodes", {"query": "search index"})
    assert near["entities"][0]["name"] == "Search Index" and len(near["relations"]) == 1
    _, added = call_tool(m, "addObservations", {"observations": [{"entityName": "Queue", "contents": ["is slow"]}]})
    assert added[0]["entityName"] == "Queue" and len(added[0]["addedObservations"]) == 1
    _, said = call_tool(m, "extractTerms", {"documentId": "d", "includeCapitalized": False, "customPatterns": ["WAITS for"]})
    assert said["terms"] == ["waits for"]
    with pytest.raises(ValueError):
        call_tool(m, "linkEntitiesToDocument", {"documentId": "e", "entityNames": []})
    m, _ = call_tool(m, "deleteEntities", {"entityNames": ["Queue"]})
    assert m.links.filter("entity_id = 'entity_queue'").count() == 0 and m.entity_vectors.count() == 1
    m, _ = call_tool(m, "createRelations", {"relations": [{"from": "Search Index", "to": "Queue", "relationType": "USES"}]})
    m, gone = call_tool(m, "deleteDocuments", {"documentIds": ["d", "e"]})
    assert gone["summary"] == {"deleted": 1, "failed": 1, "total": 2} and m.chunks.filter("document_id IS NOT NULL").count() == 0 and m.links.join(m.chunks, "chunk_id", "left_anti").count() == 0
    with pytest.raises(ValueError):
        call_tool(m, "chunkDocument", {"documentId": "d"})
    with pytest.raises(KeyError):
        call_tool(m, "nothing", {})
    _, data = call_tool(m, "exportGraph", {})
    back, counts = call_tool(empty, "importGraph", {"data": data})
    assert {r["what"]: r["imported"] for r in counts} == {"entities": 2, "relations": 1, "documents": 0}
    assert back.entities.count() == 2
    assert len(TOOLS) == 29
