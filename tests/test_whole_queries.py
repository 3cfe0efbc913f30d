"""Registered queries give the whole result, on the smallest test data."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.schema import memory
from quillon.sources import store

DATA = "/root/testdata/sf0.001"


def test_every_document_chunk_has_a_summary(spark):
    m = memory(spark, DATA)
    texts = {r.chunk_id: r.text for r in m.chunks.filter("chunk_type = 'document' AND text IS NOT NULL").collect()}
    got = {r.chunk_id: (r.text, r.score) for r in entry.queries()["content_summaries"](spark, DATA).collect()}
    assert set(got) == set(texts)
    short = [k for k, t in texts.items() if not any(len(s.strip()) > 10 for s in re.split("[.!?]+", t))]
    for k in short:
        assert got[k] == (texts[k][:150] + ("..." if len(texts[k]) > 150 else ""), 0.1)


def test_a_text_without_sentences_is_summed_up_by_its_start(spark):
    from quillon.operators import hybrid

    rows = spark.createDataFrame([("short",), ("x" * 151,)], "t string").select(hybrid.start_of(F.col("t")).alias("s")).select("s.*").collect()
    assert {tuple(r) for r in rows} == {("short", "short", 0.1), ("x" * 150 + "...", "x" * 100 + "...", 0.1)}


def test_an_export_makes_its_rows(spark):
    made = entry.queries()["export_rows"](spark, DATA)
    assert "StructsToJson" in made._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for r in store.export_rows(memory(spark, DATA)).collect():
        n, length = want.get(r.kind, (0, 0))
        want[r.kind] = (n + 1, length + len(r.json))
    assert {r.kind: (r.n, r.length) for r in entry.queries()["export_lengths"](spark, DATA).collect()} == want
    assert {r.kind: r.n for r in made.collect()} == {k: n for k, (n, _) in want.items()}
