"""Registered queries give the whole result, on tables small enough to see it."""

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import garbled, neighbours, queries


def test_pairs_shown_together_once_are_kept(spark, tmp_path):
    rows = [(1, ["a", "b", "c"]), (2, ["a", "b"]), (3, None), (4, ["d"])]
    spark.createDataFrame(rows, "result_no long, entities array<string>").write.parquet(str(tmp_path / "search_results.parquet"))
    got = {tuple(r) for r in queries.p5_pairs(spark, str(tmp_path)).collect()}
    assert got == {("a", "b", 2, 2, 2, 4, 2.0), ("a", "c", 1, 2, 1, 4, 2.0), ("b", "c", 1, 2, 1, 4, 2.0)}


RUSSIAN = "Сегодня мы обсуждали новую версию сервиса и решили перенести выпуск на неделю. "
GERMAN = "Die Prüfung der Änderungen läuft für größere Übersichten schöner. "


@pytest.mark.parametrize("clean", [RUSSIAN, GERMAN])
@pytest.mark.parametrize("ends", ["\n", " "])
def test_garbled_stretch_of_a_long_text_is_found(spark, clean, ends):
    meant = "Привет, как твои дела сегодня"
    read = meant.encode("cp1251").decode("cp1252")
    df = spark.createDataFrame([(1, clean * 40 + ends + read + ends + clean * 40), (2, clean * 80)], "k long, t string")
    got = {r.k: r.repaired for r in garbled.repair_texts(df, "k", "t").collect()}
    assert got == {1: clean * 40 + ends + meant + ends + clean * 40}


def test_escaped_garbled_text_is_found(spark):
    rows = [(1, "caf&Atilde;&copy; and so on"), (2, "The caf\\u00c3\\u00a9 demo"), (3, "caf&eacute; &amp; bar"), (4, "a & b; c\\u0041d")]
    got = {r.k: r.repaired for r in garbled.repair_texts(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got == {1: "café and so on", 2: "The café demo", 3: "café &amp; bar"}


@pytest.mark.parametrize("dims", [4, 8, 64])
def test_radius_queries_probe_every_cell_of_a_neighbour(dims):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, dims)) @ np.linalg.qr(rng.standard_normal((64, dims)))[0].T
    x = np.concatenate([x, x + 0.16 * np.linalg.norm(x, axis=1, keepdims=True) * rng.standard_normal(x.shape) / 8])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    index = neighbours.fit(x, 60 * neighbours.CELL_ROWS)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(x))), "vector": pa.array(x.tolist(), pa.list_(pa.float32())), "ask": pa.array([True] * len(x))})
    probed = np.zeros((len(x), len(index.centroids)), dtype=bool)
    for out in neighbours._route(index, None, 0.3)(iter([batch])):
        for r in out.to_pylist():
            if r["query"]:
                probed[r["id"], np.frombuffer(r["cells"], np.int32)] = True
    q, other = np.nonzero(2 - 2 * x @ x.T <= 0.09)
    assert probed[q, index.cells(x)[other]].mean() >= 0.9999
    assert dims != 8 or probed.sum(1).max() > 24


@pytest.mark.parametrize("dims", [4, 8, 64])
def test_divided_cells_keep_the_neighbours(dims, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_CELLS", 2)
    monkeypatch.setattr(neighbours, "SPLIT_ROWS", 200)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, dims)) @ np.linalg.qr(rng.standard_normal((64, dims)))[0].T
    x = np.concatenate([x, x + 0.16 * np.linalg.norm(x, axis=1, keepdims=True) * rng.standard_normal(x.shape) / 8])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    index = neighbours.fit(x, len(x))
    cell = index.cells(x)
    codes = index.encode(x, cell)
    packed = np.ascontiguousarray(codes[:, ::2] | codes[:, 1::2] << 4)
    close = 2 - 2 * x @ x.T <= 0.09
    true = hit = asked = 0
    for c in range(2):
        ids = np.flatnonzero(cell == c)
        own, queries = packed[ids].copy(), np.arange(len(x))
        node = neighbours._divide(index, c, own, ids, 0, len(ids))
        assert node.children and sorted(ids) == np.flatnonzero(cell == c).tolist() and (own == packed[ids]).all()
        seen = np.zeros((len(x), len(x)), dtype=bool)
        for rows, a, b in neighbours._leaves(node, x, queries, index.reach(float(np.hypot(0.3, index.error)))):
            seen[np.ix_(rows, ids[a:b])] = True
        true, hit, asked = true + close[:, ids].sum(), hit + (close & seen)[:, ids].sum(), asked + seen.sum()
    assert hit >= 0.9999 * true
    # vectors that are alike in all 64 dimensions form no groups that could be left out
    assert dims == 64 or asked < 0.95 * len(x) ** 2


def test_pairs_of_divided_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MAX_CELLS", 2)
    monkeypatch.setattr(neighbours, "SPLIT_ROWS", 100)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    x = np.concatenate([x, x + 0.15 * rng.standard_normal(x.shape)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[0].tolist()) for i in range(400)], "id long, v array<float>")
    near = {(r.key_a, r.key_b) for r in neighbours.nearest(df, "id", "v", 10, radius=0.3).filter("key_a < 5000 AND key_b < 5000 AND key_a <> 0 AND key_b <> 0").collect()}
    d2 = 2 - 2 * unit @ unit.T
    true = {(i, j) for i, j in zip(*(a.tolist() for a in np.nonzero(d2 <= 0.09)), strict=True) if i != j and i and j and 1500 not in (i, j)}
    assert {p for p in near if 1500 not in p} == true


def test_scores_of_a_scan_are_those_of_the_codes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[300:] = x[:300] + 0.02 * rng.normal(size=(300, 64)).astype(np.float32)
    index = neighbours.fit(x, len(x))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(list(x)), pa.array([True] * len(x))], names=["id", "vector", "ask"])
    routed = list(neighbours._route(index, None, 0.3)(iter([batch])))
    small, stands = {}, {}
    for b in routed:
        for query, i, cells, scale, code in zip(*(b.column(c).to_pylist() for c in ("query", "id", "cells", "scale", "code")), strict=True):
            if query:
                small[i] = np.frombuffer(code, np.int8) * np.float32(scale)
            else:
                stands[i] = index.decode(int(np.frombuffer(cells, np.int32)[0]), np.frombuffer(code, np.uint8)[None])[0]
    got = [row for b in neighbours._scan(index, None, 0.7, 11, False, 0.3)(iter(routed)) for row in zip(*(b.column(c).to_pylist() for c in ("q", "id", "score")), strict=True)]
    assert len(got) > 300 and max(abs(s - float(small[q] @ stands[i])) for q, i, s in got) < 1e-5
