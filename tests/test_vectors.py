"""Neighbours on a grid and by the stored index against plain numpy."""

import numpy as np
import pytest

from leafmill.operators import quantised, vectors


def frame(spark, v, name):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], f"{name} long, v array<float>")


def plain(q, v, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    d = np.round(np.maximum(0, 1 - unit(q.astype(np.float32).astype(float)) @ unit(v.astype(np.float32).astype(float)).T), 6)
    return {i: [int(j) for j in np.lexsort((np.arange(len(v)), row))[:k]] for i, row in enumerate(d)}


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.ord)
    return out


@pytest.mark.parametrize(("few", "side"), [(4096, 8192), (0, 8192), (0, 16), (5, 7)])
def test_nearest(spark, few, side):
    rng = np.random.RandomState(1)
    v, q = rng.randn(90, 6), rng.randn(23, 6)
    v[7] = v[8] = v[3]  # ties
    v[9] = q[4] = 0
    assert ranked(vectors.nearest(frame(spark, q, "query_id"), frame(spark, v, "ord"), 5, few, side)) == plain(q, v, 5)


def test_nearest_of_nothing(spark):
    some, none = frame(spark, np.ones((2, 3)), "query_id"), frame(spark, np.ones((0, 3)), "ord")
    for few in (0, 10):
        assert vectors.nearest(some, none, 5, few).collect() == []
        assert vectors.nearest(some.limit(0), frame(spark, np.ones((2, 3)), "ord"), 5, few).collect() == []


def clustered(n=3000, dims=32, seed=2):
    rng = np.random.RandomState(seed)
    centres = rng.randn(30, dims) * 3
    return centres[rng.randint(0, 30, n)] + rng.randn(n, dims)


def test_stored_cells_of_clustered_vectors(spark, tmp_path):
    v = clustered()
    at = str(tmp_path / "index")
    quantised.build(frame(spark, v, "ord"), at, 10)
    index = quantised.CellIndex(spark, at)
    q = v[::100]
    asked = frame(spark, q, "query_id")
    want, got = plain(q, v, 10), ranked(index.nearest(asked, 10))
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.9
    assert all(len(x) == 10 for x in got.values())
    read = [index.folders(asked.where(f"query_id = {i}"))[0] for i in range(5)]
    assert max(read) * 2 < len(index.sizes)
    exact = {(r.query_id, r.ord): r.distance for r in vectors.nearest(asked, frame(spark, v, "ord"), 3000).collect()}
    assert all(exact[r.query_id, r.ord] == r.distance for r in index.nearest(asked, 10).collect())
    share = quantised.recall(index.nearest(asked, 10), vectors.nearest(asked, frame(spark, v, "ord"), 10)).first()
    assert (share.queries, share.wanted) == (30, 300) and share.share >= 0.9


def test_stored_cells_of_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quantised, "CELL_ROWS", 20)  # every cell is dealt to several tasks
    monkeypatch.setattr(quantised, "ASKED", 3)
    v = clustered(200, 5)
    v[:60] = v[0]  # a large group of copies
    v[70] = 0
    rows = frame(spark, v, "ord").unionByName(spark.createDataFrame([(999, None)], "ord long, v array<float>"))
    at = str(tmp_path / "index")
    quantised.build(rows, at, 4)
    asked = frame(spark, v[[0, 70, 80, 90, 100, 110, 120]], "query_id")
    got = ranked(quantised.CellIndex(spark, at).nearest(asked, 4))
    assert got[0] == [0, 1, 2, 3] or set(got[0]) <= set(range(60))
    assert all(len(x) == 4 for x in got.values()) and len(got) == 7
    quantised.build(rows.limit(0), str(tmp_path / "none"), 4)
    assert quantised.CellIndex(spark, str(tmp_path / "none")).nearest(asked, 4).collect() == []
