"""Neighbours against a search of everything."""

import numpy as np
import pytest

from riskloom.llm import nearest as op
from riskloom.operators import cells
from tests.conftest import SF


def brute(rows, asked, k=5):
    out = {}
    for q, x in asked:
        scores = [(-float(op.cosine(np.array([x], float), np.array([y], float))[0]), i is None, i) for i, y in rows if i != q and len(y) == len(x)]
        out[q] = [(i, -s) for s, _, i in sorted(scores, key=lambda r: (r[0], r[1], r[2] or 0))[:k]]
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(op, "CELL_ROWS", 100)
    monkeypatch.setattr(cells, "PART_ROWS", 60)
    monkeypatch.setattr(cells, "QUERY_ROWS", 4)
    monkeypatch.setattr(op, "AT_ONCE", 3)
    monkeypatch.setattr(op, "SCORED_FIRST", 20)


def test_recall(spark, small_blocks):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = vectors.where("vec_id % 50 = 0")
    got = op.search(op.build_index(vectors), asked).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0])
    assert len(got) == 5 * len(want)
    hits = sum(want[r["query_id"]][r["rank"] - 1] == (r["vec_id"], r["score"]) for r in got)
    assert hits >= 0.98 * len(got)


def test_error_bound():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 64)) + 0.3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rest = unit @ op.rotation(64).T
    aligned = np.abs(rest).sum(axis=1) / 8
    q = unit[0] @ op.rotation(64).T
    near = np.sign(rest) @ q / 8 / aligned
    off = np.abs(near - unit @ unit[0]) <= np.sqrt(1 - aligned**2) / aligned * op.EPSILON / np.sqrt(63)
    assert off[1:].mean() > 0.99


def test_cases(spark, small_blocks):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [3.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]),
        (6, [inf, 1.0, 0.0]), (7, [None, 1.0, 0.0]), (8, [1.0, 1.0]), (9, []), (None, [1.0, 0.1, 0.0]), (50, [0.0, 1.0, 0.0]), (50, [0.0, 1.0, 0.0]),
        (100, [1.0, 1.0, 1.0, 1.0]), (150, None),
    ]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = {}
    for r in op.search(op.build_index(vectors), vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, None, 50, 50], 50: [None, 0, 1, 2]}
    none = vectors.where("false")
    assert op.search(op.build_index(none), none).count() == 0
    assert op.search(op.build_index(vectors), none).count() == 0


def test_cells_are_skipped(spark, small_blocks):
    """Grouped vectors: most cells cannot hold a near row and are not visited; with the
    error bound wide, nothing is lost."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((10, 32))[rng.integers(10, size=800)] + 0.05 * rng.standard_normal((800, 32))
    vectors = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = op.build_index(vectors)
    assert index[1].cells() == 8
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    want = brute(rows, rows[::50])
    got = {}
    for r in op.search(index, vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sum(got[q][i][0] == want[q][i][0] for q in want for i in range(5)) >= 0.95 * 5 * len(want)
    radius, held = np.zeros(8), np.ones(8, bool)
    for r in index[0].groupBy("cell").agg({"away": "max"}).collect():
        radius[r["cell"]] = r["max(away)"]
    asked = op.usable(vectors.where("vec_id % 50 = 0"), "vec_id", "embedding").selectExpr("id", "vector", "size", "0.95D AS least")
    assert op._visits(asked, index[1], radius, held, True).count() < 16 * 2
