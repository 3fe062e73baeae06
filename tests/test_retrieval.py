import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel

from riskloom.operators import cells as c
from riskloom.operators import retrieval as r


def table(spark, vectors, name, ids=None):
    ids = ids or list(range(len(vectors)))
    kind = "string" if isinstance(ids[0], str) else "long"
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{name} {kind}, embedding array<float>").repartition(5)


def unit(n, d, seed):
    v = np.random.default_rng(seed).standard_normal((n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def brute(queries, vectors, ids, k):
    out = {}
    for q, query in enumerate(queries):
        distance = np.round(1 - vectors.astype(float) @ query.astype(float), r.DIGITS)
        best = sorted(zip(distance, ids))[:k]
        out.update({(q, i + 1): (c, round(d, 9)) for i, (d, c) in enumerate(best)})
    return out


def found(df):
    return {(x["query_id"], x["rank"]): (x["chunk_id"], round(x["distance"], 9)) for x in df.collect()}


@pytest.mark.parametrize("query_rows,part_rows,cell_rows,cells", [(2048, 16_384, 4096, 4_000_000), (7, 30, 25, 50)])
def test_exact_with_copies(spark, monkeypatch, query_rows, part_rows, cell_rows, cells):
    """A third of the chunks are copies of one vector; ties go to the smallest id."""
    monkeypatch.setattr(c, "QUERY_ROWS", query_rows)
    monkeypatch.setattr(c, "PART_ROWS", part_rows)
    monkeypatch.setattr(r, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(r, "TILE_CELLS", cells)
    queries, vectors = unit(20, 16, 1), unit(200, 16, 2)
    vectors[100:170] = vectors[3]
    queries[5] = vectors[3]
    ids = [f"doc_{i:03d}" for i in np.random.default_rng(0).permutation(200)]
    got = found(r.topk_cosine(table(spark, queries, "query_id"), table(spark, vectors, "chunk_id", ids), 4))
    assert got == brute(queries, vectors, ids, 4)


def test_k(spark):
    queries, vectors = table(spark, unit(2, 8, 1), "query_id"), table(spark, unit(2, 8, 2), "chunk_id")
    assert r.topk_cosine(queries, vectors, 0).count() == 4  # the default of 3, with two chunks to find
    assert r.topk_cosine(queries, vectors, 1).count() == 2
    with pytest.raises(ValueError):
        r.topk_cosine(queries, vectors, -1)
    assert r.topk_cosine(queries.limit(0), vectors).count() == 0


def grouped(n, groups, d, seed):
    """Vectors in tight groups, as embeddings of related texts are."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((groups, d))[rng.integers(groups, size=n)] + 0.05 * rng.standard_normal((n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def test_exact_skips_cells(spark):
    """Grouped vectors: few cells are visited, and nothing is lost."""
    queries, vectors = grouped(60, 12, 16, 5), grouped(600, 12, 16, 5)
    ids = list(range(600))
    search = r.search_exact(table(spark, queries, "query_id"), table(spark, vectors, "chunk_id"), 4, cell_rows=50)
    assert found(search.found) == brute(queries, vectors, ids, 4)
    effort = search.effort.first()
    assert effort["queries"] == 60 and effort["rows"] == 600 and effort["compared"] < 0.4 * 60 * 600


def test_exact_of_any_length(spark):
    """Bounds hold for vectors of any length, zero ones too."""
    rng = np.random.default_rng(9)
    queries, vectors = rng.standard_normal((20, 8)).astype(np.float32), (rng.standard_normal((200, 8)) * rng.exponential(1, (200, 1))).astype(np.float32)
    vectors[:5] = 0
    search = r.search_exact(table(spark, queries, "query_id"), table(spark, vectors, "chunk_id"), 3, cell_rows=20)
    assert found(search.found) == brute(queries, vectors, list(range(200)), 3)


def test_a_visit_of_many_cells_is_a_row_for_each_pack(spark):
    """Queries that visit every cell are not repeated for each of them."""
    queries, vectors = unit(30, 16, 1), unit(400, 16, 2)
    index = c.deal(table(spark, vectors, "chunk_id"), "chunk_id", 40)
    packs = c.packed(index)
    made = c.pack_visits(table(spark, queries, "query_id"), packs, lambda x, products, bounds, batch: np.ones(products.shape, bool)).collect()
    assert len(packs.parts) == 1 and len(made) == 30
    assert {(v["n_cells"], v["n_rows"]) for v in made} == {(int((index.sizes > 0).sum()), 400)}


@pytest.mark.parametrize("part_rows", [16_384, 9])
@pytest.mark.parametrize("make", [unit, lambda n, d, seed: grouped(n, 25, d, seed % 2)])
def test_cells_find_the_stated_share(spark, monkeypatch, part_rows, make):
    monkeypatch.setattr(c, "PART_ROWS", part_rows)
    queries, vectors = make(100, 24, 3), make(1500, 24, 5)
    q, v = table(spark, queries, "query_id"), table(spark, vectors, "chunk_id")
    exact, near = r.topk_cosine(q, v, 3), r.search_cells(q, v, 3)
    distances = 1 - queries.astype(float) @ vectors.astype(float).T
    for row in near.found.collect():
        assert row["distance"] == pytest.approx(distances[row["query_id"], row["chunk_id"]], abs=1e-9)
    assert r.recall(near.found, exact).first()["recall"] >= 0.9
    assert r.recall(exact, exact).first()["recall"] == 1.0
    effort = near.effort.first()
    assert effort["vectors_read"] <= 100 * r.REREAD * 3 and effort["compared"] <= 100 * 1500
    if make is not unit:
        assert effort["compared"] < 0.2 * 100 * 1500
    assert r.search_cells(q.limit(0), v).found.count() == 0


def test_built_in_encoder(spark):
    chunks = spark.createDataFrame([("a", "review the claim"), ("b", "graph of claims"), ("c", "score and threshold")], "chunk_id string, text string")
    encoder = r.fit_encoder(chunks)
    assert isinstance(encoder, PipelineModel)
    vectors = r.embed(chunks, encoder)
    row = r.check_vectors(vectors, chunks).first()
    assert row["ok"] and row["dimension"] == r.DIMENSIONS
    asked = r.embed(spark.createDataFrame([(1, "claim review")], "query_id long, text string"), encoder)
    assert r.topk_cosine(asked, vectors, 1).first()["chunk_id"] == "a"


def test_own_encoder_and_failed_checks(spark):
    def lengths(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(len(t)), 0.0])

    chunks = spark.createDataFrame([("a", "xx"), ("b", "x")], "chunk_id string, text string")
    vectors = r.embed(chunks, lengths)
    assert {x["chunk_id"]: x["embedding"] for x in vectors.collect()} == {"a": [2.0, 0.0], "b": [1.0, 0.0]}
    row = r.check_vectors(vectors, chunks).first()
    assert not row["ok"] and row["norm_error"] == 1.0


def test_single_precision_decides_nothing():
    """Vectors that only double precision tells apart are found in their order, with and without a known k-th."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=64) / 8
    vectors = base + np.linspace(0, 1e-7, 40)[rng.permutation(40), None] * rng.normal(size=64)
    queries = np.vstack([base, rng.normal(size=(5, 64)), np.full((1, 64), 1e30)])
    ids = pa.array([f"c{i:02d}" for i in range(40)])
    for rows in (queries[:6], queries):  # the last is too large for single precision
        distance = np.round(1 - rows @ vectors.T, r.DIGITS)
        for worst in (np.full(len(rows), np.inf), np.sort(distance, axis=1)[:, 2]):
            found = r._search(rows, vectors, ids, 3, worst)
            got = found["distance"].to_numpy().reshape(-1, 3)
            wanted = np.sort(distance, axis=1)[:, :3]
            assert np.allclose(got, wanted, rtol=1e-12, atol=2e-12)
    assert r._slack(queries[:6], vectors) is not None and r._slack(queries, vectors) is None
    few = r._search(queries[:2], vectors[:2], ids[:2], 3, np.full(2, np.inf))
    assert len(few) == 4
    assert len(r._search(queries[:0], vectors, ids, 3, np.full(0, np.inf))) == 0
