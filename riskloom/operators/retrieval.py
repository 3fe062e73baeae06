"""Embedding of text and top-k retrieval by cosine distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskloom.fixed import DEFAULT_TOP_K
from riskloom.operators.cells import Cells, deal, hash_sample, matrix, met_cells, nearest, pack_visits, packed, squared, together_in_packs
from riskloom.session import materialize

# Rows for each cell of the exact search, as many as make a task worth while.
CELL_ROWS = 4096

# The approximate search scores by codes first, and reads so many vectors for each row
# asked for. Its probes reach the stated recall on a sample of so many queries.
REREAD = 10
TRIAL_QUERIES = 256
STATED_RECALL = 0.95

# Distances computed at a time within a task.
TILE_CELLS = 4_000_000

# Distances are compared at this many digits, so that equal vectors tie however their
# products were summed.
DIGITS = 12

DIMENSIONS = 384


def fit_encoder(chunks: DataFrame, dimensions: int = DIMENSIONS) -> PipelineModel:
    """The built-in text encoder: hashed words, weighted by rarity, as unit vectors."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(chunks)


def embed(df: DataFrame, encoder: PipelineModel | Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Add `embedding` to rows with `text`, by a fitted encoder or by any function from a
    series of texts to a series of vectors, which is applied to Arrow batches."""
    if isinstance(encoder, PipelineModel):
        helpers = [c for c in ["_words", "_counts", "_weighted", "_unit"]]
        encoded = encoder.transform(df).withColumn("embedding", vector_to_array("_unit", "float32"))
        return encoded.drop(*helpers)
    function = F.pandas_udf(encoder, T.ArrayType(T.FloatType()))
    return df.withColumn("embedding", function("text"))


def check_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored rows against chunks, number of dimensions in use, and distance of the norms
    from one."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    stored = vectors.agg(
        F.count(F.lit(1)).alias("stored"),
        F.count_distinct(F.size("embedding")).alias("dimension_count"),
        F.max(F.size("embedding")).cast("long").alias("dimension"),
        F.max(F.abs(norm - 1)).alias("norm_error"),
    )
    expected = chunks.agg(F.count(F.lit(1))).scalar()
    ok = (F.col("stored") == F.col("expected")) & (F.col("dimension_count") == 1) & (F.col("norm_error") < 1e-4)
    return stored.withColumn("expected", expected).withColumn("ok", ok)


def _checked_k(k: int | None) -> int:
    k = k or DEFAULT_TOP_K
    if k < 1:
        raise ValueError("k must be at least 1")
    return k


def _cut(found: pa.Table, k: int) -> pa.Table:
    """The k nearest rows per query, ties by chunk id."""
    found = found.sort_by([("query", "ascending"), ("distance", "ascending"), ("chunk_id", "ascending")])
    query = found["query"].to_numpy()
    starts = np.r_[True, query[1:] != query[:-1]] if len(query) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(starts)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return found.filter(pa.array(rank < k))


def _keep_best(found: pa.Table, k: int) -> pa.Table:
    """As `_cut`, with every chunk id once for a query."""
    found = found.group_by(["query", "chunk_id"]).aggregate([("distance", "min")])
    return _cut(pa.table({"query": found["query"], "chunk_id": found["chunk_id"], "distance": found["distance_min"]}), k)


def _slack(queries: np.ndarray, vectors: np.ndarray) -> float | None:
    """By how much a product in single precision can be off, or nothing where a number is too large for it."""
    longest = [float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0.0))) for x in (queries, vectors)]
    most = longest[0] * longest[1]
    # Twice the bound for rounded numbers, products and sums.
    return (vectors.shape[1] + 4) * 2.0**-23 * most if np.isfinite(most) and max(longest) < 1e15 else None


def _distances(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The distances of some pairs, some at a time."""
    step = max(1, TILE_CELLS // max(vectors.shape[1], 1))
    return 1.0 - np.concatenate([np.einsum("ij,ij->i", queries[q[i : i + step]], vectors[v[i : i + step]]) for i in range(0, max(len(q), 1), step)])


def _search(queries: np.ndarray, vectors: np.ndarray, ids: pa.Array, k: int, worst: np.ndarray) -> pa.Table:
    """The k nearest vectors for each query, as `query, chunk_id, distance`. Those beyond a
    query's `worst`, where it is known (else infinite), may be missing. Pairs are first
    compared in single precision; distances are made in double of those that its error
    leaves in question."""
    parts = []
    tile = max(1, TILE_CELLS // max(len(vectors), 1))
    slack = _slack(queries, vectors)
    single = (queries.astype(np.float32), vectors.astype(np.float32).T) if slack is not None else None
    for start in range(0, len(queries), tile):
        own, limit = queries[start : start + tile], worst[start : start + tile, None]
        unknown = len(vectors) > k and not np.isfinite(limit).all()
        # Rounding moves a distance by less than a step.
        if single:
            product = single[0][start : start + tile] @ single[1]
            if unknown:
                limit = np.minimum(limit, 1 + slack - np.partition(product, -k, axis=1)[:, -k : -k + 1 or None])
            least = np.nextafter((1 - slack - limit - 10.0**-DIGITS).astype(np.float32), np.float32(-np.inf))
            q, v = np.divmod(np.flatnonzero(product >= least), max(len(vectors), 1))
            near = _distances(own, vectors, q, v)
        else:
            distance = 1.0 - own @ vectors.T
            if unknown:
                limit = np.minimum(limit, np.partition(distance, k - 1, axis=1)[:, k - 1 : k])
            q, v = np.nonzero((distance <= limit + 10.0**-DIGITS) | (distance.shape[1] <= k))
            near = distance[q, v]
        if len(q):
            near = np.round(near, DIGITS)
            parts.append(_keep_best(pa.table({"query": q + start, "chunk_id": ids.take(pa.array(v)), "distance": near}), k))
    return pa.concat_tables(parts) if parts else pa.table({"query": pa.array([], pa.int64()), "chunk_id": ids[:0], "distance": pa.array([], pa.float64())})


def _meet(chunks: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest chunks per query among the cells that it visits of a group of `keys`.
    Queries may have `kth`, a distance beyond which nothing is wanted."""
    schema = T.StructType(
        [queries.schema["query_id"], chunks.schema["chunk_id"], T.StructField("distance", T.DoubleType())]
    )

    def nearest(chunks: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({f.name: pa.array([], t) for f, t in zip(schema, [queries.schema.field("query_id").type, chunks.schema.field("chunk_id").type, pa.float64()], strict=True)})
        chunks, queries = chunks.combine_chunks(), queries.combine_chunks()
        if not len(chunks) or not len(queries):
            return empty
        one = lambda t, c: t[c].combine_chunks()
        x, v, ids = matrix(one(queries, "embedding")), matrix(one(chunks, "embedding")), one(chunks, "chunk_id")
        worst = np.full(len(x), np.inf)
        if "kth" in queries.column_names:
            worst = one(queries, "kth").to_numpy(zero_copy_only=False).astype(float)
            worst = np.where(np.isnan(worst), np.inf, worst)
        found, held = [], 0
        for rows, asking in met_cells(one(chunks, "_at").to_numpy(), one(queries, "bits")):
            best = _search(x[asking], v[rows], ids.take(pa.array(rows)), k, worst[asking])
            found.append(best.set_column(0, "query", pa.array(asking[best["query"].to_numpy()])))
            held += len(best)
            if held > TILE_CELLS:
                found = [_cut(pa.concat_tables(found), k)]
                held = len(found[0])
        if not held:
            return empty
        best = _cut(pa.concat_tables(found), k).combine_chunks()
        return pa.table({"query_id": one(queries, "query_id").take(one(best, "query")), "chunk_id": best["chunk_id"], "distance": best["distance"]})

    return chunks.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(nearest, schema)


def _usable(table: DataFrame, name: str) -> DataFrame:
    return table.select(name, "embedding").where("embedding is not null")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by_distance = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(by_distance).cast("long")).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Search:
    """`found` as `topk_cosine` returns it, and `effort`, one row: `queries, rows, cells`,
    `visits` (queries times the cells they were compared with), `compared` (rows in these),
    and `vectors_read` (those of them whose vectors were read)."""

    found: DataFrame
    effort: DataFrame


def _effort(queries: DataFrame, index: Cells, visits: DataFrame | None, vectors_read: DataFrame | None) -> DataFrame:
    """From written tables: visits with `n_cells` and `n_rows`, and a row for each vector read."""
    visits = queries.select(F.lit(0).alias("n_cells"), F.lit(0).alias("n_rows")).where("false") if visits is None else visits
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("long")
    made = visits.agg(total("n_cells").alias("visits"), total("n_rows").alias("compared"))
    asked = queries.agg(F.count(F.lit(1))).scalar()
    read = F.col("compared") if vectors_read is None else vectors_read.agg(F.count(F.lit(1))).scalar()
    rows, cells = int(index.sizes.sum()), int((index.sizes > 0).sum())
    return made.select(asked.alias("queries"), F.lit(rows).cast("long").alias("rows"), F.lit(cells).cast("long").alias("cells"), "visits", "compared", read.alias("vectors_read"))


def search_exact(queries: DataFrame, chunks: DataFrame, k: int | None = DEFAULT_TOP_K, cell_rows: int | None = None) -> Search:
    """The k nearest chunks of each query, exactly, without comparing what cannot be near.

    Chunks are dealt into cells around centres. Every query is compared with its own cell first,
    which gives a k-th nearest distance; then with every other cell that can hold a
    nearer one by the product with its centre and its radius. Chunks of unit length lie
    the nearer to their centres the more structure they have; without any, every cell
    is visited, and only then is the work that of all pairs. Cells are packed, so that a
    query goes to a pack once, with the cells that it visits there; large cells are dealt
    over several tasks, and so are the queries that visit a pack.
    """
    k = _checked_k(k)
    queries, chunks = materialize(_usable(queries, "query_id"), "queries"), materialize(_usable(chunks, "chunk_id"), "chunks")
    rows = chunks.count()
    index = deal(chunks, "chunk_id", -(-rows // (cell_rows or CELL_ROWS)))
    schema = T.StructType([queries.schema["query_id"], chunks.schema["chunk_id"], T.StructField("distance", T.DoubleType())])
    if rows == 0 or queries.isEmpty():
        empty = queries.sparkSession.createDataFrame([], schema)
        return Search(_ranked(empty, k), _effort(queries, index, None, None))
    packs, home = packed(index), nearest(1)
    own = materialize(pack_visits(queries, packs, home), "visits")
    found = materialize(_meet(*together_in_packs(index.rows, own, packs, "chunk_id", "query_id"), k), "found")
    if (index.sizes > 0).sum() == 1:
        return Search(_ranked(found, k), _effort(queries, index, own, None))
    kth = _ranked(found, k).where(F.col("rank") == k).select("query_id", F.col("distance").alias("kth"))
    asked = queries.join(kth, "query_id", "left")

    def can_hold(x, products, bounds, batch):
        worst = batch.column("kth").to_numpy(zero_copy_only=False).astype(float)
        worst = np.where(np.isnan(worst), np.inf, worst)
        return (1 - bounds <= worst[:, None] + 10.0**-DIGITS) & ~home(x, products, bounds, batch)

    other = materialize(pack_visits(asked, packs, can_hold), "visits")
    if not other.isEmpty():
        found = found.unionByName(_meet(*together_in_packs(index.rows, other, packs, "chunk_id", "query_id"), k))
    return Search(_ranked(found, k), _effort(queries, index, own.select("n_cells", "n_rows").unionByName(other.select("n_cells", "n_rows")), None))


def topk_cosine(queries: DataFrame, chunks: DataFrame, k: int | None = DEFAULT_TOP_K) -> DataFrame:
    """The k nearest chunks `chunk_id, embedding` per query `query_id, embedding` (unit
    vectors), exactly: rows `query_id, chunk_id, distance, rank`, ties by chunk id. See
    `search_exact`; neither table goes through the driver."""
    return search_exact(queries, chunks, k).found


def probes_for(index: Cells, queries: np.ndarray, k: int, wanted: float) -> int:
    """How many cells a query has to visit so that the stated share of its k nearest lies
    in them, measured on the sample that the centres were fitted on. In all rows the nearest are
    nearer than in a sample, so fewer visits would do."""
    if not len(queries) or not len(index.sample):
        return 1
    home = squared(index.sample, index.centres).argmin(axis=1)
    products = np.where(index.sizes > 0, queries @ index.centres.T, -np.inf)
    place = np.argsort(np.argsort(-products, axis=1, kind="stable"), axis=1, kind="stable")
    k = min(k, len(index.sample))
    hits = np.argpartition(-(queries @ index.sample.T), k - 1, axis=1)[:, :k]
    needed = np.sort(np.take_along_axis(place, home[hits], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(wanted * len(needed))))]) + 1


def with_codes(rows: DataFrame) -> DataFrame:
    """Index rows with their vectors as one byte a component, and the value of a step."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("embedding"))
                step = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
                codes = np.rint(x / step[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("chunk_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step), batch.column("cell"), batch.column("away")],
                    ["chunk_id", "code", "step", "cell", "away"],
                )

    extra = [T.StructField("code", T.BinaryType()), T.StructField("step", T.DoubleType())]
    return rows.mapInArrow(encode, T.StructType([rows.schema["chunk_id"], *extra, rows.schema["cell"], rows.schema["away"]]))


def search_cells(queries: DataFrame, chunks: DataFrame, k: int | None = DEFAULT_TOP_K, wanted: float = STATED_RECALL) -> Search:
    """The k nearest chunks of each query, nearly: distances are exact, and the share of
    nearest chunks found is about `wanted`.

    A query visits as many of the nearest cells as the stated recall needs (`probes_for`).
    What visits it meets are codes of a byte a component; only the vectors of the best
    REREAD times k by their codes are read, by id.
    """
    k = _checked_k(k)
    queries, chunks = materialize(_usable(queries, "query_id"), "queries"), materialize(_usable(chunks, "chunk_id"), "chunks")
    index = deal(chunks, "chunk_id", round(chunks.count() ** 0.5))
    coded = materialize(with_codes(index.rows), "codes")
    probes = probes_for(index, hash_sample(queries, "query_id", TRIAL_QUERIES), k, wanted)
    packs = packed(index)
    visiting = materialize(pack_visits(queries, packs, nearest(probes)), "visits")
    schema = T.StructType([queries.schema["query_id"], chunks.schema["chunk_id"], T.StructField("distance", T.DoubleType())])
    kept = REREAD * k

    def by_code(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows, asked = rows.combine_chunks(), asked.combine_chunks()
        x = matrix(asked["embedding"]).astype(np.float32)
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.int8).reshape(len(rows), -1)
        step = rows["step"].to_numpy().astype(np.float32)
        # The best of each query over the cells seen so far, by product; of rows -1 there are none.
        best, place = np.full((len(x), kept), -np.inf, np.float32), np.full((len(x), kept), -1, np.int32)
        for held, asking in met_cells(rows["_at"].to_numpy(), asked["bits"].combine_chunks()):
            block = codes[held].astype(np.float32).T
            tile = max(1, TILE_CELLS // len(held))
            for q in np.split(asking, range(tile, len(asking), tile)):
                near, at = (x[q] @ block) * step[held], np.broadcast_to(held.astype(np.int32), (len(q), len(held)))
                near, at = np.hstack([best[q], near]), np.hstack([place[q], at])
                chosen = np.argpartition(-near, kept - 1, axis=1)[:, :kept]
                best[q], place[q] = np.take_along_axis(near, chosen, 1), np.take_along_axis(at, chosen, 1)
        query, column = np.nonzero(place >= 0)
        found = asked.select(["query_id"]).take(pa.array(query))
        found = found.append_column("chunk_id", rows["chunk_id"].combine_chunks().take(pa.array(place[query, column])))
        return found.append_column("distance", pa.array(1.0 - best[query, column].astype(np.float64)))

    left, right, keys = together_in_packs(coded, visiting, packs, "chunk_id", "query_id")
    guessed = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(by_code, schema)
    best = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    chosen = guessed.withColumn("place", F.row_number().over(best)).where(F.col("place") <= kept)
    chosen = materialize(chosen.select("query_id", "chunk_id"), "chosen")
    product = F.aggregate(F.zip_with("asked", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda t, p: t + p)
    exact = chosen.join(chunks, "chunk_id").join(queries.withColumnRenamed("embedding", "asked"), "query_id").select("query_id", "chunk_id", F.round(1 - product, DIGITS).alias("distance"))
    found = _ranked(exact.groupBy("query_id", "chunk_id").agg(F.min("distance").alias("distance")), k)
    return Search(found, _effort(queries, index, visiting, chosen))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact results that an approximate search found."""
    hits = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    return hits.agg(
        F.count(F.lit(1)).alias("exact_rows"),
        F.count("_hit").alias("found_rows"),
        F.try_divide(F.count("_hit").cast("double"), F.count(F.lit(1))).alias("recall"),
    )
