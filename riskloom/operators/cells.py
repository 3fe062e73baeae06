"""Vectors dealt into cells around centres, and what cells tell about what they hold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialize

# Rows that centres are fitted on, the first by a hash. Bounds memory only: every row is dealt to
# a cell, and what is concluded from cells holds for any centres.
SAMPLE_ROWS = 20_000

# Centres are broadcast, so there are no more than this; rows and queries that meet in one task.
MAX_CELLS = 1024
PART_ROWS = 16_384
QUERY_ROWS = 2048

# Neighbouring cells make a pack, and what visits a pack makes blocks. There are about as many of
# either as this, so that vectors are repeated as often and no more, while a task stays under so
# many of the parts and blocks above and so many values of vectors.
PACKS = 8
PACK_PARTS, BLOCK_PARTS = 4, 32
PACK_VALUES = 4_000_000

# Queries times cells that are judged at a time.
JUDGED = 4_000_000

ROUNDS = 8


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def hash_sample(vectors: DataFrame, id: str, rows: int) -> np.ndarray:
    """The first rows by a hash of id and vector."""
    chosen = vectors.select("embedding", F.xxhash64(id, "embedding").alias("h")).orderBy("h").limit(rows)
    return matrix(chosen.select("embedding").toArrow()["embedding"])


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1))


def fit_centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of groups of a sample that lie near one another."""
    cells = max(1, min(cells, len(sample), MAX_CELLS))
    if not len(sample):
        return np.zeros((1, 0))
    centres = sample[np.random.default_rng(7).choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        nearest = squared(sample, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        rows = np.bincount(nearest, minlength=cells)
        centres = np.where(rows[:, None] > 0, sums / np.maximum(rows, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Cells:
    """`rows` is the written table with `cell` and `away`, a row's distance from its
    centre. `sizes` and `radius` tell of each centre how many rows it has, and how far the farthest is."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    sample: np.ndarray


def deal(vectors: DataFrame, id: str, cells: int) -> Cells:
    """Deal rows with `id` and `embedding` (of one length) to the nearest of `cells` centres."""
    sample = hash_sample(vectors, id, SAMPLE_ROWS)
    centres = fit_centres(sample, cells)
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = squared(matrix(batch.column("embedding")), shared.value)
                cell = apart.argmin(axis=1)
                away = np.sqrt(apart[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], [*batch.schema.names, "cell", "away"])

    schema = T.StructType([*vectors.schema, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    rows = materialize(vectors.mapInArrow(place, schema), "cells")
    sizes, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect():
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["away"]
    return Cells(rows, centres, sizes, radius, sample)


def most(q: np.ndarray, cells: Cells | tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each query and cell the most that the product with a row of the cell can be:
    that with the centre, and the query's length times the cell's radius."""
    centres, radius = (cells.centres, cells.radius) if isinstance(cells, Cells) else cells
    return q @ centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * radius


def visits(queries: DataFrame, cells: Cells, choose) -> DataFrame:
    """`queries` repeated for every cell that `choose` picks: it gets a batch's vectors,
    the products with all centres, the bounds of `most`, and the batch, and gives a table of booleans.
    Cells without rows are never picked."""
    shared = queries.sparkSession.sparkContext.broadcast((cells.centres, cells.radius, cells.sizes > 0))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, held = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("embedding"))
                row, cell = np.nonzero(choose(x, np.where(held, x @ centres.T, -np.inf), most(x, (centres, radius)), batch) & held)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "visited"])

    schema = T.StructType([*queries.schema, T.StructField("visited", T.IntegerType())])
    return queries.mapInArrow(pick, schema)


def nearest(count: int):
    """A choice for `visits`: the cells with the largest products."""

    def choose(x, products, bounds, batch):
        if products.shape[1] <= count:
            return np.ones(products.shape, bool)
        order = np.argsort(-products, axis=1, kind="stable")[:, :count]
        chosen = np.zeros(products.shape, bool)
        np.put_along_axis(chosen, order, True, axis=1)
        return chosen

    return choose


def _place(columns: list[str], n: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def together(rows: DataFrame, visiting: DataFrame, cells: Cells, id: str, query: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and visiting queries with the keys that they meet by: a cell, a part of a
    large cell's rows, and a block of its queries."""
    spark = rows.sparkSession
    asked = {r["visited"]: r["n"] for r in visiting.groupBy("visited").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A row for each cell: MAX_CELLS at most.
    plan = [(c, -(-int(cells.sizes[c]) // PART_ROWS), -(-n // QUERY_ROWS)) for c, n in sorted(asked.items())]
    plan = F.broadcast(spark.createDataFrame(plan, "_cell int, _parts int, _blocks int"))
    left = rows.withColumnRenamed("cell", "_cell").join(plan, "_cell").withColumn("_part", _place([id, "away"], "_parts")).withColumn("_block", _every("_blocks"))
    right = visiting.withColumnRenamed("visited", "_cell").join(plan, "_cell").withColumn("_block", _place([query], "_blocks")).withColumn("_part", _every("_parts"))
    return left.drop("_parts", "_blocks", "away"), right.drop("_parts", "_blocks"), ["_cell", "_part", "_block"]


def task_rows(rows: int, least: int, most: int, dimensions: int) -> int:
    """Rows or queries of one task: a share of all, within bounds."""
    return max(1, min(max(least, -(-rows // PACKS)), least * most, PACK_VALUES // max(dimensions, 1)))


@dataclass(frozen=True)
class Packs:
    """Cells in stretches: pack p has the cells from `first[p]` to `first[p + 1]`, and its rows
    are dealt over `parts[p]` tasks (more than one for a single large cell only)."""

    cells: Cells
    first: np.ndarray
    parts: np.ndarray


def packed(cells: Cells) -> Packs:
    limit = task_rows(int(cells.sizes.sum()), PART_ROWS, PACK_PARTS, cells.centres.shape[1])
    first, held = [0], 0
    for cell, size in enumerate(cells.sizes):
        if held and held + size > limit:
            first.append(cell)
            held = 0
        held += int(size)
    first = np.array([*first, len(cells.sizes)])
    return Packs(cells, first, np.array([max(1, -(-int(cells.sizes[a:b].sum()) // limit)) for a, b in zip(first[:-1], first[1:], strict=True)]))


def pack_visits(queries: DataFrame, packs: Packs, choose) -> DataFrame:
    """`queries` repeated for every pack with a cell that `choose` picks (see `visits`), with
    `pack`, the picked cells as bits, and their number and rows as `n_cells` and `n_rows`."""
    cells = packs.cells
    shared = queries.sparkSession.sparkContext.broadcast((cells.centres, cells.radius, cells.sizes, packs.first))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radius, sizes, first = shared.value
        held = sizes > 0
        step = max(1, JUDGED // len(centres))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                x = matrix(batch.column("embedding"))
                chosen = choose(x, np.where(held, x @ centres.T, -np.inf), most(x, (centres, radius)), batch) & held
                for pack, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    row = np.flatnonzero(chosen[:, a:b].any(axis=1))
                    if len(row):
                        mine = chosen[row, a:b]
                        bits = pa.array([r.tobytes() for r in np.packbits(mine, axis=1)], pa.binary())
                        added = [pa.array(np.full(len(row), pack), pa.int32()), bits, pa.array(mine.sum(axis=1)), pa.array(mine @ sizes[a:b])]
                        yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, *added], [*batch.schema.names, "pack", "bits", "n_cells", "n_rows"])

    added = [("pack", T.IntegerType()), ("bits", T.BinaryType()), ("n_cells", T.LongType()), ("n_rows", T.LongType())]
    return queries.mapInArrow(pick, T.StructType([*queries.schema, *[T.StructField(n, t) for n, t in added]]))


def together_in_packs(rows: DataFrame, visiting: DataFrame, packs: Packs, id: str, query: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """As `together`, for visits of packs: rows have `_at`, the place of their cell in the pack."""
    spark, cells = rows.sparkSession, packs.cells
    asked = {r["pack"]: r["n"] for r in visiting.groupBy("pack").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A row for each cell, and one for each pack: MAX_CELLS at most.
    total = max(asked.values(), default=0)
    limit = task_rows(total, QUERY_ROWS, BLOCK_PARTS, cells.centres.shape[1])
    plan = [(p, int(packs.parts[p]), -(-n // limit)) for p, n in sorted(asked.items())]
    places = [(c, c - int(packs.first[p]), p, parts, blocks) for p, parts, blocks in plan for c in range(int(packs.first[p]), int(packs.first[p + 1]))]
    plan = F.broadcast(spark.createDataFrame(plan, "pack int, _parts int, _blocks int"))
    places = F.broadcast(spark.createDataFrame(places, "cell int, _at int, pack int, _parts int, _blocks int"))
    left = rows.join(places, "cell").withColumn("_part", _place([id, "away"], "_parts")).withColumn("_block", _every("_blocks"))
    right = visiting.drop("n_cells", "n_rows").join(plan, "pack").withColumn("_block", _place([query], "_blocks")).withColumn("_part", _every("_parts"))
    return left.drop("cell", "_parts", "_blocks", "away"), right.drop("_parts", "_blocks"), ["pack", "_part", "_block"]


def met_cells(at: np.ndarray, bits: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of rows and queries that meet in a task, for each cell its rows and the queries that visit it."""
    bits = np.unpackbits(np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), -1), axis=1)
    order = np.argsort(at, kind="stable")
    held, starts = np.unique(at[order], return_index=True)
    for cell, rows in zip(held, np.split(order, starts[1:]), strict=True):
        queries = np.flatnonzero(bits[:, cell])
        if len(queries):
            yield rows, queries
