"""Approximate nearest neighbours by cosine, with randomly rotated one-bit codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.cells import MAX_CELLS, Cells, fit_centres, most, squared, together
from riskloom.session import materialize

# Rows that centres are fitted on; bounds memory only, the bounds hold for any centres.
CENTRE_ROWS = 10_000

# Rows for each centre.
CELL_ROWS = 8192

# Queries whose estimates are held at once, rows that are scored first for each, and the
# width of the error bound in standard deviations of the estimate.
AT_ONCE = 256
SCORED_FIRST = 64
EPSILON = 2.7

INDEX = "id long, vector array<double>, size int, cell int, away double, code binary, spread double, aligned double"
FOUND = "query_id long, vec_id long, score double"


@lru_cache(8)
def rotation(size: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """`id, vector, size` of the vectors that have a direction."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = rows.where(F.col("vector").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0))
    return whole.withColumn("size", F.size("vector"))


@dataclass(frozen=True)
class Centres:
    """For each length of vector its centres, and the number of the first of them."""

    of: dict[int, np.ndarray]
    first: dict[int, int]

    def cells(self) -> int:
        return sum(map(len, self.of.values()))


def centres(rows: DataFrame) -> Centres:
    """Centres of unit vectors for each length, from a bounded sample of rows; a length that
    the sample lacks has one at zero. There are MAX_CELLS in all, or one for each length."""
    counts = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").collect()}
    total = max(1, sum(counts.values()))
    sample = rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(total)) < CENTRE_ROWS).select("vector", "size").toArrow()
    sizes, of, first = sample["size"].to_numpy(), {}, {}
    per = max(CELL_ROWS, -(-total // MAX_CELLS))
    for size, n in counts.items():
        x = np.array(sample["vector"].filter(pa.array(sizes == size)).to_pylist(), np.float64).reshape(-1, size)
        first[size] = sum(map(len, of.values()))
        of[size] = fit_centres(x / np.linalg.norm(x, axis=1, keepdims=True), -(-n // per)) if len(x) else np.zeros((1, size))
    return Centres(of, first)


def build_index(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Centres]:
    """The centres, and a row for every usable vector: `id, vector, size, cell, away, code,
    spread, aligned`.

    `cell` is the nearest centre and `away` the distance from it. `code` holds the signs
    of the rotated unit vector less its centre, a bit for each coordinate; `spread` is
    the length of that difference, and `aligned` the inner product of its direction with the
    code's. Vectors that are null, zero, or hold null or non-finite components have no
    row. Vectors of several lengths keep apart.
    """
    rows = usable(vectors, id, vector)
    middle = centres(rows)
    shared = vectors.sparkSession.sparkContext.broadcast(middle)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                x = part.column("vector").flatten().to_numpy().reshape(-1, size)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                own = shared.value.of[size]
                cell = squared(unit, own).argmin(axis=1)
                less = unit - own[cell]
                rest = less @ rotation(size).T
                spread = np.linalg.norm(rest, axis=1)
                aligned = np.abs(rest).sum(axis=1) / np.sqrt(size) / np.maximum(spread, 1e-300)
                code = np.packbits(rest > 0, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array((cell + shared.value.first[size]).astype(np.int32)), pa.array(np.linalg.norm(less, axis=1)),
                     pa.array([c.tobytes() for c in code], pa.binary()), pa.array(spread), pa.array(np.where(spread > 0, aligned, 1.0))],
                    ["id", "vector", "size", "cell", "away", "code", "spread", "aligned"],
                )

    return materialize(rows.mapInArrow(encode, INDEX), "index"), middle


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last."""
    dot, left, right = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        x, y = a[:, k], b[:, k]
        dot += x * y
        left += x * x
        right += y * y
    return np.clip(dot / np.sqrt(left * right), -1, 1)


def search_block(ids: np.ndarray, x: np.ndarray, index: dict[str, np.ndarray], centre: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nearest rows of a part of a cell for each query: query id, row, score; the k
    nearest are among them, as far as they reach `least`, a score that k rows
    elsewhere are known to have.

    The first rows by estimate give a k-th best score; every row whose upper bound reaches
    it is then scored on the original vectors.
    """
    size = x.shape[1]
    signs = np.unpackbits(index["code"], axis=1, count=size).astype(np.float32) * 2 - 1
    scale = (index["spread"] / np.sqrt(size) / index["aligned"]).astype(np.float32)
    slack = (index["spread"] * np.sqrt(np.maximum(0, 1 - index["aligned"] ** 2)) / index["aligned"] * EPSILON / np.sqrt(max(1, size - 1))).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    others = index["vector"] / np.linalg.norm(index["vector"], axis=1, keepdims=True)
    turned = (unit @ rotation(size).T).astype(np.float32)
    base = (unit @ centre).astype(np.float32)
    out = []
    for i in range(0, len(x), AT_ONCE):
        own = unit[i : i + AT_ONCE]
        near = (turned[i : i + AT_ONCE] @ signs.T) * scale + base[i : i + AT_ONCE, None]
        near[ids[i : i + AT_ONCE, None] == index["id"][None, :]] = -np.inf
        first = min(near.shape[1], max(SCORED_FIRST, k))
        top = np.argpartition(-near, first - 1, axis=1)[:, :first]
        scored = np.einsum("qd,qtd->qt", own, others[top])
        scored[np.isinf(np.take_along_axis(near, top, 1))] = -np.inf
        kth = np.partition(scored, first - k, axis=1)[:, first - k] if first >= k else np.full(len(own), -np.inf)
        kth = np.maximum(kth, least[i : i + AT_ONCE]) - 1e-6
        q, row = np.nonzero((near + slack >= kth[:, None].astype(np.float32)) & ~np.isinf(near))
        # Only what is near the k-th best in fact is scored in the order of components.
        good = np.einsum("nd,nd->n", own[q], others[row]) >= kth[q]
        q, row = q[good], row[good]
        out.append((ids[i + q], row, cosine(x[i + q], index["vector"][row])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _visits(wanted: DataFrame, middle: Centres, radius: np.ndarray, held: np.ndarray, others: bool) -> DataFrame:
    """`wanted` with the cell that is visited: the nearest that holds rows, or all `others`
    that can hold a row as near as `least`."""
    shared = wanted.sparkSession.sparkContext.broadcast((middle, radius, held))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, radius, held = shared.value
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                if size not in middle.of:
                    continue
                part = batch.filter(pa.array(sizes == size))
                x = part.column("vector").flatten().to_numpy().reshape(-1, size)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                cells = slice(middle.first[size], middle.first[size] + len(middle.of[size]))
                bound = np.where(held[cells], most(unit, (middle.of[size], radius[cells])), -np.inf)
                home = np.where(held[cells], unit @ middle.of[size].T, -np.inf).argmax(axis=1)
                if others:
                    chosen = bound >= part.column("least").to_numpy()[:, None] - 1e-9
                    chosen[np.arange(len(x)), home] = False
                else:
                    chosen = np.zeros(bound.shape, bool)
                    chosen[np.arange(len(x)), home] = True
                row, cell = np.nonzero(chosen & ~np.isinf(bound))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array((cell + cells.start).astype(np.int32))], [*part.schema.names, "visited"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
    return materialize(wanted.mapInArrow(pick, f"{fields}, visited int"), "visits")


def search(index: tuple[DataFrame, Centres], queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows of `index` for each row of `queries` by cosine:
    `query_id, rank, vec_id, score`, nearest first, ties to the smaller id.

    Rows of the index with the query's own id take no part; rows repeated under another id
    are ranked each, with a null id last. A query id that is repeated is searched with
    its smallest vector; queries without an id or a direction have no rows, nor have
    queries of a length that the index doesn't hold. Fewer candidates than k give all.

    A query meets its own cell first, which gives a k-th best score, and then the other
    cells that can hold a better one, by their centres and radii. Large cells are dealt
    over several tasks, and so are the queries of a cell.
    """
    rows, middle = index
    wanted = usable(queries, id, vector).where("id IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))
    wanted = materialize(wanted.select("id", "vector", F.size("vector").alias("size"), F.lit(-2.0).alias("least")), "queries")
    sizes, radius = np.zeros(middle.cells(), np.int64), np.zeros(middle.cells())
    for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect():
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["away"]
    flat = [centre for own in middle.of.values() for centre in own]
    shared = rows.sparkSession.sparkContext.broadcast(flat)
    layout = Cells(rows, np.zeros((0, 0)), sizes, radius, np.zeros((0, 0)))

    def meet(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(index) or not len(queries):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        index, queries = index.combine_chunks(), queries.combine_chunks()
        size = index["size"][0].as_py()
        wide = lambda t: t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        block = {
            "id": index["id"].fill_null(-(2**63)).to_numpy(),
            "vector": wide(index),
            "code": np.frombuffer(b"".join(index["code"].to_pylist()), np.uint8).reshape(len(index), -1),
            "spread": index["spread"].to_numpy(),
            "aligned": index["aligned"].to_numpy(),
        }
        query, row, score = search_block(queries["id"].to_numpy(), wide(queries), block, shared.value[index["_cell"][0].as_py()], k, queries["least"].to_numpy())
        near = block["id"][row]
        last = near == -(2**63)
        order = np.lexsort((near, last, -score, query))
        query, near, score, last = query[order], near[order], score[order], last[order]
        begin = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        keep = rank < k
        return pa.table({"query_id": query[keep], "vec_id": pa.array(near[keep], mask=last[keep]), "score": score[keep]})

    def met(visiting: DataFrame) -> DataFrame:
        left, right, keys = together(rows, visiting, layout, "id", "id")
        return materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, FOUND), "met")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    held = sizes > 0
    found = met(_visits(wanted, middle, radius, held, False))
    if held.sum() > 1:
        least = ranked(found).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("known"))
        asked = wanted.join(least, "id", "left").select("id", "vector", "size", F.coalesce("known", "least").alias("least"))
        found = found.unionByName(met(_visits(asked, middle, radius, held, True)))
    return ranked(found)
