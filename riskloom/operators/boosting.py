"""Boosted regression trees on all rows, from counts per node and bin.

The method is that of the library's `GBTClassifier` (logistic loss, variance as impurity,
leaves are weighted means, the first tree counts once and the others by the step), but a row
costs its filled features, not all of them: rows are kept as bins in blocks, of a rare
feature only the entries outside the bin of zero. Of a level the tasks send sums per node
and bin, whatever the number of rows; the driver picks the splits. Unlike the library,
candidates of splits come from all rows and not from a sample of 10,000, drawn rows depend
on the claim and not on its place, and boosting can go on where it ended.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.serializers import CPickleSerializer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import _delete, materialize, shared_dir

# Points that the distribution of a feature is told by, and how many are taken together.
POINTS, GATHERED = 1024, 65_536

# A feature that a larger share of the rows has filled is kept as a column.
DENSE = 0.25

# Rounds after which margins are brought up to date, until then the last trees are applied
# again; and after which they are written, to cut their lineage.
KEPT_EVERY, WRITTEN_EVERY = 4, 20

# Results of more tasks than these are added up on executors.
ADDED_HERE = 16

_GOLDEN, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _entries(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of what is not zero in a column of unwrapped vectors."""
    kind, _, indices, values = column.flatten()
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy()
    rows = np.repeat(np.arange(len(column)), lengths)
    feature = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    feature[np.repeat(kind.to_numpy() == 0, lengths)] = indices.flatten().to_numpy()
    filled = flat != 0
    return rows[filled], feature[filled], flat[filled]


def _summed(feature: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight per distinct value of a feature, in order."""
    order = np.lexsort((value, feature))
    feature, value, weight = feature[order], value[order], weight[order]
    starts = np.flatnonzero(np.r_[True, (feature[1:] != feature[:-1]) | (value[1:] != value[:-1])][: len(feature)])
    return feature[starts], value[starts], np.add.reduceat(weight, starts) if len(starts) else weight


def _thinner(points: tuple[np.ndarray, np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with more than `most` distinct values get `POINTS` of them, each with the weight up to it."""
    feature, value, weight = points
    starts = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]][: len(feature)])
    sizes = np.diff(np.r_[starts, len(feature)])
    if not (sizes > most).any():
        return points
    upto = np.cumsum(weight)
    before = np.repeat(upto[starts] - weight[starts], sizes)
    total = np.repeat(np.add.reduceat(weight, starts), sizes)
    part = np.minimum((upto - before) / total * POINTS, POINTS - 1).astype(np.int64)
    part = np.where(np.repeat(sizes > most, sizes), part, np.arange(len(feature)))
    last = np.flatnonzero(np.r_[(part[1:] != part[:-1]) | (feature[1:] != feature[:-1]), True])
    return feature[last], value[last], np.add.reduceat(weight, np.r_[0, last[:-1] + 1])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distribution of every feature over the rows of a task."""
    points, rows, weight, filled = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)), 0, 0.0, np.zeros(0, np.int64)
    for batch in batches:
        row, feature, value = _entries(batch.column("vector"))
        weights = batch.column("weight").to_numpy()
        more = _summed(feature, value, weights[row])
        points = _thinner(_summed(*[np.concatenate(x) for x in zip(points, more, strict=True)]), GATHERED)
        rows, weight = rows + len(weights), weight + weights.sum()
        count = np.bincount(feature, minlength=len(filled))
        count[: len(filled)] += filled
        filled = count
    if rows:
        yield pa.RecordBatch.from_pydict({"blob": [pickle.dumps((_thinner(points, POINTS), rows, weight, filled))]})


def _thresholds(value: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between all values if they are few, else near the quantiles."""
    middles = value[:-1] + (value[1:] - value[:-1]) / 2
    if len(value) <= bins:
        return middles
    upto = np.cumsum(weight)[:-1]
    wanted = weight.sum() * np.arange(1, bins) / bins
    at = np.clip(np.searchsorted(upto, wanted), 0, len(upto) - 1)
    before = np.maximum(at - 1, 0)
    return middles[np.unique(np.where(np.abs(upto[before] - wanted) < np.abs(upto[at] - wanted), before, at))]


@dataclass
class Layout:
    """Where the bins of each feature lie: `starts[f]` to `starts[f + 1]`, that of zero at
    `zero[f]` among them; `column[f]` is the place of a feature that is kept as a column, or -1."""

    thresholds: list[np.ndarray]
    starts: np.ndarray
    zero: np.ndarray
    column: np.ndarray

    @classmethod
    def of(cls, train: DataFrame, width: int, bins: int) -> "Layout":
        told = [pickle.loads(r["blob"]) for r in train.select("vector", "weight").mapInArrow(_spread, "blob binary").collect()]
        feature, value, weight = _summed(*[np.concatenate(x) for x in zip(*[t[0] for t in told], strict=True)])
        rows, total, filled = sum(t[1] for t in told), sum(t[2] for t in told), np.zeros(width, np.int64)
        for t in told:
            filled[: len(t[3])] += t[3]
        ends = np.searchsorted(feature, np.arange(width + 1))
        thresholds = []
        for f in range(width):
            v, w = value[ends[f] : ends[f + 1]], weight[ends[f] : ends[f + 1]]
            if filled[f] < rows:
                at = np.searchsorted(v, 0.0)
                v, w = np.insert(v, at, 0.0), np.insert(w, at, max(total - w.sum(), 0.0))
            thresholds.append(_thresholds(v, w, bins))
        sizes = np.array([len(t) + 1 for t in thresholds])
        zero = np.array([np.searchsorted(t, 0.0) for t in thresholds])
        dense = (filled > DENSE * rows) & (sizes > 1)
        return cls(thresholds, np.r_[0, np.cumsum(sizes)], zero, np.where(dense, np.cumsum(dense) - 1, -1))


@dataclass
class Block:
    """Rows as bins: `columns` of the dense features, and of the others the entries `row, code`
    outside the bin of zero in the order of `code`, which is the place in the layout."""

    ids: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    columns: np.ndarray
    row: np.ndarray
    code: np.ndarray


def _block(parts: list[pa.RecordBatch], layout: Layout) -> Block:
    batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    n, dense = batch.num_rows, np.flatnonzero(layout.column >= 0)
    row, feature, value = _entries(batch.column("vector"))
    order = np.argsort(feature, kind="stable")
    row, feature, value = row[order], feature[order], value[order]
    ends = np.searchsorted(feature, np.arange(len(layout.zero) + 1))
    bins = np.zeros(len(value), np.int64)
    for f in np.flatnonzero(np.diff(ends)):
        own = slice(ends[f], ends[f + 1])
        bins[own] = np.searchsorted(layout.thresholds[f], value[own])
    columns = np.repeat(layout.zero[dense].astype(np.uint16)[:, None], n, axis=1)
    for j, f in enumerate(dense):
        columns[j, row[ends[f] : ends[f + 1]]] = bins[ends[f] : ends[f + 1]]
    if not columns.size or columns.max() < 256:
        columns = columns.astype(np.uint8)
    kept = (layout.column[feature] < 0) & (bins != layout.zero[feature])
    row, code = row[kept], (layout.starts[feature] + bins)[kept]
    order = np.argsort(code, kind="stable")
    return Block(
        batch.column("id").to_numpy().view(np.uint64),
        2 * batch.column("label").to_numpy() - 1,
        batch.column("weight").to_numpy().copy(),
        columns,
        row[order].astype(np.int32),
        code[order].astype(np.int32),
    )


def _blocks(batches: Iterator[pa.RecordBatch], layout, rows: int) -> Iterator[pa.RecordBatch]:
    parts, n = [], 0
    for batch in batches:
        if n and n + batch.num_rows > rows:
            yield pa.RecordBatch.from_pydict({"blob": [pickle.dumps(_block(parts, layout.value))]})
            parts, n = [], 0
        parts, n = ([*parts, batch], n + batch.num_rows) if batch.num_rows else (parts, n)
    if parts:
        yield pa.RecordBatch.from_pydict({"blob": [pickle.dumps(_block(parts, layout.value))]})


@dataclass
class Tree:
    """Nodes by heap number from 1 on: the feature and the last bin that goes left, or -1 for
    a leaf; per node the rows, their weight, and weighted sums of targets and squares."""

    feature: np.ndarray
    upto: np.ndarray
    count: np.ndarray
    sums: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 << depth
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 3)))

    @property
    def values(self) -> np.ndarray:
        weight, total = self.sums[:, 0], self.sums[:, 1]
        return np.divide(total, weight, out=np.zeros_like(total), where=weight > 0)


def _places(block: Block, tree: Tree, depth: int, layout: Layout) -> np.ndarray:
    """The node of each row after so many levels."""
    every = np.arange(len(block.ids))
    node = np.ones(len(every), np.int64)
    for level in range(depth):
        feature, upto = tree.feature[node], tree.upto[node]
        right = layout.zero[feature] > upto
        column = layout.column[feature]
        dense = np.flatnonzero((column >= 0) & (feature >= 0))
        right[dense] = block.columns[column[dense], dense] > upto[dense]
        for k in range(1 << level, 2 << level):
            f = tree.feature[k]
            if f >= 0 and layout.column[f] < 0:
                own = slice(*np.searchsorted(block.code, layout.starts[f : f + 2]))
                rows = block.row[own]
                here = node[rows] == k
                right[rows[here]] = block.code[own][here] - layout.starts[f] > tree.upto[k]
        node = np.where(feature >= 0, 2 * node + right, node)
    return node


def _drawn(ids: np.ndarray, seed: int, share: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = ids + np.uint64(seed) * _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * _MIX_A
        z = (z ^ (z >> np.uint64(27))) * _MIX_B
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share


def _margins(block: Block, margin: np.ndarray, layout: Layout, trees: list[tuple[float, Tree]], depth: int) -> np.ndarray:
    """Margins after the given trees, each with its step."""
    for step, tree in trees:
        margin = margin + step * tree.values[_places(block, tree, depth, layout)]
    return margin


def _level(pairs: Iterator, layout, tree: Tree, level: int, depth: int, trees: list, seed: int, share: float, first: bool) -> Iterator[list[np.ndarray]]:
    """Sums per node of a level and bin: rows, weight, targets, and squares on the last level,
    as the places of those that have rows, and their sums; and all four per node."""
    layout, slots, size = layout.value, 1 << level, int(layout.value.starts[-1])
    kinds = 4 if level == depth - 1 else 3
    out, totals = np.zeros((kinds, slots, size)), np.zeros((4, slots))
    for block, margin in pairs:
        node = _places(block, tree, level, layout) - slots
        rows = np.flatnonzero((node >= 0) & _drawn(block.ids, seed, share))
        y = block.target[rows]
        target = y if first else 4 * y / (1 + np.exp(np.minimum(2 * y * _margins(block, margin, layout, trees, depth)[rows], 700.0)))
        at, weight = node[rows], block.weight[rows]
        stats = [None, weight, weight * target, weight * target * target]
        for i, x in enumerate(stats):
            totals[i] += np.bincount(at, x, slots)
        columns = block.columns[:, rows]
        for f in np.flatnonzero(layout.column >= 0):
            start, end = layout.starts[f : f + 2]
            index = at * (end - start) + columns[layout.column[f]]
            for i, x in enumerate(stats[:kinds]):
                out[i, :, start:end] += np.bincount(index, x, slots * (end - start)).reshape(slots, -1)
        place = np.full(len(node), -1)
        place[rows] = np.arange(len(rows))
        drawn = place[block.row]
        kept = drawn >= 0
        drawn = drawn[kept]
        index = at[drawn] * size + block.code[kept]
        for i, x in enumerate(stats[:kinds]):
            out[i] += np.bincount(index, None if x is None else x[drawn], slots * size).reshape(slots, size)
    out = out.reshape(kinds, -1)
    filled = np.flatnonzero(out[0]).astype(np.int32)
    yield [filled, out[:, filled], totals]


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    filled = np.union1d(a[0], b[0])
    out = np.zeros((len(a[1]), len(filled)))
    for places, sums, _ in (a, b):
        out[:, np.searchsorted(filled, places)] += sums
    return [filled, out, a[2] + b[2]]


def _later(pair, layout, trees: list, depth: int) -> np.ndarray:
    return _margins(*pair, layout.value, trees, depth)


@dataclass
class Booster:
    """Boosting that can go on: `more` rounds add to `trees`, and `margins` are those of the first
    `told`. `close` frees what it keeps."""

    session: SparkSession
    learner: GBTClassifier
    width: int
    blocks: RDD
    layout: Broadcast
    margins: RDD
    told: int = 0
    trees: list[Tree] = field(default_factory=list)
    made: list = field(default_factory=list)
    written: list[str] = field(default_factory=list)

    @classmethod
    def on(cls, learner: GBTClassifier, train: DataFrame, block_rows: int) -> "Booster":
        """For rows `claim_id, features, label, weight`."""
        spark = train.sparkSession
        context = spark.sparkContext
        shared_dir(spark)
        first = train.select("features").first()
        if first is None:
            raise ValueError("no rows to fit trees on")
        width = first["features"].size
        rows = train.select(F.xxhash64("claim_id").alias("id"), "label", "weight", F.unwrap_udt("features").alias("vector"))
        layout = Layout.of(rows, width, learner.getMaxBins())
        sent = context.broadcast(layout)
        dealt = rows.repartition(context.defaultParallelism)
        table = materialize(dealt.mapInArrow(partial(_blocks, layout=sent, rows=block_rows), "blob binary"), "blocks")
        # Both are kept unbatched, so that blocks and margins can be zipped as they are.
        blocks = table.rdd.map(lambda r: pickle.loads(r["blob"]))._reserialize(CPickleSerializer())
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        margins = blocks.map(lambda b: np.zeros(len(b.ids)))._reserialize(CPickleSerializer())
        margins.persist(StorageLevel.MEMORY_AND_DISK)
        return cls(spark, learner, width, blocks, sent, margins)

    def more(self, rounds: int) -> None:
        for _ in range(rounds):
            self._round()

    def _round(self) -> None:
        n, depth, size = len(self.trees), self.learner.getMaxDepth(), int(self.layout.value.starts[-1])
        pending = [(self._weight(i), self.trees[i]) for i in range(self.told, n)]
        before = None
        if len(pending) == KEPT_EVERY:
            later = partial(_later, layout=self.layout, trees=pending, depth=depth)
            before, self.margins = self.margins, self.blocks.zip(self.margins).map(later)._reserialize(CPickleSerializer())
            self.margins.persist(StorageLevel.MEMORY_AND_DISK)
            if n % WRITTEN_EVERY == 0:
                self.margins.checkpoint()
            self.told, pending = n, []
        tree = Tree.empty(depth)
        rows = self.blocks.zip(self.margins)
        for level in range(depth):
            sums = partial(
                _level, layout=self.layout, tree=tree, level=level, depth=depth, trees=pending,
                seed=self.learner.getSeed() + n, share=self.learner.getSubsamplingRate(), first=not n,
            )
            found = rows.mapPartitions(sums)
            found = [found.treeReduce(_added)] if found.getNumPartitions() > ADDED_HERE else found.collect()
            bins, totals = np.zeros((len(found[0][1]), size << level)), sum(f[2] for f in found)
            for filled, part, _ in found:
                bins[:, filled] += part
            if not self._split(tree, level, bins.reshape(len(bins), 1 << level, size), totals):
                break
        if before is not None:
            before.unpersist()
            file = self.margins.getCheckpointFile()
            if file:
                for old in self.written:
                    _delete(self.session, old)
                self.written = [file]
        self.trees.append(tree)

    def _weight(self, n: int) -> float:
        return self.learner.getStepSize() if n else 1.0

    def _split(self, tree: Tree, level: int, bins: np.ndarray, totals: np.ndarray) -> bool:
        """Pick the splits of a level; whether there is one."""
        layout, base = self.layout.value, 1 << level
        least, share = self.learner.getMinInstancesPerNode(), float(self.learner.getFeatureSubsetStrategy())
        wanted = int(np.ceil(share * self.width))
        # What the entries of rare features leave of a node lies in the bin of zero.
        rare = np.flatnonzero((layout.column < 0) & (np.diff(layout.starts) > 1))
        for i in range(len(bins)):
            seen = np.add.reduceat(bins[i], layout.starts[:-1], axis=1)[:, rare]
            bins[i][:, layout.starts[rare] + layout.zero[rare]] = totals[i][:, None] - seen
        sizes = np.diff(layout.starts)
        left = np.zeros_like(bins)
        gain = np.full(bins.shape[1:], -np.inf)
        every = totals[:, :, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            for size in np.unique(sizes[sizes > 1]):
                at = layout.starts[:-1][sizes == size][:, None] + np.arange(size)
                upto = np.cumsum(bins[:, :, at], axis=3)
                left[:, :, at] = upto
                (count, weight, total), (n, w, s) = upto[:3], every[:3]
                better = total * total / weight + (s - total) * (s - total) / (w - weight) - s * s / w
                better = np.where((count >= least) & (n - count >= least) & (weight > 0) & (w - weight > 0), better, -np.inf)
                better[..., -1] = -np.inf
                gain[:, at] = better
        feature_of = np.repeat(np.arange(self.width), sizes)
        split = False
        for k in range(base):
            node, (count, *sums) = base + k, totals[:, k]
            if level == 0 or tree.feature[node // 2] >= 0:
                tree.count[node], tree.sums[node] = round(count), sums
            else:
                continue
            weight, total, squares = sums
            spread = squares - total * total / weight if weight > 0 else 0.0
            if weight <= 0 or spread <= 1e-15 * weight:
                continue
            drawn = np.zeros(self.width, bool)
            draw = np.random.default_rng([self.learner.getSeed(), len(self.trees), node])
            drawn[draw.permutation(self.width)[:wanted]] = True
            own = np.where(drawn[feature_of], gain[k], -np.inf)
            best = own.max(initial=-np.inf)
            if not best > 1e-12 * spread:
                continue
            # Of splits that differ by rounding only the first.
            place = int(np.argmax(own >= best - 1e-9 * abs(best)))
            f = int(feature_of[place])
            tree.feature[node], tree.upto[node], split = f, place - layout.starts[f], True
            if len(bins) == 4:
                for child, part in ((2 * node, left[:, k, place]), (2 * node + 1, totals[:, k] - left[:, k, place])):
                    tree.count[child], tree.sums[child] = round(part[0]), part[1:]
        return split

    def model(self) -> GBTClassificationModel:
        """All trees so far, as the library's model."""
        self.made += [self._tree(t) for t in self.trees[len(self.made) :]]
        gateway, jvm = SparkContext._gateway, SparkContext._jvm
        trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(self.made))
        weights = gateway.new_array(jvm.double, len(self.made))
        for i, tree in enumerate(self.made):
            trees[i], weights[i] = tree, self._weight(i)
        java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(self.learner.uid, trees, weights, self.width, 2)
        return self.learner._copyValues(GBTClassificationModel(java))

    def _tree(self, tree: Tree):
        gateway, jvm = SparkContext._gateway, SparkContext._jvm
        leaf, inner, test = jvm.org.apache.spark.ml.tree.LeafNode, jvm.org.apache.spark.ml.tree.InternalNode, jvm.org.apache.spark.ml.tree.ContinuousSplit
        calculator, cut = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator, jvm.java.util.Arrays.copyOfRange
        thresholds, values = self.layout.value.thresholds, tree.values.tolist()
        weight, total, squares = tree.sums.T
        spread = np.divide(squares - np.divide(total * total, weight, out=np.zeros_like(total), where=weight > 0), weight, out=np.zeros_like(total), where=weight > 0)
        spread = np.maximum(spread, 0.0).tolist()
        sums = gateway.new_array(jvm.double, tree.sums.size)
        jvm.java.nio.ByteBuffer.wrap(tree.sums.astype(">f8").tobytes()).asDoubleBuffer().get(sums)

        def build(node: int):
            stats = calculator(cut(sums, 3 * node, 3 * node + 3), int(tree.count[node]))
            f = int(tree.feature[node])
            if f < 0:
                return leaf(values[node], spread[node], stats)
            gain = spread[node] - sum(float(weight[k] / weight[node]) * spread[k] for k in (2 * node, 2 * node + 1))
            split = test(f, float(thresholds[f][tree.upto[node]]))
            return inner(values[node], spread[node], gain, build(2 * node), build(2 * node + 1), split, stats)

        name = f"dtr_{uuid.uuid4().hex[:12]}"
        return jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(name, build(1), self.width)

    def close(self) -> None:
        self.blocks.unpersist()
        self.margins.unpersist()
        for file in self.written:
            _delete(self.session, file)
        self.written = []
