"""Similarity join on sets of word n-grams, with an R-tree over count vectors.

Linked sets share most of their n-grams, so they share one of the first few in any common
order: sets meet at those keys. At a key, sets are points, the counts of their n-grams in
hashed groups. Summed coordinate minima bound the overlap of two points, and of a point
with all points of a tree node; only pairs that no bound excludes are verified on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.batches import bound_batches, flat_bytes, groups, tidied
from riskloom.llm.bitmaps import may_be_among
from riskloom.llm.components import components, joined_components
from riskloom.llm.repeats import Names, _mixed
from riskloom.session import discard, materialize, written_only

WORDS = 5
PERCENT = 80

# Groups that n-grams are hashed into.
GROUPS = 256

# Documents that common n-grams are found in, how many are kept, and from which count on.
# They come last in the order; any order gives the same links.
SAMPLE_DOCUMENTS = 20_000
COMMON = 100_000
COMMON_FROM = 4

# Sets at a key that meet in one task; more are split into blocks that meet pairwise.
MEETING = 2000
LEAF, FAN = 16, 8

BLOCK = 1 << 18
FEATURES = "doc_id bigint, text_hash bigint, n bigint, set_a bigint, set_b bigint, point binary, keys array<bigint>"

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_names(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of all words, and where each text's begin."""
    flat = _LOWER[flat]
    inside = ~_SPACE[flat]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    firsts = starts[:-1][np.diff(starts) > 0]
    opens[firsts] = inside[firsts]
    begin = np.flatnonzero(opens)
    stop = np.flatnonzero(~inside)
    end = np.append(stop, len(flat))[np.searchsorted(stop, begin)] if len(begin) else begin
    limit = starts[np.searchsorted(starts, begin, "right")]
    return Names(flat, both=False).of(begin, np.minimum(end, limit)), np.searchsorted(begin, starts)


def long_word_names(flat: np.ndarray) -> np.ndarray:
    """Of one long text, in parts that end at white space."""
    out, at = [], 0
    while at < len(flat):
        stop = min(len(flat), at + BLOCK)
        if stop < len(flat):
            spaces = np.flatnonzero(_SPACE[flat[stop : stop + BLOCK]])
            while not len(spaces) and stop < len(flat):
                stop = min(len(flat), stop + BLOCK)
                spaces = np.flatnonzero(_SPACE[flat[stop : stop + BLOCK]])
            stop = min(len(flat), stop + (int(spaces[0]) if len(spaces) else 0))
        out.append(word_names(flat[at:stop], np.array([0, stop - at]))[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sets_of(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last text, the distinct n-grams of each in order, and where each set
    begins, for some texts after others."""
    flat, starts = flat_bytes(texts)
    for lo, hi in groups(starts, BLOCK):
        if hi == lo + 1 and starts[hi] - starts[lo] > BLOCK:
            names = long_word_names(flat[starts[lo] : starts[hi]])
            begin = np.array([0, len(names)])
        else:
            names, begin = word_names(flat[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo])
        count = np.diff(begin)
        doc = np.repeat(np.arange(hi - lo), count)
        place = np.arange(len(names)) - begin[:-1][doc]
        # Short texts are one n-gram of all their words.
        length = np.minimum(count, words)
        full = place + length[doc] <= count[doc]
        at, doc = np.flatnonzero(full), doc[full]
        value = _mixed(length[doc].astype(np.uint64) + np.uint64(77))
        for k in range(words):
            has = k < length[doc]
            nxt = names[np.minimum(at + k, len(names) - 1)] if len(names) else names
            value = np.where(has, _mixed(value * np.uint64(0x9E3779B97F4A7C15) + nxt), value)
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[new], doc[new]
        yield lo, hi, value, np.searchsorted(doc, np.arange(hi - lo + 1))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams of a set have to be shown: a linked set shares at least
    ceil(percent n / 100) of them, so not all others."""
    return np.where(n > 0, n + 1 + (-n * percent) // 100, 0)


def point_of(counts: np.ndarray) -> bytes:
    return (counts.astype("<u2") if counts.max(initial=0) < 65536 else counts.astype("<u4")).tobytes()


def points_of(column: pa.Array) -> np.ndarray:
    rows = [np.frombuffer(b, "<u2" if len(b) == 2 * GROUPS else "<u4") for b in column.to_pylist()]
    return np.array(rows, np.int32).reshape(-1, GROUPS)


def common_ngrams(docs: DataFrame, words: int, text: str) -> np.ndarray:
    """N-grams that occur often in a bounded sample of documents, COMMON at most."""
    total = max(1, docs.count())
    sample = docs.where(F.col(text).isNotNull()).where(F.pmod(F.xxhash64(text, F.lit(3)), F.lit(total)) < SAMPLE_DOCUMENTS)

    @tidied("ngram_join")
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, value, _ in sets_of(batch.column(0), words):
                name, n = np.unique(value.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], ["name", "n"])

    counted = sample.select(F.col(text).alias("text")).mapInArrow(found, "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "name").limit(COMMON).select("name").toArrow()
    return np.sort(top["name"].to_numpy())


def features(docs: DataFrame, words: int, percent: int, id: str, text: str) -> DataFrame:
    """A row for each row of `docs`, numbered: size and digest of its set, its point, and
    its keys."""
    common = docs.sparkSession.sparkContext.broadcast(common_ngrams(docs, words, text))

    @tidied("ngram_join")
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, value, begin in sets_of(batch.column("text"), words):
                n = np.diff(begin)
                doc = np.repeat(np.arange(hi - lo), n)
                digests = []
                for k in (1, 2):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(value * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(k)))))
                    digests.append((sums[begin[1:]] - sums[begin[:-1]]).view(np.int64))
                group = (value >> np.uint64(20)).astype(np.int64) % GROUPS
                counts = np.bincount(doc * GROUPS + group, minlength=(hi - lo) * GROUPS).reshape(-1, GROUPS)
                signed = value.view(np.int64)
                late = np.zeros(len(value), bool)
                if len(common.value):
                    late = common.value[np.minimum(np.searchsorted(common.value, signed), len(common.value) - 1)] == signed
                order = np.lexsort((_mixed(value ^ np.uint64(0xA0761D6478BD642F)), late, doc))
                rank = np.arange(len(value)) - begin[:-1][doc]
                shown = prefix_size(n, percent)
                keys = signed[order][rank < shown[doc]]
                offsets = np.concatenate(([0], np.cumsum(shown))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(digests[0]), pa.array(digests[1]),
                        pa.array([point_of(c) for c in counts], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)),
                    ],
                    [c.split()[0] for c in FEATURES.split(", ")],
                )

    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return texts.mapInArrow(describe, FEATURES).withColumn("row", F.monotonically_increasing_id())


def fits(overlap, a, b, percent: int):
    """Whether sets of sizes a and b with such an overlap (or bound of it) are linked."""
    return (100 + percent) * overlap >= percent * (a + b)


class Tree:
    """An R-tree of points, packed from leaves up; nodes keep coordinate maxima and the
    extremes of the set sizes."""

    def __init__(self, size: np.ndarray, point: np.ndarray):
        # Sets of like sizes side by side, then of like points.
        self.order = np.lexsort((point.argmax(axis=1), size))
        low = high = size[self.order]
        top = point[self.order]
        self.levels = [(low, high, top)]
        step = LEAF
        while len(low) > 1:
            at = np.arange(0, len(low), step)
            low, high, top = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(top, at)
            self.levels.append((low, high, top))
            step = FAN

    def reach(self, size: np.ndarray, point: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in the tree) that the bounds don't exclude."""
        query, node = np.arange(len(size)), np.zeros(len(size), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            low, high, top = self.levels[level]
            near = (100 * high[node] >= percent * size[query]) & (100 * size[query] >= percent * low[node])
            query, node = query[near], node[near]
            keep = np.zeros(len(query), bool)
            for i in range(0, len(query), 8192):
                q, t = query[i : i + 8192], node[i : i + 8192]
                bound = np.minimum(point[q], top[t]).sum(axis=1, dtype=np.int64)
                # A smaller set needs a smaller overlap.
                keep[i : i + 8192] = fits(bound, size[q], low[t], percent)
            query, node = query[keep], node[keep]
            if level:
                step = LEAF if level == 1 else FAN
                below = len(self.levels[level - 1][0])
                node = (node[:, None] * step + np.arange(step)).ravel()
                query = np.repeat(query, step)
                query, node = query[node < below], node[node < below]
        return query, self.order[node]


def meet(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets of one meeting, in different components, that the tree leaves."""
    node, n, root, side = (rows[c].to_numpy() for c in ("node", "n", "root", "side"))
    # Where two blocks meet, only pairs across them are wanted: side 0 with side 1.
    right = np.flatnonzero(side == side.max())
    left = np.flatnonzero(side == 0)
    if not len(left) or len(np.unique(root)) < 2:
        return node[:0], node[:0]
    point = points_of(rows["point"].combine_chunks())
    tree = Tree(n[right], point[right])
    a, b = [], []
    for i in range(0, len(left), 256):
        own = left[i : i + 256]
        query, found = tree.reach(n[own], point[own], percent)
        x, y = own[query], right[found]
        keep = root[x] != root[y]
        a.append(np.minimum(node[x], node[y])[keep])
        b.append(np.maximum(node[x], node[y])[keep])
    return np.concatenate(a), np.concatenate(b)


def tree_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """`a, b` for the rows (`key, part, side, node, n, root, point`) of each meeting."""

    @tidied("ngram_join")
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, part = table["key"].to_numpy(), table["part"].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            for lo, hi in zip(np.concatenate(([0], cut)), np.append(cut, len(key)), strict=True):
                if hi - lo > 1:
                    a, b = meet(table.slice(int(lo), int(hi - lo)), percent)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            # The last meeting may go on in the next batch.
            key, part = table["key"].to_numpy(), table["part"].to_numpy()
            other = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            done = int(other[-1]) + 1 if len(other) else 0
            yield from pairs(table.slice(0, done)) if done else ()
            held = table.slice(done)
        if held is not None:
            yield from pairs(held)

    sorted_rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return sorted_rows.mapInArrow(join, "a bigint, b bigint").distinct()


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs (`a, b`) that summed coordinate minima allow."""
    left = points.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("p_a"))
    right = points.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("p_b"))
    joined = pairs.join(left, "a").join(right, "b")

    @tidied("ngram_join")
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bound = np.minimum(points_of(batch.column("p_a")), points_of(batch.column("p_b"))).sum(axis=1, dtype=np.int64)
                good = fits(bound, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return joined.mapInArrow(keep, "a bigint, b bigint")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs whose sets are linked. `docs` is `doc_id, text_hash, text`; only texts of
    nodes in a pair are made into sets."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = materialize(nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "text_hash"), "wanted")
    # Only texts that may be wanted are shuffled; a null text has no node.
    known = may_be_among(wanted, "text_hash", wanted.count())
    texts = docs.where(F.col("text").isNotNull()).where(known(F.col("text_hash")))
    texts = texts.join(wanted, ["doc_id", "text_hash"]).select("node", "text")

    @tidied("ngram_join")
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, value, begin in sets_of(batch.column("text"), words):
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), lists], ["node", "members"])

    sets = materialize(texts.mapInArrow(make, "node bigint, members array<bigint>"), "sets")
    joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    @tidied("ngram_join")
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("set_a"), batch.column("set_b")
            good = []
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                good.append(fits(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # Rows that repeat an id and its text give a node's set more than once.
    return joined.mapInArrow(check, "a bigint, b bigint").distinct()


def similarity_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id: str = "doc_id", text: str = "text", hashes: bool = False) -> DataFrame:
    """`id, n_shingles, component_id` for every row of `docs`; other columns are ignored.
    With `hashes` also `text_hash`, which tells rows of one id apart.

    Words are what stands between ASCII white space, A-Z in lower case; a document's set
    is its distinct runs of `words` words, or all its words as one run if it has fewer. Two
    documents link when their overlap is at least `percent` of their union. The component
    is the smallest id that links reach, the document's own included. Null and empty texts
    have an empty set and link with nothing, not with each other either. Rows without an id
    take no part: size counted, component null. Rows that repeat an id are linked by their
    sets each. An empty table gives none.

    Documents with equal sets are one node. Links are looked for in rounds, so that a
    large group of like sets needs a few links for each member: twice one set at each key
    is compared with the others there that are in another component, and at the end the
    trees of the keys that still hold several components give all pairs across them.
    """
    bound_batches(docs.sparkSession)
    described = materialize(features(docs, words, percent, id, text), "features")
    own = described.where("n > 0 AND doc_id IS NOT NULL")
    sets = ["set_a", "set_b", "n"]
    nodes = own.groupBy(*sets).agg(
        F.min("doc_id").alias("doc_id"), F.min_by(F.struct("row", "text_hash", "point"), F.struct("doc_id", "row")).alias("first")
    )
    nodes = materialize(nodes.select(*sets, "doc_id", F.col("first.row").alias("node"), "first.text_hash", "first.point"), "nodes")
    # The node's own row shows its keys; those of its copies are neither shuffled nor counted, but
    # for a few that the bitmap lets through (the join with the nodes is exact).
    among = may_be_among(nodes.select(F.xxhash64("node").alias("hash")), "hash", nodes.count())
    shown = own.where(among(F.xxhash64("row"))).select(F.col("row").alias("node"), F.explode("keys").alias("key"))

    def meetings() -> DataFrame:
        many = materialize(shown.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "keys")
        return shown.join(many, "key").join(nodes.select("node", "n"), "node")

    met = written_only(meetings, "met")
    rows = materialize(described.select("doc_id", "text_hash", *sets), "sets")
    discard(described)

    points = nodes.select("node", "n", "point")
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    roots = None
    for turn in range(3):
        now = met.withColumn("root", F.col("node"))
        if roots is not None:
            now = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = written_only(lambda: _starred(now, points, percent, turn) if turn < 2 else _across(now, points, percent), "near")  # noqa: B023
        if pairs.isEmpty():
            continue
        new = written_only(lambda: verified(pairs, nodes, texts, percent, words), "linked")  # noqa: B023
        discard(pairs)
        old, roots = roots, written_only(lambda: components(new) if roots is None else joined_components(roots, new), "roots")  # noqa: B023
        discard(old, new)
    discard(met)
    found = nodes.withColumn("root", F.col("node"))
    if roots is not None:
        found = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = materialize(found.groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    known = materialize(found.select(*sets, "root").join(least, "root").select(*sets, "least"), "known")
    own_hash = ["text_hash"] if hashes else []
    joined = rows.select("doc_id", *own_hash, *sets).join(known, sets, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return joined.select(F.col("doc_id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), *own_hash)


def _starred(now: DataFrame, points: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of one set at each key, first the smallest node, then any, with the others there
    that are in another component and of like size."""
    star = now.groupBy("key").agg(F.min(_pick(turn)).alias("f"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    star = materialize(star.select("key", F.col("f.node").alias("star"), F.col("f.root").alias("star_root"), F.col("f.n").alias("star_n")), "stars")
    sizes = 100 * F.least("n", "star_n") >= percent * F.greatest("n", "star_n")
    pairs = now.join(star, "key").where("root <> star_root").where(sizes)
    return bounded(pairs.select(F.least("star", "node").alias("a"), F.greatest("star", "node").alias("b")).distinct(), points, percent)


def _pick(turn: int) -> Column:
    order = [F.xxhash64("node").alias("order")] if turn else []
    return F.struct(*order, "node", "root", "n")


def _across(now: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Pairs across components at keys that hold several, by their trees.

    What the rounds before compared at a key, its stars, has met all others there. Of the
    rest a row goes on if there is another within the limits of size. Keys with the same
    first star are one meeting: like sets share many keys, and would meet at each."""
    stars = now.groupBy("key").agg(F.min(_pick(0)).alias("f"), F.min(_pick(1)).alias("g"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    stars = materialize(stars.select("key", F.col("f.node").alias("f"), F.col("g.node").alias("g")), "stars")
    rest = now.join(stars, "key").where("node <> f AND node <> g").select("key", "node", "n", "root")
    by_size = Window.partitionBy("key").orderBy("n", "node")
    near = (100 * F.lag("n").over(by_size) >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.lead("n").over(by_size))
    rest = rest.withColumn("near", near).where("near").select("key", "node", "n", "root")
    rest = rest.join(stars.select("key", "f"), "key").select(F.col("f").alias("key"), "node", "n", "root")
    rest = materialize(rest.distinct(), "rest")
    keys = rest.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    keys = materialize(keys.select("key", F.ceil(F.col("m") / MEETING).cast("int").alias("blocks")), "open")
    rows = rest.join(keys, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Every block of a key meets every block, itself included.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low = F.least("own", "other")
    rows = rows.withColumn("part", low * F.col("blocks") + F.greatest("own", "other")).withColumn("side", (F.col("own") != low).cast("int"))
    return tree_pairs(rows.select("key", "part", "side", "node", "root").join(points, "node"), percent)
