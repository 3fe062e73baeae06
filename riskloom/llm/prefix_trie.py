"""The trie of the common beginnings of conversations.

The digest of a prefix is the exclusive-or of the digests of its turns with their places,
128 bits, so it is a running total and long conversations are no chain of steps. A
count-min sketch of all prefix digests is built by a sum for each cell. Where its
estimate of a prefix is one, no other conversation begins so, and neither does any with what
follows: these tails are nodes of their own, emitted where they are. Prefixes that may
be shared are shuffled and grouped exactly, with partial sums before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.exchange import hot_keys, key_counts, lookup_join
from riskloom.llm.scans import place, running
from riskloom.session import materialize

# Turns that a conversation may take from another, and how far apart these are.
HEADS, FAMILY = 4, 20

# Rows of the sketch, cells for each prefix, and the bounds of a row's cells. Only cells
# counted twice are broadcast, as a bit each: 16 MB a row at most. A crowded sketch lets more
# prefixes through to exact grouping, and changes no result.
ROWS, CELLS, LEAST, MOST = 2, 8, 1 << 16, 1 << 27

# Bits in one value of bitmap_construct_agg.
BITMAP = 32_768

# Characters of joined ids that are hashed at a time.
JOINED = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"


def digests(role: Column, text: Column) -> list[Column]:
    return [F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("second"), role, text).alias("b")]


def turns(conversations: DataFrame, range_rows: int | None = None) -> DataFrame:
    """`conv_id, at, a, b, words`: every turn of every conversation with its place from 1,
    two digests and its words. Turns stand by number, null first, then by digest."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *digests(role, text), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = ["conv_id", "turn", "a", "b"]
    numbered = running(place(rows, order, range_rows), order, {"at": ("sum", F.lit(1))})
    return materialize(numbered.select("conv_id", "at", "a", "b", "words"), "turns")


def rebuilt(own: DataFrame, heads: int = HEADS, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Conversations with their first turns taken from the first of their family: rows
    `conv_id, depth, a, b, words`, and `conv_id, length` for every conversation.

    Only the first turns of a conversation, fewer than `heads`, are gathered for it."""
    few = F.when(F.col("at") < heads, F.struct("at", "a", "b", "words"))
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(few)).alias("first"))
    taken = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = materialize(convs.withColumn("taken", taken).withColumn("source", F.col("conv_id") - F.col("conv_id") % family), "convs")
    source = convs.where("conv_id = source").select("source", F.col("first").alias("lent"))
    lent = F.slice(F.coalesce("lent", F.array().cast(convs.schema["first"].dataType)), F.lit(1), F.col("taken").cast("int"))
    convs = convs.join(source, "source", "left").select("conv_id", "n", "taken", lent.alias("lent"))
    convs = convs.select("conv_id", "taken", "lent", (F.size("lent") + F.greatest(F.lit(0), F.col("n") - F.col("taken"))).cast("long").alias("length"))
    convs = materialize(convs, "rebuilt")
    head = convs.select("conv_id", F.explode("lent").alias("t")).select("conv_id", F.col("t.at").alias("depth"), "t.a", "t.b", "t.words")
    lookup = convs.select("conv_id", "taken", F.size("lent").alias("lent"))
    hot = hot_keys(key_counts(own, "conv_id"), "conv_id")
    tail = lookup_join(own, lookup, "conv_id", "at", hot, "inner").where("at > taken")
    tail = tail.select("conv_id", (F.col("at") - F.col("taken") + F.col("lent")).cast("long").alias("depth"), "a", "b", "words")
    return head.unionByName(tail), convs.select("conv_id", "length")


def prefixes(rows: DataFrame, range_rows: int | None = None) -> DataFrame:
    """`conv_id, depth, x, y, px, py, words, upto`: the digests of the prefix that ends in
    each row and of its parent, the row's words, and the words up to it."""
    rows = rows.select("conv_id", "depth", F.xxhash64("depth", "a", "b").alias("s"), F.xxhash64("b", "a", "depth").alias("t"), "words")
    order = ["conv_id", "depth"]
    totals = {"x": ("xor", F.col("s")), "y": ("xor", F.col("t")), "upto": ("sum", F.col("words"))}
    found = running(place(rows, order, range_rows), order, totals)
    parent = [F.col("x").bitwiseXOR(F.col("s")).alias("px"), F.col("y").bitwiseXOR(F.col("t")).alias("py")]
    return materialize(found.select("conv_id", "depth", "x", "y", *parent, "words", "upto", "_range"), "prefixes")


def cell(row: int, cells: int, x="x", y="y") -> Column:
    """Of a power of two of cells the one that a digest falls in."""
    return (F.col(x) if row == 0 else F.col(y)).bitwiseAND(cells - 1)


def crowded(paths: DataFrame) -> tuple[int, list[np.ndarray]]:
    """The count-min sketch of all prefixes, as far as it is needed: the number of cells
    in a row, and for each row a bit for every cell that counts more than one."""
    rows = paths.count()
    cells = min(MOST, max(LEAST, 1 << (CELLS * max(1, rows) - 1).bit_length()))
    places = F.array(*[F.struct(F.lit(r).alias("row"), cell(r, cells).alias("cell")) for r in range(ROWS)])
    counts = paths.select(F.explode(places).alias("p")).groupBy("p.row", "p.cell").agg(F.count(F.lit(1)).alias("n"))
    # Buckets count from one, positions from zero.
    bits = counts.where("n > 1").groupBy("row", F.bitmap_bucket_number(F.col("cell") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("cell") + 1)).alias("bits")
    )
    out = [np.zeros(max(cells, BITMAP) // 8, np.uint8) for _ in range(ROWS)]
    for r in bits.toLocalIterator():
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[r["row"]][(r["bucket"] - 1) * BITMAP // 8 :][: len(own)] = own
    return cells, out


def screened(paths: DataFrame, range_rows: int | None = None) -> DataFrame:
    """Add `tail` (the prefix is proven to be of one conversation, itself or by a shorter
    one) and `top` (the first such of a conversation, as far as is seen).

    Ranges are sorted anew, and a range that begins within a conversation proves from
    there on; what it lets through is grouped exactly, as all that passes."""
    spark = paths.sparkSession
    sketch = spark.sparkContext.broadcast(crowded(paths))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, bits = sketch.value
        last, proven = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            single = np.zeros(batch.num_rows, bool)
            for row, name in enumerate("xy"[:ROWS]):
                at = batch.column(name).to_numpy() & (cells - 1)
                single |= (bits[row][at >> 3] >> (at & 7).astype(np.uint8) & 1) == 0
            conv = batch.column("conv_id").to_numpy()
            new = np.concatenate(([conv[0] != last], conv[1:] != conv[:-1]))
            begin = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
            # Proven from the first single prefix of the conversation on.
            seen = np.cumsum(single)
            tail = seen - np.where(begin > 0, seen[begin - 1], 0) > 0
            if not new[0] and proven:
                tail |= np.cumsum(new) == 0
            before = np.concatenate(([not new[0] and proven], tail[:-1])) & ~new
            before[0] = not new[0] and proven
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tail), pa.array(tail & ~before)], [*batch.schema.names, "tail", "top"])
            last, proven = conv[-1], bool(tail[-1])

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = paths.repartition(parts, "_range", "conv_id").sortWithinPartitions("conv_id", "depth")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paths.schema)
    return materialize(ordered.mapInArrow(screen, f"{schema}, tail boolean, top boolean"), "screened")


def joined_hashes(ends: DataFrame) -> DataFrame:
    """`node, ends_sha256`: of each node the hash of its `conv_id`s in rising order, with
    commas.

    Ids are sorted in ranges over all nodes and joined to strings of a bounded length
    there, so that a node of very many conversations is spread; the hash itself has
    one order, and takes those strings one by one."""
    spark = ends.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size = None, None, [], 0
        for batch in batches:
            done = []
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (n != node or size > JOINED):
                    done.append((node, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    node, first = n, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _batch(done)
        if ids:
            yield _batch([(node, first, ",".join(ids))])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if n != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _pair(done)
        if state is not None:
            yield _pair([(node, state.hexdigest())])

    def _pair(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["node", "ends_sha256"])

    strings = ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(join, "node string, first long, ids string")
    return strings.repartition(parts, "node").sortWithinPartitions("node", "first").mapInArrow(digest, "node string, ends_sha256 string")


def _node(x: str, y: str, depth: str) -> Column:
    return F.concat_ws(":", depth, F.lower(F.hex(x)), F.lower(F.hex(y)))


def prefix_trie(conversations: DataFrame, range_rows: int | None = None) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (see `rebuilt`): `conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`.

    A null role or text is empty; rows without a conv_id belong to no conversation and are
    left out; turns of one number stand in the order of a digest of role and text, equal
    ones each. Other columns are ignored, whatever their names. An empty table has no
    conversations, and no root either.

    What a subtree saves is counted along conversations: of every member of a node the
    words that lie below the node and above the first node of which this member is the
    smallest. Leaves likewise: a leaf counts for the member that is its smallest. So both are
    sums over the rows of a node, and no level waits for the one below.
    """
    rows, lengths = rebuilt(turns(conversations, range_rows))
    paths = screened(prefixes(rows, range_rows))
    none = hashlib.sha256(b"").hexdigest()
    lengths = materialize(lengths, "lengths")

    # All rows that may be shared, with the root for every conversation.
    root = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("x", "y", "px", "py", "words", "upto")])
    open_ = root.unionByName(paths.where("NOT tail").select(*root.columns)).select(
        "conv_id", "depth", _node("x", "y", "depth").alias("node"), F.when(F.col("depth") > 0, F.concat_ws(":", F.col("depth") - 1, F.lower(F.hex("px")), F.lower(F.hex("py")))).alias("parent"),
        (F.col("upto") - F.col("words")).alias("above"), "words",
    )
    tops = paths.where("top").select(
        "conv_id", "depth", F.concat_ws(":", F.col("depth") - 1, F.lower(F.hex("px")), F.lower(F.hex("py"))).alias("parent"), (F.col("upto") - F.col("words")).alias("above")
    )
    nodes = open_.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min(F.struct("conv_id", "above")).alias("first"), F.first("depth").alias("depth"), F.first("parent").alias("parent")
    )
    nodes = materialize(nodes.select("node", "depth", "parent", "n_convs", F.col("first.conv_id").alias("conv_id"), F.col("first.above").alias("above")), "nodes")
    children = nodes.select("parent").unionByName(tops.select("parent")).where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").fillna(0, ["n_children"]), "nodes")

    # Of each conversation the words above its first own node, and whether its end is a leaf.
    own = nodes.select("conv_id", "above", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"))
    own = own.unionByName(tops.select("conv_id", "above", F.lit(1).alias("leaf"))).groupBy("conv_id").agg(F.min("above").alias("shared"), F.max("leaf").cast("long").alias("leaf"))
    own = materialize(own, "own")
    hot = hot_keys(key_counts(open_, "conv_id"), "conv_id")
    told = lookup_join(open_.select("conv_id", "depth", "node", "above", "words"), own, "conv_id", "depth", hot)
    # A conversation without an own node shares all its words.
    saved = F.coalesce(F.greatest(F.lit(0), F.col("shared") - F.col("above")), F.lit(None))
    whole = paths.groupBy("conv_id").agg(F.max("upto").alias("all_words"))
    lacking = materialize(lengths.join(own, "conv_id", "left_anti").join(whole, "conv_id", "left").select("conv_id", F.coalesce("all_words", F.lit(0)).alias("all_words")), "lacking")
    told = told.where("shared IS NOT NULL").select("node", saved.alias("saved"), "leaf").unionByName(
        lookup_join(open_.select("conv_id", "depth", "node", "above"), lacking, "conv_id", "depth", hot, "inner").select("node", (F.col("all_words") - F.col("above")).alias("saved"), F.lit(0).cast("long").alias("leaf"))
    )
    sums = told.groupBy("node").agg(F.sum("saved").cast("long").alias("saved_tokens"), F.sum("leaf").cast("long").alias("n_leaves"))

    ends = materialize(open_.select("conv_id", "depth", "node").join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select("node", "conv_id"), "ends")
    nodes = nodes.join(sums, "node").join(joined_hashes(ends), "node", "left")
    by_parent = hot_keys(key_counts(nodes.unionByName(tops.select("parent"), allowMissingColumns=True), "parent"), "parent")
    smallest = materialize(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "smallest")
    grouped = lookup_join(nodes, smallest, "parent", "node", by_parent)
    # A parent that was proven single elsewhere is of the same conversation.
    parent_id = F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    grouped = grouped.select("conv_id", "depth", parent_id.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))

    tails = paths.where("tail AND NOT top").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"))
    above = lookup_join(tops.select("conv_id", "depth", "parent"), smallest, "parent", "conv_id", by_parent)
    alone = tails.unionByName(above.select("conv_id", "depth", F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id")))
    alone = lookup_join(alone, lengths, "conv_id", "depth", hot_keys(key_counts(alone, "conv_id"), "conv_id"))
    last = F.col("depth") == F.col("length")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = alone.select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(none)).alias("ends_sha256"),
    )
    return grouped.unionByName(alone)
