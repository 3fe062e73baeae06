"""Cheapest repairs of conversations, by a Viterbi search in chunks.

A conversation is legal if the initials of its roles read `(s?(ua)+)?`. Four states say what
may follow: nothing yet, after `s`, after `u`, after `a`. For every place of a conversation
a vector holds the least cost from there to the end, one number a state, less the
smallest of the four, which makes a *shape*. Chunks of a conversation start at their
right ends from a speculative shape, all at a time. Fix-up passes then rerun chunks whose right
neighbour came to another shape than was assumed, next to the run before, until the two
vectors differ only by a constant, that is until the shapes are equal; from there on nothing
changes but the constant. With the shapes stitched, the least audit is traced from the
front: of the edits that keep to the least cost, the first in ASCII at every step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.batches import bound_batches
from riskloom.llm.scans import place, running
from riskloom.session import materialize

# What an edit costs, and what a truncated row costs that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# Chunk k holds rows from FIRST * k^2 on, so a conversation of n rows has sqrt(n / FIRST)
# chunks at most, and the last are the longest.
FIRST = 32

# The role that comes next in each state (nothing yet, s, u, a), the state after it,
# and the least cost to the end from a conversation's last row on.
NEXT, AFTER = "uuau", (2, 2, 3, 2)
END = (0, 2 * INSERT, INSERT, 0)

# A row is told by its role's initial (s, u, a or another), whether it has to go, and
# whether it is truncated.
MUST_GO, CUT = 4, 8

NOT_BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"


def _kept(kind: int, state: int) -> int | None:
    """The state after a row that keeps its role, None where that is not legal."""
    initial = kind & 3
    if initial == 0:
        return 1 if state == 0 else None
    return AFTER[state] if initial < 3 and NEXT[state] == "sua"[initial] else None


@lru_cache(100_000)
def step(kind: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The shape before a row from the shape after it, and what was taken off."""
    costs = []
    for state in range(4):
        best = DELETE + after[state]
        if not kind & MUST_GO:
            stays = TRUNCATED * bool(kind & CUT)
            best = min(best, stays + REROLE + after[AFTER[state]])
            if (to := _kept(kind, state)) is not None:
                best = min(best, stays + after[to])
        costs.append(best)
    for _ in range(2):
        costs = [min(c, INSERT + costs[AFTER[state]]) for state, c in enumerate(costs)]
    least = min(costs)
    return tuple(c - least for c in costs), least


@lru_cache(100_000)
def choose(kind: int, after: tuple[int, ...], state: int) -> tuple[str, str, int]:
    """The least edits at a row from `state` on: their initials, the roles they leave
    (`s`, `u`, `a` for a row or an inserted one in capitals, `k` for a kept row), and the state they end in."""
    before, least = step(kind, after)
    letters, roles, cost = "", "", before[state] + least
    while True:
        if cost == DELETE + after[state]:
            return letters + "D", roles, state
        if cost == INSERT + before[AFTER[state]] + least:
            letters, roles = letters + "I", roles + NEXT[state].upper()
            state, cost = AFTER[state], before[AFTER[state]] + least
            continue
        stays = TRUNCATED * bool(kind & CUT)
        to = _kept(kind, state)
        if to is not None and cost == stays + after[to]:
            return letters + "K", roles + "k", to
        return letters + "R", roles + NEXT[state], AFTER[state]


def packed(shape: tuple[int, ...]) -> int:
    return sum(c << 8 * k for k, c in enumerate(shape))


def unpacked(number: int) -> tuple[int, ...]:
    return tuple(number >> 8 * k & 255 for k in range(4))


def backward(rows: bytes, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The shape before the first of `rows`, and the cost that was taken off on the way."""
    total = 0
    for kind in reversed(rows):
        after, least = step(kind, after)
        total += least
    return after, total


def rerun(rows: bytes, assumed: tuple[int, ...], after: tuple[int, ...], came_to: tuple[int, ...]) -> tuple[tuple[int, ...], int, int]:
    """As `backward`, from a corrected shape: run next to the run from `assumed` until
    both shapes are equal. Returns the shape, the change of the cost, and the rows run."""
    change, n = 0, 0
    for kind in reversed(rows):
        if after == assumed:
            return came_to, change, n
        assumed, was = step(kind, assumed)
        after, least = step(kind, after)
        change, n = change + least - was, n + 1
    return after, change, n


def trace(chunks: list[tuple[bytes, tuple[int, ...]]]) -> tuple[str, list[str]]:
    """The least audit of a conversation's chunks with their right shapes, and the roles
    that every row leaves; a last entry holds those inserted at the end."""
    state, audit, roles = 0, [], []
    for rows, after in chunks:
        shapes = [after]
        for kind in reversed(rows):
            shapes.append(step(kind, shapes[-1])[0])
        for k, kind in enumerate(rows):
            letters, left, state = choose(kind, shapes[len(rows) - 1 - k], state)
            audit.append(letters)
            roles.append(left)
    rest = {0: "", 1: "UA", 2: "A", 3: ""}[state]
    return "".join(audit) + "I" * len(rest), [*roles, rest]


def damaged(conversations: DataFrame) -> DataFrame:
    """`conv_id, turn, copy, role, text`: the rows as the damage leaves them, by
    crc32(`conv_id:turn`) % 20; nulls are one space there, but a null turn stays null."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", (F.crc32(key) % 20).cast("int").alias("fate"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text")
    ).where("fate <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
    )


def told(rows: DataFrame) -> DataFrame:
    """Rows without their texts: what they are, and two digests of role and text."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(NOT_BLANK)
    cut = ~F.col("text").rlike(ENDED)
    return rows.select(
        F.struct("conv_id").alias("conv"),
        "turn",
        F.xxhash64("role", "text").alias("a"),
        F.xxhash64(F.lit("second"), "role", "text").alias("b"),
        "copy",
        (kind + F.when(blank, MUST_GO).when(cut, CUT).otherwise(0)).cast("int").alias("kind"),
        blank.alias("blank"),
    )


ORDER = ["conv", "turn", "a", "b", "copy"]


def chunked(rows: DataFrame, range_rows: int | None = None) -> DataFrame:
    """`conv, chunk, rows, blank, duplicate, truncated`: a byte for every row of a chunk,
    and how many rows have each first fault.

    A row is a duplicate unless it is the first of its role and text. The first place of
    each text is found by an aggregate, and it is not joined to the rows but gathered with
    them, so a text that fills a conversation costs no more than others.
    """
    numbered = running(place(rows, ORDER, range_rows), ORDER, {"at": ("sum", F.lit(1))}).withColumn("at", F.col("at") - 1)
    numbered = materialize(numbered.select("conv", "at", "a", "b", "kind", "blank"), "numbered")
    first = numbered.groupBy("conv", "a", "b").agg(F.min("at").alias("at")).select("conv", "at", F.lit(None).cast("int").alias("kind"), F.lit(None).cast("boolean").alias("blank"))
    both = numbered.select("conv", "at", "kind", "blank").unionByName(first)
    number = F.floor(F.sqrt(F.col("at") / FIRST)).cast("long")
    # The root of a square may come out just below it.
    number = F.when(F.lit(FIRST) * (number + 1) * (number + 1) <= F.col("at"), number + 1).when(F.lit(FIRST) * number * number > F.col("at"), number - 1).otherwise(number)
    gathered = both.groupBy("conv", number.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("at", "kind", "blank")))).alias("own"),
        F.collect_set(F.when(F.col("kind").isNull(), F.col("at"))).alias("firsts"),
    )

    def told_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, blank, again, cut = [], [], [], []
            for own, firsts in zip(batch.column("own").to_pylist(), batch.column("firsts").to_pylist(), strict=True):
                new = set(firsts)
                kinds = [r["kind"] if r["at"] in new else r["kind"] & 3 | MUST_GO for r in own]
                made.append(bytes(kinds))
                blank.append(sum(r["blank"] for r in own))
                again.append(sum(r["at"] not in new and not r["blank"] for r in own))
                cut.append(sum(k & CUT > 0 for k in kinds))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("chunk"), pa.array(made, pa.binary()), *[pa.array(c, pa.int64()) for c in (blank, again, cut)]],
                ["conv", "chunk", "rows", "blank", "duplicate", "truncated"],
            )

    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, chunk long, rows binary, blank long, duplicate long, truncated long"
    return materialize(gathered.mapInArrow(told_rows, schema), "chunks")


STITCH = "struct<shape: bigint, cost: bigint>"


def _pairs(found: list[tuple[int, int]]) -> pa.Array:
    shapes, costs = zip(*found, strict=True) if found else ((), ())
    return pa.StructArray.from_arrays([pa.array(shapes, pa.int64()), pa.array(costs, pa.int64())], ["shape", "cost"])


def speculate(rows: pa.Array, after: pa.Array) -> pa.Array:
    runs = [backward(r, unpacked(a)) for r, a in zip(rows.to_pylist(), after.to_pylist(), strict=True)]
    return _pairs([(packed(shape), cost) for shape, cost in runs])


def fix(rows: pa.Array, assumed: pa.Array, after: pa.Array, came_to: pa.Array, cost: pa.Array) -> pa.Array:
    """Chunks whose shape was assumed rightly are not run."""
    found = []
    for r, was, now, shape, c in zip(*[x.to_pylist() for x in (rows, assumed, after, came_to, cost)], strict=True):
        new, change, _ = rerun(r, unpacked(was), unpacked(now), unpacked(shape))
        found.append((packed(new), c + change))
    return _pairs(found)


def stitched(chunks: DataFrame) -> DataFrame:
    """Chunks with `after`, the shape at their right end, `shape` at their left end, and
    `cost`, what was taken off in between.

    All chunks start from the shape of an end, which is true of last chunks. A fix-up pass
    reruns the chunks of longer conversations whose right neighbour's shape is not the one
    they assumed. Passes end when none is left: after one or two where chunks come to
    their own shape, after as many as a stretch has chunks where no row in it settles
    anything (a run of rows that all have to go).
    """
    begun = chunks.withColumn("after", F.lit(packed(END)).cast("long"))
    begun = materialize(begun.withColumn("found", F.arrow_udf(speculate, STITCH)("rows", "after")).select("*", "found.shape", "found.cost").drop("found"), "speculated")
    long = begun.where("chunk > 0").select("conv").distinct()
    single, many = begun.join(long, "conv", "left_anti"), begun.join(long, "conv", "left_semi")
    if long.isEmpty():
        return begun
    many = materialize(many, "many")
    following = Window.partitionBy("conv").orderBy("chunk")
    while True:
        seen = many.withColumn("true_after", F.coalesce(F.lead("shape").over(following), F.lit(packed(END)).cast("long")))
        wrong = F.col("true_after") != F.col("after")
        if seen.where(wrong).isEmpty():
            return single.unionByName(many)
        fixed = F.arrow_udf(fix, STITCH)("rows", "after", "true_after", "shape", "cost")
        many = materialize(seen.withColumn("found", fixed).select(*chunks.columns, F.col("true_after").alias("after"), "found.shape", "found.cost"), "fixed")


LEGAL = {(0, 1), (1, 2), (2, 1)}


def traced(conversations: pa.Array) -> pa.Array:
    found = []
    for chunks in conversations.to_pylist():
        audit, roles = trace([(c["rows"], unpacked(c["after"])) for c in chunks])
        kinds = [k & 3 for c in chunks for k in c["rows"]]
        cost = sum(c["cost"] for c in chunks) + unpacked(chunks[0]["shape"])[0]
        illegal = sum(p not in LEGAL for p in zip(kinds, kinds[1:], strict=False))
        found.append({"audit": audit, "cost": cost, "illegal": illegal, "roles": roles})
    return pa.array(found, pa.struct([("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("roles", pa.list_(pa.string()))]))


def audits(chunks: DataFrame) -> DataFrame:
    """A row for each conversation with rows: faults, `cost`, `audit`, and `roles`, what
    each row leaves. Gathers a byte and a shape for each row, as its result does."""
    whole = chunks.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "rows", "after", "shape", "cost"))).alias("chunks"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    return whole.withColumn("found", F.arrow_udf(traced, "struct<audit: string, cost: bigint, illegal: bigint, roles: array<string>>")("chunks")).select("conv", "blank", "duplicate", "truncated", "found.illegal", "found.cost", "found.audit", "found.roles")


NAMES = {"S": "system", "U": "user", "A": "assistant"}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_conversations(conversations: DataFrame, range_rows: int | None = None) -> DataFrame:
    """Cheapest legal form of every conversation of `conv_id, turn, role, text` rows after
    the damage of `damaged`.

    Returns `conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`, a row for each conv_id of the input; a null one is a conversation
    as others. Conversations that lost all rows have zeros, an empty audit and the hash of
    nothing. Rows of one turn stand in the order of a digest of role and text; equal rows
    are each a row of their own. Other columns are ignored, whatever their names. An empty
    table gives none.

    Rows are numbered in ranges, and searched in chunks, so no conversation is sorted or
    searched in one task. Two things of it are in one place, as the result asks: its audit,
    of a byte for each row, and its hash, which is taken from a stream of its rows.
    """
    bound_batches(conversations.sparkSession)
    rows = damaged(conversations)
    found = audits(stitched(chunked(told(rows), range_rows)))
    turns = rows.groupBy(F.struct("conv_id").alias("conv")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    every = conversations.select(F.struct("conv_id").alias("conv")).distinct()
    found = every.join(turns, "conv", "left").join(found, "conv", "left")
    lines = found.select("conv", F.lit(True).alias("head"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("roles", F.array().cast("array<string>")).alias("roles"))
    texts = rows.select(F.struct("conv_id").alias("conv"), "turn", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("second"), "role", "text").alias("b"), "copy", "role", "text", F.lit(False).alias("head"))
    stream = lines.unionByName(texts, allowMissingColumns=True)
    parts = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stream = stream.repartition(parts, "conv").sortWithinPartitions("conv", F.desc("head"), "turn", "a", "b", "copy")
    stream = stream.select("conv", "head", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "roles")
    fields = [f.split()[0] for f in RESULT.split(", ")]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, result, roles, at, digest, empty, done = None, None, [], 0, None, True, []

        def add(line: str) -> None:
            nonlocal empty
            digest.update(("" if empty else "\n").encode() + line.encode())
            empty = False

        def left(role: str, text: str) -> None:
            for r in roles[at]:
                if r.isupper():
                    add(f"{NAMES[r]}:")
                else:
                    add(f"{role if r == 'k' else NAMES[r.upper()]}:{text}")

        def close() -> None:
            nonlocal at
            if result is not None:
                if roles:
                    at = len(roles) - 1
                    left("", "")
                done.append({"conv": conv, **result, "repaired_sha256": digest.hexdigest()})

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(done, schema=out)
            done.clear()
            return batch

        out = None
        for batch in batches:
            out = out or pa.schema([batch.schema.field("conv"), *[pa.field(f, pa.string() if f in ("audit", "repaired_sha256") else pa.int64()) for f in fields]])
            for row in batch.to_pylist():
                if row["head"]:
                    close()
                    conv, roles, at, digest, empty = row["conv"], row["roles"], 0, hashlib.sha256(), True
                    result = {f: row[f] for f in fields[:-1]}
                else:
                    left(row["role"], row["text"])
                    at += 1
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    schema = f"conv {stream.schema['conv'].dataType.simpleString()}, {RESULT}"
    return stream.mapInArrow(hashed, schema).select("conv.conv_id", *fields)
