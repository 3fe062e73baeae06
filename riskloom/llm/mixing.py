"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

# Rows of one source and epoch that are ordered together.
BLOCK_ROWS = 10_000

# Exponents looked at in one pass over the sources, so five halvings at once; passes.
POINTS, PASSES = 31, 8

# Exponents and weights are rounded down and off, so that the order of sums has no part in them.
ALPHA_STEPS, WEIGHT_DIGITS = 1_000_000, 9

WORD = r"[^ \t\n\r\f\x0B]+"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Mix:
    """What was found: the exponent, the tokens to hand out, and a row for each source
    (`source, n_rows, tokens, weight, budget, copies, rest`)."""

    alpha: float
    budget: int
    sources: DataFrame


def sized(docs: DataFrame, id: str, source: str, tokens: Column) -> DataFrame:
    return docs.select(F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"), tokens.cast("long").alias("n_tokens"))


def _curve(shares: DataFrame, low: float, high: float) -> list[dict]:
    """At exponents between `low` and `high`: the sum of p^a, the entropy in bits of
    p^a over that sum, and the extremes of p^(a - 1). One row per exponent comes back."""
    step = (high - low) / (POINTS + 1)
    at = shares.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(POINTS + 1)))).withColumn("a", F.lit(low) + F.col("k") * step)
    power, log = F.exp(F.col("a") * F.ln("p")), F.log2("p")
    sums = at.groupBy("k").agg(
        F.first("a").alias("a"), F.sum(power).alias("z"), F.sum(power * log).alias("zl"),
        F.max(power / F.col("p")).alias("most"), F.min(power / F.col("p")).alias("least"),
    )
    return [r.asDict() | {"entropy": math.log2(r["z"]) - r["a"] * r["zl"] / r["z"]} for r in sums.orderBy("k").collect()]


def find_alpha(shares: DataFrame, fits, flattest: bool) -> float:
    """Bisect [0, 1] for the edge of `fits`, which holds from some exponent on
    (`flattest`: the smallest such) or up to some exponent (the largest such)."""
    low, high = 0.0, 1.0
    for turn in range(PASSES):
        rows = _curve(shares, low, high)
        good = [fits(r) for r in rows]
        if turn == 0 and good[0 if flattest else -1]:
            return 0.0 if flattest else 1.0
        if turn == 0 and not any(good):
            return 1.0 if flattest else 0.0
        edge = good.index(True) if flattest else len(good) - 1 - good[::-1].index(True)
        low, high = (rows[edge - 1]["a"], rows[edge]["a"]) if flattest else (rows[edge]["a"], rows[edge + 1]["a"])
    alpha = high if flattest else low
    return (math.ceil if flattest else math.floor)(round(alpha * ALPHA_STEPS, 3)) / ALPHA_STEPS


def plan_mix(rows: DataFrame, budget: int | None = None, entropy: float | None = None, repetition: float | None = None) -> Mix:
    """Weights p^a / sum p^a over the sources' shares p of the tokens, and what each source
    gives of `budget` tokens.

    The exponent is 1 (natural shares) without a target. `entropy` (bits) takes the
    largest exponent whose weights reach it, 0 if none does. `repetition` takes the
    smallest exponent at which no source is repeated more often, 1 if none does. With
    both, the larger of the two holds, so that the limit is kept. Without a budget, the
    mix is the smallest that holds every document once.

    `rows` is `source, n_tokens`; a null source is a source. One without tokens has
    weight 0 and gives each document once.
    """
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("tokens"))
    totals = materialize(totals, "sources")
    whole = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    shares = totals.where("tokens > 0").select("source", (F.col("tokens") / whole).alias("p"))
    alpha = 1.0
    if whole:
        found = []
        if entropy is not None:
            found.append(find_alpha(shares, lambda r: r["entropy"] >= entropy - 1e-9, flattest=False))
        if repetition is not None:
            least = (lambda r: r["most"] / r["least"]) if budget is None else (lambda r: r["most"] * budget / (r["z"] * whole))
            found.append(find_alpha(shares, lambda r: least(r) <= repetition + 1e-9, flattest=True))
        alpha = max(found, default=1.0)
    power = F.exp(F.lit(alpha) * F.ln("p"))
    sums = shares.agg(F.sum(power).alias("z"), F.min(power / F.col("p")).alias("least")).first()
    total = budget if budget is not None else math.ceil(whole * sums["z"] / sums["least"] - 1e-6) if whole else 0
    p = F.col("tokens") / max(whole, 1)
    weight = F.when(F.col("tokens") > 0, F.round(F.exp(F.lit(alpha) * F.ln(p)) / (sums["z"] or 1.0), WEIGHT_DIGITS)).otherwise(0.0)
    given = F.floor(F.col("weight") * total).cast("long")
    sources = totals.withColumn("weight", weight).withColumn("budget", F.greatest("tokens", given) if budget is None else given)
    some = F.col("tokens") > 0
    sources = sources.withColumn("copies", F.when(some, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int"))
    sources = sources.withColumn("rest", F.when(some, F.col("budget") - F.col("copies") * F.col("tokens")).otherwise(0).cast("long"))
    return Mix(alpha, total, materialize(sources, "mix"))


def order_key(epoch: Column | int, seed: int) -> Column:
    """A source's permutation in an epoch is the order of these digests."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch) if isinstance(epoch, int) else epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def realise(rows: DataFrame, mix: Mix, block_tokens: int = 1 << 20, seed: int = 1) -> DataFrame:
    """The mix as block permutations: `doc_id, source, n_tokens, weight, epoch, start, block`.

    A row for every time a document is used. Each epoch of a source is a permutation of
    its own; the last one ends with the last document that the budget still holds.
    `start` is the place in the source's stream in tokens, and each source is spread
    evenly over the blocks, about `block_tokens` each, so that every block has the weights.
    Rows that repeat id and source are taken or left together, one `start` for all.
    """
    blocks = max(1, -(-mix.budget // block_tokens))
    joined = rows.alias("r").join(mix.sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    used = joined.select("doc_id", "r.source", "n_tokens", "weight", "n_rows", "tokens", "budget", "copies", "rest",
        F.explode(F.sequence(F.lit(0), F.col("copies") - F.when(F.col("rest") > 0, 0).otherwise(1))).alias("epoch"),
    ).where("epoch < copies OR rest > 0")
    used = used.withColumn("key", order_key(F.col("epoch"), seed))
    prefix = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    part = F.floor(prefix * F.ceil(F.col("n_rows") / BLOCK_ROWS) / F.lit(1 << 32)).cast("long")
    used = used.withColumn("part", part)
    # A block of rows knows what stands before it; only rows of one block are ordered together.
    before = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = used.groupBy("source", "epoch", "part").agg(F.sum("n_tokens").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = used.alias("u").join(
        offsets.alias("o"),
        F.col("u.source").eqNullSafe(F.col("o.source")) & (F.col("u.epoch") == F.col("o.epoch")) & (F.col("u.part") == F.col("o.part")),
    ).select("u.*", "offset")
    within = Window.partitionBy("source", "epoch", "part").orderBy("key")
    placed = placed.withColumn("end", F.col("offset") + F.sum("n_tokens").over(within)).where("epoch < copies OR end <= rest")
    start = F.col("epoch") * F.col("tokens") + F.col("end") - F.col("n_tokens")
    block = F.when(F.col("budget") > 0, F.least(F.floor(start * blocks / F.col("budget")), F.lit(blocks - 1))).otherwise(0)
    return placed.select("doc_id", "source", "n_tokens", "weight", "epoch", start.cast("long").alias("start"), block.cast("long").alias("block"))


def cut_keys(rows: DataFrame, mix: Mix, seed: int = 1) -> DataFrame:
    """For each source the last key that its last, partial epoch takes: `source, copies,
    last_key`, null where it takes none."""
    last = realise(rows, mix, seed=seed).alias("r").join(mix.sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    last = last.where("epoch = copies").groupBy("r.source").agg(F.max(order_key(F.col("epoch"), seed)).alias("last_key"))
    kept = mix.sources.alias("s").join(last.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left")
    return materialize(kept.select("s.source", "copies", "last_key"), "cuts")


def mix_documents(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text",
    budget: int | None = None, entropy: float | None = None, repetition: float | None = None, seed: int = 1,
) -> DataFrame:
    """The rows of `docs`, each as often as the mix uses it, with their own columns.

    Every row decides by its own key and its source's cut, so texts are not shuffled but
    where the table of sources is too large to be broadcast. Tokens are words.
    """
    rows = materialize(sized(docs, id, source, count_words(F.col(text))), "sized")
    mix = plan_mix(rows, budget, entropy, repetition)
    cuts = cut_keys(rows, mix, seed).select(F.col("source").alias("_source"), F.col("copies").alias("_copies"), F.col("last_key").alias("_last"))
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id).cast("string").alias("_id"), F.col(source).cast("string").alias("_join"))
    joined = own.join(cuts, F.col("_join").eqNullSafe(F.col("_source")))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("_copies"), F.coalesce("_id", F.lit("null"))))
    times = F.col("_copies") + F.coalesce((key <= F.col("_last")).cast("int"), F.lit(0))
    return joined.where(times > 0).select("_row", F.explode(F.sequence(F.lit(1), times)).alias("_time")).select("_row.*")
