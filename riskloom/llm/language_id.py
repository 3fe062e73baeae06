"""Language identification by prediction by partial matching."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.batches import bound_batches, flat_bytes, groups, tidied
from riskloom.session import materialize

# Bytes before the predicted one that a context may hold.
ORDER = 3

# Text that each language is learned from: texts are taken in the order of a hash until
# their bytes are this many. Bounds the model, whatever the size of the corpus.
TRAIN_BYTES = 400_000

# Of a longer text so many pieces, evenly spaced, stand for the whole.
PIECES = 16

# Hashes are counted in so many classes for each language before any is ranked.
CLASSES = 1 << 16

# What stands before a text's first byte.
PAD = 10

# Bytes that are scored in one go.
BLOCK = 1 << 20

UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


def grams(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For every byte, the number formed by it and the k bytes before it, k = 0..ORDER.
    Contexts don't reach into the text before."""
    out = [flat.astype(np.uint32)]
    firsts = starts[:-1][np.diff(starts) > 0]
    before = flat
    for k in range(1, ORDER + 1):
        # The byte k places back, PAD beyond the text's beginning.
        before = np.concatenate((np.full(1, PAD, np.uint8), before[:-1]))[: len(flat)]
        before[firsts] = PAD
        out.append(out[-1] | before.astype(np.uint32) << np.uint32(8 * k))
    return out


class GramTable:
    """Finds numbers among given distinct ones: a hash table with open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        size = 1 << self.bits
        self.keys, self.rows = np.zeros(size, np.uint32), np.full(size, -1, np.int32)
        keys, rows = keys.astype(np.uint32), np.arange(len(keys), dtype=np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.rows[at] < 0
            self.keys[at[free]], self.rows[at[free]] = keys[free], rows[free]
            left = self.rows[at] != rows
            keys, rows, at = keys[left], rows[left], (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places among the given numbers, -1 for others."""
        at = self._slot(keys)
        found = self.rows[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & (len(self.rows) - 1)
            found[wrong] = self.rows[at[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return found


@dataclass
class Model:
    """Code lengths in bits. `coded[k]` has a row for each gram of k + 1 bytes seen in any
    language, with its length in each; `escapes[k]` a row for each context of k bytes,
    with what each language adds when the gram is in none."""

    languages: list[str]
    seen: list[GramTable]
    coded: list[np.ndarray]
    contexts: list[GramTable | None]
    escapes: list[np.ndarray]

    def bits(self, by_order: list[np.ndarray]) -> np.ndarray:
        """The length of each byte in each language."""
        row = self.seen[ORDER].find(by_order[ORDER])
        out = self.coded[ORDER][row]
        if len(missed := np.flatnonzero(row < 0)):
            out[missed] = self._shorter([g[missed] for g in by_order], ORDER)
        return out

    def _shorter(self, by_order: list[np.ndarray], order: int) -> np.ndarray:
        """Lengths of grams that no language has at `order`."""
        if order < 0:
            return np.full((len(by_order[0]), len(self.languages)), 8.0, np.float32)
        if order == 0:
            out = self.escapes[0][np.zeros(len(by_order[0]), np.int64)].copy()
        else:
            context = self.contexts[order].find(by_order[order] >> np.uint32(8))
            out = np.where((context >= 0)[:, None], self.escapes[order][context], np.float32(0))
        row = self.seen[order - 1].find(by_order[order - 1]) if order else np.full(len(out), -1, np.int32)
        found = row >= 0
        if order:
            out[found] += self.coded[order - 1][row[found]]
        if len(rest := np.flatnonzero(~found)):
            out[rest] += self._shorter([g[rest] for g in by_order], order - 1)
        return out


def build_model(counts: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Model:
    """From each language's grams of 1..ORDER + 1 bytes with their counts.

    In a context seen n times with d different bytes, a byte seen c times has probability
    c / (n + d), and the escape d / (n + d) (method C). After an escape the bytes already
    known to the longer context are excluded, so the shorter one is divided by what it
    leaves; at the end every unseen byte is equally likely.
    """
    languages = sorted(counts)
    seen, coded, contexts, escapes = [], [], [], []
    width = len(languages)
    union = [
        np.unique(np.concatenate([counts[lang][k][0] for lang in languages]).astype(np.uint32)) for k in range(ORDER + 1)
    ]
    for k in range(ORDER + 1):
        above = np.unique(union[k] >> np.uint32(8)) if k else np.zeros(1, np.uint32)
        lengths = np.full((len(union[k]), width), np.inf, np.float64)
        extra = np.zeros((len(above), width), np.float64)
        # Every gram's length by the shorter context, which holds its suffix too.
        if k:
            suffix = union[k] & np.uint32((1 << 8 * k) - 1)
            lower = coded[k - 1][np.searchsorted(union[k - 1], suffix)].astype(np.float64)
        else:
            lower = np.full((len(union[0]), width), 8.0)
        for j, lang in enumerate(languages):
            grams_, n = counts[lang][k]
            at = np.searchsorted(union[k], grams_.astype(np.uint32))
            context = np.searchsorted(above, grams_.astype(np.uint32) >> np.uint32(8)) if k else np.zeros(len(grams_), np.int64)
            total = np.bincount(context, n, len(above))
            distinct = np.bincount(context, minlength=len(above))
            known = np.minimum(np.bincount(context, np.exp2(-lower[at, j]), len(above)), 1 - 1e-9)
            used = total > 0
            extra[used, j] = -np.log2(distinct[used] / (total[used] + distinct[used])) + np.log2(1 - known[used])
            lengths[at, j] = np.log2(total[context] + distinct[context]) - np.log2(n)
        unseen = np.isinf(lengths)
        context = np.searchsorted(above, union[k] >> np.uint32(8)) if k else np.zeros(len(union[0]), np.int64)
        lengths[unseen] = (extra[context] + lower)[unseen]
        seen.append(GramTable(union[k]))
        coded.append(lengths.astype(np.float32))
        contexts.append(GramTable(above) if k else None)
        escapes.append(extra.astype(np.float32))
    return Model(languages, seen, coded, contexts, escapes)


def draw(rows: DataFrame, train_bytes: int) -> DataFrame:
    """Of the distinct texts of each language those that come first by their hash, until
    `train_bytes` are reached; one at least. A text over `train_bytes` is given as PIECES
    pieces of about as many bytes together.

    Only hashes and sizes are shuffled. In which class of hashes a language's bytes are
    reached is seen from sums; only the texts up to that class are ranked."""
    hashed = rows.withColumn("h", F.xxhash64("text"))
    texts = hashed.groupBy("lang", "h").agg(F.max(F.octet_length("text")).cast("long").alias("n"))
    texts = materialize(texts.withColumn("class", F.pmod("h", F.lit(CLASSES))), "texts")

    def before(*order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = texts.groupBy("lang", "class").agg(F.sum("n").alias("n"))
    sums = sums.withColumn("before", before("class")).where(F.col("before") < train_bytes)
    near = texts.join(F.broadcast(sums.select("lang", "class")), ["lang", "class"])
    taken = near.withColumn("before", before("class", "h")).where(F.col("before") < train_bytes).select("lang", "h")
    chosen = hashed.join(F.broadcast(materialize(taken, "taken")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    n = F.char_length("text")
    size = F.greatest(F.lit(1), F.floor(n * (train_bytes / PIECES) / F.octet_length("text"))).cast("int")
    begin = lambda i: F.floor(i * (n - size) / (PIECES - 1)).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring("text", begin(i), size))
    pieces = F.when(F.octet_length("text") > train_bytes, pieces).otherwise(F.array("text"))
    # A bounded sample: each language in one task, so that grams are counted together.
    return chosen.select("lang", F.explode(pieces).alias("text")).repartition("lang")


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", train_bytes: int = TRAIN_BYTES) -> Model | None:
    """Fit on texts with a language, at least `train_bytes` of each language or all it has,
    and less than twice as many.

    Rows without text or language are left out; of equal texts of a language one counts.
    None if nothing is left. What comes to the driver is at most four grams per byte of
    the sample.
    """
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.col(text) != "")).select(
        F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    drawn = draw(rows, train_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang_ in dict.fromkeys(langs):
                texts = batch.column("text").filter(pa.array([x == lang_ for x in langs]))
                for k, found in enumerate(grams(*flat_bytes(texts))):
                    values, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang_] * len(values), pa.string()), pa.array(np.full(len(values), k, np.int32)), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "k", "gram", "n"],
                    )

    found = drawn.mapInArrow(count, "lang string, k int, gram bigint, n bigint")
    sums = found.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not sums.num_rows:
        return None
    langs = np.array(sums["lang"].to_pylist(), object)
    k, gram, n = (sums[c].to_numpy() for c in ("k", "gram", "n"))
    counts = {}
    for lang_ in sorted(set(langs)):
        own = langs == lang_
        counts[lang_] = [(gram[own & (k == i)], n[own & (k == i)]) for i in range(ORDER + 1)]
    return build_model(counts)


def code_lengths(model: Model, texts: pa.Array) -> np.ndarray:
    """Bits of every whole text in every language."""
    flat, starts = flat_bytes(texts)
    out = np.zeros((len(texts), len(model.languages)))
    for first, last in groups(starts, BLOCK):
        # A text longer than a block is taken in parts that know the bytes before them.
        for lo in range(starts[first], max(starts[last], starts[first] + 1), BLOCK if last == first + 1 else starts[last] - starts[first] + 1):
            hi = min(starts[last], lo + BLOCK) if last == first + 1 else starts[last]
            if hi <= lo:
                continue
            lead = min(ORDER, lo - starts[first])
            bounds = np.clip(starts[first : last + 1], lo - lead, hi) - (lo - lead)
            bits = model.bits([g[lead:] for g in grams(flat[lo - lead : hi], bounds)])
            bounds = np.maximum(bounds - lead, 0)
            full = np.flatnonzero(np.diff(bounds) > 0)
            out[first + full] += np.add.reduceat(bits, bounds[full], axis=0, dtype=np.float64)
    return out


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add `lang_pred` and `score` to `docs` (columns of these names are replaced).

    The language whose frozen model codes the whole text in the fewest bits; at a tie the
    first by name. The score is its share of the probability, all languages being equally
    likely beforehand. `und` and 0 for null texts, texts without a letter, and all texts
    if there is no model. Repeated rows are judged each; an empty table gives none.
    """
    bound_batches(docs.sparkSession)
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    @tidied("language_id")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = frozen.value
        for texts in batches:
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if model is not None:
                bits = code_lengths(model, texts)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000)).sum(axis=1)
                for i, doc in enumerate(texts):
                    if doc.is_valid and LETTER.search(doc.as_py()):
                        names[i], scores[i] = model.languages[best[i]], share[i]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    judged = docs.select(F.struct(*docs.columns).alias("row"), judge(F.col(text)).alias("judged"))
    return judged.select(*[F.col("row")[c].alias(c) for c in kept], F.col("judged.lang").alias("lang_pred"), F.col("judged.score").alias("score"))
