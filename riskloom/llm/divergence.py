"""Quality rules by divergence from a language's usual text, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.exchange import BROADCAST_BYTES, key_counts, sized_join
from riskloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Base rules: fewer words fail, and so do texts with a larger share (in percent) of their
# words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30

# Classes of characters, each counted in what the ones before it leave; the rest is a class.
CLASSES = (r"[a-z]+", r"[\x20\x09-\x0D]+", r"\p{Ll}+", r"\p{Lu}+", r"\p{L}+", r"\p{N}+", r"""[.,;:!?'"()\-]+""")

# Common words of a language: so many that stand in most of its documents, none longer than this.
COMMON, LONGEST = 32, 40

# References are made of documents of so many words that pass the base rules; a language
# has one if it has so many of these. Shorter documents are judged by characters only.
REFERENCE_WORDS, REFERENCE_DOCUMENTS, COMMON_WORDS_FROM = 50, 20, 100

# Shares of classes are medians to this fraction.
STEPS = 1000

# A distance is too large above `base + noise / sqrt(words)`: short texts differ by chance.
CHARACTER_LIMIT, WORD_LIMIT = (0.10, 1.5), (0.08, 2.7)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is made once, however often `body` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _after(array: Column) -> Column:
    return F.slice(array, F.lit(2), F.size(array))


def _joined(hashes: Column, reach: int) -> Column:
    """Hashes of runs of twice `reach` words from those of `reach` words."""
    left, right = F.slice(hashes, F.lit(1), F.size(hashes) - reach), F.slice(hashes, F.lit(reach + 1), F.size(hashes) - reach)
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of WINDOW words that is found twice or more in the
    text. Windows are looked at only where runs of two and of four words repeat."""

    def covered(hashes: Column) -> Column:
        """Equal hashes are neighbours once sorted; each place covers up to the next one."""
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pair = lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
        places = let(ordered, lambda s: F.sort_array(F.array_distinct(F.flatten(F.array_compact(F.zip_with(s, _after(s), pair))))))
        reach = lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))
        return let(places, lambda p: F.aggregate(F.zip_with(p, _after(p), reach), F.lit(0), lambda t, n: t + n))

    def grown(hashes: Column, reach: int) -> Column:
        longer = covered(hashes) if reach == WINDOW else let(_joined(hashes, reach), lambda h: grown(h, 2 * reach))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), longer).otherwise(F.lit(0))

    single = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, let(single, lambda h: grown(h, 1))).otherwise(F.lit(0)).cast("long")


def base_counts(text: Column, words: Column) -> dict[str, Column]:
    """The counts of the base rules, from a text and its words."""
    # Lines without a word are no lines here.
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.length(text) - F.length(F.regexp_replace(text, WORD, ""))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": let(lines, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def class_counts(text: Column) -> Column:
    """Characters in each of CLASSES and besides."""

    def count(left: Column, patterns: tuple[str, ...]) -> Column:
        if not patterns:
            return F.array(F.length(left))
        return let(F.regexp_replace(left, patterns[0], ""), lambda rest: F.concat(F.array(F.length(left) - F.length(rest)), count(rest, patterns[1:])))

    return let(text, lambda t: count(t, CLASSES))


def common_counts(words: Column, common: Column, longest: Column) -> Column:
    """How often each of the words in `common` stands among `words`, and how many others
    there are. Words over `longest` bytes, the most of a common one, are others."""
    short = F.transform(F.filter(words, lambda w: F.octet_length(w) <= longest), lambda w: F.lower(w))

    def count(found: Column) -> Column:
        each = F.transform(common, lambda w: F.size(found) - F.size(F.array_remove(found, w)))
        return let(each, lambda n: F.concat(n, F.array(F.size(words) - F.aggregate(n, F.lit(0), lambda t, c: t + c))))

    return let(short, count)


def distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (base 2, so 0 to 1) of counts and shares; null without either."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    total = F.aggregate(counts, F.lit(0).cast("long"), lambda t, c: t + c)
    own = F.transform(counts, lambda c: c.cast("double"))
    summed = let(total.cast("double"), lambda n: F.aggregate(
        F.zip_with(own, shares, lambda c, q: part(c / n, (c / n + q) / 2) + part(q, (c / n + q) / 2)), F.lit(0.0), lambda t, d: t + d
    ))
    return F.when((total > 0) & shares.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), summed / 2)))


def common_words(docs: DataFrame, text: str) -> DataFrame:
    """`key, common, longest`: the words that stand in most documents of a language, once
    for each way a document spells them, ties by word; and the bytes of the longest."""
    words = docs.select("key", words_of(F.col(text)).alias("words")).where(F.size("words") >= REFERENCE_WORDS)
    each = words.select("key", F.explode(F.array_distinct("words")).alias("word")).select("key", F.lower("word").alias("word"))
    counts = each.where(F.length("word") <= LONGEST).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("key").orderBy(F.desc("n"), "word")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= COMMON)
    gathered = top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("top"), F.max(F.octet_length("word")).alias("longest"))
    return materialize(gathered.select("key", F.col("top.word").alias("common"), "longest"), "common")


def references(counted: DataFrame) -> DataFrame:
    """`key, class_shares, common_shares`: of every language with enough documents the
    median share of each class of characters, and the mean share of each common word.
    Copies count each; medians are not moved by a third of all documents."""
    usable = counted.where((F.col("n_words") >= REFERENCE_WORDS) & ~F.col("base_failed"))
    enough = usable.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= REFERENCE_DOCUMENTS)
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda t, c: t + c)
    steps = F.transform("classes", lambda c: F.floor(c * STEPS / F.col("chars") + 0.5).cast("int"))
    spread = usable.withColumn("chars", total).select("key", F.posexplode(steps).alias("k", "step")).groupBy("key", "k", "step").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key", "k").orderBy("step"))
    whole = F.sum("n").over(Window.partitionBy("key", "k"))
    medians = spread.withColumn("upto", upto).withColumn("whole", whole).where("2 * upto >= whole").groupBy("key", "k").agg(F.min("step").alias("step"))
    medians = medians.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "step"))).alias("s"), F.sum("step").alias("all"))
    medians = medians.select("key", F.transform("s", lambda x: x["step"] / F.col("all")).alias("class_shares"))
    shares = usable.select("key", F.posexplode("common_counts").alias("k", "n"), "n_words")
    means = shares.groupBy("key", "k").agg(F.avg(F.col("n") / F.col("n_words")).alias("share"))
    means = means.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "share"))).alias("s")).select("key", F.col("s.share").alias("common_shares"))
    return materialize(enough.join(medians, "key").join(means, "key"), "references")


def _small(lookup: DataFrame) -> bool:
    """Lookup rows are of a bounded size, that of COMMON words of LONGEST characters."""
    return lookup.count() * 8 * COMMON * LONGEST <= BROADCAST_BYTES


def judge_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Base counts and the verdict on every document.

    Returns `id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, word_distance`, a row for each row of `docs`. A
    document is kept if it passes the base rules, and its characters, and from
    COMMON_WORDS_FROM words on its common words too, are distributed much as in its
    language. A language without enough documents has no reference: its documents are
    judged by the base rules alone, with null distances. Documents without a language are
    compared with one another. Null and empty texts have no words and fail.
    Repeated rows are judged each, and weigh in their language's reference each. Other
    columns are ignored, whatever their names; an empty table gives none.

    Two passes over the texts: for the common words, and for all counts. Words are counted by
    partial sums, and only a few rows a language are looked up.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), key.alias("key"))
    languages = materialize(key_counts(rows, "key"), "languages")
    common = common_words(rows, "text")
    found = sized_join(rows, common, "key", "doc_id", _small(common), languages)
    listed = F.coalesce("common", F.array().cast("array<string>"))
    own = F.coalesce("text", F.lit(""))
    told = let(words_of(own), lambda w: F.struct(*[c.alias(n) for n, c in base_counts(own, w).items()], common_counts(w, listed, F.coalesce("longest", F.lit(0))).alias("common_counts")))
    counted = found.select("doc_id", "key", told.alias("told"), class_counts(own).alias("classes")).select("doc_id", "key", "told.*", "classes")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counted = materialize(counted.withColumn("base_failed", failed), "counted")
    known = references(counted)
    judged = sized_join(counted, known, "key", "doc_id", _small(known), languages)
    judged = judged.withColumn("class_distance", distance(F.col("classes"), F.col("class_shares")))
    judged = judged.withColumn("word_distance", F.when(F.col("n_words") >= COMMON_WORDS_FROM, distance(F.col("common_counts"), F.col("common_shares"))))
    noise = F.sqrt(F.col("n_words").cast("double"))
    far = lambda c, limit: F.coalesce(F.col(c) > limit[0] + limit[1] / noise, F.lit(False))
    kept = ~F.col("base_failed") & ~far("class_distance", CHARACTER_LIMIT) & ~far("word_distance", WORD_LIMIT)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(F.col("doc_id").alias(id), *names, kept.alias("kept"), "class_distance", "word_distance")
