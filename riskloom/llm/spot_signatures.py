"""SpotSigs fingerprints, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.exchange import number_rows
from riskloom.session import materialize

# Common words that signatures hang on: English, French, German and Spanish function words.
ANCHORS = (
    "a an and are as at be by for from in is it of on that the this to was with "
    "au avec ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine für ich im ist mit nicht sich sie und von zu "
    "al como con del el era es las lo los más no por se su una y"
).split()

# Content words in a chain.
CHAIN = 2

# Where so many content words have followed a common word, those after them open chains
# too, up to the next common word.
GAP = 8

# Ids that share a range of this width are looked at together.
RANGE = 1000

MASK = (1 << 40) - 1
WORDS = r"[^\p{L}\p{N}]+"


def signatures(text: Column, anchors: list[str] | None = None, chain: int = CHAIN) -> Column:
    """The set of signatures of a text, as a sorted array of numbers under 2^40.

    Every common word gives a signature with the `chain` content words that follow it,
    fewer at the end of the text, none if no content word follows. The beginning of the
    text counts as a common word. Of a stretch without common words the content words
    after the first GAP give signatures in the same way, so that tables, lists and other
    languages are covered to their end, and an edit changes only what is near it. A text
    without content words has one signature, of the text itself; an empty or null text has
    none.
    """
    common = sorted(set(anchors or ANCHORS))
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORDS), lambda w: w != "")

    def parts(w: Column) -> Column:
        spots = F.filter(F.transform(w, lambda x, i: F.when(x.isin(common), i)), lambda i: i.isNotNull())
        return F.struct(w.alias("words"), spots.alias("spots"), F.filter(w, lambda x: ~x.isin(common)).alias("content"))

    def chains(s: Column) -> Column:
        # Before the k-th common word, at place i, stand i - k content words.
        content, words = s["content"], s["words"]
        following = lambda at: [F.get(content, at + j) for j in range(chain)]
        own = F.transform(s["spots"], lambda i, k: F.when(F.get(content, i - k).isNotNull(), F.xxhash64(F.get(words, i), *following(i - k))))
        first = F.when(F.size(content) > 0, F.xxhash64(F.lit(""), *following(F.lit(0))))
        # The beginning counts as a common word at place -1.
        spots = F.concat(F.array(F.lit(-1)), s["spots"])

        def stretch(i: Column, k: Column) -> Column:
            # The content words after place i, of which k - 1 common words stand before.
            begin, count = i - k + 1, F.coalesce(F.get(s["spots"], k), F.size(words)) - i - 1
            link = lambda at: F.when(F.get(content, at + 1).isNotNull(), F.xxhash64(F.get(content, at), *following(at + 1)))
            return F.when(count > GAP, F.transform(F.sequence(begin + GAP, begin + count - 1), link)).otherwise(F.array().cast("array<bigint>"))

        return F.concat(F.array(first), own, F.flatten(F.transform(spots, stretch)))

    # The words and the parts are handed on as values of lambdas, so each is made once.
    found = F.get(F.transform(F.transform(F.array(words), parts), chains), F.lit(0))
    kept = F.transform(F.filter(found, lambda h: h.isNotNull()), lambda h: h.bitwiseAND(MASK))
    whole = F.when(F.coalesce(text, F.lit("")) != "", F.array(F.xxhash64(F.lit("text"), text).bitwiseAND(MASK))).otherwise(F.array().cast("array<bigint>"))
    chosen = F.get(F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, k).otherwise(whole)), F.lit(0))
    return F.array_sort(F.array_distinct(chosen))


def fingerprint(signed: Column) -> Column:
    """The signatures as ten hexadecimal digits each, in order."""
    return F.array_join(F.transform(signed, lambda h: F.lower(F.lpad(F.hex(h), 10, "0"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of signatures: 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(F.transform(F.array(shared), lambda n: n / (total - n))[0])


def with_next(docs: DataFrame) -> DataFrame:
    """`doc_id, text, signed, next_text, next_signed` for rows `doc_id, text`: signatures,
    and those of the row that follows by (id, text); after the last comes the first. Rows
    without an id come last and are followed by the first.

    Rows meet in ranges of ids of a fixed width; the first row of each range is what the
    last row of the range before needs. Texts are shuffled once: the join with the first
    rows keeps the partitions of the window.
    """
    own = F.struct("text", "signed")
    placed = docs.where(F.col("doc_id").isNotNull()).withColumn("range", F.floor(F.col("doc_id") / RANGE))
    least = placed.groupBy("range").agg(F.min("doc_id").alias("doc_id"))
    least = materialize(number_rows(least, [F.col("range")], "n"), "ranges")
    count = max(1, least.count())
    heads = docs.join(least.select("doc_id", "n"), "doc_id").groupBy("n").agg(F.min("text").alias("text"))
    heads = materialize(heads.withColumn("signed", signatures(F.col("text"))).select("n", own.alias("head")), "heads")
    after = least.select("range", F.pmod(F.col("n") + 1, F.lit(count)).alias("n")).join(heads, "n").select("range", "head")
    order = Window.partitionBy("range").orderBy("doc_id", "text")
    followed = placed.withColumn("signed", signatures(F.col("text"))).withColumn("next", F.lead(own).over(order))
    followed = followed.join(materialize(after, "after"), "range", "left").withColumn("next", F.coalesce("next", "head"))
    nameless = docs.where(F.col("doc_id").isNull()).withColumn("signed", signatures(F.col("text")))
    # One row at most; without any id, a row follows itself.
    nameless = nameless.join(F.broadcast(heads.where("n = 0").select("head")), how="left").withColumn("next", F.coalesce("head", own))
    columns = ["doc_id", "text", "signed", F.col("next.text").alias("next_text"), F.col("next.signed").alias("next_signed")]
    return followed.select(*columns).unionByName(nameless.select(*columns))


def fingerprint_edits(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text, and how like they are to those of an edited text
    and of the next document.

    The edited text has its last quarter of code points (rounded down) replaced by as many
    from the beginning of the next document, or all it has. Returns `id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, length_class`,
    a row for each row of `docs`; other columns are ignored. Null texts are empty; rows
    that repeat an id follow one another by text; an empty table gives none.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(rows)
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "signed", "next_signed", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn("edited_signed", signatures(F.col("edited")))
    return rows.select(
        F.col("doc_id").alias(id), "n_chars", "edited_sha256", fingerprint(F.col("signed")).alias("fingerprint"),
        fingerprint(F.col("edited_signed")).alias("edited_fingerprint"),
        likeness(F.col("signed"), F.col("edited_signed")).alias("near_edited"),
        likeness(F.col("signed"), F.col("next_signed")).alias("near_next"),
        length_class(F.size("signed"), 0.8).alias("length_class"),
    )


def length_class(size: Column, least: float) -> Column:
    """Sets whose classes differ by more than one cannot be `least` alike."""
    return F.when(size > 0, F.floor(F.ln(size) / math.log(1 / least) + 1e-9)).otherwise(-1).cast("int")


def similar_sets(docs: DataFrame, least: float = 0.8, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Near duplicates by their signatures: members and links.

    Members are `id, set_id`, where `set_id` is the smallest id with the same signatures
    (null for texts without any, which are like nothing). Links are `left_id, right_id,
    likeness` between set ids, left smaller, for every two different sets at least `least`
    alike. Rows without an id take no part; repeated rows are one set.

    Sets are partitioned by length; within two neighbouring classes only sets that share
    one of the smallest signatures of both are compared (two sets that are alike do), and
    only if their lengths allow the likeness. Sets with one of many shared signatures meet
    in the join on (class, signature), which adaptive execution splits.
    """
    signed = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), signatures(F.col(text)).alias("signed"))
    signed = materialize(signed, "signed")
    sets = signed.where(F.size("signed") > 0).groupBy("signed").agg(F.min("id").alias("set_id"))
    sets = materialize(sets.withColumn("n", F.size("signed")).withColumn("class", length_class(F.size("signed"), least)), "sets")
    members = signed.join(sets.select("signed", "set_id"), "signed", "left").select(F.col("id").alias(id), "set_id")
    prefix = F.slice("signed", 1, (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))
    keyed = sets.select("set_id", "n", "class", "signed", prefix.alias("prefix"), F.explode(prefix).alias("key"))
    right = keyed.withColumn("at", F.explode(F.array("class", F.col("class") - 1)))
    a, b = keyed.alias("a"), right.alias("b")
    ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.set_id") < F.col("b.set_id")))
    # Compared once, at the smallest signature that both prefixes hold.
    once = F.array_min(F.array_intersect("a.prefix", "b.prefix")) == F.col("a.key")
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.class") == F.col("b.at")) & ordered & (F.col("a.n") >= F.col("b.n") * least - 1e-9) & once)
    scored = met.select(
        F.least("a.set_id", "b.set_id").alias("left_id"), F.greatest("a.set_id", "b.set_id").alias("right_id"),
        likeness(F.col("a.signed"), F.col("b.signed")).alias("likeness"),
    )
    return members, scored.where(F.col("likeness") >= least - 1e-12)
