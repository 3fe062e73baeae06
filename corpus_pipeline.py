"""Documents to training tokens, stage by stage.

Every stage takes what the one before kept. Stages but the last return the columns of
documents, with `text` and `n_chars` as the stage leaves them. Rows that repeat an id
are judged each by its own text; rows without an id pass the join untouched; null texts are
kept as rows without tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, mixing, ngram_join, quality_net, queries, repeats
from riskloom.llm.batches import fold
from riskloom.session import materialize

# Passages of so many words that stand elsewhere too are removed, whatever their bytes.
PASSAGE_WORDS = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects, those `predicted` to be of label
    0. It is fitted on the labels of two folds of three and on the documents given."""
    labels = queries.table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    net = quality_net.learn(docs, labels)
    scored = docs.withColumn("_docs", F.struct(*docs.columns))
    scored = quality_net.score_quality(scored.select("_docs", "text"), net)
    return scored.where("predicted = 1").select("_docs.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id. Rows that repeat an
    id are judged each by its own text; of those with equal text one stays."""
    groups = ngram_join.similarity_components(docs, hashes=True).where("doc_id IS NOT NULL")
    marks = groups.groupBy("doc_id", "text_hash").agg((F.first("component_id") != F.col("doc_id")).alias("copy"), (F.count(F.lit(1)) > 1).alias("again"))
    marks = materialize(marks.where("copy OR again"), "copies")
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    kept = rows.join(marks, ["doc_id", "text_hash"], "left_anti").select(*docs.columns)
    again = marks.where("NOT copy")
    if again.isEmpty():
        return kept
    once = rows.join(again, ["doc_id", "text_hash"]).select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.unionByName(once)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of over 50 words, or of 400 bytes, that stand elsewhere too.
    Letters that were cut are left out."""
    done = repeats.remove_repeats(docs, words=PASSAGE_WORDS)
    changed = F.col("repeats.n_removed") > 0
    text = F.when(changed, repeats.whole_letters(F.col("repeats.kept"))).otherwise(F.col("text"))
    done = done.withColumn("text", text).withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources more often, as the weights ask."""
    return mixing.mix_documents(docs, repetition=queries.REPETITION)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row."""
    return bpe.encode_documents(docs, queries.tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix", mix),
    ("encode", encode),
]

# The classifier has no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
