"""Directories of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.exchange import number_rows, running_totals


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.md", recursive: bool = False) -> DataFrame:
    """Whole text files, numbered from 0 by file name, with the name and its stem.

    Only names and paths are sorted for the numbers; the texts join by path. For folders
    with very many files, which take the driver long to list, see `write_collection`.
    """
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", recursive)
        .text(folder, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_name").alias("source_file"),
            F.col("value").alias("text"),
        )
    )
    paths = files.select("_path", "source_file")
    numbered = number_rows(paths, [F.col("source_file"), F.col("_path")], "document_id").drop("source_file")
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    return files.join(numbered, "_path").select("document_id", "source_file", stem.alias("stem"), "text")


def write_collection(documents: DataFrame, path: str) -> None:
    """Documents `source_file, text` packed into few files, many to each, by name: the number of
    files follows the bytes, not the documents. Names are kept as they are, and are not
    paths; a name may occur more than once."""
    documents.select("source_file", "text").write.mode("overwrite").parquet(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """Documents of `write_collection`, numbered from 0 by name, as `read_documents` gives
    them. Names are sorted with a hash of the text behind them, so that texts are not sorted."""
    rows = spark.read.schema("source_file string, text string").parquet(path)
    rows = rows.withColumn("_hash", F.xxhash64("source_file", "text"))
    # Equal documents share a row here, and take the numbers that follow it.
    names = rows.groupBy("source_file", "_hash").agg(F.count(F.lit(1)).alias("_copies"))
    numbered = running_totals(names, [F.col("source_file"), F.col("_hash")], {"_upto": "_copies"})
    first = numbered.select("source_file", "_hash", (F.col("_upto") - F.col("_copies")).alias("_first"))
    copy = F.row_number().over(Window.partitionBy("source_file", "_hash").orderBy(F.lit(0))) - 1
    repeated = numbered.where("_copies > 1").select("source_file", "_hash")
    if repeated.isEmpty():
        joined = rows.join(first, ["source_file", "_hash"]).withColumn("document_id", F.col("_first"))
    else:
        joined = rows.withColumn("_copy", copy).join(first, ["source_file", "_hash"]).withColumn("document_id", F.col("_first") + F.col("_copy"))
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    return joined.select("document_id", "source_file", stem.alias("stem"), "text")
