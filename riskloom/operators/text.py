"""Document normalization and chunking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.fixed import CHUNK_OVERLAP, CHUNK_SIZE
from riskloom.functions.text import strip


def normalized(text: Column) -> Column:
    """Unix line ends, no more than one blank line in a row, no white space at the ends."""
    unix = F.regexp_replace(text, "\r\n", "\n")
    return strip(F.regexp_replace(unix, "\n{3,}", "\n\n"))


def normalize_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, normalized(F.col(column)))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Character windows of `size`, each starting `overlap` characters before the end of
    the one before, up to the first that reaches the end of the text.

    The text is cut once into strides of `size - overlap` characters, and a window joins
    the strides it covers, so the work is linear in the text; cutting every window out
    of the whole text would be quadratic, as characters vary in width. The strides reach
    the windows as the value of a lambda: an expression inside it would be evaluated for
    every window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    stride = size - overlap
    covered = -(-size // stride)
    strides = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{stride}}}"), F.lit(0))
    length = F.char_length(text)
    count = F.when(length == 0, 0).otherwise(F.greatest(F.ceil((length - overlap) / stride), F.lit(1))).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

    def window(cut: Column, i: Column) -> Column:
        parts = [F.coalesce(F.get(cut, i + k), F.lit("")) for k in range(covered)]
        return F.left(F.concat(*parts), F.lit(size))

    both = F.array(F.struct(strides.alias("cut"), starts.alias("starts")))
    return F.get(F.transform(both, lambda b: F.transform(b["starts"], lambda i: window(b["cut"], i))), F.lit(0))


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunk records of documents `document_id, source_file, stem, text`. Windows that are
    white space only are dropped before the chunks are numbered."""
    prepared = docs.withColumn("_text", normalized(F.col("text"))).withColumn("_windows", windows(F.col("_text"), size, overlap))
    stripped = F.filter(F.transform("_windows", strip), lambda w: w != "")
    return prepared.select("document_id", "source_file", "stem", F.posexplode(stripped).alias("chunk_index", "chunk")).select(
        F.format_string("%s_chunk_%04d", F.col("stem"), F.col("chunk_index")).alias("chunk_id"),
        "document_id",
        "source_file",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("chunk").alias("text"),
    )


def chunk_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document, characters of the raw text and number of chunks; and the totals, in a
    row without a source file."""
    per_file = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    stats = docs.select("document_id", "source_file", F.char_length("text").cast("long").alias("characters")).join(
        per_file, "document_id", "left"
    )
    stats = stats.select("source_file", "characters", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
    totals = stats.agg(
        F.lit(None).cast("string").alias("source_file"),
        F.sum("characters").alias("characters"),
        F.sum("chunks").alias("chunks"),
    )
    return stats.unionByName(totals)
