"""Claim files, canonical tables and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.fixed import NULL_TOKENS, RAW_SCHEMA
from riskloom.functions.text import strip
from riskloom.operators.normalize import export_dates
from riskloom.operators.quality import stop_on


def read_text_columns(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A CSV file with header as text columns, with missing-value tokens as nulls."""
    df = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').csv(path)
    return df.select(*[F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of `schema` by name; values that do not parse become missing."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])


def read_claims(spark: SparkSession, path: str, fmt: str = "parquet", as_text: bool = False) -> DataFrame:
    """The 24-column raw claims table. `as_text` keeps CSV values unparsed, with all
    columns of the file, for validation."""
    if fmt == "parquet":
        return spark.read.schema(RAW_SCHEMA).parquet(path)
    if fmt == "csv":
        df = read_text_columns(spark, path)
        return df if as_text else typed(df, RAW_SCHEMA)
    raise ValueError(f"unknown format: {fmt}")


def claim_ids(df: DataFrame) -> DataFrame:
    return df.select("claim_id")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a table; CSV gets a header and ISO dates."""
    writer = df.write.mode("overwrite") if fmt == "parquet" else export_dates(df).write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return typed(read_text_columns(spark, path), schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, missing values written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


BROKEN = "_broken_line"


def _parsed_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lines that hold something, with `row`, their fields, and BROKEN where a line is no
    JSON object of the schema."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    told = T.StructType([*wanted, T.StructField(BROKEN, T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block_start"))
    lines = lines.where(strip(F.col("value")) != "")
    row = F.from_json("value", told, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    return lines.withColumn("row", row).withColumn(BROKEN, F.when(F.col("row").isNull(), F.col("value")).otherwise(F.col(f"row.{BROKEN}")))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped. A line that is no JSON
    object of the schema stops the job, whatever columns are read; `broken_lines` lists them."""
    names = [f.name for f in (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))]
    lines = _parsed_lines(spark, path, schema)
    said = F.concat(F.lit("broken line in "), F.col("file"), F.lit(": "), F.substring(BROKEN, 1, 200))
    return stop_on(lines, F.col(BROKEN).isNotNull(), said).select(*[F.col("row")[n].alias(n) for n in names])


def read_sound_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """The rows of sound lines, and the broken lines `file, block_start, line`, kept apart:
    `block_start` is where the part of the file begins that the line was read with."""
    names = [f.name for f in (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))]
    lines = _parsed_lines(spark, path, schema)
    broken = lines.where(F.col(BROKEN).isNotNull()).select("file", "block_start", F.col("value").alias("line"))
    return lines.where(F.col(BROKEN).isNull()).select(*[F.col("row")[n].alias(n) for n in names]), broken
