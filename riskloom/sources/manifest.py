"""Provenance of a normalization run."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Files are read in blocks of this size, each by a task of its own; a file of one block has its
# own SHA-256, a longer one that of its blocks' digests in order.
BLOCK_BYTES = 1 << 30
READ_BYTES = 1 << 22


@dataclass
class Block(InputPartition):
    path: str
    file: str
    block: int
    offset: int
    length: int


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


class FileBlocks(DataSource):
    """Rows `path, file, block, length, sha256` for the blocks of all files under a path. The path is
    one that Arrow's file systems know (local or mounted, hdfs, s3, gs)."""

    @classmethod
    def name(cls) -> str:
        return "file_blocks"

    def schema(self) -> str:
        return "path string, file string, block long, length long, sha256 string"

    def reader(self, schema) -> "BlockReader":
        return BlockReader(self.options["path"], int(self.options.get("blockbytes", BLOCK_BYTES)))


class BlockReader(DataSourceReader):
    def __init__(self, path: str, block_bytes: int):
        self.path, self.block_bytes = path, block_bytes

    def partitions(self) -> list[Block]:
        files, path = _open(self.path)
        found = files.get_file_info(path)
        if found.type == pyarrow.fs.FileType.Directory:
            listed = files.get_file_info(pyarrow.fs.FileSelector(path, recursive=True))
        elif found.type == pyarrow.fs.FileType.File:
            listed = [found]
        else:
            raise FileNotFoundError(self.path)
        blocks = []
        for info in listed:
            # As Spark's own readers do, hidden files are left out.
            if info.type == pyarrow.fs.FileType.File and not info.base_name.startswith((".", "_")):
                for k in range(max(1, -(-info.size // self.block_bytes))):
                    offset = k * self.block_bytes
                    blocks.append(Block(info.path, info.base_name, k, offset, min(self.block_bytes, info.size - offset)))
        return blocks

    def read(self, partition: Block) -> Iterator[tuple]:
        files, _ = _open(self.path)
        digest, left = hashlib.sha256(), partition.length
        with files.open_input_file(partition.path) as file:
            file.seek(partition.offset)
            while left:
                data = file.read(min(READ_BYTES, left))
                if not data:
                    raise EOFError(f"{partition.path} became shorter")
                digest.update(data)
                left -= len(data)
        yield partition.path, partition.file, partition.block, partition.length, digest.hexdigest()


def file_digests(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`file, length, sha256` of every file under a path, of any length."""
    spark.dataSource.register(FileBlocks)
    blocks = spark.read.format("file_blocks").option("path", path).option("blockBytes", block_bytes).load()
    files = blocks.groupBy("path", "file").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("block", "sha256"))).alias("blocks"))
    digests = F.col("blocks.sha256")
    whole = F.when(F.size("blocks") == 1, digests[0]).otherwise(F.sha2(F.concat_ws("\n", digests), 256))
    return files.select("file", "length", whole.alias("sha256"))


def combined_digest(digests: DataFrame) -> DataFrame:
    """One digest for a set of files: that of the file itself if it is the only one, else
    a hash over sorted digests, taken first within 4,096 groups and then over the groups."""
    groups = digests.groupBy(F.substring("sha256", 1, 3).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("sha256")).alias("all")
    )
    group_digest = F.when(F.col("n") == 1, F.col("all")[0]).otherwise(F.sha2(F.concat_ws("\n", "all"), 256))
    top = groups.select("n", group_digest.alias("d")).agg(
        F.sum("n").alias("files"), F.sort_array(F.collect_list("d")).alias("all")
    )
    whole = F.when(F.size("all") == 1, F.col("all")[0]).otherwise(F.sha2(F.concat_ws("\n", "all"), 256))
    return top.select(whole.alias("sha256"))


def manifest(
    raw: DataFrame,
    policies: DataFrame,
    claims: DataFrame,
    source: str,
    digest: DataFrame | None = None,
    output_policies: str = "policies",
    output_claims: str = "claims",
) -> DataFrame:
    """One row: source, its digest, row counts in and out, class counts, outputs."""
    one = F.lit(1)
    counts = claims.agg(
        F.count(one).alias("claim_rows"),
        F.count_if(F.col("fraud_label")).alias("fraud_claims"),
        F.count_if(~F.col("fraud_label")).alias("non_fraud_claims"),
    )
    sha = digest.select("sha256").scalar() if digest is not None else F.lit(None).cast("string")
    return counts.select(
        F.lit(source).alias("source_file"),
        sha.alias("source_sha256"),
        raw.agg(F.count(one)).scalar().alias("source_rows"),
        policies.agg(F.count(one)).scalar().alias("policy_rows"),
        "claim_rows",
        "fraud_claims",
        "non_fraud_claims",
        F.lit(output_policies).alias("output_policies"),
        F.lit(output_claims).alias("output_claims"),
    )
