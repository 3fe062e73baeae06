"""Written graphs, feature tables and run metadata."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


POINTER = "CURRENT"

# With so many types of edges in a task, or fewer, their files are written side by side and the edges
# need no sorting.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
EDGE_WRITERS = 16


@dataclass(frozen=True)
class Graph:
    """One whole version of a written graph: `nodes` has a table for each label, `node_id`
    first and then the properties of that label; `edges` are `src, dst, rel_type`."""

    version: str
    nodes: dict[str, DataFrame]
    edges: DataFrame

    def all_nodes(self) -> DataFrame:
        """Rows `label, node_id` of every node."""
        parts = [nodes.select(F.lit(label).alias("label"), "node_id") for label, nodes in sorted(self.nodes.items())]
        return reduce(DataFrame.unionByName, parts)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function from names under it to its paths."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda *names: jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *names)))
    return at().getFileSystem(conf), at


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Let the pointer name a version: written beside it, then moved over it in one step."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files, at = _files(spark, path)
    beside = at(f"_{POINTER}.{version}")
    out = files.create(beside, True)
    out.write(bytearray(version.encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    context.rename(files.makeQualified(beside), files.makeQualified(at(POINTER)), overwrite)


def current_version(spark: SparkSession, path: str) -> str | None:
    files, at = _files(spark, path)
    if not files.exists(at(POINTER)):
        return None
    return spark.read.text(f"{path.rstrip('/')}/{POINTER}").first()["value"]


def write_graph(nodes: dict[str, DataFrame], edges: DataFrame, path: str) -> str:
    """Replace a graph as a whole: a new version is written beside the others, and the
    pointer moved to it last. A reader sees the version that was whole when it began;
    the one before is kept for readers that are not done, older ones and unfinished ones go.
    One writer at a time. Returns the version."""
    spark = edges.sparkSession
    before, version = current_version(spark, path), uuid.uuid4().hex
    root = f"{path.rstrip('/')}/versions/{version}"
    for label, table in nodes.items():
        table.write.parquet(f"{root}/nodes/{label}")
    writers = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, EDGE_WRITERS)
    try:
        edges.write.partitionBy("rel_type").parquet(f"{root}/edges")
    finally:
        spark.conf.set(WRITERS, writers)
    _point(spark, path, version)
    files, at = _files(spark, path)
    for status in files.listStatus(at("versions")):
        if status.getPath().getName() not in (before, version):
            files.delete(status.getPath(), True)
    return version


def read_graph(spark: SparkSession, path: str) -> Graph:
    """The version that the pointer names now."""
    version = current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no graph at {path}")
    files, at = _files(spark, path)
    root = f"{path.rstrip('/')}/versions/{version}"
    labels = sorted(s.getPath().getName() for s in files.listStatus(at("versions", version, "nodes")))
    nodes = {label: spark.read.parquet(f"{root}/nodes/{label}") for label in labels}
    return Graph(version, nodes, spark.read.schema("src string, dst string, rel_type string").parquet(f"{root}/edges"))


def write_features(df: DataFrame, path: str) -> None:
    """Sparse feature vectors and labels, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_features(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def feature_metadata(nonzero: DataFrame, numeric: list[str], categorical: list[str], width: int, min_count: int) -> DataFrame:
    """One row about a feature run: what was fitted on what, and rows and non-zero
    entries per split, from rows `split, nonzero`."""
    per_split = []
    for name in ["train", "validation", "test"]:
        here = F.col("split") == name
        per_split.append(F.count_if(here).alias(f"{name}_rows"))
        per_split.append(F.coalesce(F.sum(F.when(here, F.col("nonzero"))), F.lit(0)).alias(f"{name}_matrix_nonzero"))
    return nonzero.agg(*per_split).select(
        F.lit("fraud_label").alias("target"),
        F.lit("train_only").alias("fit_scope"),
        F.lit(",".join(numeric)).alias("numeric_input_columns"),
        F.lit(",".join(categorical)).alias("categorical_input_columns"),
        F.lit(len(numeric) + len(categorical)).cast("long").alias("raw_engineered_feature_count"),
        F.lit(width).cast("long").alias("transformed_feature_count"),
        F.lit(min_count).cast("long").alias("onehot_min_frequency"),
        "*",
    )
