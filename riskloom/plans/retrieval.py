"""Queries over chunking, embedding and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import retrieval, text
from riskloom.plans import fixtures as fx
from riskloom.plans.oracle import with_ctes
from riskloom.plans.registry import REGISTRY
from riskloom.session import materialize, scratch_path
from riskloom.sources import tables

add = REGISTRY.add


def chunks(s, d):
    return text.chunk_documents(fx.documents(s, d))


def vectors(s, d):
    return fx.table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_queries(s, d):
    return fx.table(s, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")


def jsonl_roundtrip(s, d):
    path = scratch_path(s, "chunks")
    written = chunks(s, d)
    tables.write_jsonl(written, path)
    return tables.read_jsonl(s, path, written.schema)


def embedded(s, d):
    table = materialize(chunks(s, d), "chunks")
    return table, retrieval.embed(table, retrieval.fit_encoder(table))


def embed_chunks(s, d):
    table, vectors = embedded(s, d)
    return vectors.select("chunk_id", F.size("embedding").alias("dimension"), F.expr("round(sqrt(aggregate(embedding, 0D, (t, x) -> t + x * x)), 4)").alias("norm"))


def vector_checks(s, d):
    """The embedded chunks as they are stored, against the chunks."""
    table, embedded_ = embedded(s, d)
    path = scratch_path(s, "vectors")
    embedded_.write.parquet(path)
    return retrieval.check_vectors(s.read.parquet(path), table).withColumn("norm_error", F.round("norm_error", 6) + 0.0)


def topk_recall(s, d):
    """The approximate search with what it read, against the exact one."""
    queries, table = vector_queries(s, d), vectors(s, d)
    near = retrieval.search_cells(queries, table)
    found = retrieval.recall(near.found, retrieval.topk_cosine(queries, table))
    read = near.effort.select((F.col("vectors_read") < 0.1 * F.col("queries") * F.col("rows")).alias("under_tenth_read")).scalar()
    return found.select("exact_rows", (F.col("recall") >= 0.9).alias("recall_reached"), read.alias("under_tenth_read"))


def topk_effort(s, d):
    """What both searches read, with cells small enough for these tables to have several."""
    queries, table = vector_queries(s, d), vectors(s, d)
    exact, near = retrieval.search_exact(queries, table, cell_rows=64), retrieval.search_cells(queries, table)
    return exact.effort.withColumn("search", F.lit("exact")).unionByName(near.effort.withColumn("search", F.lit("cells")))


_space = r"[\t-\r\x1c-\x20\x{85}\pZ]"
CHUNKS = f"""normal AS (
  SELECT doc_id, length(text) AS characters,
    regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_space}+|{_space}+$', '', 'g') AS t
  FROM documents),
windows AS (
  SELECT doc_id, w, regexp_replace(substring(t, CAST(w * 850 + 1 AS BIGINT), 1000), '^{_space}+|{_space}+$', '', 'g') AS text
  FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, (length(t) - 150 + 849) // 850) END)) AS w
        FROM normal)),
chunks AS (
  SELECT 'doc_' || doc_id || '_chunk_' || lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), '0') AS chunk_id, doc_id AS document_id,
    'doc_' || doc_id || '.md' AS source_file, i AS chunk_index, text
  FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY w) - 1 AS i FROM windows WHERE text <> ''))"""

TOPK = """hits AS (SELECT query_id, chunk_id, distance, rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, d.distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY d.distance, c.vec_id) AS rank
  FROM embeddings q, embeddings c,
  LATERAL (SELECT round(1 - list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) AS distance) d)
  WHERE rank <= 3)"""

add(
    "normalize_text",
    lambda s, d: text.normalize_text(fx.table(s, d, "documents")).select(
        "doc_id", F.length("text").cast("long").alias("characters"), F.md5("text").alias("digest")
    ),
    f"WITH {CHUNKS} SELECT doc_id, length(t) AS characters, md5(t) AS digest FROM normal",
)
add("chunk_documents", chunks, f"WITH {CHUNKS} SELECT * FROM chunks")
add("jsonl_roundtrip", jsonl_roundtrip, f"WITH {CHUNKS} SELECT * FROM chunks")
add(
    "chunk_stats",
    lambda s, d: text.chunk_stats(fx.documents(s, d), chunks(s, d)),
    f"""WITH {CHUNKS}, stats AS (SELECT 'doc_' || n.doc_id || '.md' AS source_file, n.characters, count(c.chunk_id) AS chunks
  FROM normal n LEFT JOIN chunks c ON n.doc_id = c.document_id GROUP BY 1, 2)
SELECT * FROM stats UNION ALL SELECT NULL, CAST(sum(characters) AS BIGINT), CAST(sum(chunks) AS BIGINT) FROM stats""",
)
add("embed_chunks", embed_chunks, f"WITH {CHUNKS} SELECT chunk_id, 384 AS dimension, CAST(1 AS DOUBLE) AS norm FROM chunks")
add("vector_checks", vector_checks, f"""WITH {CHUNKS} SELECT count(*) AS stored, CAST(1 AS BIGINT) AS dimension_count, CAST(384 AS BIGINT) AS dimension,
  CAST(0 AS DOUBLE) AS norm_error, count(*) AS expected, TRUE AS ok FROM chunks""")
add(
    "given_vector_checks",
    lambda s, d: retrieval.check_vectors(vectors(s, d), vector_queries(s, d)).withColumn("norm_error", F.round("norm_error", 6) + 0.0),
    """SELECT *, stored = expected AND dimension_count = 1 AND norm_error < 1e-4 AS ok FROM (
  SELECT count(*) AS stored, count(DISTINCT length(embedding)) AS dimension_count, max(length(embedding)) AS dimension,
    round(max(abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1)), 6) + 0.0 AS norm_error,
    count(*) AS expected FROM embeddings)""",
)
add(
    "topk_cosine",
    lambda s, d: retrieval.topk_cosine(vector_queries(s, d), vectors(s, d)).withColumn("distance", F.round("distance", 6) + 0.0),
    f"WITH {TOPK} SELECT query_id, chunk_id, round(distance, 6) + 0.0 AS distance, rank FROM hits",
)
add(
    "topk_recall",
    topk_recall,
    "SELECT count(*) * least(3, count(*)) AS exact_rows, TRUE AS recall_reached, TRUE AS under_tenth_read FROM embeddings",
)
add("topk_effort", topk_effort)
