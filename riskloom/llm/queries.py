"""The registered queries of the text operators, and SQL for their rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import divergence, language_id, mixing, nearest, ngram_join, prefix_trie, quality_net, repair, repeats, spot_signatures, warc
from riskloom.llm.batches import fold
from riskloom.llm.bpe import round_trip
from riskloom.llm.token_counts import count_tokens
from riskloom.session import materialize

TOKENIZER = "byte_bpe_50k.json"

# No source is repeated more than this often for once of another.
REPETITION = 1.5


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialize(mixing.sized(docs, "doc_id", "source", mixing.count_words(F.col("text"))), "sized")
    return mixing.realise(rows, mixing.plan_mix(rows, repetition=REPETITION))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 4) == 2)
    model = language_id.learn(docs.where("not held_out"))
    return language_id.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = repeats.remove_repeats(docs)
    return done.select("doc_id", *[f"repeats.{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    net = quality_net.learn(docs, labels.where(fold("doc_id", 3) != 1))
    scored = quality_net.score_quality(docs, net)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(table(spark, sf_dir, "documents"))


def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(nearest.build_index(vectors), vectors.where(F.col("vec_id") % 50 == 0))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, archive)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.judge_documents(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_repeats": op4_repeats,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_ngram_join": op7_ngram_join,
    "op8_spot_signatures": op8_spot_signatures,
    "op9_nearest": op9_nearest,
    "op10_warc": op10_warc,
    "op11_repair": op11_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}

# The exponent that bisection finds has a closed form here: the extremes of p^(a - 1) are
# those of p, and their quotient is REPETITION.
MIXING_SQL = f"""
WITH t AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')) AS BIGINT) AS n_tokens FROM documents
), s AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM t GROUP BY source
), p AS (SELECT *, CAST(tokens AS DOUBLE) / sum(tokens) OVER () AS p FROM s),
a AS (
  SELECT CASE WHEN max(p) / min(p) <= {REPETITION} THEN 0.0
    ELSE ceil(round((1 - ln({REPETITION}) / ln(max(p) / min(p))) * 1000000, 3)) / 1000000 END AS alpha
  FROM p WHERE tokens > 0
), z AS (
  SELECT sum(exp(alpha * ln(p))) AS z, ceil(sum(tokens) * sum(exp(alpha * ln(p))) / min(exp(alpha * ln(p)) / p) - 0.000001) AS total
  FROM p, a WHERE tokens > 0
), w AS (
  SELECT source, tokens, total, CASE WHEN tokens > 0 THEN round(exp(alpha * ln(p)) / z, 9) ELSE 0.0 END AS weight FROM p, a, z
), b AS (SELECT *, greatest(tokens, CAST(floor(weight * total) AS BIGINT)) AS budget FROM w),
c AS (
  SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS copies, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM b
), used AS (
  SELECT doc_id, t.source, n_tokens, weight, tokens, total, budget, copies, rest, CAST(unnest(range(copies + 1)) AS INTEGER) AS epoch
  FROM t JOIN c ON t.source IS NOT DISTINCT FROM c.source
), placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY md5('1|' || epoch || '|' || doc_id)) AS "end"
  FROM used WHERE epoch < copies OR rest > 0
)
SELECT doc_id, source, n_tokens, CAST(weight AS DOUBLE) AS weight, epoch, CAST(epoch * tokens + "end" - n_tokens AS BIGINT) AS start,
  CAST(CASE WHEN budget > 0 THEN least(floor((epoch * tokens + "end" - n_tokens) * blocks / budget), blocks - 1) ELSE 0 END AS BIGINT) AS block
FROM (SELECT *, greatest(1, CAST(ceil(total / 1048576) AS BIGINT)) AS blocks FROM placed)
WHERE epoch < copies OR "end" <= rest
"""

NEAREST_SQL = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def _base32_sql(digits: str) -> str:
    letters = [
        f"substr('{warc.BASE32}', CAST((CAST('0x' || substr({digits}, {10 * i + 1}, 10) AS BIGINT) >> {35 - 5 * k}) & 31 AS BIGINT) + 1, 1)"
        for i in range(4)
        for k in range(8)
    ]
    return " || ".join(letters)


WARC_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY sha, payload_bytes) AS first_id FROM p)
SELECT page_id, payload_bytes, {_base32_sql("sha")} AS payload_digest,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

# Strings are looked at as hexadecimal digits, two for a byte.
REPEATS_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents
), p AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n_bytes - 399)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM p) WHERE c > 1),
b AS (SELECT doc_id, i, CAST(coalesce(i > lag(i) OVER o + 400, TRUE) AS INTEGER) AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b),
s AS (SELECT doc_id, span, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY doc_id, span),
gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS z FROM s
  UNION ALL SELECT doc_id, coalesce(max(s.hi), 0), max(n_bytes) FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id
), k AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""

NGRAM_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS doc, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc = e.a)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM documents d JOIN r ON r.doc = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

CRC_SQL = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split({text}, ''),
    lambda c: [CAST(unicode(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""

# Prefixes are told apart by a digest of all they hold; a node is paired with those above it
# along its smallest member.
TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS at
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (
  SELECT s.conv_id, s.h, s.src, least(s.h, coalesce(o.n, 0)) AS lent FROM (
    SELECT conv_id, {CRC_SQL.format(text="CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS src FROM sizes
  ) s LEFT JOIN sizes o ON o.conv_id = s.src
), r AS (
  SELECT c.conv_id, t.at AS d, role, text FROM c JOIN t ON t.conv_id = c.src AND t.at <= c.h
  UNION ALL SELECT c.conv_id, c.lent + t.at - c.h, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.at > c.h
), p AS (
  SELECT conv_id, 0 AS d, 0 AS words, '' AS name FROM c
  UNION ALL SELECT conv_id, d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')),
    md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d)) FROM r
), q AS (SELECT *, lag(name) OVER o AS above, max(d) OVER (PARTITION BY conv_id) AS last FROM p WINDOW o AS (PARTITION BY conv_id ORDER BY d)),
n AS (SELECT d, name, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM q GROUP BY d, name),
k AS (SELECT d - 1 AS d, above AS name, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
e AS (SELECT d, name, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM q WHERE d = last GROUP BY d, name),
s AS (
  SELECT q.d, q.name, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (k.n_children IS NULL) AS leaves
  FROM n LEFT JOIN k ON k.d = n.d AND k.name = n.name JOIN q ON q.conv_id = n.conv_id AND q.d <= n.d GROUP BY q.d, q.name
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s ON s.d = n.d AND s.name = n.name LEFT JOIN k ON k.d = n.d AND k.name = n.name
LEFT JOIN e ON e.d = n.d AND e.name = n.name LEFT JOIN n up ON up.d = n.d - 1 AND up.name = n.above
"""

_CLASSES = len(divergence.CLASSES)


def _class_sql() -> str:
    """Lists of what is left of a text after each class of characters."""
    steps = ["t AS c0"]
    for i, pattern in enumerate(divergence.CLASSES):
        steps.append(f"regexp_replace(c{i}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS c{i + 1}")
    counts = [f"length(c{i}) - length(c{i + 1})" for i in range(_CLASSES)] + [f"length(c{_CLASSES})"]
    return ", ".join(steps) + f", [{', '.join(counts)}] AS classes, length(t) AS chars"


def _far_sql(name: str, limit: tuple[float, float]) -> str:
    return f"coalesce({name} > {limit[0]} + {limit[1]} / sqrt(n_words), FALSE)"


# Of a pair of shares the part of the squared distance.
_PART = "(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2"

DIVERGENCE_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce('=' || lang, '') AS key, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
g AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 7], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 8) r(j) GROUP BY doc_id),
b AS (
  SELECT w.doc_id, key, w, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[{divergence.SYMBOLS}]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(w) < {divergence.LEAST_WORDS} OR 100 * coalesce(c.n, 0) > {divergence.MOST_REPEATED} * len(w) AS base_failed
  FROM w JOIN l USING (doc_id) LEFT JOIN covered c USING (doc_id)
), seen AS (
  SELECT key, lower(x) AS word, count(*) AS n FROM (SELECT key, unnest(list_distinct(w)) AS x FROM b WHERE n_words >= {divergence.REFERENCE_WORDS})
  WHERE length(lower(x)) <= {divergence.LONGEST} GROUP BY ALL
), common AS (
  SELECT key, word, rank - 1 AS k, max(octet_length(encode(word))) OVER (PARTITION BY key) AS longest
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, word) AS rank FROM seen) WHERE rank <= {divergence.COMMON}
), found AS (
  SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, key, unnest(w) AS x FROM b) x JOIN common c ON c.key = x.key AND lower(x) = word AND octet_length(encode(x)) <= longest
  GROUP BY ALL
), spread AS (
  SELECT b.doc_id, b.key, c.k, coalesce(f.n, 0) AS n FROM b JOIN common c ON c.key = b.key LEFT JOIN found f ON f.doc_id = b.doc_id AND f.k = c.k
  UNION ALL SELECT b.doc_id, b.key, {divergence.COMMON}, n_words - coalesce(f.n, 0) FROM b LEFT JOIN (SELECT doc_id, sum(n) AS n FROM found GROUP BY doc_id) f USING (doc_id)
), chars AS (SELECT doc_id, key, n_words, base_failed, {_class_sql()} FROM b),
cells AS (SELECT doc_id, key, n_words, base_failed, chars, unnest(range(0, {_CLASSES + 1})) AS k, unnest(classes) AS n FROM chars),
usable AS (SELECT doc_id, key FROM b WHERE n_words >= {divergence.REFERENCE_WORDS} AND NOT base_failed),
enough AS (SELECT key FROM usable GROUP BY key HAVING count(*) >= {divergence.REFERENCE_DOCUMENTS}),
steps AS (
  SELECT key, k, quantile_disc(CAST(floor(n * {divergence.STEPS} / chars + 0.5) AS INTEGER), 0.5) AS step FROM cells JOIN usable USING (doc_id, key) JOIN enough USING (key) GROUP BY key, k
), char_ref AS (SELECT key, k, step / sum(step) OVER (PARTITION BY key) AS q FROM steps),
word_ref AS (SELECT key, k, avg(s.n / b.n_words) AS q FROM spread s JOIN usable USING (doc_id, key) JOIN enough USING (key) JOIN b USING (doc_id, key) GROUP BY key, k),
char_far AS (SELECT doc_id, sqrt(sum({_PART})) AS far FROM (SELECT doc_id, n / chars AS p, q FROM cells JOIN char_ref USING (key, k) WHERE chars > 0) GROUP BY doc_id),
word_far AS (
  SELECT doc_id, sqrt(sum({_PART})) AS far FROM (SELECT doc_id, s.n / n_words AS p, q FROM spread s JOIN b USING (doc_id, key) JOIN word_ref USING (key, k)
  WHERE n_words >= {divergence.COMMON_WORDS_FROM}) GROUP BY doc_id
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  n_repeat_words, base_failed, NOT base_failed AND NOT {_far_sql("c.far", divergence.CHARACTER_LIMIT)} AND NOT {_far_sql("x.far", divergence.WORD_LIMIT)} AS kept
FROM b LEFT JOIN char_far c USING (doc_id) LEFT JOIN word_far x USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_mixing": MIXING_SQL, "op4_repeats": REPEATS_SQL, "op7_ngram_join": NGRAM_SQL, "op9_nearest": NEAREST_SQL, "op10_warc": WARC_SQL, "op12_prefix_trie": TRIE_SQL, "op13_divergence": DIVERGENCE_SQL}
