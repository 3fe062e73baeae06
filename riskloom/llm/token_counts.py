"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.batches import bound_batches, kept, stamped, tidied
from riskloom.llm.bpe import byte_letters
from riskloom.llm.pretokens import read_tokenizer, splitter

# Documents that the table of frequent pieces is drawn from, and its size. Both bound
# memory only: a piece outside the table is encoded, so counts don't depend on them.
SAMPLE_DOCUMENTS = 2000
FREQUENT = 131_072

# Pieces that a worker remembers besides the table, from task to task; then it starts anew.
REMEMBERED = 200_000

# Pieces longer than this are encoded each time and not remembered.
LONG_PIECE = 200


def _model(text: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text).model


def _lengths(text: str, pieces: list[str]) -> list[int]:
    """Tokens in each piece, by the library's model: pieces are what the tokenizer splits
    texts into, with bytes as the letters that its vocabulary writes."""
    letters = kept("token_counts", "letters", lambda: {b: c for c, b in byte_letters().items()})
    tokenize = kept("token_counts", text, lambda: _model(text)).tokenize
    return [len(tokenize(p.encode().decode("latin-1").translate(letters))) for p in pieces]


def frequent_pieces(docs: DataFrame, tokenizer: str, text: str = "text") -> tuple[bytes, np.ndarray]:
    """The commonest pieces of a sample of documents as one UTF-8 string joined by NUL
    after each, and the tokens in each. Pieces that contain NUL are left out."""
    bound_batches(docs.sparkSession)
    total = docs.count()
    row = F.pmod(F.xxhash64(text), F.lit(max(1, total)))
    sample = docs.where(F.col(text).isNotNull()).where(row < SAMPLE_DOCUMENTS).select(F.col(text).alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for doc in stamped(batch.column(0)):
                for _, found in splitter(tokenizer)(doc):
                    seen.update(p for p in found if len(p) <= LONG_PIECE and "\0" not in p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["piece", "n"]
            )

    counted = sample.mapInArrow(pieces, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    top = [r["piece"] for r in counted.orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece").collect()]
    lengths = np.array(_lengths(tokenizer, top), np.uint16)
    return "".join(p + "\0" for p in top).encode(), lengths


def count_tokens(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of every whole text, as the tokenizers library counts them.

    Returns `id, n_bytes, n_tokens, over_limit`, a row for each row of `docs`; other
    columns are ignored, whatever their names. Null and empty texts have 0 bytes and 0
    tokens; a null id stays null; repeated rows are counted each; an empty table gives
    none. Very long texts are cut into pieces step by step.

    Nothing is shuffled but the sample that the broadcast table is drawn from. Pieces in
    the table (FREQUENT entries at most) are looked up; the others are encoded once per
    worker and remembered there.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tokenizer = read_tokenizer(path)
    packed = spark.sparkContext.broadcast((tokenizer, *frequent_pieces(docs, tokenizer, text)))

    @F.arrow_udf("long")
    @tidied("token_counts")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, names, lengths = packed.value
        unpack = lambda: dict(zip(names.decode().split("\0"), lengths.tolist(), strict=False))
        frequent = kept("token_counts", ("frequent", names), unpack)
        remembered: dict[str, int] = kept("token_counts", ("remembered", table), dict)
        parts = splitter(table)

        def learn(missed: set[str]) -> dict[str, int]:
            """Lengths of what the table lacks; long pieces are not remembered."""
            if len(remembered) + len(missed) > REMEMBERED:
                remembered.clear()
            new = [p for p in missed if p not in remembered]
            found = dict(zip(new, _lengths(table, new), strict=True))
            remembered.update((p, n) for p, n in found.items() if len(p) <= LONG_PIECE)
            return found

        def count(pieces: list[str]) -> int:
            found = list(map(frequent.get, pieces))
            if None not in found:
                return sum(found)
            missed = [p for p, n in zip(pieces, found, strict=True) if n is None]
            known = list(map(remembered.get, missed))
            total = sum(filter(None, found))
            if None not in known:
                return total + sum(known)
            new = learn(set(missed))
            return total + sum(new[p] if p in new else remembered[p] for p in missed)

        for texts in batches:
            yield pa.array(
                [sum(1 if mark else count(pieces) for mark, pieces in parts(doc)) for doc in stamped(texts)], pa.int64()
            )

    counted = docs.select(
        F.col(id).alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        n_tokens(text).alias("n_tokens"),
    )
    return counted.select(F.col("doc_id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
