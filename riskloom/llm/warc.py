"""WARC archives as tables of bounded chunks."""

from __future__ import annotations

import hashlib
import uuid
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.batches import bound_batches
from riskloom.session import materialize, scratch_path

# Payload bytes in one record; longer payloads go on in continuation records.
CHUNK_BYTES = 1 << 20

# The format's line end, version line, base32 alphabet and revisit profile.
END = "\r\n"
VERSION = "WARC/1.1" + END
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """A folder of WARC files. Every record's first field is the mark, a random number
    drawn for the archive, so no payload can look like the beginning of a record."""

    path: str
    mark: str

    @property
    def opening(self) -> str:
        return f"{VERSION}X-Archive: {self.mark}{END}"


def base32(hex_digits: Column) -> Column:
    """Base32 of 40 hexadecimal digits: four numbers of 40 bits, eight letters each."""
    letters = []
    for i in range(4):
        number = F.conv(F.substring(hex_digits, 10 * i + 1, 10), 16, 10).cast("long")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, 35 - 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*letters)


def digest_of(payload: Column) -> Column:
    return base32(F.sha1(payload))


def chunk_records(pages: DataFrame, id: str, url: str, payload: str, chunk_bytes: int, revisit_bytes: int) -> DataFrame:
    """The chunk table: a row for every record that will be written, with
    `page_id, url, row, kind, refers_to, n_bytes, digest, n_chunks, chunk, data`.

    Digests come first; payloads that occur once need nothing more. The smallest page of
    each repeated payload is found by an aggregate, and joined back on the digest.
    """
    rows = pages.select(
        F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    first = rows.where(F.col("n_bytes") >= revisit_bytes).groupBy("sha", "n_bytes")
    first = first.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first_id IS NOT NULL")
    known = materialize(first.select("sha", "n_bytes", "first_id"), "payloads")
    placed = rows.join(known, ["sha", "n_bytes"], "left").withColumn("row", F.monotonically_increasing_id())
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    placed = placed.withColumn("kind", F.when(revisit, "revisit").otherwise("response"))
    placed = placed.withColumn("n_chunks", F.when(revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk_bytes))).cast("int"))
    chunked = placed.withColumn("chunk", F.explode(F.sequence(F.lit(1), "n_chunks")))
    data = F.substring("payload", (F.col("chunk") - 1) * chunk_bytes + 1, F.lit(chunk_bytes))
    return chunked.select(
        "page_id", "url", "row", "kind", F.when(revisit, F.col("first_id")).alias("refers_to"), "n_bytes",
        base32(F.col("sha")).alias("digest"), "n_chunks", "chunk", F.when(revisit, F.lit(b"")).otherwise(data).alias("data"),
    )


def record_of(date: str) -> Column:
    """The bytes of the record for a row of the chunk table, after its opening."""

    def line(name: str, value: Column | str, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(END))
        return text if when is None else F.when(when, text).otherwise("")

    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))
    text = lambda c: F.col(c).cast("string")
    page, first, revisit, parts = F.col("page_id"), F.col("chunk") == 1, F.col("kind") == "revisit", F.col("n_chunks") > 1
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), line("Content-Length", text("n_bytes")), F.lit(END))
    block = F.concat(F.when(first, http).otherwise("").cast("binary"), F.col("data"))
    own = F.concat(F.lit("<urn:page:"), F.coalesce(text("page_id"), F.lit("none")), F.lit(":"), text("row"), F.lit(":"), text("chunk"), F.lit(">"))
    head = F.concat(
        line("WARC-Type", F.when(first, F.col("kind")).otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, name(page)).otherwise(own)),
        line("WARC-Date", date),
        line("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20"), F.col("url").isNotNull()),
        line("WARC-Profile", PROFILE, revisit),
        line("WARC-Refers-To", name(F.col("refers_to")), revisit),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")), first),
        line("WARC-Segment-Number", text("chunk"), parts),
        line("WARC-Segment-Origin-ID", name(page), ~first),
        line("WARC-Segment-Total-Length", (F.octet_length(http) + F.col("n_bytes")).cast("string"), parts & (F.col("chunk") == F.col("n_chunks"))),
        line("X-Page", text("page_id"), page.isNotNull()),
        line("X-Row", text("row")),
        line("X-Payload-Length", text("n_bytes")),
        line("Content-Type", "application/http; msgtype=response", first),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(END),
    )
    return F.concat(head.cast("binary"), block)


def write_archives(
    pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", path: str | None = None,
    chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
) -> Archive:
    """Write a record for every row of `pages`, with the payload's UTF-8 bytes.

    Of records with the same payload of at least `revisit_bytes` bytes, the one with the
    smallest id is a response and the others are revisits of it; rows that repeat the
    smallest id are responses too, and so are payloads whose rows have no id at all. A
    null payload is empty; a null url has no target; white space in a url is escaped;
    other columns are ignored; an empty table gives an archive without records. Payloads
    over `chunk_bytes` go on in continuation records of at most that size.
    """
    archive = Archive(path or scratch_path(pages.sparkSession, "warc"), uuid.uuid4().hex)
    rows = chunk_records(pages, id, url, payload, chunk_bytes, revisit_bytes)
    # The bytes pass through the text writer as they are; between records it puts two line ends.
    value = F.concat(F.lit(archive.opening).cast("binary"), record_of(date)).cast("string")
    rows.select(value.alias("value")).write.option("lineSep", END * 2).text(archive.path)
    return archive


def read_chunks(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records of an archive as its chunk table, without order:
    `page_id, row, kind, refers_to, n_bytes, digest, chunk, n_chunks, data`. Files are
    split between tasks; a row holds one record."""
    lines = spark.read.schema("value string").option("lineSep", END * 2 + archive.opening).text(archive.path)
    value = F.when(F.startswith("value", F.lit(archive.opening)), F.substring("value", len(archive.opening) + 1, F.lit(2**31 - 1))).otherwise(F.col("value"))
    cut = lines.select(value.alias("value")).withColumn("head", F.substring_index("value", END * 2, 1))
    field = F.str_to_map("head", F.lit(END), F.lit(": "))
    block = F.substring(F.col("value").cast("binary"), F.octet_length("head") + 5, F.col("field")["Content-Length"].cast("int"))
    got = cut.withColumn("field", field).withColumn("block", block)
    first = F.col("field")["WARC-Type"] != "continuation"
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), END * 2, 1)) + 4
    known = got.select(
        F.col("field")["X-Page"].cast("long").alias("page_id"),
        F.col("field")["X-Row"].cast("long").alias("row"),
        F.when(first, F.col("field")["WARC-Type"]).alias("kind"),
        F.regexp_extract(F.col("field")["WARC-Refers-To"], r"urn:page:(\d+|-\d+)>", 1).cast("long").alias("refers_to"),
        F.col("field")["X-Payload-Length"].cast("long").alias("n_bytes"),
        F.substring(F.col("field")["WARC-Payload-Digest"], 6, 32).alias("digest"),
        F.coalesce(F.col("field")["WARC-Segment-Number"], F.lit("0")).cast("int").alias("chunk"),
        F.when(first, F.substring("block", http + 1, F.lit(2**31 - 1))).otherwise(F.col("block")).alias("data"),
    )
    return known


def read_archives(spark: SparkSession, archive: Archive) -> DataFrame:
    """A row for every response and revisit: `page_id, payload_bytes, payload_digest,
    record_type, refers_to`.

    Lengths and digests of responses are those of the bytes read; if they differ from what
    the record says, or a part of a payload is missing, the job fails. Those of revisits,
    which have no payload, are the ones they state. Payloads in one record are digested
    where they are read. Parts of longer ones meet in order, and a digest is carried
    from part to part, so that no more than a batch of parts is in memory.
    """
    bound_batches(spark)
    chunks = read_chunks(spark, archive)
    stated = [F.col("n_bytes"), F.col("digest"), F.col("kind"), F.col("refers_to")]
    whole = chunks.where("chunk = 0").select(
        "page_id", *stated,
        F.when(F.col("kind") == "revisit", F.col("n_bytes")).otherwise(F.octet_length("data")).cast("long").alias("found_bytes"),
        F.when(F.col("kind") == "revisit", F.col("digest")).otherwise(digest_of(F.col("data"))).alias("found"),
    )
    parts = chunks.where("chunk > 0").repartition("row").sortWithinPartitions("row", "chunk")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, size, seen = None, None, 0, 0
        columns = ["page_id", "n_bytes", "digest", "kind", "refers_to"]

        def closed() -> pa.RecordBatch:
            row = [*now[1:], size, b32encode(state.digest()).decode()]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [*columns, "found_bytes", "found"])

        for batch in batches:
            for i in range(batch.num_rows):
                row, part = batch.column("row")[i].as_py(), batch.column("chunk")[i].as_py()
                if now is None or now[0] != row:
                    if now is not None:
                        yield closed()
                    now, state, size, seen = (row, *(batch.column(c)[i].as_py() for c in columns)), hashlib.sha1(), 0, 0
                seen += 1
                if part != seen:
                    raise ValueError(f"page {now[1]}: part {seen} is missing")
                data = batch.column("data")[i].as_buffer()
                state.update(data)
                size += len(data)
        if now is not None:
            yield closed()

    long_ones = parts.mapInArrow(joined, "page_id long, n_bytes long, digest string, kind string, refers_to long, found_bytes long, found string")
    rows = whole.unionByName(long_ones)
    wrong = (F.col("found_bytes") != F.col("n_bytes")) | (F.col("found") != F.col("digest"))
    message = F.concat(F.lit("payload differs from what its record says: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    return rows.select(
        "page_id", F.col("found_bytes").alias("payload_bytes"),
        F.when(wrong, F.raise_error(message)).otherwise(F.col("found")).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to",
    )
