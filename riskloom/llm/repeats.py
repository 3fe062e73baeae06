"""Removal of long repeated passages by distributed bucket-pointer refinement.

A suffix is repeated if its first `length` bytes begin elsewhere too. Instead of sorting
every suffix, suffixes are kept in runs, and runs in buckets:

* Initial q-gram buckets: of the q-grams within its first `length` bytes, every suffix
  belongs to the one with the smallest number (the leftmost of equal ones), its anchor.
  Equal strings have equal anchors at equal offsets, and neighbouring suffixes mostly
  share theirs, so a run is a stretch of suffixes with one anchor and one grid cell of
  offsets from it.
* Refinement: a run's bucket is sorted by the identifiers of what stands at later offsets.
  The identifier of its core (what all suffixes of the cell have in common) tells whether
  any of them can be repeated; that of its hull (all they cover together) whether all are.
  Only runs whose core is repeated and whose hull isn't stay open.
* Open runs are refined again in finer cells of the same anchor, down to single suffixes,
  where core and hull are the suffix's own `length` bytes. What was settled for a run is
  settled for all its suffixes; of its bucket one run stands for all in what follows.

Identifiers are 64 bits for cores, where a chance match costs another look and no more,
and 128 bits for hulls and suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.batches import bound_batches, flat_bytes, groups, kept, tidied
from riskloom.llm.bitmaps import may_be_among
from riskloom.session import discard, materialize, written_only

LENGTH = 400
GRAM = 17

# Widths of the cells of offsets, coarse to fine; the last is 1.
CELLS = (192, 16, 1)

# Bytes of text that are looked at together.
BLOCK = 1 << 18

# Passages of words meet at their smallest run of so many words.
WORD_GRAM = 17

RUNS = "doc_id bigint, text_hash bigint, anchor bigint, first bigint, last bigint, core bigint, hull_a bigint, hull_b bigint, weight int, settled boolean"
PIECES = "doc_id bigint, text_hash bigint, anchor bigint, first bigint, last bigint, begin bigint, piece binary"
SPOTS = "doc_id bigint, text_hash bigint, spot bigint, name bigint"
PASSAGES = "doc_id bigint, text_hash bigint, first bigint, past bigint, name_a bigint, name_b bigint"
KEY = ["doc_id", "text_hash"]


def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64, from one table of the
    largest size that was asked for."""
    tables = kept("repeats", base, list)
    if not tables or len(tables[0]) < size:
        tables.clear()
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            tables.append(np.multiply.accumulate(p))
    return tables[0][:size], tables[1][:size]


@lru_cache(1)
def _tables() -> list[tuple[np.ndarray, int]]:
    rng = np.random.default_rng(20)
    return [(rng.integers(0, 1 << 64, 256, np.uint64), int(rng.integers(0, 1 << 62)) * 2 + 1) for _ in range(2)]


class Names:
    """Identifiers of the strings within a flat array, each in constant time."""

    def __init__(self, flat: np.ndarray, both: bool = True):
        size = 1 << max(10, int(len(flat) + 1).bit_length())
        self.sums, self.inverse = [], []
        for table, base in _tables()[: 2 if both else 1]:
            power, inverse = _powers(size, base)
            sums = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum(table[flat] * power[: len(flat)], out=sums[1:])
            self.sums.append(sums)
            self.inverse.append(inverse)

    def of(self, begin: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        sums = self.sums[which]
        name = (sums[end] - sums[begin]) * self.inverse[which][begin]
        return _mixed(name + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(names: Names, flat: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each place, where the smallest q-gram of the next `length` bytes begins. Only
    places with so many bytes in their own text have a meaning."""
    n = len(flat) - gram + 1
    at = np.arange(n, dtype=np.uint64)
    here = at.astype(np.int64)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (names.of(here, here + gram) >> bits << bits) | at
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if width > span:
        key = np.minimum(key[: n - width + 1], key[width - span :])
    return (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def runs_of(anchor: np.ndarray, place: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch with one anchor and one cell."""
    box = (anchor - place) // cell
    turn = np.flatnonzero((anchor[1:] != anchor[:-1]) | (box[1:] != box[:-1]) | (place[1:] != place[:-1] + 1)) + 1
    begin = np.concatenate(([0], turn)) if len(place) else np.zeros(0, np.int64)
    return begin, np.append(begin[1:], len(place)) - 1 if len(place) else begin


def name_runs(names: Names, anchor: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, cell: int) -> list[np.ndarray]:
    """Core and hull identifiers. `low` and `high` bound each run's text in the array.
    The cell is part of them, as two runs of one place can have the same hull."""
    box = (anchor - first) // cell
    top = anchor - box * cell
    bottom = top - cell + 1
    core = names.of(np.maximum(top, low), np.minimum(bottom + length, high))
    begin, end = np.maximum(bottom, low), np.minimum(top + length, high)
    own = box.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return [_mixed(x + own) for x in (core, names.of(begin, end, 0), names.of(begin, end, 1))]


def _merge_ranges(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring runs of a text in one."""
    if not len(doc):
        return doc, first, last
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)))
    end = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], first[new], last[end]


def _batch(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.strip().split()[0] for c in schema.split(",")])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _emit(ids: pa.Array, hashes: pa.Array, doc: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, named: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Runs for the shuffle. Hulls that occur more than once here are repeated for
    certain: one of them goes out, with a weight of two, and the rest as settled ranges."""
    core, a, b = named
    _, where, back, count = np.unique(a, return_index=True, return_inverse=True, return_counts=True)
    again = count[back] > 1
    shown = np.zeros(len(a), bool)
    shown[where] = True
    doc_s, first_s, last_s = _merge_ranges(doc[again], first[again], last[again])
    if len(doc_s):
        empty = pa.nulls(len(doc_s), pa.int64())
        yield _batch([ids.take(pa.array(doc_s)), hashes.take(pa.array(doc_s)), empty, first_s, last_s, empty, empty, empty, np.zeros(len(doc_s), np.int32), np.ones(len(doc_s), bool)], RUNS)
    at = np.flatnonzero(shown)
    weight = np.where(again[at], 2, 1).astype(np.int32)
    yield _batch([ids.take(pa.array(doc[at])), hashes.take(pa.array(doc[at])), anchor[at], first[at], last[at], _signed(core[at]), _signed(a[at]), _signed(b[at]), weight, again[at]], RUNS)


def text_runs(batch: pa.RecordBatch, length: int, gram: int, cell: int) -> Iterator[pa.RecordBatch]:
    """All runs of whole texts; `doc_id, text_hash, text` come in."""
    ids, hashes = batch.column("doc_id"), batch.column("text_hash")
    flat, starts = flat_bytes(batch.column("text"))
    for lo, hi in groups(starts, BLOCK):
        base, end = int(starts[lo]), int(starts[hi])
        # A text longer than a block goes in stretches of suffixes, each with the bytes
        # around it that its runs reach to.
        for at in range(base, max(end, base + 1), BLOCK if hi == lo + 1 else end - base + 1):
            stop = min(end, at + BLOCK) if hi == lo + 1 else end
            long = hi == lo + 1 and end - base > BLOCK
            left, right = max(base, at - cell), min(end, stop + length + 2 * cell)
            part = flat[left:right]
            bounds = np.clip(starts[lo : hi + 1], left, right) - left
            doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
            place = np.arange(len(part))
            # Runs belong to the stretch that they begin in, so one more place is looked at
            # before it, and a cell behind it.
            ok = (place + length <= bounds[1:][doc]) & (place + left >= at - 1) & (place + left < stop + cell)
            if not ok.any():
                continue
            names = Names(part)
            place = place[ok]
            doc = doc[ok]
            anchor = anchors(names, part, length, gram)[place]
            begin, last = runs_of(anchor, place, cell)
            if long:
                begun = (place[begin] + left >= at) & (place[begin] + left < stop)
                begin, last = begin[begun], last[begun]
            doc, anchor, first, last = doc[begin], anchor[begin], place[begin], place[last]
            named = name_runs(names, anchor, first, bounds[:-1][doc], bounds[1:][doc], length, cell)
            shift = left - starts[lo + doc]
            yield from _emit(ids, hashes, lo + doc, anchor + shift, first + shift, last + shift, named)


def cut_pieces(batch: pa.RecordBatch, length: int, cell: int) -> Iterator[pa.RecordBatch]:
    """The bytes of open runs' hulls; `doc_id, text_hash, text, open` come in."""
    flat, starts = flat_bytes(batch.column("text"))
    data = flat.tobytes()
    opened = batch.column("open")
    for i in range(batch.num_rows):
        rows = opened[i].as_py()
        lo, hi = int(starts[i]), int(starts[i + 1])
        begins, pieces = [], []
        for r in rows:
            top = r["anchor"] - (r["anchor"] - r["first"]) // cell * cell
            begin = max(0, top - cell + 1)
            begins.append(begin)
            pieces.append(data[lo + begin : min(hi, lo + top + length)])
        one = np.full(len(rows), i)
        columns = [batch.column("doc_id").take(pa.array(one)), batch.column("text_hash").take(pa.array(one))]
        columns += [np.array([r[c] for r in rows], np.int64) for c in ("anchor", "first", "last")]
        yield _batch([*columns, np.array(begins, np.int64), pa.array(pieces, pa.binary())], PIECES)


def _cells(anchor: np.ndarray, first: np.ndarray, last: np.ndarray, cell: int) -> tuple[np.ndarray, ...]:
    """Runs cut at a finer grid: row, first, last."""
    near, far = (anchor - last) // cell, (anchor - first) // cell
    count = far - near + 1
    row = np.repeat(np.arange(len(anchor)), count)
    box = far[row] - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    top = anchor[row] - box * cell
    return row, np.maximum(first[row], top - cell + 1), np.minimum(last[row], top)


def piece_runs(batch: pa.RecordBatch, length: int, cell: int) -> Iterator[pa.RecordBatch]:
    """Finer runs of open ones, from their pieces."""
    pieces = batch.column("piece").cast(pa.large_binary())
    flat, starts = flat_bytes_of(pieces)
    anchor, first, last, begin = (batch.column(c).to_numpy() for c in ("anchor", "first", "last", "begin"))
    for lo, hi in groups(starts, BLOCK):
        part = flat[starts[lo] : starts[hi]]
        names = Names(part)
        row, head, tail = _cells(anchor[lo:hi], first[lo:hi], last[lo:hi], cell)
        bounds = starts[lo : hi + 1] - starts[lo]
        shift = bounds[:-1][row] - begin[lo:hi][row]
        named = name_runs(names, anchor[lo:hi][row] + shift, head + shift, bounds[:-1][row], bounds[1:][row], length, cell)
        yield from _emit(batch.column("doc_id"), batch.column("text_hash"), lo + row, anchor[lo:hi][row], head, tail, named)


def flat_bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = array.buffers()
    starts = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[starts[0] : starts[-1]], starts - starts[0]


def settle(runs: DataFrame, single: bool) -> DataFrame:
    """Runs that are repeated, and those to be refined: `doc_id, text_hash, anchor, first,
    last, settled`. Identifiers are counted before they are joined back, so a common one
    is a row per task in the count, and adaptive execution splits it in the join.

    A suffix of an open run may have its other copy in a settled one of the same core. So
    of the settled runs with one hull, a run is refined too where its core is that of an
    open run."""
    shape = [*KEY, "anchor", "first", "last"]
    # With single suffixes, core and hull are the same string, so the hull alone decides.
    keys = ["hull_a", "hull_b"] if single else ["core"]
    shown = runs.where("hull_a IS NOT NULL")
    ranges = runs.where("hull_a IS NULL").select(*shape, "settled")
    counted = shown.groupBy(*keys).agg(F.sum("weight").alias("n")).where("n > 1").select(*keys)
    found = shown.join(materialize(counted, "buckets"), keys)
    if single:
        return ranges.unionByName(found.select(*shape, F.lit(True).alias("settled")))
    found = materialize(found, "runs")
    hulls = found.groupBy("hull_a", "hull_b").agg(F.sum("weight").alias("n")).where("n > 1").select("hull_a", "hull_b", F.lit(True).alias("whole"))
    known = found.join(materialize(hulls, "hulls"), ["hull_a", "hull_b"], "left")
    known = materialize(known.select(*shape, "core", "hull_a", "hull_b", F.coalesce("whole", F.lit(False)).alias("settled")), "known")
    open_cores = materialize(known.where("NOT settled").select("core").distinct(), "cores")
    copies = known.where("settled").join(open_cores, "core", "left_semi").groupBy("hull_a", "hull_b").agg(F.min(F.struct(*shape)).alias("run"))
    copies = copies.select("run.*", F.lit(False).alias("settled"))
    return ranges.unionByName(known.select(*shape, "settled")).unionByName(copies)


class Phrases(Names):
    """Identifiers of runs of words, each word given by two numbers."""

    def __init__(self, words: np.ndarray):
        size = 1 << max(10, int(words.shape[1] + 1).bit_length())
        self.sums, self.inverse = [], []
        for own, (_, base) in zip(words, _tables(), strict=True):
            power, inverse = _powers(size, base)
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(own * power[: len(own)], out=sums[1:])
            self.sums.append(sums)
            self.inverse.append(inverse)


def find_words(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch without ASCII white space begins and ends, texts kept apart."""
    inside = (flat != 32) & ((flat < 9) | (flat > 13))
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    firsts = starts[:-1][np.diff(starts) > 0]
    opens[firsts] = inside[firsts]
    lasts = starts[1:][np.diff(starts) > 0] - 1
    closes[lasts] = inside[lasts]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def name_words(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two numbers for each word, the same wherever it stands."""
    out = np.empty((2, len(begin)), np.uint64)
    long = end - begin > BLOCK
    for rows in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(begin // BLOCK)) + 1):
        rows = rows[~long[rows]]
        if len(rows):
            base = begin[rows[0]]
            names = Names(flat[base : end[rows[-1]]])
            for which in range(2):
                out[which, rows] = names.of(begin[rows] - base, end[rows] - base, which)
    for i in np.flatnonzero(long):
        out[:, i] = np.frombuffer(hashlib.blake2b(flat[begin[i] : end[i]].tobytes(), digest_size=16).digest(), np.uint64)
    return out


def passages(batch: pa.RecordBatch, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Every run of `words` words: text, first word of the text and of the run, place of
    its smallest run of WORD_GRAM words, all in one count; where it begins and ends among
    the bytes of its text; and the names of words that it is told by."""
    flat, starts = flat_bytes(batch.column("text"))
    begin, end = find_words(flat, starts)
    doc = np.searchsorted(starts, begin, "right") - 1
    gram = min(WORD_GRAM, words)
    step = max(1, BLOCK // 8)  # words of about a block
    for lo in range(0, max(0, len(begin) - words + 1), step):
        hi = min(len(begin), lo + step + words - 1)
        own = np.arange(lo, hi - words + 1)
        own = own[doc[own] == doc[own + words - 1]]
        if len(own):
            phrases = Phrases(name_words(flat, begin[lo:hi], end[lo:hi]))
            spot = anchors(phrases, begin[lo:hi], words, gram)[own - lo] + lo
            text = doc[own]
            shift = np.searchsorted(doc, text)
            named = phrases.of(spot - lo, spot - lo + gram)
            yield text, spot - shift, named, begin[own] - starts[text], end[own + words - 1] - starts[text], phrases, own - lo


def passage_spots(batch: pa.RecordBatch, words: int) -> Iterator[pa.RecordBatch]:
    """Where runs of `words` words may meet others; `doc_id, text_hash, text` come in."""
    for text, spot, named, *_ in passages(batch, words):
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (spot[1:] != spot[:-1])))
        at = pa.array(text[new])
        yield _batch([batch.column("doc_id").take(at), batch.column("text_hash").take(at), spot[new], _signed(named[new])], SPOTS)


def met_passages(batch: pa.RecordBatch, words: int) -> Iterator[pa.RecordBatch]:
    """The runs of words at given spots; `doc_id, text_hash, text, spots` come in."""
    spots = batch.column("spots")
    # A spot's number beyond all others of the texts before it.
    far = 1 << 32
    given = np.unique(np.repeat(np.arange(batch.num_rows), [len(x) for x in spots]) * far + spots.flatten().to_numpy())
    for text, spot, _, first, past, phrases, own in passages(batch, words):
        met = np.isin(text * far + spot, given)
        if met.any():
            at, own = pa.array(text[met]), own[met]
            names = [_signed(phrases.of(own, own + words, which)) for which in range(2)]
            yield _batch([batch.column("doc_id").take(at), batch.column("text_hash").take(at), first[met], past[met], *names], PASSAGES)


def repeated_words(docs: DataFrame, words: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id, text_hash, first, past`: the bytes of every run of `words` words that also
    stands somewhere else, in the same text or another. Words are what stands between
    ASCII white space, and are all that is compared.

    Equal runs of words hold the same smallest run of WORD_GRAM words at the same place.
    So these are counted first, about one for every 18 words, and of the runs of `words`
    words only those whose smallest occurs twice are counted in turn, by 128 bits."""
    bound_batches(docs.sparkSession)
    texts = docs.where(F.octet_length(F.col(text)) >= 2 * words - 1).select(*_key(docs, id, text), F.col(text).alias("text"))
    shown = materialize(texts.mapInArrow(tidied("repeats")(lambda it: (x for b in it for x in passage_spots(b, words))), SPOTS), "spots")
    counted = materialize(shown.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "names")
    given = shown.join(counted, "name", "left_semi").groupBy(*KEY).agg(F.collect_set("spot").alias("spots"))
    given = materialize(given, "given")
    discard(shown, counted)
    joined = _texts_of(texts, given, "spots")
    met = materialize(joined.mapInArrow(tidied("repeats")(lambda it: (x for b in it for x in met_passages(b, words))), PASSAGES), "passages")
    names = ["name_a", "name_b"]
    again = materialize(met.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*names), "again")
    return met.join(again, names).select(*KEY, "first", "past")


def cut_text(length: int):
    """An Arrow function from a text and the repeated suffixes in it to what is left."""

    @F.arrow_udf("struct<n_removed:bigint,n_spans:bigint,kept_sha256:string,kept:binary>")
    @tidied("repeats")
    def cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in parts:
            flat, starts = flat_bytes(texts)
            data = flat.tobytes()
            removed, spans, digests, rest = [], [], [], []
            for i, own in enumerate(ranges.to_pylist()):
                text = data[starts[i] : starts[i + 1]]
                out, done, n = [], 0, 0
                for r in sorted(own or [], key=lambda r: (r["first"], -r["last"])):
                    begin, end = r["first"], r["last"] + length
                    if n == 0 or begin > done:
                        out.append(text[done:begin])
                        n += 1
                    done = max(done, end)
                out.append(text[done:])
                left = b"".join(out)
                removed.append(len(text) - len(left))
                spans.append(n)
                digests.append(hashlib.sha256(left).hexdigest())
                rest.append(left)
            yield pa.StructArray.from_arrays(
                [pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(rest, pa.binary())],
                ["n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return cut


def whole_letters(kept: Column) -> Column:
    """Text from kept bytes; bytes of a letter that was cut are left out."""

    @F.arrow_udf("string")
    @tidied("repeats")
    def letters(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield pa.array([None if b is None else b.decode("utf-8", "ignore") for b in rows.to_pylist()], pa.string())

    return letters(kept)


def _key(docs: DataFrame, id: str, text: str) -> list[Column]:
    return [F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash")]


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def _texts_of(texts: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """The texts that a written table has a row for, with its `column`. Others are mostly
    left out before the join, so they are not shuffled."""
    known = may_be_among(found, "text_hash", found.count())
    some = texts.where(known(F.col("text_hash")))
    return some.join(found, _same(some, found)).select(some["doc_id"], some["text_hash"], "text", column)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text", gram: int = GRAM, cells: tuple[int, ...] = CELLS, words: int | None = None) -> DataFrame:
    """Add `repeats` to `docs`: `n_bytes, n_removed, n_spans, kept_sha256, kept`.

    Every byte that lies in a string of `length` bytes which also begins somewhere else,
    in the same text or another, is removed from the text's UTF-8 bytes; strings are
    judged on the input. `kept` holds the remaining bytes (no UTF-8 where a letter was
    cut). Null texts are empty; texts shorter than `length` stay whole; a row that occurs
    twice is a repeat of itself; rows without an id count as others do. Columns pass
    through; one named `repeats` is replaced. An empty table gives none.

    With `words`, the bytes of every run of so many words that also stands somewhere else
    are removed as well, however short it is (`repeated_words`).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if cells[-1] != 1 or gram > length or any(a % b for a, b in zip(cells, cells[1:], strict=False)):
        raise ValueError("cells must divide one another down to 1, and a gram fit in the length")
    if cells[0] > length:
        raise ValueError("a cell of suffixes must have a core")
    everything = written_only(lambda: _repeated_runs(docs, length, id, text, gram, cells, words), "repeated")
    kept_columns = [c for c in docs.columns if c != "repeats"]
    rows = docs.select(F.struct(*kept_columns).alias("_row"), *_key(docs, id, text))
    # Rows that have no repeated run for certain are not shuffled.
    known = may_be_among(everything, "text_hash", everything.count())(F.col("text_hash"))
    some = rows.where(known)
    whole = some.join(everything, _same(some, everything), "left").select("_row", F.coalesce("all", F.array()).alias("all"))
    own = F.col("_row")[text]
    touched = F.size("all") > 0
    size = F.coalesce(F.octet_length(own), F.lit(0)).cast("long")
    cut = cut_text(length)
    done = whole.where(touched).withColumn("_cut", cut(own, F.col("all")))
    done = done.select("_row", F.struct(size.alias("n_bytes"), "_cut.n_removed", "_cut.n_spans", "_cut.kept_sha256", "_cut.kept").alias("repeats"))
    bytes_ = F.coalesce(own, F.lit("")).cast("binary")
    untouched = whole.where(~touched).select("_row").union(rows.where(~known).select("_row")).select("_row", F.struct(
        size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(bytes_, 256).alias("kept_sha256"), bytes_.alias("kept"),
    ).alias("repeats"))
    return done.unionByName(untouched).select("_row.*", "repeats")


def _repeated_runs(docs: DataFrame, length: int, id: str, text: str, gram: int, cells: tuple[int, ...], words: int | None) -> DataFrame:
    """`doc_id, text_hash, all`: the repeated runs of every text that has any."""
    texts = docs.where(F.octet_length(F.col(text)) >= length).select(*_key(docs, id, text), F.col(text).alias("text"))
    found = texts.mapInArrow(tidied("repeats")(lambda it: (x for b in it for x in text_runs(b, length, gram, cells[0]))), RUNS)
    first = written_only(lambda: settle(materialize(found, "runs"), cells[0] == 1), "settled")
    run = F.struct("anchor", "first", "last")
    # Texts meet their open runs here and all their repeated ones at the end; in between
    # only pieces of them go on.
    opened = materialize(first.where("NOT settled").groupBy(*KEY).agg(F.collect_set(run).alias("open")), "open")
    joined = _texts_of(texts, opened, "open")
    pieces = joined.mapInArrow(tidied("repeats")(lambda it: (x for b in it for x in cut_pieces(b, length, cells[0]))), PIECES)
    settled_runs = first.where("settled").select(*KEY, run.alias("run"))
    for k in range(1, len(cells)):
        # A row that occurs twice gives its pieces twice; they count as two.
        pieces = materialize(pieces, "pieces")
        if k > 1:
            discard(coarse)
        cell = cells[k]
        finer = pieces.mapInArrow(tidied("repeats")(lambda it, cell=cell: (x for b in it for x in piece_runs(b, length, cell))), RUNS)
        now = written_only(lambda: settle(materialize(finer, "runs"), cell == 1), "settled")  # noqa: B023
        settled_runs = settled_runs.unionByName(now.where("settled").select(*KEY, run.alias("run")))
        if cell > 1:
            coarse, pieces = pieces, _finer_pieces(pieces, now.where("NOT settled"), length, cell)
        else:
            discard(pieces)
    if words is not None:
        # As runs of suffixes they end `length` bytes after the last one.
        again = repeated_words(docs, words, id, text)
        span = F.struct(F.lit(None).cast("long").alias("anchor"), "first", (F.col("past") - length).alias("last"))
        settled_runs = settled_runs.unionByName(again.select(*KEY, span.alias("run")))
    return settled_runs.groupBy(*KEY).agg(F.collect_set("run").alias("all"))


def _finer_pieces(pieces: DataFrame, opened: DataFrame, length: int, cell: int) -> DataFrame:
    """The pieces of finer open runs, cut from those of the runs that they are in."""
    p, o = pieces.alias("p"), opened.alias("o")
    inside = (F.col("p.doc_id").eqNullSafe(F.col("o.doc_id"))) & (F.col("p.text_hash") == F.col("o.text_hash")) & (F.col("p.anchor") == F.col("o.anchor"))
    inside = inside & F.col("o.first").between(F.col("p.first"), F.col("p.last"))
    top = F.col("o.anchor") - F.floor((F.col("o.anchor") - F.col("o.first")) / cell) * cell
    begin = F.greatest(F.col("p.begin"), top - cell + 1)
    piece = F.substring("p.piece", (begin - F.col("p.begin") + 1).cast("int"), (top + length - begin).cast("int"))
    return p.join(o, inside).select("o.doc_id", "o.text_hash", "o.anchor", "o.first", "o.last", begin.alias("begin"), piece.alias("piece"))
