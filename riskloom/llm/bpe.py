"""Exact byte-level BPE by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.batches import bound_batches, kept, stamped, tidied
from riskloom.llm.pretokens import read_tokenizer, special_ids, splitter

NEVER = 1 << 40

# What a worker remembers: encoded pieces up to this length, and token pairs. Each store
# is emptied when it is full.
REMEMBERED = 200_000
LONG_PIECE = 64
PAIRS = 300_000

ROW = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Encodes pieces (bytes as Latin-1 strings) to token ids.

    For each prefix of a piece there is one token that its encoding ends with: the token
    that matches there, and that can stand beside the last token of the prefix before
    it. A pair can stand if the merges, run over the two tokens side by side, never cross
    the border; for that the growth of the left token's right edge and of the right
    token's left edge is followed by rank.
    """

    def __init__(self, text: str):
        import ahocorasick

        spec = json.loads(text)
        letters = byte_letters()
        self.special = special_ids(text)
        self.ids = {"".join(chr(letters[c]) for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.bytes = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for word, i in self.ids.items():
            self.bytes[i] = word.encode("latin-1")
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (pair.split(" ") if isinstance(pair, str) else pair)
            left, right = ("".join(chr(letters[c]) for c in x) for x in (left, right))
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = rank
            made.setdefault(whole, (a, b, rank))
        # Tokens along an edge from the byte up, each with the rank of its next merge.
        self.right_edge, self.left_edge = self._edges(made, 1), self._edges(made, 0)
        self.matches = ahocorasick.Automaton()
        for word, i in self.ids.items():
            if i in made or len(word) == 1:
                self.matches.add_word(word, (i, len(word)))
        self.matches.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _edges(self, made: dict[int, tuple[int, int, int]], side: int) -> dict[int, list[tuple[int, int]]]:
        out: dict[int, list[tuple[int, int]]] = {}
        for token in [i for i in self.ids.values() if i not in made]:
            out[token] = [(token, NEVER)]
        for token, (*children, rank) in sorted(made.items(), key=lambda x: x[1][2]):
            below = out[children[side]]
            out[token] = [*below[:-1], (below[-1][0], rank), (token, NEVER)]
        return out

    def can_stand(self, left: int, right: int) -> bool:
        a, b, i, j = self.right_edge[left], self.left_edge[right], 0, 0
        while True:
            (x, next_x), (y, next_y) = a[i], b[j]
            rank = self.rank.get((x, y), NEVER)
            # At equal rank the merge further left comes first.
            if rank < next_x and rank <= next_y and rank != NEVER:
                return False
            if next_x == next_y == NEVER:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: str) -> list[int]:
        last = [-1] * len(piece)
        length = [0] * len(piece)
        pairs = self.pairs
        for end, (token, size) in self.matches.iter(piece):
            if last[end] >= 0:
                continue
            start = end - size
            if start >= 0:
                key = last[start] << 20 | token
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.can_stand(last[start], token)
                if not fits:
                    continue
            last[end], length[end] = token, size
        out, end = [], len(piece) - 1
        while end >= 0:
            out.append(last[end])
            end -= length[end]
        if len(pairs) > PAIRS:
            pairs.clear()
        return out[::-1]

    def packed(self, piece: str) -> bytes:
        """Ids of one piece, four bytes each, lowest first."""
        ids = array("I", self.encode_piece(piece.encode().decode("latin-1"))).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def encode(self, doc: str, parts: Callable) -> bytes:
        out: list[bytes] = []
        for mark, pieces in parts(doc):
            if mark:
                out.append(self.special[mark].to_bytes(4, "little"))
                continue
            found = list(map(self.known.get, pieces))
            if None in found:
                found = [self.packed(p) if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
            out.append(b"".join(found))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def encoder(text: str) -> Encoder:
    return kept("bpe", text, lambda: Encoder(text))


def encode_documents(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of every whole text: `id, n_tokens, ids` with ids as an array of ints.

    A row for each row of `docs`, other columns ignored. Null and empty texts have an
    empty array; a null id stays null; repeated rows are encoded each; an empty table
    gives none. Strings of special tokens inside texts become those tokens.
    """
    bound_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    @F.arrow_udf("array<int>")
    @tidied("bpe")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, parts = encoder(table.value), splitter(table.value)
        for texts in batches:
            packed = [model.encode(doc, parts) for doc in stamped(texts)]
            offsets = [0]
            for x in packed:
                offsets.append(offsets[-1] + len(x) // 4)
            flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return docs.select(F.col(id).alias("doc_id"), ids(text).alias("ids")).select(
        F.col("doc_id").alias(id), F.size("ids").cast("long").alias("n_tokens"), "ids"
    )


def decode_ids(encoded: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`id, text` from arrays of ids; special tokens are kept. Null arrays give null;
    bytes that are no UTF-8 become U+FFFD, as in the library."""
    bound_batches(encoded.sparkSession)
    table = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    @F.arrow_udf("string")
    @tidied("bpe")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encoder(table.value)
        for rows in batches:
            yield pa.array([None if r is None else model.decode(array("I", r).tobytes()) for r in rows.to_pylist()], pa.string())

    return encoded.select(F.col(id).alias("doc_id"), text(ids).alias("text")).withColumnRenamed("doc_id", id)


def round_trip(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode the ids, and give digests of both:
    `id, n_tokens, ids_sha256, decoded_sha256`. Cases as in `encode_documents`; ids and
    decoded texts stay within the task that made them."""
    bound_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    @F.arrow_udf(ROW)
    @tidied("bpe")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, parts = encoder(table.value), splitter(table.value)
        for texts in batches:
            counts, encoded, decoded = [], [], []
            for doc in stamped(texts):
                ids = model.encode(doc, parts)
                counts.append(len(ids) // 4)
                encoded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id).alias("doc_id"), digests(text).alias("row")).select(F.col("doc_id").alias(id), "row.*")
