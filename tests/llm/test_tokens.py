"""Counts, ids and decoded texts against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import bpe, token_counts
from riskloom.llm.pretokens import read_tokenizer, splitter

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n\n  x", "don't  stop 'sure' I'LL", "a<|endoftext|>b <|endoftext|>", "<|endoftext|", "aaa" * 50 + "!!!" * 31,
    "Éreux größe 東京 🙂 naïve", "x y z　\u0085\x1c\x1d\x1f q", "1234 ½ ²³ ٣", "\t\t\tif (x): \r\n   return", "é ‍ ﻿",
    "word " * 3000, "word " * 3000, "\0 a\0b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    # Columns that operators don't know, with the names of their results.
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "id is null", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")


def test_counts(docs, library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, PATH).collect()}
    assert len(got) == len(TEXTS) + 1
    for k, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (n, len((t or "").encode()), n > 512), t


def test_round_trip(docs, library):
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, PATH).collect()}
    encoded = bpe.encode_documents(docs, PATH)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    texts = {r["doc_id"]: r["text"] for r in bpe.decode_ids(encoded, PATH).collect()}
    for k, t in enumerate(TEXTS):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[k] == want, t
        assert texts[k] == library.decode(want, skip_special_tokens=False)
        assert got[k]["n_tokens"] == len(want)
        assert got[k]["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(texts[k].encode()).hexdigest()


def test_empty_table(docs):
    none = docs.where("false")
    assert token_counts.count_tokens(none, PATH).count() == 0
    assert bpe.round_trip(none, PATH).count() == 0


def test_every_token_encodes_to_itself():
    model = bpe.encoder(read_tokenizer(PATH))
    assert [i for w, i in model.ids.items() if model.encode_piece(w) != [i]] == []


def test_long_text_step_by_step(library, monkeypatch):
    monkeypatch.setattr("riskloom.llm.pretokens.LONG_TEXT", 10)
    monkeypatch.setattr("riskloom.llm.pretokens.STEP", 3)
    text = read_tokenizer(PATH)
    doc = "one two  three<|endoftext|> four five\n\n six"
    pieces = [x for mark, found in splitter(text)(doc) for x in ([mark] if mark else found)]
    assert "".join(pieces) == doc


def test_random_text(library):
    import random

    rng = random.Random(5)
    letters = "aeioutnsrhl  \n\t'.,!é中1٣  \u001c🙂"
    model, parts = bpe.encoder(read_tokenizer(PATH)), splitter(read_tokenizer(PATH))
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        want = b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids)
        assert model.encode(t, parts) == want, repr(t)
