"""Removed bytes against a plain count of all strings."""

import hashlib
import pathlib
import random
import re
from collections import Counter

import pytest

from riskloom import session
from riskloom.llm import repeats as op


def plain(texts, length):
    count = Counter()
    for t in texts:
        count.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abc dé"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(rng.randrange(30, 200)) for _ in range(8)]
    texts = [None, "", "abc", "ab" * 150, "a" * 333, "ab" * 90]
    for _ in range(60):
        t = make(rng.randrange(120))
        for _ in range(rng.randrange(3)):
            t += rng.choice(shared)[rng.randrange(20) :] + make(rng.randrange(60))
        texts.append(t)
    texts += [texts[10], texts[10], texts[12] + "x", "y" + texts[12]]
    for t in texts[20:30]:
        if len(t) > 50:
            i = rng.randrange(len(t))
            texts.append(t[:i] + "Z" + t[i + 1 :])
    return texts


@pytest.mark.parametrize("length,gram,cells,block", [(40, 7, (16, 4, 1), 1 << 19), (40, 7, (16, 4, 1), 100), (33, 5, (8, 1), 64), (25, 3, (1,), 1 << 19), (60, 17, (44, 11, 1), 150)])
def test_against_plain(spark, monkeypatch, length, gram, cells, block):
    monkeypatch.setattr(op, "BLOCK", block)
    # Functions that run in workers see the module as it is imported there.
    texts = corpus(length)
    docs = spark.createDataFrame([(k if k % 9 else None, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, text_hash string, first int")
    got = op.remove_repeats(docs, length, gram=gram, cells=cells).collect()
    assert got[0].__fields__ == ["doc_id", "text", "text_hash", "first", "repeats"]
    rows = sorted(((r["text"] or "").encode(), *(r["repeats"][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256"))) for r in got)
    data = [(t or "").encode() for t in texts]
    assert rows == sorted((t, *p) for t, p in zip(data, plain(data, length), strict=True))


def test_blocks_of_one_text(monkeypatch):
    """A long text in stretches has the runs of the whole."""
    import pyarrow as pa

    text = next(t for t in corpus(3) if t and len(t) > 280)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["doc_id", "text_hash", "text"])

    def covered():
        return sorted(x for b in op.text_runs(batch, 40, 7, 16) for r in b.to_pylist() if not r["settled"] for x in range(r["first"], r["last"] + 1))

    whole = covered()
    monkeypatch.setattr(op, "BLOCK", 50)
    parts = covered()
    assert parts == whole


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.remove_repeats(docs).count() == 0


def plain_words(texts, words):
    """Bytes left without runs of so many words that stand twice."""
    found = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\r\f\x0b]+", t)] for t in texts]
    runs = lambda t, w: [(tuple(t[a:b] for a, b in w[i : i + words]), w[i][0], w[i + words - 1][1]) for i in range(len(w) - words + 1)]
    count = Counter(r[0] for t, w in zip(texts, found, strict=True) for r in runs(t, w))
    out = []
    for t, w in zip(texts, found, strict=True):
        gone = [False] * len(t)
        for run, a, b in runs(t, w):
            if count[run] > 1:
                gone[a:b] = [True] * (b - a)
        out.append(bytes(x for x, g in zip(t, gone, strict=True) if not g))
    return out


def test_words_against_plain(spark):
    rng = random.Random(8)
    make = lambda n: [rng.choice(["a", "be", "sé", "word", "Ünder"]) for _ in range(n)]
    shared = [make(rng.randrange(19, 60)) for _ in range(6)]
    texts = [None, "", "a", " a\n" * 90, "x" * 500, "\t"]
    for _ in range(60):
        own = make(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            own += rng.choice(shared)[rng.randrange(4) :] + make(rng.randrange(30))
        texts.append("".join(w + rng.choice([" ", "  ", "\n"]) for w in own))
    texts += [texts[20], texts[20]]
    docs = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    # Only words decide, as no string of 5,000 bytes is here.
    got = op.remove_repeats(docs, 5000, words=20).collect()
    data = [(t or "").encode() for t in texts]
    want = plain_words(data, 20)
    assert sorted(((r["text"] or "").encode(), bytes(r["repeats"]["kept"])) for r in got) == sorted(zip(data, want, strict=True))
    assert sum(a != b for a, b in zip(data, want, strict=True)) > 20


def test_words_in_stretches(monkeypatch):
    """Texts and words longer than a block have the passages of the whole."""
    import pyarrow as pa

    rng = random.Random(9)
    texts = [" ".join("z" * rng.choice([1, 2, 3, 90]) for _ in range(n)) for n in (70, 3, 0, 45)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([5, 6, 7, 8]), pa.array(texts)], ["doc_id", "text_hash", "text"])

    def spans():
        spots = [r for b in op.passage_spots(batch, 20) for r in b.to_pylist()]
        own = [sorted({r["spot"] for r in spots if r["doc_id"] == k}) for k in (1, 2, 3, 4)]
        given = batch.append_column("spots", pa.array(own, pa.list_(pa.int64())))
        return sorted((r["doc_id"], r["first"], r["past"]) for b in op.met_passages(given, 20) for r in b.to_pylist())

    whole = spans()
    assert len(whole) == 51 + 26
    monkeypatch.setattr(op, "BLOCK", 40)
    assert spans() == whole


def test_texts_without_repeats_stay_where_they_are(spark, monkeypatch):
    """Only texts that may have repeats go through the joins, whatever a bitmap lets through the rows are the
    same, and of the tables written on the way one is left."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared = words(12)
    texts = [words(30) for _ in range(30)] + [words(5) + " " + shared + " " + words(4), shared, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    home = pathlib.Path(session.scratch_path(spark, "x").removeprefix("file:")).parent
    left = set(home.iterdir()) if home.exists() else set()
    done = op.remove_repeats(docs, 40, gram=7, cells=(16, 4, 1), words=10)
    assert [p.name.split("-")[0] for p in set(home.iterdir()) - left] == ["repeated"]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "among(text_hash" in plan
    rows = lambda df: sorted((r["doc_id"], *r["repeats"]) for r in df.collect())
    got = rows(done)
    assert [r[0] for r in got if r[2]] == [30, 31] and len(got) == 34
    monkeypatch.setattr(op, "may_be_among", lambda *_: lambda hash_: hash_.isNotNull())
    assert rows(op.remove_repeats(docs, 40, gram=7, cells=(16, 4, 1), words=10)) == got


def test_words_are_looked_at_by_the_block(monkeypatch):
    """Tables over words are no larger than those over a block of text."""
    import pyarrow as pa

    seen, whole = [], op.Phrases
    monkeypatch.setattr(op, "Phrases", lambda words: seen.append(words.shape[1]) or whole(words))
    monkeypatch.setattr(op, "BLOCK", 800)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([" ".join(str(k) for k in range(1000))])], ["doc_id", "text_hash", "text"])
    assert sum(len(own) for *_, own in op.passages(batch, 20)) == 981
    assert max(seen) <= 100 + 19
