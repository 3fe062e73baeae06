"""Fingerprints against a plain recount."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom.llm import spot_signatures as op


def plain(text):
    """Signatures as tuples of words."""
    words = [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]
    content = [w for w in words if w not in op.ANCHORS]
    if not content:
        return {("text", text)} if text else set()
    out = {("", *content[: op.CHAIN])}
    for i, w in enumerate(words):
        rest = [x for x in words[i + 1 :] if x not in op.ANCHORS][: op.CHAIN]
        if w in op.ANCHORS and rest:
            out.add((w, *rest))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = {
    5: "The cat sat on the mat and the dog was by the old red door of a house", 9: None, 11: "", 3: "the of and", 2000: "!!! ???", 2001: "cat",
    999: "Über größe für die Straße und der Hund", 1000: "The cat sat on the mat and the dog was by the old red door of a house", -7: "é" * 30 + " la casa",
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", 1.0) for k, t in TEXTS.items()], "doc_id long, text string, signed string, near_next double")


def test_against_plain(docs, monkeypatch):
    monkeypatch.setattr(op, "RANGE", 10)
    got = {r["doc_id"]: r for r in op.fingerprint_edits(docs).collect()}
    order = sorted(TEXTS)
    assert sorted(got) == order
    for k, following in zip(order, order[1:] + order[:1], strict=True):
        text, after = TEXTS[k] or "", TEXTS[following] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = got[k]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(plain(text), plain(edited)))
        assert r["near_next"] == pytest.approx(jaccard(plain(text), plain(after)))
        assert len(r["fingerprint"].split()) == len(plain(text))
    assert got[5]["fingerprint"] == got[1000]["fingerprint"] != got[999]["fingerprint"]


def test_cases(spark):
    rows = [(None, "the cat"), (None, None), (4, "b the dog"), (4, "a the cow"), (4, "a the cow")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = op.fingerprint_edits(docs)
    assert got.count() == 5
    assert op.fingerprint_edits(docs.where("doc_id IS NULL")).count() == 2
    assert op.fingerprint_edits(docs.where("false")).count() == 0
    members, links = op.similar_sets(docs.where("false"))
    assert members.count() == links.count() == 0


def test_similar_sets(spark):
    rng = random.Random(3)
    words = op.ANCHORS[:12] + [f"w{i}" for i in range(200)]
    base = [[rng.choice(words) for _ in range(rng.randrange(5, 90))] for _ in range(12)]
    texts = {}
    for k in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts[k] = " ".join(t)
    texts |= {200: "", 201: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    members, links = op.similar_sets(docs, 0.6)
    first = {}
    for k, t in texts.items():
        first.setdefault(frozenset(plain_whole(t)), k)
    assert {r["doc_id"]: r["set_id"] for r in members.collect()} == {k: first[frozenset(plain_whole(t))] if t else None for k, t in texts.items()}
    sets = {k: s for s, k in first.items() if s}
    want = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.6}
    got = [(r["left_id"], r["right_id"]) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_no_python(docs):
    plan = op.fingerprint_edits(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert "signed" in F.col("signed")._jc.toString()


def plain_whole(text):
    """As `plain`, with the content words of stretches without common words."""
    words = [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]
    out, since = plain(text), 0
    for i, w in enumerate(words):
        since = 0 if w in op.ANCHORS else since + 1
        rest = [x for x in words[i + 1 :] if x not in op.ANCHORS][: op.CHAIN]
        if since > op.GAP and rest:
            out.add((w, *rest))
    return out


def test_without_common_words(spark):
    """Long texts with few common words or none are told apart to their end."""
    rng = random.Random(5)
    many = lambda n: " ".join(rng.choice("kivi talo meri lumi puu joki saari taivas".split()) + str(rng.randrange(99)) for _ in range(n))
    one, other = many(300), many(300)
    texts = [f"alku sana {one}", f"alku sana {other}", f"alku sana {one} loppu", f"{one} the {other}", many(9), many(10), f"the {many(12)} and {many(9)} of the", f"{many(20)} the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in op.fingerprint_edits(docs).collect()}
    for k, text in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert len(got[k]["fingerprint"].split()) == len(plain_whole(text))
        assert got[k]["near_edited"] == pytest.approx(jaccard(plain_whole(text), plain_whole(edited)))
        assert got[k]["near_next"] == pytest.approx(jaccard(plain_whole(text), plain_whole(after)))
    assert got[0]["fingerprint"] != got[1]["fingerprint"] and got[0]["near_next"] < 0.1
    assert len(got[0]["fingerprint"].split()) > 250 and 0.4 < got[0]["near_edited"] < 0.8
