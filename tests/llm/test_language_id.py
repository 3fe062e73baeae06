"""Code lengths against a plain recursion, and held-out accuracy."""

from collections import Counter
from math import log2

import numpy as np
import pyarrow as pa

from riskloom.llm import language_id as op
from riskloom.llm.batches import fold
from tests.conftest import SF


def slow_bits(train: list[bytes], doc: bytes) -> float:
    """Prediction by partial matching with exclusion, byte by byte."""
    seen: dict[bytes, Counter] = {}
    for t in train:
        padded = bytes([op.PAD]) * op.ORDER + t
        for i in range(op.ORDER, len(padded)):
            for k in range(op.ORDER + 1):
                seen.setdefault(padded[i - k : i], Counter())[padded[i]] += 1

    def p(context: bytes, byte: int) -> float:
        counts = seen.get(context)
        shorter = (lambda b: p(context[1:], b)) if context else (lambda b: 1 / 256)
        if counts is None:
            return shorter(byte)
        n, d = sum(counts.values()), len(counts)
        if byte in counts:
            return counts[byte] / (n + d)
        return d / (n + d) * shorter(byte) / (1 - sum(map(shorter, counts)))

    padded = bytes([op.PAD]) * op.ORDER + doc
    return sum(-log2(p(padded[i - op.ORDER : i], padded[i])) for i in range(op.ORDER, len(padded)))


def counted(train: list[str]):
    out = []
    for g in op.grams(*op.flat_bytes(pa.array(train))):
        out.append(np.unique(g, return_counts=True))
    return [(v.astype(np.int64), n) for v, n in out]


def test_code_lengths(monkeypatch):
    train = {"a": ["abracadabra", "cab\nbad", "ab"], "b": ["zebra zone", "", "éa zz"]}
    model = op.build_model({k: counted(v) for k, v in train.items()})
    docs = ["abra", "", "zebra", None, "ééé x", "a", "abracadabra zebra cab éa\n\n!" * 3]
    for block in (1 << 20, 7):
        monkeypatch.setattr(op, "BLOCK", block)
        got = op.code_lengths(model, pa.array(docs))
        for i, d in enumerate(docs):
            for j, lang in enumerate("ab"):
                want = slow_bits([t.encode() for t in train[lang]], (d or "").encode())
                assert abs(got[i, j] - want) < 1e-3 * (1 + want), (d, lang)


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.withColumn("held_out", fold("doc_id", 4) == 2)
    model = op.learn(rows.where("not held_out"))
    judged = op.identify(rows.where("held_out"), model).toPandas()
    assert len(judged) > 20
    assert (judged.lang == judged.lang_pred).mean() > 0.95
    assert judged.score.between(0, 1).all()


def test_cases(spark):
    rows = [(1, "the cat", "en"), (2, "the hat", "en"), (3, "die Katze", "de"), (3, "die Katze", "de"), (4, None, "en"), (5, "", "de"), (6, "12 !?", "de"), (None, "the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", op.F.lit("x")).withColumn("k", op.F.lit(1))
    model = op.learn(docs)
    got = [(r["doc_id"], r["lang_pred"]) for r in op.identify(docs, model).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "en"), (2, "en"), (3, "de"), (3, "de"), (4, "und"), (5, "und"), (6, "und"), (None, "en")], key=str
    )
    assert op.learn(docs.where("false")) is None
    assert {r["lang_pred"] for r in op.identify(docs, None).collect()} == {"und"}
    assert op.identify(docs.where("false"), model).count() == 0


def test_rare_languages(spark):
    """A language with one huge text is learned, from pieces; copies count once."""
    rng = np.random.default_rng(4)
    words = {"en": "the cat sat on a mat and saw his dog".split(), "fi": "kissa istui matolla ja koira juoksi".split()}
    make = lambda lang, n: " ".join(rng.choice(words[lang], n))
    copied = make("en", 60)
    rows = [(make("en", 60), "en") for _ in range(200)] + [(copied, "en")] * 300 + [(make("fi", 300_000), "fi")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    drawn = op.draw(docs, 4000).collect()
    own = {k: [r["text"] for r in drawn if r["lang"] == k] for k in words}
    assert len(set(own["en"])) == len(own["en"]) and 4000 <= sum(len(t) for t in own["en"]) < 8000
    assert len(own["fi"]) == op.PIECES and 3900 <= sum(len(t) for t in own["fi"]) <= 4000
    assert all(t in rows[-1][0] for t in own["fi"])
    everything = op.draw(docs, 10**9).collect()
    assert sorted(map(tuple, everything)) == sorted((k, t) for t, k in set(rows))
    model = op.learn(docs, train_bytes=4000)
    assert model.languages == ["en", "fi"]
    tests = spark.createDataFrame([(make(k, 20), k) for k in words for _ in range(5)], "text string, lang string")
    assert op.identify(tests, model).where("lang = lang_pred").count() == 10


def test_letters_and_names(spark):
    """Numbers that look like letters are none; columns of any name pass through."""
    texts = ["½ ² ①", "12 _", "word", "ß", ""]
    docs = spark.createDataFrame([(i, t, "own", "kept") for i, t in enumerate(texts)], "doc_id long, text string, _judged string, row string")
    model = op.learn(spark.createDataFrame([("some words of a text " * 20, "en")], "text string, lang string"))
    got = {r["doc_id"]: r for r in op.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["und", "und", "en", "en", "und"]
    assert got[2]["_judged"] == "own" and got[2]["row"] == "kept"
