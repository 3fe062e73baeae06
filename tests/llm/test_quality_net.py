"""Slopes against differences, chunks against a plain cut, and held-out accuracy."""

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import quality_net as op
from riskloom.llm.batches import flat_bytes, fold
from tests.conftest import SF


def test_chunks_cover_every_byte(monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 8)
    monkeypatch.setattr(op, "STRIDE", 5)
    for size in range(40):
        text = np.arange(size, dtype=np.uint8)
        chunks, n = op.cut(text, np.array([0, size]))
        assert len(chunks) == n[0] >= 1
        assert set(chunks[chunks < 256].tolist()) == set(range(size))
        assert size < 8 or (chunks < 256).all()


def test_long_text_in_parts(monkeypatch):
    net = op.new_net()
    text = pa.array(["ab é\n" * 1500, None, "", "x"])
    whole = op.probability(net, *flat_bytes(text))
    monkeypatch.setattr(op, "CHUNKS", 2)
    assert np.allclose(whole, op.probability(net, *flat_bytes(text)), atol=1e-5)
    assert whole[1] == whole[2]


def test_slopes():
    net = op.Net(*[p.astype(np.float64) for p in op.new_net(3).parts()])
    chunks, n = op.cut(*flat_bytes(pa.array(["one two", "three " * 200])))
    labels, weight = np.array([1.0, 0.0]), np.ones(2)

    def loss() -> float:
        p = 1 / (1 + np.exp(-op.combine(net, op.hidden(net, chunks), n)))
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean())

    slopes = op.gradients(net, chunks, n, labels, weight)
    for part, slope in zip(net.parts(), slopes, strict=True):
        for at in (0, part.size // 2):
            old = part.flat[at]
            part.flat[at] = old + 1e-5
            up = loss()
            part.flat[at] = old - 1e-5
            down = loss()
            part.flat[at] = old
            assert (up - down) / 2e-5 == pytest.approx(slope.flat[at], abs=1e-4)


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    net = op.learn(docs, labels.where(fold("doc_id", 3) != 1))
    got = op.score_quality(docs, net).join(labels, "doc_id").where(fold("doc_id", 3) == 1).toPandas()
    assert len(got) > 80 and got.score.between(0, 1).all()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert (good.values[:, None] > bad.values).mean() > 0.93


def test_cases(spark):
    docs = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (2, None, 9), (3, "", 9), (None, "x", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert op.learn(docs, labels) == 1.0
    assert op.learn(docs, labels.where("false")) == 0.5
    rows = op.score_quality(docs, op.new_net()).collect()
    assert len(rows) == 5
    assert rows[0]["score"] == rows[1]["score"] and rows[2]["score"] == rows[3]["score"]
    assert {r["predicted"] for r in op.score_quality(docs, 0.5).collect()} == {1}
    assert op.score_quality(docs.where("false"), 0.5).count() == 0


def plain_probability(net, data: bytes) -> float:
    """The network layer by layer, with loops in place of products."""
    size = len(data)
    begins = [0] if size <= op.CHUNK else [min(i * op.STRIDE, size - op.CHUNK) for i in range(-(-(size - (op.CHUNK - op.STRIDE)) // op.STRIDE))]
    layers = []
    for begin in begins:
        chunk = [data[i] if i < size else 256 for i in range(begin, begin + op.CHUNK)]
        top = [-np.inf] * op.FILTERS
        for at in range(0, op.CHUNK - op.WIDTH + 1, op.STEP):
            seen = [x for byte in chunk[at : at + op.WIDTH] for x in net.embed[byte].tolist()]
            for f in range(op.FILTERS):
                top[f] = max(top[f], sum(x * w for x, w in zip(seen, net.filters[:, f].tolist())) + float(net.bias[f]))
        active = [max(0.0, x) for x in top]
        layers.append([np.tanh(sum(x * w for x, w in zip(active, net.dense[:, h].tolist())) + float(net.dense_bias[h])) for h in range(op.HIDDEN)])
    joined = [pick(column) for pick in (max, min, lambda c: sum(c) / len(c)) for column in zip(*layers)]
    return float(1 / (1 + np.exp(-(sum(x * w for x, w in zip(joined, net.out.tolist())) + float(net.out_bias[0])))))


def test_against_plain_layers():
    net = op.new_net(5)
    texts = ["", "a", "é" * 300, "one two three\n" * 36, "x" * 512, "y" * 513, " ".join(f"w{i}" for i in range(420))]
    got = op.probability(net, *flat_bytes(pa.array(texts)))
    assert got == pytest.approx([plain_probability(net, t.encode()) for t in texts], abs=1e-5)


def test_long_labelled_texts(spark):
    """A label that only long texts have is learned from pieces; the sample is of the first by hash, and bounded."""
    long, short = "#$% <a href> " * 8000, "A plain sentence about the sea. "
    docs = spark.createDataFrame([(i, long + str(i) if i % 2 else short * (3 + i % 5)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    net = op.learn(docs, labels)
    assert isinstance(net, op.Net)
    scores = {r["doc_id"]: r["score"] for r in op.score_quality(docs.withColumn("_score", op.F.lit("x")), net).collect()}
    assert min(s for i, s in scores.items() if i % 2 == 0) > max(s for i, s in scores.items() if i % 2)
    sizes = docs.select(op.F.octet_length(op.bounded("text")).alias("n"), op.F.octet_length("text").alias("whole")).collect()
    assert all(r["n"] == r["whole"] or r["whole"] > op.TRAIN_TEXT_BYTES >= r["n"] > 0.9 * op.TRAIN_TEXT_BYTES for r in sizes)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "text", "a", "b")], "doc_id long, text string, _score string, row string")
    got = op.score_quality(docs, 0.25).first().asDict()
    assert got == {"doc_id": 1, "text": "text", "_score": "a", "row": "b", "score": 0.25, "predicted": 0}
