"""Every stage against a plain recount over what the one before kept."""

import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from riskloom.session import materialize
from tests.conftest import SF
from tests.llm.test_ngram_join import plain as components


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in pipeline.STAGES:
        out.append((name, materialize(stage(spark, out[-1][1], SF))))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in stages] == ["documents", "quality", "near_duplicates", "repeated_passages", "mix", "encode"]
    for _, df in stages[:-1]:
        assert df.columns == stages[0][1].columns


def test_quality(spark, stages):
    before, after = rows(stages[0][1]), rows(stages[1][1])
    assert all(before[k] == r for k, r in after.items()) and len(after) < len(before)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [k for k in before if labels.get(k) == 1]
    bad = [k for k in before if labels.get(k) == 0]
    assert sum(k in after for k in good) >= 0.97 * len(good)
    assert sum(k not in after for k in bad) >= 0.7 * len(bad)


def test_near_duplicates(stages):
    before, after = rows(stages[1][1]), rows(stages[2][1])
    groups = components([(k, r["text"]) for k, r in before.items()], 80, 5)
    assert set(after) == {k for k, _, c in groups if k == c}
    assert all(before[k] == r for k, r in after.items())


def passages(texts, length, words):
    """Of each text the bytes that lie in a string of `length` bytes, or in a run of `words`
    words, which stands somewhere else too."""
    seen, spans = Counter(), []
    for data in texts:
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        own = [(i, i + length, data[i : i + length]) for i in range(len(data) - length + 1)]
        own += [(at[i][0], at[i + words - 1][1], tuple(data[a:b] for a, b in at[i : i + words])) for i in range(len(at) - words + 1)]
        seen.update(hash(x) for _, _, x in own)
        spans.append([(a, b, hash(x)) for a, b, x in own])
    out = []
    for data, own in zip(texts, spans, strict=True):
        covered = bytearray(len(data))
        for a, b, x in own:
            if seen[x] > 1:
                covered[a:b] = b"\x01" * (b - a)
        out.append(bytes(c for c, gone in zip(data, covered, strict=True) if not gone))
    return out


def test_repeated_passages(stages):
    before, after = rows(stages[2][1]), rows(stages[3][1])
    assert set(before) == set(after)
    order = sorted(before)
    texts = [before[k]["text"].encode() for k in order]
    for k, data, left in zip(order, texts, passages(texts, 400, pipeline.PASSAGE_WORDS), strict=True):
        assert after[k]["text"] == left.decode("utf-8", "ignore")
        assert after[k]["n_chars"] == (len(after[k]["text"]) if left != data else before[k]["n_chars"])


def test_mix_and_encode(stages):
    before = rows(stages[3][1])
    mixed = stages[4][1].collect()
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) == set(before) and max(times.values()) <= 2
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = stages[5][1].collect()
    assert Counter(r["doc_id"] for r in encoded) == times
    for r in encoded[::20]:
        assert r["ids"] == library.encode(before[r["doc_id"]]["text"], add_special_tokens=False).ids


def test_odd_documents(spark):
    docs = spark.createDataFrame(
        [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a " * 900, None, None, 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for table in (docs, docs.where("false")):
        for _, stage in pipeline.STAGES[1:]:
            table = materialize(stage(spark, table, SF))
    assert table.count() == 0
    assert pipeline.quality(spark, docs.where("false"), SF).count() == 0


def test_short_passages(spark):
    """A passage of 51 words and about 300 bytes goes, one of 50 words stays."""
    own = lambda k, n: " ".join(f"own{k}x{i}" for i in range(n))
    passage, short = (" ".join(f"{x}{i:04d}" for i in range(n)) for x, n in (("p", 51), ("s", 50)))
    assert len(passage) == 305
    texts = {k: f"{own(k, 30)} {p} {own(k + 10, 30)}" for k, p in enumerate([passage, passage, short, short])}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    after = rows(pipeline.repeated_passages(spark, docs, SF))
    for k in (0, 1):
        assert after[k]["text"] == f"{own(k, 30)}  {own(k + 10, 30)}"
        assert after[k]["n_chars"] == len(after[k]["text"])
    assert all(after[k]["text"] == texts[k] for k in (2, 3))


def test_quality_rejects_predicted(spark, monkeypatch):
    """Scores from 0.2 to 0.5 go too."""
    def scored(docs, net):
        return docs.withColumn("score", pipeline.F.col("text").cast("double")).withColumn("predicted", (pipeline.F.col("score") >= 0.5).cast("int"))

    monkeypatch.setattr(pipeline.quality_net, "learn", lambda *a: 0.5)
    monkeypatch.setattr(pipeline.quality_net, "score_quality", scored)
    docs = spark.createDataFrame([(k, t, "en", "s", 3) for k, t in enumerate(["0.1", "0.3", "0.49", "0.5", "0.9"])], "doc_id long, text string, lang string, source string, n_chars long")
    assert set(rows(pipeline.quality(spark, docs, SF))) == {3, 4}


def test_repeated_ids(spark):
    """Of rows with one id only the copy goes, and of equal ones all but one."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    texts = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, a), (4, None), (4, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 3) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (2, b), (3, c), (None, a), (None, a), (4, None)], key=repr)
