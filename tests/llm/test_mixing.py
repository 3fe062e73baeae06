"""Mixes against a plain recount."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.llm import mixing as op

ROWS = [(k, "abcde"[min(4, k % 7)] if k % 11 else None, "w " * (k % 13)) for k in range(400)]
SCHEMA = "doc_id long, source string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def words(text):
    return len((text or "").split())


def shares():
    total = defaultdict(int)
    for _, s, t in ROWS:
        total[s] += words(t)
    return {s: n for s, n in total.items()}


def entropy_at(a):
    total = shares()
    w = [(n / sum(total.values())) ** a for n in total.values() if n]
    return -sum(x / sum(w) * math.log2(x / sum(w)) for x in w)


def sized(docs):
    return op.materialize(op.sized(docs, "doc_id", "source", op.count_words(F.col("text"))))


def test_entropy(docs):
    target = (entropy_at(0) + entropy_at(1)) / 2
    alpha = op.plan_mix(sized(docs), 5000, entropy=target).alpha
    assert entropy_at(alpha) >= target > entropy_at(alpha + 2e-6)
    assert op.plan_mix(sized(docs), 5000, entropy=99.0).alpha == 0
    assert op.plan_mix(sized(docs), 5000, entropy=0.1).alpha == 1
    assert op.plan_mix(sized(docs), 5000).alpha == 1


def test_repetition(docs):
    total = shares()
    budget = sum(total.values())

    def most(a):
        w = {s: (n / budget) ** a for s, n in total.items() if n}
        return max(w[s] / sum(w.values()) * budget / total[s] for s in w)

    limit = (most(0) + 1) / 2
    alpha = op.plan_mix(sized(docs), budget, repetition=limit).alpha
    assert most(alpha) <= limit + 1e-6 and most(alpha - 2e-6) > limit
    assert op.plan_mix(sized(docs), budget * 9, repetition=2).alpha == 1


@pytest.mark.parametrize("budget,block_rows", [(None, 10_000), (3000, 7), (900, 10_000)])
def test_realised(docs, budget, block_rows, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ROWS", block_rows)
    rows = sized(docs)
    mix = op.plan_mix(rows, budget, repetition=2.5)
    got = op.realise(rows, mix, block_tokens=50).collect()
    times = Counter((r["doc_id"], r["source"]) for r in got)
    per = {r["source"]: r for r in mix.sources.collect()}
    for s, plan in per.items():
        own = [(k, words(t)) for k, src, t in ROWS if src == s]
        key = lambda k, e: hashlib.md5(f"1|{e}|{k}".encode()).hexdigest()
        left, want = plan["rest"], set()
        for k, n in sorted(own, key=lambda r: key(r[0], plan["copies"])):
            left -= n
            if left < 0 or plan["rest"] == 0:
                break
            want.add(k)
        for k, _ in own:
            assert times[k, s] == plan["copies"] + (k in want), (s, k)
        stream = sorted((r["start"], r["n_tokens"]) for r in got if r["source"] == s and r["n_tokens"])
        assert [a for a, _ in stream[1:]] == [a + n for a, n in stream[:-1]]
        assert sum(n for _, n in stream) <= plan["budget"]
    if budget is None:
        assert min(times[k, s] for k, s, _ in ROWS) >= 1
    mixed = Counter((r["doc_id"], r["source"]) for r in op.mix_documents(docs, budget=budget, repetition=2.5).collect())
    assert mixed == +times


def test_cases(spark):
    rows = [(1, "a", None), (1, "a", None), (None, "a", "x y"), (2, None, ""), (3, "b", "x"), (3, "b", "x")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", weight int, key string")
    got = op.mix_documents(docs, repetition=3).collect()
    assert {tuple(r)[:3] for r in got} == set(rows) and len(got) >= len(rows)
    none = docs.where("false")
    assert op.mix_documents(none, repetition=3).count() == 0
    assert op.realise(sized(none), op.plan_mix(sized(none), 10, entropy=1.0)).count() == 0
    assert op.mix_documents(docs.where("text IS NULL"), entropy=1.0).count() == 2
