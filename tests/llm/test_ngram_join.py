"""Components against a comparison of all sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import ngram_join as op
from riskloom.llm import components as linked_components
from riskloom.llm.components import components, joined_components
from riskloom.session import materialize


def shingles(text, words):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def plain(rows, percent, words):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least[find(i)] if k is not None else None) for i, (k, _) in enumerate(rows)), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "é", "ÉA", "a b"]
    bases = [[rng.choice(words) for _ in range(rng.randrange(1, 120))] for _ in range(10)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for k in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(7)):
            i = rng.randrange(len(t))
            t[i : i + rng.randrange(2)] = [rng.choice(words)]
        if rng.random() < 0.3:
            t = [rng.choice(words) for _ in range(rng.randrange(90))] + passage
        rows.append((k * 3, rng.choice([" ", "\n", "\t\x0b", " "]).join(t)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (None, rows[0][1]), (None, "one"), (5005, rows[1][1]), (5005, rows[1][1]), (5006, rows[2][1]), (5006, rows[3][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent,words,meeting,block", [(80, 5, 2000, 1 << 20), (60, 2, 7, 1 << 20), (80, 3, 5, 40)])
def test_against_plain(spark, monkeypatch, percent, words, meeting, block):
    monkeypatch.setattr(op, "MEETING", meeting)
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "COMMON_FROM", 20)
    rows = corpus(percent + words, 90)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, node string")
    got = op.similarity_components(docs, percent, words)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, percent, words)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"word{i} Ab" for i in range(300)) + " " + "x" * 500
    whole = next(iter(op.sets_of(pa.array([text]))))[2]
    monkeypatch.setattr(op, "BLOCK", 50)
    assert np.array_equal(whole, next(iter(op.sets_of(pa.array([text]))))[2])


def test_tree_keeps_what_bounds_allow():
    rng = np.random.default_rng(2)
    n = rng.integers(20, 200, 300)
    point = np.array([rng.multinomial(k, np.full(op.GROUPS, 1 / op.GROUPS)) for k in n])
    point[150:] = np.maximum(0, point[:150] - (rng.random((150, op.GROUPS)) < 0.02))
    n = point.sum(axis=1)
    query, found = op.Tree(n, point).reach(n, point, 80)
    over = np.minimum(point[:, None, :], point[None, :, :]).sum(axis=2)
    sizes = (100 * n[None, :] >= 80 * n[:, None]) & (100 * n[:, None] >= 80 * n[None, :])
    want = set(zip(*np.nonzero(op.fits(over, n[:, None], n[None, :], 80) & sizes), strict=True))
    assert set(zip(query, found, strict=True)) == want and len(want) > 400


def test_prefix():
    for n in range(1, 300):
        assert op.prefix_size(np.array([n]), 80)[0] == n - -(-n * 80 // 100) + 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.similarity_components(docs).count() == 0
    one = spark.createDataFrame([(4, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r) for r in op.similarity_components(one).collect()] == [(4, 2, 4)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_components_in_parts(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    first, more = (spark.createDataFrame(part, "a long, b long") for part in (edges[:150], edges[150:] + [(7, 7)]))
    got = joined_components(components(first), more)
    whole = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def test_no_round_for_settled_links(spark, monkeypatch):
    written = []
    monkeypatch.setattr(linked_components, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    stars = spark.createDataFrame([(k, k // 10 * 10) for k in range(50)], "a long, b long")
    assert sorted(map(tuple, components(stars).collect())) == [(k, k // 10 * 10) for k in range(50)]
    # A round that only finds that nothing changes would write more.
    assert written == ["links"]


def test_copies_show_no_keys(spark, monkeypatch):
    """Keys that only copies of one text hold are not kept: a set shows its keys once."""
    held, write = {}, op.materialize

    def counted(df, label="table"):
        table = write(df, label)
        held[label] = table.count()
        return table

    monkeypatch.setattr(op, "materialize", counted)
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(k, texts[0]) for k in range(30)] + [(100, texts[1]), (101, texts[2])]
    found = op.similarity_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict.fromkeys(range(30), 0) | {100: 100, 101: 101}
    assert held["keys"] == 0
