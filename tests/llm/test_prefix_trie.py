"""The trie against one of dictionaries."""

import hashlib
import math
import random
import re
import zlib

import pytest

from riskloom.llm import prefix_trie as op
from tests.conftest import SF


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, x) for _, r, x in sorted(t, key=lambda t: t[0])] for c, t in convs.items()}
    members, ends = {(): []}, {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        whole = turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = children.get(node, [])
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in below)
        leaves[node] = sum(leaves[c] for c in below) or 1
    if not turns:
        return []
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest())
        for n, m in members.items()
    )


def check(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int").repartition(3)
    got = sorted(tuple(r) for r in op.prefix_trie(frame, **settings).collect())
    assert got == plain(rows)


def made(seed, convs, texts, longest):
    rng = random.Random(seed)
    rows, kept = [], []
    for c in rng.sample(range(-40, 300), convs):
        own = [(rng.choice(["user", "assistant", None]), rng.choice(texts)) for _ in range(rng.randrange(1, longest))]
        if kept and rng.random() < 0.4:
            base = rng.choice(kept)
            own = base[: rng.randrange(len(base) + 1)] + own[: rng.randrange(len(own) + 1)] or base
        kept.append(own)
        rows += [(c, None if t == 0 and rng.random() < 0.1 else t, r, x) for t, (r, x) in enumerate(own)]
    return rows


TEXTS = ["", None, "one two", "one  two", " a\tb\nc ", "ü", "x" * 5000] + [f"w{i} v" for i in range(5)]


@pytest.mark.parametrize("cells,range_rows", [(8, None), (8, 30), (0, 11)])
def test_all_nodes(spark, monkeypatch, cells, range_rows):
    """With room in the sketch, with conversations over several ranges, and with a sketch so crowded that
    it proves little."""
    monkeypatch.setattr(op, "CELLS", max(cells, 1))
    monkeypatch.setattr(op, "LEAST", 1 << 16 if cells else 16)
    monkeypatch.setattr(op, "MOST", 1 << 27 if cells else 16)
    monkeypatch.setattr(op, "JOINED", 10)
    check(spark, made(cells + (range_rows or 0), 120, TEXTS, 7), range_rows=range_rows)


def test_copies_and_long(spark):
    """Hundreds of copies of one conversation, and one far longer than a range."""
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    rows += [(1001, t, "user", f"turn {t}") for t in range(400)] + [(1002, t, "user", f"turn {t}" if t < 350 else "else") for t in range(400)]
    check(spark, rows, range_rows=60)


def test_cases(spark):
    check(spark, [(5, 0, "user", "alone")])
    check(spark, [(None, 0, "user", "left out"), (7, 1, None, None), (7, 1, None, None), (-3, None, "", "x")])
    check(spark, [])


def test_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert sorted(tuple(r) for r in op.prefix_trie(table).collect()) == plain([tuple(r) for r in table.collect()])


def test_screening(spark):
    """Most prefixes of one conversation alone are proven, none that is shared."""
    rows = [(c, t, "user", f"{c} {t}" if t else "first") for c in range(200) for t in range(5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own, _ = op.rebuilt(op.turns(frame))
    seen = op.screened(op.prefixes(own))
    shared = seen.groupBy("x", "y").count().where("count > 1")
    assert seen.where("tail").join(shared, ["x", "y"]).count() == 0
    assert seen.where("NOT tail").count() <= shared.agg({"count": "sum"}).first()[0] + 20
