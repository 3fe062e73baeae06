"""Repairs against a search of all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from riskloom.llm import repair as op
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0)) for c, r in out.items()}


def plain(rows):
    """Dijkstra over (cost, audit) from the front; audits of one cost in ASCII order."""
    seen, faults = set(), []
    for _, role, text in rows:
        found = WORD.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, left = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        if cost <= 5 * len(rows) + 20:
            for name in ("user", "assistant"):
                if to := follow.get((state, name[0])):
                    heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*left, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, left))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if to := follow.get((state, role[:1])):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*left, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if to := follow.get((state, name[0])):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, to, (*left, f"{name}:{text}")))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def check(spark, rows, **settings):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in op.repair_conversations(frame, **settings).collect()}
    assert got == {c: plain(r) for c, r in damage(rows).items()}
    return got


def made(seed, convs, turns):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(turns)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown"])
            text = rng.choice(["One.", "Two!", "cut off", "", None, f"Row {t}?", f"Row {t}. ", " \n", f"long {t}", "é…?"])
            rows.append((c, t * rng.choice([1, 1, 2]) if rng.random() < 0.97 else t, role, text))
    # One row for each turn: the order of rows in a turn is open.
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


@pytest.mark.parametrize("first,range_rows", [(32, None), (1, 40), (2, 7)])
def test_all_edits(spark, monkeypatch, first, range_rows):
    monkeypatch.setattr(op, "FIRST", first)
    check(spark, made(first, 40, 30), range_rows=range_rows)


def test_long_stretches(spark, monkeypatch):
    """Chunks that pass on any shape, and a text that fills a conversation."""
    monkeypatch.setattr(op, "FIRST", 1)
    rows = [(1, t, "user", "The same.") for t in range(150)] + [(2, t, "assistant", "") for t in range(60)]
    rows += [(3, t, "user" if t % 2 else "system", f"cut {t}") for t in range(90)] + [(4, t, "system", f"Whole {t}.") for t in range(90)]
    check(spark, rows, range_rows=25)


def test_cases(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = check(spark, [(dropped, 0, "user", "Gone."), (None, None, None, None), (None, 3, "user", "Here."), (7, None, "system", "x."), (7, 2, "user", "y" * 300_000 + ".")])
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op.repair_conversations(none).count() == 0


def test_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in op.repair_conversations(table).collect()}
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert got == {c: plain(r) for c, r in damage(rows).items()}


def test_rerun_stops():
    """Two runs meet where rows settle what follows, and the correction is a constant."""
    rng = random.Random(2)
    rows = bytes(rng.choice([0, 1, 2, 1, 2, 1, 2, 5, 9, 10]) for _ in range(2000))
    for after in [(0, 5, 5, 0), (3, 0, 0, 4), (0, 10, 5, 0)]:
        came_to, cost = op.backward(rows, op.END)
        shape, change, n = op.rerun(rows, op.END, after, came_to)
        assert (shape, cost + change) == op.backward(rows, after) and n < 100
