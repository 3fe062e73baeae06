"""Counts against a plain count, and verdicts on seeded documents."""

import math
import random
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from riskloom.llm import divergence as op
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, again = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        again += line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered), failed)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def verdicts(docs):
    """`kept` of `{id: (lang, text)}` from the definitions."""
    split = {i: WORD.findall(t or "") for i, (_, t) in docs.items()}
    base = {i: plain(t) for i, (_, t) in docs.items()}

    def classes(text):
        out = []
        for pattern in op.CLASSES:
            less = regex.sub(pattern, "", text)
            out.append(len(text) - len(less))
            text = less
        return [*out, len(text)]

    def js(p, q):
        part = lambda a, m: a * math.log2(a / m) if a > 0 else 0
        return math.sqrt(max(0, sum(part(a, (a + b) / 2) + part(b, (a + b) / 2) for a, b in zip(p, q)) / 2))

    kept = {}
    for lang in {x for x, _ in docs.values()}:
        own = [i for i in docs if docs[i][0] == lang]
        seen = Counter(w for i in own if len(split[i]) >= op.REFERENCE_WORDS for w in set(split[i]) for w in [w.lower()] if len(w) <= op.LONGEST)
        common = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0].encode()))[: op.COMMON]]
        counts = {}
        for i in own:
            longest = max((len(w.encode()) for w in common), default=0)
            found = Counter(w.lower() for w in split[i] if len(w.encode()) <= longest)
            each = [found[w] for w in common]
            counts[i] = [*each, len(split[i]) - sum(each)]
        usable = [i for i in own if len(split[i]) >= op.REFERENCE_WORDS and not base[i][-1]]
        chars = {i: classes(docs[i][1] or "") for i in own}
        shares = None
        if len(usable) >= op.REFERENCE_DOCUMENTS:
            steps = [sorted(math.floor(chars[i][k] * op.STEPS / sum(chars[i]) + 0.5) for i in usable)[(len(usable) + 1) // 2 - 1] for k in range(len(op.CLASSES) + 1)]
            shares = [s / sum(steps) for s in steps]
            means = [sum(counts[i][k] / len(split[i]) for i in usable) / len(usable) for k in range(len(common) + 1)]
        for i in own:
            kept[i] = not base[i][-1]
            if shares and kept[i]:
                n = len(split[i])
                kept[i] = js([c / sum(chars[i]) for c in chars[i]], shares) <= op.CHARACTER_LIMIT[0] + op.CHARACTER_LIMIT[1] / math.sqrt(n)
                if n >= op.COMMON_WORDS_FROM:
                    kept[i] &= js([c / n for c in counts[i]], means) <= op.WORD_LIMIT[0] + op.WORD_LIMIT[1] / math.sqrt(n)
    return kept


def check(spark, docs):
    frame = spark.createDataFrame([(i, t, x, "s", 1, True) for i, (x, t) in docs.items()], "doc_id long, text string, lang string, key string, n_words int, common boolean").repartition(3)
    got = {r["doc_id"]: r for r in op.judge_documents(frame).collect()}
    assert {i: tuple(r[c] for c in COUNTS) for i, r in got.items()} == {i: plain(t) for i, (_, t) in docs.items()}
    assert {i: r["kept"] for i, r in got.items()} == verdicts(docs)
    return got


def test_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    check(spark, {r["doc_id"]: (r["lang"], r["text"]) for r in rows})


def test_cases(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice("the of and to in a is that was word some thing other more".split()) + rng.choice(["", "", ".", str(rng.randrange(9))]) for _ in range(n))
    docs = {i: ("en", prose(rng.randrange(20, 300))) for i in range(80)}
    docs |= {100: ("en", None), 101: ("en", ""), 102: ("en", " \n\t"), 103: (None, prose(40)), 104: ("rare", "$$ " * 30), 105: (None, "a b c d e f g h " * 5)}
    docs |= {200: ("en", "x" * 400_000), 201: ("en", "same line of text\n" * 40 + "\n\n"), 202: ("en", "AB!!%% " * 150), 203: ("en", "é#" * 60 + " | a < b > " * 40), 204: ("en", prose(60_000))}
    docs |= {210: ("en", "a " * 9), 211: ("en", "a " * 8), 212: ("en", " ".join(map(str, range(30))) + " " + " ".join(map(str, range(5, 15))))}
    got = check(spark, docs)
    assert got[104]["class_distance"] is None and not got[202]["kept"] and not got[203]["kept"]
    assert op.judge_documents(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    # Repeated ids and rows are judged each.
    twice = spark.createDataFrame([(1, "a b", "en")] * 2 + [(None, "c", None)], "doc_id long, text string, lang string")
    assert op.judge_documents(twice).count() == 3


def test_no_python(spark):
    plan = op.judge_documents(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_labels(spark):
    """Rules that never saw a label drop nearly all documents labelled bad, and keep the others."""
    sf = "/root/testdata/sf0.01"
    judged = op.judge_documents(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = judged.where("n_words >= 100").select("quality", F.col("kept").cast("double").alias("kept")).groupBy("quality").avg("kept").collect()
    shares = {r["quality"]: r["avg(kept)"] for r in rows}
    assert shares[1] > 0.99 and shares[0] < 0.05
