import random
import re
import time

import pytest

from riskloom.operators import text as t


def expected(text, size, overlap):
    """Windows by arithmetic: the k-th begins k strides in, and the last is the first to
    reach the end."""
    text = re.sub("\n\n\n+", "\n\n", text.replace("\r\n", "\n")).strip()
    stride = size - overlap
    last = max(0, -(-(len(text) - size) // stride)) if text else -1
    return [w for w in (text[k * stride : k * stride + size].strip() for k in range(last + 1)) if w]


def docs(spark, texts):
    rows = [(i, f"d{i}.md", f"d{i}", x) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "document_id long, source_file string, stem string, text string")


def sample_texts():
    rng = random.Random(4)
    words = ["ab", "ü", "漢字", "😀", "\n\n\n\n", "\r\n", " ", " ", "x" * 40]
    mixed = ["".join(rng.choice(words) for _ in range(n)) for n in [3, 40, 400, 900]]
    lengths = ["y" * n for n in [0, 1, 149, 150, 151, 849, 850, 851, 999, 1000, 1001, 1849, 1850, 1851, 5000]]
    return mixed + lengths + ["a" + " " * 4000 + "b", " \n ", "\r\n\r\n\r\n", "😀" * 1500]


@pytest.mark.parametrize("size,overlap", [(1000, 150), (50, 0), (40, 30), (7, 6)])
def test_chunks_equal_brute_force(spark, size, overlap):
    texts = sample_texts() if size > 10 else sample_texts()[:8]
    got = {}
    for r in t.chunk_documents(docs(spark, texts), size, overlap).orderBy("document_id", "chunk_index").collect():
        assert r["chunk_id"] == f"d{r['document_id']}_chunk_{r['chunk_index']:04d}"
        got.setdefault(r["document_id"], []).append(r["text"])
    for i, text in enumerate(texts):
        assert got.get(i, []) == expected(text, size, overlap), (i, len(text))


def test_chunk_numbers_over_four_digits(spark):
    last = t.chunk_documents(docs(spark, ["z" * 12_001]), 2, 1).orderBy("chunk_index", ascending=False).first()
    assert last["chunk_id"] == "d0_chunk_11999"


def test_overlap_must_be_below_size(spark):
    with pytest.raises(ValueError):
        t.chunk_documents(docs(spark, ["a"]), 10, 10)


def test_stats(spark, rows):
    table = docs(spark, ["a" * 1001, "  ", "b"])
    got = rows(t.chunk_stats(table, t.chunk_documents(table)))
    assert got == sorted([("d0.md", 1001, 2), ("d1.md", 2, 0), ("d2.md", 1, 1), (None, 1004, 3)], key=repr)


def test_work_grows_with_the_text(spark):
    """Four times the text takes about four times as long."""

    def seconds(n):
        table = docs(spark, ["lorem ipsum " * n])
        t.chunk_documents(table).count()
        began = time.perf_counter()
        for _ in range(3):
            t.chunk_documents(table).selectExpr("sum(length(text))").collect()
        return time.perf_counter() - began

    small, large = seconds(60_000), seconds(240_000)
    assert large < 10 * small
