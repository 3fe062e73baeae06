import datetime
import hashlib

import pytest

from riskloom.fixed import RAW_COLUMNS
from riskloom.sources import documents, manifest, stores, tables


def test_csv_by_name_with_missing_tokens(spark, tmp_path):
    header = list(reversed(RAW_COLUMNS)) + ["extra"]
    values = dict.fromkeys(RAW_COLUMNS, "None") | {"policy_id": "POL1", "insured_age": "old", "claim_amount": "8161.36", "insured_hobbies": 'a "b", c'}
    line = ",".join('"' + values.get(c, "x").replace('"', '""') + '"' for c in header)
    (tmp_path / "claims.csv").write_text(",".join(header) + "\n" + line + "\n")
    row = tables.read_claims(spark, str(tmp_path), "csv").first()
    assert row.__fields__ == RAW_COLUMNS
    assert (row["policy_id"], row["claim_amount"], row["insured_hobbies"]) == ("POL1", 8161.36, 'a "b", c')
    assert row["authorities_contacted"] is None and row["insured_age"] is None
    text = tables.read_claims(spark, str(tmp_path), "csv", as_text=True)
    assert "extra" in text.columns and text.first()["insured_age"] == "old"
    with pytest.raises(ValueError):
        tables.read_claims(spark, str(tmp_path), "xml")


def test_csv_table_with_dates(spark, tmp_path):
    df = spark.createDataFrame([("a", datetime.date(2024, 1, 2), True, None)], "k string, d date, b boolean, x double")
    tables.write_table(df, str(tmp_path / "t"), "csv")
    assert tables.read_table(spark, str(tmp_path / "t"), df.schema, "csv").collect() == df.collect()


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "x", "n": 1}\n\n  \n{"k": "y", "n": null}\n')
    got = tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k string, n long")
    assert sorted(tuple(r) for r in got.where("k is not null").collect()) == [("x", 1), ("y", None)]
    tables.write_jsonl(got.where("k is not null"), str(tmp_path / "out"))
    lines = [line for f in (tmp_path / "out").glob("*.json") for line in f.read_text().splitlines()]
    assert sorted(lines) == ['{"k":"x","n":1}', '{"k":"y","n":null}']


def test_documents(spark, tmp_path):
    for name, text in [("b.md", "two\n\nlines"), ("a.b.md", "é"), ("c.txt", "not read")]:
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = documents.read_documents(spark, str(tmp_path)).orderBy("document_id").collect()
    assert [tuple(r) for r in got] == [(0, "a.b.md", "a.b", "é"), (1, "b.md", "b", "two\n\nlines")]


def test_digests(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one")
    one = manifest.combined_digest(manifest.file_digests(spark, str(tmp_path))).first()["sha256"]
    assert one == hashlib.sha256(b"one").hexdigest()
    (tmp_path / "b").write_bytes(b"two")
    two = manifest.combined_digest(manifest.file_digests(spark, str(tmp_path))).first()["sha256"]
    assert two not in (one, hashlib.sha256(b"two").hexdigest()) and len(two) == 64


def test_digest_of_a_large_file(spark, tmp_path):
    """A sparse file over 2 GB, in blocks; and a small one in blocks of a few bytes."""
    with open(tmp_path / "large", "wb") as file:
        file.truncate((2 << 30) + 5)
        file.seek(1 << 30)
        file.write(b"here")
    zeros = bytes(1 << 22)

    def block(first, n):
        digest, left = hashlib.sha256(first), n - len(first)
        while left:
            digest.update(zeros[: min(left, len(zeros))])
            left -= min(left, len(zeros))
        return digest.hexdigest()

    row = manifest.file_digests(spark, str(tmp_path / "large")).first()
    want = hashlib.sha256("\n".join([block(b"", 1 << 30), block(b"here", 1 << 30), block(b"", 5)]).encode()).hexdigest()
    assert (row["file"], row["length"], row["sha256"]) == ("large", (2 << 30) + 5, want)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "e").mkdir()
    for name, data in (("small", b"abcdefg"), ("none", b""), ("_hidden", b"x"), ("e/none", b"")):
        (tmp_path / "d" / name).write_bytes(data)
    found = manifest.file_digests(spark, f"file://{tmp_path}/d", 3).collect()
    got = {r["file"]: r["sha256"] for r in found}
    assert len(found) == 3
    parts = "\n".join(hashlib.sha256(x).hexdigest() for x in (b"abc", b"def", b"g"))
    assert got == {"small": hashlib.sha256(parts.encode()).hexdigest(), "none": hashlib.sha256(b"").hexdigest()}
    with pytest.raises(Exception, match="missing"):
        manifest.file_digests(spark, str(tmp_path / "missing")).collect()


def test_graph_store_is_replaced(spark, tmp_path, rows):
    """A reader of the version before sees it whole; older versions go."""
    path = str(tmp_path / "g")
    with pytest.raises(FileNotFoundError):
        stores.read_graph(spark, path)
    edges = spark.createDataFrame([("p", "c", "HAS_CLAIM")], "src string, dst string, rel_type string")
    versions, before = [], None
    for n in range(3):
        nodes = {"Claim": spark.createDataFrame([("c", float(n))], "node_id string, amount double"), "Policy": spark.createDataFrame([("p",)], "node_id string")}
        if n == 2:
            nodes.pop("Policy")
        versions.append(stores.write_graph(nodes, edges, path))
        if before is not None:
            assert rows(before.nodes["Claim"]) == [("c", float(n - 1))] and rows(before.nodes["Policy"]) == [("p",)]
        before = stores.read_graph(spark, path)
        assert before.version == versions[-1] and rows(before.nodes["Claim"]) == [("c", float(n))]
    assert list(before.nodes) == ["Claim"] and before.edges.count() == 1 and before.all_nodes().count() == 1
    assert sorted(p.name for p in (tmp_path / "g" / "versions").iterdir()) == sorted(versions[1:])


def test_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "x", "n": 1}\n{"k": "cut\n\n[1]\n{"k": "z", "n": "word"}\n{"n": 2}\n')
    sound, broken = tables.read_sound_lines(spark, str(tmp_path), "k string, n long")
    assert sorted((tuple(r) for r in sound.collect()), key=repr) == [("x", 1), (None, 2)]
    assert sorted((r["file"], r["line"]) for r in broken.collect()) == [("a.jsonl", x) for x in ['[1]', '{"k": "cut', '{"k": "z", "n": "word"}']]
    read = tables.read_jsonl(spark, str(tmp_path), "k string, n long")
    for use in (read.count, read.select("k").collect):
        with pytest.raises(Exception, match="broken line in a.jsonl"):
            use()


def test_collection(spark, tmp_path):
    texts = [("b.md", "two"), ("a/b:c.md", "é\n"), ("b.md", "two"), ("b.md", None), ("ü", "")]
    documents.write_collection(spark.createDataFrame(texts, "source_file string, text string").repartition(3), str(tmp_path / "c"))
    got = documents.read_collection(spark, str(tmp_path / "c")).orderBy("document_id").collect()
    assert [r["document_id"] for r in got] == [0, 1, 2, 3, 4] and [r["source_file"] for r in got] == ["a/b:c.md", "b.md", "b.md", "b.md", "ü"]
    assert sorted((r["source_file"], r["text"]) for r in got if r["text"] is not None) == sorted((n, t) for n, t in texts if t is not None)
    assert got[0]["stem"] == "a/b:c" and got[4]["stem"] == "ü"
