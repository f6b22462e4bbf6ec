"""JSON read in splits against the whole document."""

import json
import os
import random

import pytest

from contactlake.sources import imports, stores
from contactlake.sources.json_splits import Levels, json_elements

CHARS = ["a", '"', "\\", "{", "}", "[", "]", ",", "é", "😀", "\n", " "]


def value(rng, depth=0):
    r = rng.random()
    if r < 0.4:
        return "".join(rng.choice(CHARS) for _ in range(rng.randint(0, 30)))
    if r < 0.6:
        return rng.choice([None, 7, -1.5, True])
    if depth > 2:
        return False
    if r < 0.8:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f'{i}"': value(rng, depth + 1) for i in range(rng.randint(0, 3))}


@pytest.fixture
def splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def of(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "0")

    yield of
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", ["50", "1000", "128m"])
def test_elements_equal_the_whole_document(spark, tmp_path, splits, size):
    rng, docs = random.Random(3), {}
    for i in range(6):
        docs[f"a{i}"] = [value(rng) for _ in range(i * 9)]
        docs[f"o{i}"] = {"emails": 3, "z": {"q": [1], "w": {}}, "contacts": [value(rng) for _ in range(i * 7)], "t": []}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])))
    for i, bad in enumerate(["[1,2],", "[1,2", "[1] x [2]", "plain, text", '[{"a":1]}', '["open]', "", ",", "]["]):
        (tmp_path / f"bad{i}").write_text(bad)
    splits(size)
    elements, documents = json_elements(spark, str(tmp_path), Levels((0, 1), (0, 2)))
    left = {os.path.basename(r.file): json.loads(r.text) for r in documents.collect()}
    assert left == {k: [] if k[0] == "a" else {"emails": 3, "z": {}, "contacts": [], "t": []} for k in docs}
    got = {k: [] for k in docs}
    for r in sorted(elements.collect(), key=lambda r: (r.member, r.ord)):
        name = os.path.basename(r.file)
        if name[0] == "a" or r.member == 2:
            assert r.ord == len(got[name]) and r.container == "["
            got[name].append(json.loads(r.text))
        else:
            assert r.member == 1 and r.container == "{"
    assert got == {k: d if k[0] == "a" else d["contacts"] for k, d in docs.items()}


def test_one_array_is_read_by_many_tasks(spark, tmp_path, splits):
    entries = [{"id": str(i), "type": "email", "value": f"u{i}@x.com", "note": 'a],{"'} for i in range(3_000)]
    (tmp_path / "one.json").write_text(json.dumps(entries))
    splits("8k")
    assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = stores.read_suppression(spark, str(tmp_path), multi_line=True).collect()
    assert sorted((r.id, r.value, r.note) for r in got) == sorted((e["id"], e["value"], e["note"]) for e in entries)


def test_folders_of_any_size(spark, tmp_path, splits):
    folders = [
        {"id": f"f{i}", "tags": [["x"]], "records": [{"email": f"e{j}@x.com", "socials": {"github": "{"}} for j in range(i * 40)], "name": f"n{i},"}
        for i in range(8)
    ]
    (tmp_path / "array.json").write_text(json.dumps(folders[:4], indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(f) for f in folders[4:7]))
    (tmp_path / "single.json").write_text(json.dumps(folders[7]))
    (tmp_path / "broken.json").write_text('[{"id": "no", "records": [{]')
    splits("300")
    heads, records = stores.read_folders(spark, str(tmp_path), multi_line=True)
    assert sorted((r.folder_id, r.name) for r in heads.collect()) == [(f["id"], f["name"]) for f in folders]
    want = sorted((f["id"], j, r["email"], "{") for f in folders for j, r in enumerate(f["records"]))
    assert sorted((r.folder_id, r.pos, r.email, r.socials.github) for r in records.collect()) == want


def test_import_reads_splits_and_falls_back(spark, tmp_path, splits):
    (tmp_path / "list.json").write_text(json.dumps([{"mail": f"u{i}@x.com", "name": "A, {B"} for i in range(200)]))
    (tmp_path / "object.json").write_text(json.dumps({"contacts": 1, "records": ["r@x.com", {"email": "s@x.com"}], "emails": None}))
    (tmp_path / "trailing comma.json").write_text('[{"email": "t@x.com"},]')
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "text.json").write_text("plain@x.com\n")
    splits("500")
    accepted = imports.import_contacts_json(spark, str(tmp_path)).accepted.collect()
    mails = {}
    for r in accepted:
        mails.setdefault(os.path.basename(r.file), []).append((r.line, r.email))
    assert sorted(mails["list.json"]) == [(i + 1, f"u{i}@x.com") for i in range(200)]
    assert sorted(mails["object.json"]) == [(1, "r@x.com"), (2, "s@x.com")]
    assert mails["text.json"] == [(1, "plain@x.com")]
    assert "empty.json" not in mails


def test_pieces_travel_in_chunks():
    import pyarrow as pa

    from contactlake.sources import json_splits as J

    pieces = [("f", b, b"piece%d" % i) for b in (0, 7) for i in range(20_000)]
    batches = [pa.RecordBatch.from_pylist([{"file": f, "block": b, "value": v} for f, b, v in pieces[i : i + 3000]]) for i in range(0, len(pieces), 3000)]
    rows = [r for batch in J._chunks(iter(batches)) for r in batch.to_pylist()]
    assert [(r["block"], r["number"]) for r in rows] == [(b, n) for b in (0, 7) for n in range(len(rows) // 2)]
    assert len(rows) <= 10 and max(len(r["value"]) for r in rows) < J.CHUNK + 20
    assert b"".join(r["value"] for r in rows) == b"".join(v + b"," for _, _, v in pieces)
