"""Real files as sources: listings with a broken one among them, documents as bytes; ranks over ranges."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from vacantia import schemas
from vacantia.operators.sequence import ranked
from vacantia.sources import files as B
from vacantia.sources import listings as L


def test_broken_listings_are_kept_apart(spark, tmp_path):
    good = {"jobs": [{"id": 1, "title": " Data Engineer ", "absolute_url": "u"}, {"id": None, "title": "x"}]}
    for board, name, text in (("a", "1", json.dumps(good, indent=2)), ("a", "2", json.dumps(good)[:-9]), ("b", "1", json.dumps(good)), ("c", "1", "[1, 2")):
        folder = tmp_path / f"board={board}"
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.json").write_text(text)
    read, bad = L.quarantined(L.read_json(spark, str(tmp_path), schemas.LISTING_A))
    assert sorted((r.board, r.partly) for r in read.select("board", "partly").collect()) == [("a", True), ("b", False)]
    assert sorted((r.board, r.file.rsplit("/", 1)[1], r.reason) for r in bad.collect()) == [("a", "2.json", "not JSON of this kind"), ("c", "1.json", "not JSON of this kind")]
    assert sorted(r.posting_id.split(":", 1)[1] for r in L.read_listing_a(read).collect()) == ["a:1", "b:1"]


def test_files_are_addressed_by_their_bytes(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1"), ("sub/b.PDF", b"%PDF-1"), ("c.txt", bytes(range(256)))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in B.content_address(B.read_files(spark, str(tmp_path))).collect()}
    assert {n: (r.bytes, r.length) for n, r in rows.items()} == {"a.pdf": (6, 6), "b.PDF": (6, 6), "c.txt": (256, 256)}
    assert rows["a.pdf"].storage_key == rows["b.PDF"].storage_key and rows["c.txt"].sha256 == hashlib.sha256(bytes(range(256))).hexdigest()


def test_ranks_equal_row_numbers(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, n int, i int").repartition(5)
    got = {x.i: x.pos for x in ranked(df, "g", [F.col("n").desc(), F.col("i")], "pos").collect()}
    at = {}
    for g, n, i in sorted(rows, key=lambda x: (x[0] or "", -x[1], x[2])):
        at[g] = at.get(g, 0) + 1
        assert got[i] == at[g]
    assert len(got) == 3000
