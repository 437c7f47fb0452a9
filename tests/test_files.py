import hashlib

import numpy as np
import pytest

from caseforge.sources import files


def test_cases_round_trip(spark, tmp_path):
    rows = [(f"PT-{k}", "s.json", f'{{"age": {k}}}') for k in range(23)] + [(f"PT-{k}", "d.json", '"yes"' if k % 2 else None) for k in range(23)] + [("PT-3", "r.json", "{broken"), ("PT-4", "r.json", "")]
    root = f"{tmp_path}/cases"
    assert files.write_cases(spark.createDataFrame(rows, "case_id string, file string, text string").repartition(3), root) == 23 + 11 + 2
    (tmp_path / "cases" / "stray.txt").write_text("no case")
    (tmp_path / "cases" / "PT-empty").mkdir()
    for each in (500, 4):
        c = files.cases(spark, f"file://{root}", ["s.json", "d.json"], each)
        assert c.rdd.getNumPartitions() == (1 if each == 500 else 6)
        got = {(r.case_id, r.file): r.text for r in c.collect()}
        assert len(got) == 48 and got["PT-5", "d.json"] == '"yes"' and got["PT-6", "d.json"] is None and got["PT-empty", "s.json"] is None
    t = {r.case_id: r for r in files.case_table(spark, root, {"s": ("s.json", "age int"), "d": ("d.json", "string"), "r": ("r.json", "x int")}).collect()}
    assert t["PT-7"].s.age == 7 and t["PT-7"].d == "yes" and t["PT-8"].d is None and (t["PT-3"].r is None or t["PT-3"].r.x is None) and t["PT-empty"].s is None
    assert files.cases(spark, f"{tmp_path}/nowhere", ["s.json"]).count() == 0


def test_manifest_hashes_in_pieces(spark, tmp_path, monkeypatch):
    big = bytes(range(256)) * 9000
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "big.bin").write_bytes(big)
    (tmp_path / "a" / "b" / "empty").write_bytes(b"")
    m = {r.path: (r.length, r.sha256) for r in files.manifest(spark, str(tmp_path), 1).collect()}
    assert m == {"a/big.bin": (len(big), hashlib.sha256(big).hexdigest()), "a/b/empty": (0, hashlib.sha256(b"").hexdigest())}
    assert files.commit_stamp(str(tmp_path)) is None and len(files.commit_stamp(__file__.rsplit("/", 2)[0]) or "0" * 40) == 40


def test_array_shards_round_trip(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(50, 7))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)
    assert files.save_arrays(df, f"{tmp_path}/arrays") >= 4
    got = {r.id: r.v for r in files.load_arrays(spark, f"{tmp_path}/arrays").collect()}
    assert len(got) == 50 and all(got[i] == x[i].tolist() for i in range(50))
    assert files.load_arrays(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="vectors of lengths"):
        files.save_arrays(spark.createDataFrame([(1, [1.0]), (2, None)], "id long, v array<double>").coalesce(1), f"{tmp_path}/bad")
