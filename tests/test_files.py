"""Files as they are found on disk: missing, corrupt, changed; read once; written with digests; compared by fingerprints."""

import gzip
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from trajecta.sources import files
from trajecta.sources.store import BadInput


def episode(task, rep):
    return json.dumps({"uid": "u", "task": task, "rep": rep, "won": True, "steps": [{"step": 1, "action": "look", "observation_before": "a", "feedback": "b", "score": 1.0, "done": True}]})


def put(folder, task, rep, text):
    path = folder / f"train_{hashlib.sha256(task.encode()).hexdigest()[:16]}_r{rep:02d}.json"
    path.write_text(text)
    return hashlib.sha256(text.encode()).hexdigest()


def test_inventory(spark, tmp_path):
    good = put(tmp_path, "t1", 0, episode("t1", 0))
    put(tmp_path, "t1", 1, episode("t1", 1))
    put(tmp_path, "t2", 0, "{not json")
    put(tmp_path, "t2", 1, episode("t1", 1))
    put(tmp_path, "t3", 0, '["a list"]')
    (tmp_path / "notes.json").write_text("{}")
    (tmp_path / "other.txt").write_text("x")
    expected = spark.createDataFrame([("t1", 0, good), ("t1", 1, "0" * 64), ("t2", 0, None), ("t2", 1, None), ("t2", 2, None), ("t3", 0, None)], "task string, rep int, expected string")
    recorded = files.recorded_files(spark, str(tmp_path))
    found = files.inventory(recorded, expected)
    assert {(r["task"], r["rep"]): r["issue"] for r in found.collect()} == {("t1", 0): None, ("t1", 1): files.CHANGED, ("t2", 0): files.CORRUPT, ("t2", 1): files.OTHER, ("t2", 2): files.MISSING, ("t3", 0): files.CORRUPT}
    steps = files.readable_steps(recorded, found).collect()
    assert [(r["task"], r["rep"], r["t"], r["action"]) for r in steps] == [("t1", 0, 0, "look")]


def test_files_are_read_again_only_if_they_changed(spark, tmp_path):
    source, kept = tmp_path / "in", files.ReadOnce(spark, str(tmp_path / "kept"))
    source.mkdir()
    for k in range(5):
        (source / f"{k}.json").write_text(f"v{k}")
    docs, n = kept.refresh(str(source))
    assert n == 5 and sorted(r["content"] for r in docs.collect()) == ["v0", "v1", "v2", "v3", "v4"]
    assert kept.refresh(str(source))[1] == 0
    (source / "1.json").write_text("longer")
    (source / "2.json").write_text("v9")  # as long as before: its time tells
    os.utime(source / "2.json", (2_000_000_000, 2_000_000_000))
    (source / "3.json").unlink()
    (source / "5.json").write_text("v5")
    docs, n = kept.refresh(str(source))
    assert n == 3 and sorted(r["content"] for r in docs.collect()) == ["longer", "v0", "v4", "v5", "v9"]
    (source / "0.json").unlink()
    docs, n = kept.refresh(str(source))
    assert n == 0 and docs.count() == 4


def snapshot(folder):
    return {p.name: p.read_bytes() for p in folder.iterdir()}


def test_documents_have_equal_bytes_in_every_run(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("g%03d", "id").alias("name"), F.concat(F.lit('{"é": '), F.col("id").cast("string"), F.lit("}")).alias("body"))
    files.write_documents(rows.repartition(3), str(tmp_path / "a"), 4)
    files.write_documents(rows.repartition(7), f"file://{tmp_path}/b", 4)
    a, b = snapshot(tmp_path / "a"), snapshot(tmp_path / "b")
    assert a == b and "READY" in a and not any(n.endswith(".tmp") for n in a)
    manifest = json.loads(a["MANIFEST.json"])
    listed = [json.loads(line) for p in manifest["parts"] for line in a[p["part"]].decode().splitlines()]
    assert manifest["files"] == 40 == len(listed) == len({x["path"] for x in listed})
    for p in manifest["parts"]:
        assert hashlib.sha256(a[p["part"]]).hexdigest() == p["sha256"]
    for x in listed:
        data = a[x["path"]]
        assert hashlib.sha256(data).hexdigest() == x["sha256"] and len(data) == x["compressed_bytes"] and len(gzip.decompress(data)) == x["json_bytes"]
    with pytest.raises(Exception, match="ready already"):
        files.write_documents(rows, str(tmp_path / "a"))


def test_a_failing_task_leaves_no_marker(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").cast("string").alias("name"), F.expr("CASE WHEN id = 7 THEN raise_error('lost') ELSE 'x' END").alias("body"))
    with pytest.raises(Exception):  # noqa: B017
        files.write_documents(rows, str(tmp_path / "a"), 3)
    assert not (tmp_path / "a" / "READY").exists() and not (tmp_path / "a" / "MANIFEST.json").exists()
    files.write_documents(rows.where("name <> '7'"), str(tmp_path / "a"), 3)
    assert (tmp_path / "a" / "READY").exists()


def test_fingerprints_name_the_range_that_differs(spark):
    rows = spark.range(500).selectExpr("id", "id % 7 AS v", "CASE WHEN id % 5 = 0 THEN NULL ELSE 'x' END AS w")
    files.require_same(rows, rows.orderBy(F.desc("id")).repartition(9), ["id"])
    other = rows.withColumn("v", F.when(F.col("id") == 77, 99).otherwise(F.col("v")))
    assert files.guard(rows, other, ["id"]).count() == 1 and files.guard(rows, other, ["id"], columns=[]).count() == 0
    with pytest.raises(BadInput, match="1 of 64 ranges"):
        files.require_same(rows, other, ["id"])
    missing = files.guard(rows, rows.where("id <> 3"), ["id"], columns=[]).collect()
    assert len(missing) == 1 and missing[0]["n_base"] - missing[0]["n_other"] == 1
    assert files.guard(rows, rows.limit(0), ["id"], 8).count() == 8 and files.guard(rows.limit(0), rows.limit(0), ["id"]).count() == 0
    # a null isn't an empty text, and rows that repeat count
    assert files.guard(rows, rows.fillna({"w": ""}), ["id"]).count() > 0 and files.guard(rows, rows.union(rows.where("id = 1")), ["id"]).count() == 1


def test_results_of_other_settings_are_refused(spark):
    jobs = spark.createDataFrame([("a", 0), ("a", 1)], "task string, rep int")
    done = spark.createDataFrame([("a", 0, "s1")], "task string, rep int, signature string")
    assert [tuple(r) for r in files.unfinished(jobs, done, ["task", "rep"], "s1").collect()] == [("a", 1)]
    with pytest.raises(BadInput):
        files.unfinished(jobs, done, ["task", "rep"], "s2")


def test_household_catalogs(spark):
    rows = [("a", "x/game.tw-pddl"), ("b", "y/game.tw-pddl")]
    make = lambda r: spark.createDataFrame(r, "task_id string, gamefile string")
    assert files.resolved_tasks(make(rows)).count() == 2
    for bad in [("a", "z/game.tw-pddl"), ("c", "x/game.tw-pddl"), ("c", "/x/game.tw-pddl"), (None, "z/game.tw-pddl")]:
        with pytest.raises(BadInput):
            files.resolved_tasks(make([*rows, bad]))
