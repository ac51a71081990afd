"""Readers on small literal fixtures (the written-fixture rows of the survey)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quire.sources import io as IO


def _write(folder, rel, text):
    path = os.path.join(folder, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


@pytest.fixture(scope="module")
def scratch():
    return tempfile.mkdtemp(prefix="quire-test-src-", dir="/tmp")


def test_read_runs_keeps_leaves_of_every_level(spark, scratch):
    root = os.path.join(scratch, "deep")
    _write(root, "run_0/final_info.json", json.dumps(
        {"a": {"means": {"l1": {"l2": {"l3": {"l4": {"l5": 5.0, "t}{": "x"}, "n": 4.0}, "n": 3.0}, "n": 2.0}, "n{\\\"": 1.0}}}))
    _write(root, "run_1/final_info.json", json.dumps({"b": {"means": 7.0, "note": "{{{{"}}))
    rows = {(r["run"], r["dataset"], r["metric"], r["mean"]) for r in IO.read_runs(spark, root).collect()}
    assert rows == {("run_0", "a", "l1.l2.l3.l4.l5", 5.0), ("run_0", "a", "l1.l2.l3.n", 4.0), ("run_0", "a", "l1.l2.n", 3.0),
                    ("run_0", "a", "l1.n", 2.0), ("run_0", "a", "n{\\\"", 1.0), ("run_1", None, "b", 7.0)}


def test_read_runs_tolerates_drifted_shapes(spark, scratch):
    root = os.path.join(scratch, "runs")
    _write(root, "run_0/final_info.json", json.dumps(
        {"circle": {"means": {"eval_loss": 0.44, "kl": 0.32}, "stderrs": {"eval_loss": 0.01}}}))
    _write(root, "run_1/final_info.json", json.dumps({"final_train_loss": {"means": 0.799}}))
    _write(root, "run_2/final_info.json", json.dumps({"layer_1_beta_2": {"means": 0.1, "stds": 0.02}}))
    _write(root, "run_3/final_info.json", json.dumps(
        {"MACE": {"means": {"h2o": {"params": {"r_max": 5.0, "hidden": "128x0e"}, "md": {"rmfs": 0.3}}}}}))
    _write(root, "run_4/final_info.json", json.dumps(
        {"SEIR": {"means": {"infected_peak": 12.0}, "solution": [[1.0, 2.0]]}}))
    _write(root, "notes/final_info.json", json.dumps({"x": {"means": 1.0}}))  # not a run folder
    rows = {(r["run"], r["dataset"], r["metric"]): (r["mean"], r["stderr"])
            for r in IO.read_runs(spark, root).collect()}
    assert rows[("run_0", "circle", "eval_loss")] == (0.44, 0.01)
    assert rows[("run_0", "circle", "kl")] == (0.32, None)
    assert rows[("run_1", None, "final_train_loss")] == (0.799, None)
    assert rows[("run_2", None, "layer_1_beta_2")] == (0.1, 0.02)
    assert rows[("run_3", "MACE", "h2o.params.r_max")] == (5.0, None)
    assert rows[("run_3", "MACE", "h2o.md.rmfs")] == (0.3, None)
    assert rows[("run_4", "SEIR", "infected_peak")] == (12.0, None)
    assert not any(k[0] == "notes" for k in rows)
    assert ("run_3", "MACE", "h2o.params.hidden") not in rows  # non-numeric leaf dropped


def test_read_xyz_frames(spark, scratch):
    p = _write(scratch, "xyz/md.xyz", "2\nframe a\nH 0.0 0.0 0.1\nO 1.0 2.0 3.0\n1\nframe b\nC -1.5 0 2e-1\n")
    rows = IO.read_xyz(spark, p).orderBy("frame", "atom").collect()
    assert [(r["frame"], r["atom"], r["symbol"], r["z"]) for r in rows] == [
        (1, 0, "H", 0.1), (1, 1, "O", 3.0), (2, 0, "C", 0.2)]


def test_read_cameras(spark, scratch):
    p = _write(scratch, "cam/cameras.txt", "# Camera list\n1 SIMPLE_RADIAL 2048 1536 1580.46 1024 768 0.0045691\n"
               "2 OPENCV 3840 2160 3178.27 3182.09 1920 1080 0.159668 -0.231286 -0.00123982 0.00272224\n"
               "3 PINHOLE 100 50 10 20 30 40\n")
    r = {x["camera_id"]: x for x in IO.read_cameras(spark, p).collect()}
    assert r[1]["k1"] == 0.0045691 and r[1]["fl_y"] == 1580.46 and r[1]["cx"] == 1024
    assert r[2]["fl_y"] == 3182.09 and r[2]["p2"] == 0.00272224
    assert r[3]["fl_y"] == 20 and r[3]["cy"] == 40
    import math
    assert abs(r[3]["angle_x"] - 2 * math.atan(100 / 20)) < 1e-12


def test_read_image_poses_odd_lines(spark, scratch):
    p = _write(scratch, "img/images.txt", "# Image list\n# comment\n"
               "1 1 0 0 0 0.5 0 0 1 a b.png\n10 20 -1\n2 0.7 0.1 0 0 0 0.5 0 1 c.png\n11 21 -1\n")
    rows = {r["image_id"]: r for r in IO.read_image_poses(spark, p).collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["name"] == "a_b.png" and rows[2]["ty"] == 0.5


def test_read_frames_and_pose_rows(spark, scratch):
    p = _write(scratch, "frames/transforms.json", json.dumps({"camera_angle_x": 0.69, "frames": [
        {"file_path": "./r_0", "transform_matrix": [[1, 0, 0, 1], [0, 1, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]]}]}))
    r = IO.read_frames(spark, p).collect()[0]
    assert r["file_path"] == "./r_0" and r["transform_matrix"][2][3] == 3.0
    df = spark.createDataFrame([(1, [float(i) for i in range(17)])], "id int, v array<double>")
    out = IO.split_pose_rows(df, "v").collect()[0]
    assert out["pose"][2] == [10.0, 11.0, 12.0, 13.0, 14.0] and out["near"] == 15.0 and out["far"] == 16.0


def test_pick_split_files_fallback(spark):
    files = spark.createDataFrame([(1, "0_a"), (1, "1_b"), (1, "2_c"), (2, "0_d"), (2, "1_e")], "k int, f string")
    test = {(r["k"], r["f"]) for r in IO.pick_split_files(files, "k", "f", "test").collect()}
    assert test == {(1, "2_c"), (2, "1_e")}


def test_json_and_csv_sinks_roundtrip(spark, scratch):
    df = spark.createDataFrame([(0, 1, 2, 0.5), (1, 1, 5, 0.25)], "split int, layer int, beta int, accuracy double")
    path = IO.write_csv(df, os.path.join(scratch, "csv"), partition_by=["split", "layer", "beta"])
    back = spark.read.option("header", True).schema("accuracy double, split int, layer int, beta int").csv(path)
    assert sorted(tuple(r) for r in back.select("split", "layer", "beta", "accuracy").collect()) == \
        sorted(tuple(r) for r in df.collect())
    jpath = IO.write_json(df, os.path.join(scratch, "json"))
    assert spark.read.json(jpath).where(F.col("beta") == 5).count() == 1


def test_one_large_file_is_read_by_many_tasks(spark, scratch):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(9000)] + ["", "last"]
    p = _write(scratch, "big/lines.txt", "\n".join(lines) + "\n")
    texts = [f"doc {i}\n\nmore " + "é" * (i % 50) for i in range(4000)]
    c = _write(scratch, "big/corpus.txt", "".join(t + "\n\x1e\n" for t in texts))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = IO.read_lines(spark, p).orderBy("line_no").collect()
        assert [r["line"] for r in got] == lines and [r["line_no"] for r in got] == list(range(len(lines)))
        docs = IO.read_corpus(spark, c)
        assert docs.rdd.getNumPartitions() > 5
        assert sorted(r["text"] for r in docs.collect()) == sorted(texts)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_listing_of_a_folder(spark, scratch):
    for f in ("a/2_x.png", "a/0_y.png", "b/c/1_z.png", "b/note.txt"):
        _write(scratch, f"tree/{f}", "content")
    files = IO.listing(spark, os.path.join(scratch, "tree"), ".png")
    assert sorted((r["name"], r["size"]) for r in files.collect()) == [("0_y.png", 7), ("1_z.png", 7), ("2_x.png", 7)]
    folder = files.withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    got = {(r["folder"], r["place"]): r["name"] for r in IO.sorted_listing(folder, ["folder"]).collect()}
    assert got == {("a", 0): "0_y.png", ("a", 1): "2_x.png", ("c", 0): "1_z.png"}


def test_many_folders_are_written_by_many_tasks(spark):
    path = IO.scratch_dir(spark, "many-folders")
    rows = spark.createDataFrame([(i % 3, f"{i}_a+b c.txt", f"body {i}") for i in range(60)], "scene long, file string, value string").coalesce(1)
    IO.write_folders(rows, path, ["scene", "file"])
    files = IO.listing(spark, path, ".txt")
    got = files.select(IO.folder_value("path", "scene").cast("long"), IO.folder_value("path", "file"), "size", "name").collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted((i % 3, f"{i}_a+b c.txt", len(f"body {i}") + 1) for i in range(60))
    assert len({r["name"].split("-")[1] for r in got}) > 1  # part numbers: tasks
