"""Scores dealt by paper: one shuffle, whatever is done by paper afterwards."""

import pytest
from pyspark.sql import functions as F

from quire.operators import reviews as RV
from quire.plans import derived as D
from quire.plans.registry import QUERIES, load_all
from quire.sources import tables as TB


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k, n, float(q), k % 7, k % 5) for k in range(1, 60) for n in range(1, 5) for q in (n, n + k % 9)]
    df = spark.createDataFrame(rows + [(61, None, 3.0, None, 1)], "l_orderkey long, l_linenumber int, l_quantity double, l_partkey long, l_suppkey long")
    df.write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_one_shuffle_by_paper(spark, folder):
    load_all()
    for name in ("ag1_ensemble_scores", "wn26_numbered_reviews", "wn16_stop_at_score", "sc17_meta_review_prompt"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, name


def test_parts_grow_with_the_files(spark, folder, monkeypatch):
    parts = lambda: TB.dealt(spark.read.parquet(f"{folder}/lineitem.parquet"), "l_orderkey").rdd.getNumPartitions()
    few = parts()
    monkeypatch.setattr(TB, "DEALT_BYTES", 16)
    assert parts() > 4 * few


@pytest.mark.parametrize("hot", [False, True])
def test_numbers_and_stops_with_and_without_hot_keys(spark, folder, monkeypatch, hot):
    from quire.plans import ordering

    monkeypatch.setattr(ordering, "HOT_ROWS", 3 if hot else 1 << 20)
    t = D.d_scores(TB.Tables(spark, folder)).unionByName(spark.createDataFrame([(None, 1, "Overall", 9)], "paper_id long, reviewer int, field string, score int"))
    rows = t.where("reviewer is not null")
    want = {}
    for r in sorted((x for x in rows.collect() if x["paper_id"] is not None), key=lambda x: x["reviewer"]):
        want.setdefault((r["paper_id"], r["field"]), []).append((r["reviewer"], r["score"]))
    got = {}
    for r in sorted(RV.numbered(rows, ["paper_id", "field"]).collect(), key=lambda x: x["review_no"]):
        got.setdefault((r["paper_id"], r["field"]), []).append((r["reviewer"], r["review_label"]))
    assert got == {k: [(v, f"Review {i}/{len(x)}") for i, (v, _) in enumerate(x, 1)] for k, x in want.items()}
    kept = {(r["paper_id"], r["field"], r["reviewer"], r["stopped_early"])
            for r in RV.stop_at_score(rows, ["paper_id", "field"], "reviewer", "score", at=8, max_iters=3).collect()}
    left = set()
    for (p, f), x in want.items():
        stop = next((v for v, s in x if v <= 3 and (s is None or s >= 8)), None)
        left |= {(p, f, v, stop is not None) for v, _ in x if v <= 3 and (stop is None or v <= stop)}
    assert kept == left and rows.where(F.col("paper_id").isNull()).count() == 1
