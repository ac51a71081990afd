"""Keys that share a slot of the state store keep states, ends and late rows apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.streaming import jobs as J


def test_calls_to_the_state_store_are_by_slot(spark, monkeypatch):
    """Every key has its result although a slot's keys end at different times."""
    seen = []
    plain = J.run_to_completion
    monkeypatch.setattr(J, "run_to_completion", lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1])
    hour = 3600
    rows = lambda lo, hi, s: spark.range(lo, hi).select(
        F.col("id").alias("item_id"), F.lit(1).alias("round"),
        F.when(F.col("id") % 2 == 0, "Decision made: novel.").otherwise("Decision made: not novel.").alias("text"),
        (F.lit(1704067200) + F.lit(s)).cast("timestamp").alias("ts"))
    arrivals = [rows(0, 300, 0), rows(300, 500, 1800), rows(500, 510, 10 * hour), rows(0, 5, 60)]
    d = J.first_decision(spark, arrivals, watermark="1 hour", keep=hour * 1000, files_per_trigger=1)
    got = {r.item_id: (r.novel, r.round) for r in d.results.collect()}
    assert got == {i: (i % 2 == 0, 1) for i in range(510)} and d.results.count() == 510
    assert sorted(r.item_id for r in d.late.collect()) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4][::2] and d.open_rows == 0
    most = max(op["numRowsUpdated"] for _, p in seen for op in p["stateOperators"])
    assert J.SLOT_ROWS > 500 and most <= 8 * 4  # two values and a timer a slot at most, not a key
