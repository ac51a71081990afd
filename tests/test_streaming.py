"""Streaming twins on small inputs: several micro-batches, replays, empty inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.sources.io import scratch_dir
from quire.streaming import jobs as J


def test_replayed_batch_overwrites_its_epoch(spark):
    out = scratch_dir(spark, "replay-test")
    sink = J.epoch_sink(out)
    batch = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sink(batch, 0)
    sink(batch, 0)
    sink(spark.createDataFrame([(2, "c")], "k int, v string"), 1)
    assert spark.read.parquet(out).count() == 3
    assert {(r.k, r.v) for r in J.latest_per_key(spark, out, ["k"]).collect()} == {(1, "a"), (2, "c")}


def test_first_decision_keeps_undecided_items(spark):
    rows = [(1, 1, "thinking"), (1, 2, "Decision made: novel."), (1, 3, "Decision made: not novel."),
            (2, 1, "nothing yet"), (3, 1, "decision made: NOT novel"), (3, 1, "decision made: NOT novel"),
            (4, 11, "Decision made: novel."), (5, 1, None)]
    df = spark.createDataFrame(rows, "item_id int, round int, text string") \
        .withColumn("ts", (F.lit(1704067200) + F.col("round")).cast("timestamp"))
    out = J.first_decision(spark, df, watermark="1 hour", max_rounds=10).results.collect()
    assert {r.item_id: (r.novel, r.round) for r in out} == {
        1: (True, 2), 2: (False, None), 3: (False, 1), 4: (False, None), 5: (False, None)}


def at(df, seconds):
    return df.withColumn("ts", (F.lit(1704067200) + seconds).cast("timestamp"))


def test_chunks_over_several_batches(spark):
    chunks = lambda *rows: at(spark.createDataFrame(rows, "resp_id long, pos int, chunk string, s int"), F.col("s"))
    hour = 3600
    arrivals = [chunks((1, 0, "He", 0), (1, 1, "llo" + J.EOT, 1), (2, 0, "open", 2), (1, 0, "He", 3), (None, 0, "no key", 3)),
                chunks((1, 2, "tail", 60), (3, 0, "other" + J.EOT, 10 * hour)),
                chunks((1, 3, "too late" + J.EOT, hour), (3, 1, "more" + J.EOT, 10 * hour + 1)),
                chunks((2, 1, "late too", 5), (2, 0, "a new start" + J.EOT, 11 * hour))]
    d = J.assemble(spark, arrivals, watermark="1 hour", keep=hour * 1000, files_per_trigger=1)
    assert sorted((r.resp_id, r.text, r.last_pos) for r in d.results.collect()) == [(1, "Hello", 1), (2, "a new start", 0), (3, "othermore", 1)]
    assert sorted((r.resp_id, r.pos, r.chunk) for r in d.late.collect()) == [(1, 3, "too late" + J.EOT), (2, 1, "late too")]
    assert d.open_rows == 0


def test_state_ends_at_the_end_marker(spark):
    rows = [(1, 0, "He"), (1, 1, "llo" + J.EOT), (2, 1, "b" + J.EOT), (3, 0, "open")]
    df = at(spark.createDataFrame(rows, "resp_id long, pos int, chunk string"), F.col("pos"))
    d = J.assemble(spark, df, one_marker=True)
    assert {(r.resp_id, r.text) for r in d.results.collect()} == {(1, "Hello"), (2, "b")} and d.open_rows == 0


def test_attempts_in_two_arrivals(spark):
    events = lambda *rows: at(spark.createDataFrame(rows, "idea_id long, seq long, ok int"), F.col("seq"))
    arrivals = [events((1, 1, 1), (1, 2, 0), (2, 1, 0), (2, 2, 0), (2, 3, 0), (3, 1, 0), (3, 1, 0)),
                events((1, 3, 1), (1, 4, 0), (2, 4, 0), (2, 5, 1), (4, 9, 0))]
    d = J.attempts(spark, arrivals, files_per_trigger=1)
    assert sorted((r.idea_id, r.outcome, r.stop_seq) for r in d.results.collect()) == [
        (1, "success", 3), (2, "fail", 4), (3, "open", None), (4, "open", None)]
    assert d.late.count() == 0 and d.open_rows == 0


def test_empty_inputs_read_back_as_empty_tables(spark):
    runs = spark.createDataFrame([], "run string, dataset string, step int, val_loss double")
    out = J.run_stats(spark, runs)
    assert out.columns == ["run", "dataset", "step", "mean", "stderr", "n"] and out.count() == 0
    replies = spark.createDataFrame([], "item_id int, round int, text string, ts timestamp")
    out = J.first_decision(spark, replies, watermark="1 hour").results
    assert out.columns == ["item_id", "novel", "round"] and out.count() == 0
    events = spark.createDataFrame([], "idea_id long, seq long, ok int, ts timestamp")
    assert J.attempts(spark, events).results.count() == 0
