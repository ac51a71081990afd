"""Structured Streaming twins of the stateful batch operators.

Every job reads a file stream with an explicit schema, runs to completion
with ``trigger(availableNow=True)`` (``files_per_trigger`` bounds a
micro-batch) and writes through ``foreachBatch`` into epoch folders
("upsert by replace": the newest epoch of a key wins when read back).
Checkpoints and outputs live under the shared checkpoint folder.

SS-1 chunk assembly, SS-3 attempt tracking and SS-5 first decisions keep
per-key state on RocksDB with ``transformWithStateInPandas``: a key's state ends
at its end marker or when the watermark has passed its last row by ``keep``
(an event-time timer), and its result is written then, once.  Keys are grouped
in slots by hash: a slot's states are read and written together and share one
timer, so the calls to the state store are by slot, not by key; the number of
slots follows the rows, ``SLOT_ROWS`` a slot.  Rows behind the
watermark change nothing; they go to a side table, so none is lost uncounted.
SS-4 uses streaming aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from quire.operators import gate as G
from quire.sources.io import scratch_dir

EOT = "<|eot_id|>"


FILES_PER_TRIGGER = 1000  # files of one micro-batch
SLOT_ROWS = 8192  # rows whose keys share a slot of the state store


def stage_files(df: DataFrame, path: str, by: str | None = None) -> str:
    """Write ``df`` as the stream's input.  Without ``by`` every task writes its
    own file; with it rows are spread by key hash over the shuffle partitions,
    so all rows of a key arrive in one file."""
    (df.repartition(by) if by else df).write.mode("append").parquet(path)
    return path


def epoch_sink(out: str):
    """``foreachBatch`` function that writes a folder per epoch; a batch
    replayed after a failure overwrites its own folder."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    return sink


def run_to_completion(sdf: DataFrame, spark: SparkSession, name: str, mode: str = "append", with_progress: bool = False):
    """Drain a streaming DataFrame into epoch folders; return the output root
    (``with_progress``: and the last progress report).

    An empty epoch -1 carries the schema, so a stream without rows reads back
    as an empty table.
    """
    out = scratch_dir(spark, f"stream-{name}-out")
    ckpt = scratch_dir(spark, f"stream-{name}-ckpt")
    sink = epoch_sink(out)
    sink(spark.createDataFrame([], sdf.schema), -1)
    q = (sdf.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
         .foreachBatch(sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return (out, q.lastProgress) if with_progress else out


def latest_per_key(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Read epoch folders back: newest row per key (upsert by replace)."""
    df = spark.read.parquet(out)
    rec = F.struct(*[c for c in df.columns if c not in (*keys, "epoch")])
    return df.groupBy(*keys).agg(F.max_by(rec, "epoch").alias("_r")).select(*keys, "_r.*")


def _source(spark: SparkSession, path: str, schema, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


# -------------------------------------------------------- state with an end

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "late_ts"  # set on the rows that came behind the watermark


class Drained:
    """What a stateful stream left: results, late rows and open state rows."""

    def __init__(self, rows: DataFrame, results: list[str], inputs: list[str], open_rows: int):
        self.results = rows.where(F.col(LATE).isNull()).select(*results)
        self.late = rows.where(F.col(LATE).isNotNull()).select(*inputs, LATE)
        self.open_rows = open_rows


class TimedProcessor(StatefulProcessor):
    """State per key that ends ``keep_ms`` after the key's last row.

    Subclasses say how rows (tuples of the ``INPUTS`` after the key, in order of
    arrival) change the state (``fold``: a tuple or None) and what it gives in
    the end (``result``); a state that ``fold`` calls finished gives its result
    and ends at once.  The first of ``INPUTS`` is the key; a call has the rows
    of a slot of keys."""

    STATE: str
    RESULTS: list[str]
    INPUTS: list[str]

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms
        one = T.StructType([T.StructField("item", T.LongType()), T.StructField("until", T.LongType()),
                            *T._parse_datatype_string(self.STATE).fields])
        self.schema = T.StructType([T.StructField("open", T.ArrayType(one))])

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.schema)
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        pdf = pd.concat(list(rows), ignore_index=True)
        ms = pdf["ts_ms"].to_numpy()
        late = ms < mark
        if late.any():
            yield self._frame(pdf[late], ms[late])
        pdf, ms = pdf[~late], ms[~late]
        if not len(pdf):
            return
        order = np.argsort(pdf[self.INPUTS[0]].to_numpy(), kind="stable")
        items, ms = pdf[self.INPUTS[0]].to_numpy()[order], ms[order]
        values = list(zip(*[pdf[c].to_numpy()[order].tolist() for c in self.INPUTS[1:]]))
        first = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
        held, done = self._held(), []
        for a, b, item, last in zip(first.tolist(), [*first[1:].tolist(), len(items)], items[first].tolist(),
                                    np.maximum.reduceat(ms, first).tolist()):
            until, state = held.get(item, (0, None))
            state, finished = self.fold(state, values[a:b])
            if finished:
                done.append((item, state))
                held.pop(item, None)
            else:
                held[item] = (max(last + self.keep_ms, until), state)
        yield from self._results(done)
        self._hold(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, now = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        held = self._held()
        done = [(item, state) for item, (until, state) in held.items() if until < mark or until <= now]
        for item, _ in done:
            del held[item]
        yield from self._results(done)
        self._hold(held)

    def _held(self) -> dict[int, tuple[int, tuple]]:
        """{key: (end of its state, state)} of the slot."""
        rows = self.open.get()[0] if self.open.exists() else []
        return {r[0]: (r[1], tuple(r[2:])) for r in map(tuple, rows)}

    def _hold(self, held) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        new = min((until for until, _ in held.values()), default=None)
        if new != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)
                self.timer.update((new,))
        if held:
            self.open.update(([(item, until, *state) for item, (until, state) in held.items()],))
        else:
            self.open.clear()
            self.timer.clear()

    def _frame(self, pdf: pd.DataFrame, late_ms) -> pd.DataFrame:
        out = pd.DataFrame({c: pdf[c].to_numpy() if c in pdf else None for c in dict.fromkeys([*self.RESULTS, *self.INPUTS])}, dtype=object)
        out[LATE] = pd.Series(late_ms, dtype=object)
        return out

    def _results(self, ended) -> Iterator[pd.DataFrame]:
        rows = [r for r in (self.result(item, state) for item, state in ended) if r is not None]
        if rows:
            yield self._frame(pd.DataFrame(rows, columns=self.RESULTS, dtype=object), [None] * len(rows))

    def close(self) -> None:
        pass


def _arrivals(rows: DataFrame | list[DataFrame], *cols) -> list[DataFrame]:
    return [x.select(*cols) for x in (rows if isinstance(rows, list) else [rows])]


def drain(spark: SparkSession, arrivals: list[DataFrame], key: str, processor: TimedProcessor, out_types: dict[str, str], watermark: str,
          name: str, by: str | None, files_per_trigger: int) -> Drained:
    """Run rows (with an event time ``ts``), staged one arrival after the other,
    through a timed processor until every key's state has ended.

    A last file holds one row without a key, later than all others by the time
    states are kept and the watermark lags, so the timers of all keys fire.
    Rows without a key have no result."""
    src = scratch_dir(spark, f"stream-{name}-src")
    for part in arrivals:
        # a small arrival is one file: its rows come in one micro-batch, none late by another's time
        stage_files(part if by else part.hint("rebalance"), src, by)
    rows = arrivals[0]
    delay = F.expr(f"interval {watermark}")
    keep = F.expr(f"interval {processor.keep_ms + 1000} milliseconds")
    staged = spark.read.schema(rows.schema).parquet(src)
    ahead = staged.agg((F.max("ts") + delay + delay + keep).alias("ts")).where("ts is not null")
    close = ahead.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    close.coalesce(1).write.mode("append").parquet(src)
    stream = _source(spark, src, rows.schema, files_per_trigger).withWatermark("ts", watermark)
    # the plain copy of the time has no watermark of its own, so late rows reach the processor
    ms = F.coalesce(F.unix_millis("ts"), F.lit(-1))  # without a time: late
    # the closing row goes after the watermark has seen it: a condition on the time stays above that
    stream = stream.where(F.col(key).isNotNull() | (ms < -(1 << 62))).withColumn("ts_ms", ms).drop("ts")
    fields = [T.StructField(c, T._parse_datatype_string(t)) for c, t in out_types.items()] + [T.StructField(LATE, T.LongType())]
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), staged.count() // SLOT_ROWS)
    res = stream.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(slots))).groupBy("slot").transformWithStateInPandas(processor, T.StructType(fields), "Append", "EventTime")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out, progress = run_to_completion(res, spark, name, with_progress=True)
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    open_rows = sum(op["numRowsTotal"] for op in progress["stateOperators"]) if progress else 0
    return Drained(spark.read.parquet(out), processor.RESULTS, processor.INPUTS, open_rows)


# ---------------------------------------------------------------- SS-2


def gate(spark: SparkSession, docs: DataFrame, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Stateless gate on arriving documents (same Column rules as the batch gate)."""
    src = stage_files(docs, scratch_dir(spark, "stream-gate-src"))
    stream = _source(spark, src, docs.schema, files_per_trigger)
    verdicts = G.verdict(stream).select("doc_id", "is_paper", "confidence", "reason")
    out = run_to_completion(verdicts, spark, "gate")
    return spark.read.parquet(out).drop("epoch")


# ---------------------------------------------------------------- SS-3

class Attempts(TimedProcessor):
    """Successes so far, failures since the last one.  An idea fails at
    ``max_iters`` failures before the first success, one fewer after it.  A
    verdict stays until the state ends, so later events change nothing."""

    STATE = "wins int, losses int, verdict string, stop long, last long"
    RESULTS = ["idea_id", "outcome", "stop_seq"]
    INPUTS = ["idea_id", "seq", "ok"]

    def __init__(self, keep_ms: int, max_runs: int, max_iters: int):
        super().__init__(keep_ms)
        self.max_runs, self.max_iters = max_runs, max_iters

    def fold(self, state, rows):
        wins, losses, verdict, stop, last = state or (0, 0, "open", None, -1)
        new = sorted((r for r in rows if r[0] > last), key=lambda r: r[0])  # ids seen before are copies; no id: NaN
        for seq, ok in new:
            if verdict != "open":
                break
            good = ok == 1
            wins, losses = (wins + 1, 0) if good else (wins, losses + 1)
            if losses >= (self.max_iters - 1 if wins else self.max_iters) and (not good or self.max_iters <= 1):
                verdict, stop = "fail", int(seq)
            elif wins >= self.max_runs:
                verdict, stop = "success", int(seq)
        return (wins, losses, verdict, stop, int(new[-1][0]) if new else last), False

    def result(self, item, state):
        return item, state[2], state[3]


def attempts(spark: SparkSession, events: DataFrame | list[DataFrame], max_runs: int = 2, max_iters: int = 4, watermark: str = "1 hour",
             keep: int = 3_600_000, files_per_trigger: int = FILES_PER_TRIGGER) -> Drained:
    """Attempt tracker (batch twin: ``attempts.outcome``) over (idea_id, seq,
    ok, ts).  Staged by key, so the events of an idea arrive in order."""
    rows = _arrivals(events, F.col("idea_id").cast("long"), F.col("seq").cast("long"), F.col("ok").cast("int"), "ts")
    types = {"idea_id": "long", "outcome": "string", "stop_seq": "long", "seq": "long", "ok": "int"}
    return drain(spark, rows, "idea_id", Attempts(keep, max_runs, max_iters), types, watermark, "attempts", "idea_id", files_per_trigger)


# ---------------------------------------------------------------- SS-4


def run_stats(spark: SparkSession, summaries: DataFrame, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Running mean / stderr (population std / n) per (run, dataset, step)."""
    src = stage_files(summaries, scratch_dir(spark, "stream-runstats-src"))
    stream = _source(spark, src, summaries.schema, files_per_trigger)
    agg = stream.groupBy("run", "dataset", "step").agg(
        F.avg("val_loss").alias("mean"), (F.stddev_pop("val_loss") / F.count("val_loss")).alias("stderr"),
        F.count("val_loss").alias("n"))
    out = run_to_completion(agg, spark, "runstats", mode="update")
    return latest_per_key(spark, out, ["run", "dataset", "step"])


# ---------------------------------------------------------------- SS-5


class FirstDecision(TimedProcessor):
    """The earliest round with a decision, among rounds up to ``max_rounds``;
    copies of a reply change nothing."""

    STATE = "novel boolean, round int"
    RESULTS = ["item_id", "novel", "round"]
    INPUTS = ["item_id", "round", "text"]

    def __init__(self, keep_ms: int, max_rounds: int):
        super().__init__(keep_ms)
        self.max_rounds = max_rounds

    def fold(self, state, rows):
        novel, first = state or (False, None)
        for r, text in rows:  # of one round the first to come
            low = (text or "").lower()
            said = True if "decision made: novel" in low else False if "decision made: not novel" in low else None
            if said is not None and r <= self.max_rounds and (first is None or r < first):
                novel, first = said, int(r)
        return (novel, first), False

    def result(self, item, state):
        return item, state[0], state[1]


def first_decision(spark: SparkSession, responses: DataFrame | list[DataFrame], watermark: str, max_rounds: int = 10, keep: int = 3_600_000,
                   files_per_trigger: int = FILES_PER_TRIGGER) -> Drained:
    """(item_id, novel, round) of every item: its first novelty decision within
    ``max_rounds``; undecided items are not novel and have a null round.

    Replies (item_id, round, text) carry an event time ``ts``; ``watermark`` is
    how late one may come, ``keep`` (ms) how long an item is held after its last one.
    """
    rows = _arrivals(responses, F.col("item_id").cast("long"), F.col("round").cast("int"), "text", "ts")
    types = {"item_id": "long", "novel": "boolean", "round": "int", "text": "string"}
    return drain(spark, rows, "item_id", FirstDecision(keep, max_rounds), types, watermark, "novelty", "item_id", files_per_trigger)


# ---------------------------------------------------------------- SS-1


class Assembler(TimedProcessor):
    """Chunks by position.  The text up to the latest end marker is written
    when the state ends: with ``one_marker`` at the first marker whose chunks
    are all there, else by time.  Without a marker nothing is written."""

    STATE = "parts array<struct<pos: long, chunk: string>>"
    RESULTS = ["resp_id", "text", "last_pos"]
    INPUTS = ["resp_id", "pos", "chunk"]

    def __init__(self, keep_ms: int, one_marker: bool):
        super().__init__(keep_ms)
        self.one_marker = one_marker

    def fold(self, state, rows):
        parts = {int(p[0]): p[1] for p in (state[0] if state else [])}
        for pos, chunk in rows:
            parts.setdefault(int(pos), chunk or "")
        seq = sorted(parts.items())
        ends = [p for p, c in seq if c.endswith(EOT)]
        whole = self.one_marker and bool(ends) and all(p in parts for p in range(ends[0]))
        return ([tuple(x) for x in seq if not whole or x[0] <= ends[0]],), whole

    def result(self, item, state):
        seq = [(int(p[0]), p[1]) for p in state[0]]
        ends = [p for p, c in seq if c.endswith(EOT)]
        if not ends:
            return None
        return item, "".join(c for p, c in seq if p <= ends[-1]).replace(EOT, ""), ends[-1]


def assemble(spark: SparkSession, chunks: DataFrame | list[DataFrame], watermark: str = "1 hour", keep: int = 3_600_000, one_marker: bool = False,
             files_per_trigger: int = FILES_PER_TRIGGER) -> Drained:
    """Assemble chunks (resp_id, pos, chunk, ts) per response; the text up to
    the latest end marker (marker removed).  Batch twin: ``replies.assemble``
    cut at that marker."""
    rows = _arrivals(chunks, F.col("resp_id").cast("long"), F.col("pos").cast("long"), "chunk", "ts")
    types = {"resp_id": "long", "text": "string", "last_pos": "long", "pos": "long", "chunk": "string"}
    return drain(spark, rows, "resp_id", Assembler(keep, one_marker), types, watermark, "chunks", None, files_per_trigger)
