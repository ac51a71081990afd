"""Attempt logs: the experiment attempt machine, stage funnels, error tails
and timestamped run identifiers.

The attempt machine is solved as gaps-and-islands over skew-safe running
counts (``quire.plans.ordering.running_totals``) plus per-key aggregates;
there is no per-row loop and no window holding a whole idea.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans.ordering import running_totals

# Stage order of one idea's pipeline.
STAGES = ["experiments", "writeup", "review", "improvement"]


def outcome(df: DataFrame, key: str, order: str, ok: str, max_runs: int = 2, max_iters: int = 4,
            done: str | None = None) -> DataFrame:
    """Outcome per key of the attempt loop.

    State starts at run 1, counter 0.  A success moves to the next run and
    sets the counter to 1; a failure adds 1.  The loop fails once the counter
    reaches ``max_iters`` and succeeds after ``max_runs`` successes or at an
    event flagged ``done`` (ALL_COMPLETED, checked before the event runs).
    Returns (key, outcome in {success, fail, open}, stop_seq, runs_done).
    """
    o = F.col(ok)
    sums = {"_succ": o.cast("long"), "_fail": (1 - o).cast("long")}
    if done is not None:
        sums["_done"] = F.col(done).cast("long")
    r = running_totals(df, [order], sums, partition_by=[key])
    # island = number of successes strictly before the row
    r = r.withColumn("_island", F.col("_succ") - o)
    # failures before each island starts, from an aggregate (no window)
    start = r.groupBy(key, "_island").agg(F.min(F.col("_fail") - (1 - o)).alias("_fail0"))
    r = r.join(start, [key, "_island"]).withColumn("_fno", F.col("_fail") - F.col("_fail0"))
    seq = F.col(order)
    # failures needed in island i: max_iters in the first island, max_iters-1 later
    need = F.when(F.col("_island") == 0, F.lit(max_iters)).otherwise(F.lit(max_iters - 1))
    fail_hit = (o == 0) & (F.col("_fno") == need) & (F.col("_island") < max_runs)
    succ_hit = (o == 1) & (F.col("_succ") == max_runs)
    if max_iters <= 1:  # the counter is spent after any first event, a success too
        fail_hit, succ_hit = F.lit(True), F.lit(False)
    aggs = [F.min(F.when(fail_hit, seq)).alias("_f"), F.min(F.when(succ_hit, seq)).alias("_s")]
    if done is not None:
        aggs.append(F.min(F.when(F.col(done).cast("boolean"), seq)).alias("_d"))
    per = r.groupBy(key).agg(*aggs)
    f, s = F.col("_f"), F.col("_s")
    d = F.col("_d") if done is not None else F.lit(None).cast(df.schema[order].dataType)
    # the earliest terminal event decides; a done marker stops before its event runs
    first = F.least(f, s, d)
    res = (F.when(first.isNull(), F.lit("open"))
           .when(first == d, F.lit("success"))
           .when(first == f, F.lit("fail"))
           .otherwise(F.lit("success")))
    return per.select(key, res.alias("outcome"), first.alias("stop_seq"))


def runs_done(df: DataFrame, key: str, order: str, ok: str, decided: DataFrame) -> DataFrame:
    """Successful runs up to (and including) the stop event, per key."""
    j = df.join(decided.select(key, "stop_seq"), key)
    keep = F.col("stop_seq").isNull() | (F.col(order) <= F.col("stop_seq"))
    return j.where(keep).groupBy(key).agg(F.sum(F.col(ok)).alias("runs_done"), F.count("*").alias("events_used"))


def stage_funnel(stages: DataFrame, key: str, stage: str, ok: str, order: Sequence[str] = STAGES) -> DataFrame:
    """Per key the first failing stage (by pipeline order), 'completed' if none."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(stage))
    first = F.min_by(F.col(stage), F.when(~F.col(ok).cast("boolean"), rank))
    return stages.groupBy(key).agg(F.coalesce(first, F.lit("completed")).alias("failed_stage"))


def funnel_counts(first_fail: DataFrame) -> DataFrame:
    return first_fail.groupBy("failed_stage").agg(F.count("*").alias("n"))


def error_tail(c: Column, n: int = 1500) -> Column:
    """Long error output -> '...' + last n characters."""
    return F.when(F.length(c) > n, F.concat(F.lit("..."), F.substring(c, -n, n))).otherwise(c)


def timeout_message(run: Column, timeout: int) -> Column:
    return F.concat(F.lit("Run "), run.cast("string"), F.lit(f" timed out after {timeout} seconds"))


def run_id(ts: Column, name: Column) -> Column:
    """``yyyyMMdd_HHmmss_name``."""
    return F.concat(F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"), name)


def check_new(df: DataFrame, id_col: str) -> DataFrame:
    """Flags identifiers that are not new (occur more than once)."""
    counts = df.groupBy(id_col).agg(F.count("*").alias("_c"))
    return df.join(counts, id_col).withColumn("is_new", F.col("_c") == 1).drop("_c")
