"""Streaming twins: each drains a file stream built from the driver tables
and must equal its batch twin (same oracle statement)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.fmt import r6
from quire.plans import derived as D
from quire.plans.catalog.gate import _verdict_sql
from quire.plans.catalog.series import ATTEMPT_SQL
from quire.plans.registry import query
from quire.streaming import jobs as J


def _at(number: str):
    """Event time: so many seconds after the start."""
    return (F.lit(1704067200) + F.col(number)).cast("timestamp")


@query("ss2_streaming_gate", f"WITH {_verdict_sql('d_papers')}\nselect doc_id, is_paper, confidence, reason from v",
       ("d_papers",))
def ss2(t):
    return J.gate(t.spark, D.d_papers(t)).select("doc_id", "is_paper", "confidence", "reason")


@query("ss3_streaming_attempts", ATTEMPT_SQL, ("d_attempts",))
def ss3(t):
    out = J.attempts(t.spark, D.d_attempts(t).withColumn("ts", _at("seq")))
    return out.results.select("idea_id", "outcome", "stop_seq")


@query("ss4_streaming_run_stats", """
select run, dataset, step, round(avg(val_loss), 6) as mean, round(stddev_pop(val_loss) / count(val_loss), 6) as stderr,
       count(val_loss) as n
from d_runs group by run, dataset, step""", ("d_runs",))
def ss4(t):
    out = J.run_stats(t.spark, D.d_runs(t))
    return out.select("run", "dataset", "step", r6("mean").alias("mean"), r6("stderr").alias("stderr"), "n")


@query("ss5_streaming_first_decision", """
WITH d AS (select item_id, round, case when contains(lower(text), 'decision made: novel') then true
                                       when contains(lower(text), 'decision made: not novel') then false end as dec
           from d_responses where round <= 10),
f AS (select item_id, dec from d where dec is not null
      qualify row_number() over (partition by item_id order by round) = 1)
select i.item_id, coalesce(f.dec, false) as novel
from (select distinct item_id from d_responses) i left join f on i.item_id = f.item_id""", ("d_responses",))
def ss5(t):
    r = D.d_responses(t).withColumn("ts", _at("round"))
    dup = r.where(F.col("round") == 1)  # re-delivered replies: must be dropped
    out = J.first_decision(t.spark, r.unionByName(dup), watermark="1 hour")
    return out.results.select("item_id", "novel")


@query("ss1_streaming_assemble", """
WITH last AS (select resp_id, max(pos) as last_pos from d_chunks where ends_with(chunk, '<|eot_id|>') group by resp_id)
select c.resp_id, md5(replace(string_agg(c.chunk, '' order by c.pos), '<|eot_id|>', '')) as text_md5, l.last_pos
from d_chunks c join last l on c.resp_id = l.resp_id and c.pos <= l.last_pos group by c.resp_id, l.last_pos""", ("d_chunks",))
def ss1(t):
    out = J.assemble(t.spark, D.d_chunks(t).withColumn("ts", _at("pos")))
    return out.results.select("resp_id", F.md5("text").alias("text_md5"), "last_pos")
