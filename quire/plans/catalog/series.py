"""Series and attempt queries (WN-4..8, WN-10..12, WN-15, WN-17, WN-25, WN-27,
AG-23, AG-26, AG-36, JN-11, SC-18..20, SC-26, SC-32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.fmt import r6
from quire.operators import attempts as AT
from quire.operators import series as S
from quire.plans import derived as D
from quire.plans.registry import query

RUN_KEY = ["run", "dataset", "seed"]


@query("wn4_best_so_far_min", """
select run, dataset, seed, step, coalesce(min(val_loss) over w, 1e9) as best_before,
       val_loss < coalesce(min(val_loss) over w, 1e9) as improved
from d_runs window w as (partition by run, dataset, seed order by step rows between unbounded preceding and 1 preceding)""",
       ("d_runs",))
def wn4(t):
    out = S.best_so_far(D.d_runs(t), RUN_KEY, "step", "val_loss", "min")
    return out.select(*RUN_KEY, "step", "best_before", "improved")


@query("wn4_best_so_far_max", """
select run, dataset, seed, step, coalesce(max(val_acc) over w, 0.0) as best_before,
       val_acc > coalesce(max(val_acc) over w, 0.0) as improved
from d_runs window w as (partition by run, dataset, seed order by step rows between unbounded preceding and 1 preceding)""",
       ("d_runs",))
def wn4m(t):
    out = S.best_so_far(D.d_runs(t), RUN_KEY, "step", "val_acc", "max")
    return out.select(*RUN_KEY, "step", "best_before", "improved")


@query("wn5_first_crossing", """
select run, dataset, seed, coalesce(min(case when val_acc > 0.09 then step end), count(*)) as first_step
from d_runs group by run, dataset, seed""", ("d_runs",))
def wn5(t):
    out = S.first_crossing(D.d_runs(t), RUN_KEY, "step", "val_acc", 0.09)
    return out.select(*RUN_KEY, F.col("first_step").cast("long").alias("first_step"))


@query("wn6_phase_changes", """
select user_id, event_id, event_type from (
  select user_id, event_id, event_type, coalesce(case when event_type = 'view' then null else event_type end, 'full1') as ph,
         lag(coalesce(case when event_type = 'view' then null else event_type end, 'full1')) over (partition by user_id order by event_id) as prev
  from events) where prev is not null and prev <> ph""")
def wn6(t):
    ev = t.events.select("user_id", "event_id", "event_type",
                         F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("event_type")).alias("phase"))
    return S.phase_changes(ev, ["user_id"], "event_id", "phase").select("user_id", "event_id", "event_type")


def _smooth_sql(w: int, name: str) -> str:
    kern = "cast([" + ", ".join(repr(x) for x in S.kernel(name, w)) + "] as double[])"
    return f"""
WITH s AS (select run, dataset, seed, list(val_loss order by step) as x from d_runs group by run, dataset, seed),
r AS (select run, dataset, seed, x, len(x) as n, least({w - 1}, len(x) - 1) as L from s),
p AS (select run, dataset, seed, list_concat(list_reverse(x[2:L + 1]), x, list_reverse(x[n - L:n - 1])) as sx from r)
select run, dataset, seed, k, round(list_sum(list_transform(range({w}), lambda j: {kern}[j + 1] * sx[k + {w} - j])), 6) as smoothed
from p cross join lateral (select unnest(range(len(p.sx) - {w - 1})) as k) q"""


@query("wn7_smooth_hanning", _smooth_sql(10, "hanning"), ("d_runs",))
def wn7(t):
    out = S.smooth(D.d_runs(t), RUN_KEY, "step", "val_loss", 10, "hanning")
    return out.select(*RUN_KEY, "k", r6("smoothed").alias("smoothed"))


@query("wn7_smooth_flat", _smooth_sql(5, "flat"), ("d_runs",))
def wn7f(t):
    out = S.smooth(D.d_runs(t), RUN_KEY, "step", "val_loss", 5, "flat")
    return out.select(*RUN_KEY, "k", r6("smoothed").alias("smoothed"))


def _epoch_batches(t):
    return t.lineitem.groupBy(F.col("l_linenumber").alias("epoch"), F.col("l_orderkey").alias("bkey")).agg(
        F.avg("l_discount").alias("loss"), F.count("*").alias("n"),
        F.sum((F.col("l_returnflag") == "R").cast("long")).alias("correct"))


@query("wn8_running_mean", """
WITH b AS (select l_linenumber as epoch, l_orderkey as bkey, avg(l_discount) as loss, count(*) as n,
                  sum(case when l_returnflag = 'R' then 1 else 0 end) as correct from lineitem group by all),
r AS (select epoch, row_number() over w - 1 as batch_idx, sum(loss) over w as l, sum(correct) over w as c, sum(n) over w as tot
      from b window w as (partition by epoch order by bkey rows between unbounded preceding and current row))
select epoch, batch_idx, round(l / (batch_idx + 1), 9) as loss, round(100.0 * c / tot, 6) as acc from r where batch_idx % 50 = 0""")
def wn8(t):
    out = S.running_mean(_epoch_batches(t), ["epoch"], "bkey", "loss", "n", "correct", every=50)
    return out.select("epoch", "batch_idx", F.round("loss", 9).alias("loss"), r6("acc").alias("acc"))


@query("wn10_cumulative_product", """
select paper_id, field, reviewer, round(product(x) over (partition by paper_id, field order by reviewer rows between unbounded preceding and current row), 9) as cumprod,
       round(coalesce(product(x) over (partition by paper_id, field order by reviewer rows between unbounded preceding and 1 preceding), 1.0), 9) as cumprod_prev
from (select paper_id, field, reviewer, score / 10.0 as x from d_scores)""", ("d_scores",))
def wn10(t):
    s = D.d_scores(t).select("paper_id", "field", "reviewer", (F.col("score") / 10.0).alias("x"))
    a = S.cumulative_product(s, ["paper_id", "field"], "reviewer", "x", name="cumprod")
    b = S.cumulative_product(a, ["paper_id", "field"], "reviewer", "x", shift=True, name="cumprod_prev")
    return b.select("paper_id", "field", "reviewer", F.round("cumprod", 9).alias("cumprod"),
                    F.round("cumprod_prev", 9).alias("cumprod_prev"))


@query("wn11_volume_composite", """
WITH a AS (select mol, atom, 1 - exp(-(x / 10) * 0.1) as alpha, y / 10 as v from d_points),
b AS (select *, coalesce(product(1 - alpha + 1e-10) over (partition by mol order by atom rows between unbounded preceding and 1 preceding), 1.0) as tr from a)
select mol, round(sum(alpha * tr), 9) as acc_map, round(least(greatest(sum(alpha * tr * v), 0.0), 1.0), 9) as v from b group by mol""",
       ("d_points",))
def wn11(t):
    p = D.d_points(t).select("mol", "atom", (F.col("x") / 10).alias("sigma"), F.lit(0.1).alias("dist"),
                             (F.col("y") / 10).alias("v"))
    out = S.composite(p, "mol", "atom", "sigma", "dist", ["v"])
    return out.select("mol", F.round("acc_map", 9).alias("acc_map"), F.round("v", 9).alias("v"))


@query("wn12_future_window_label", """
select cell, day, label from (
  select cell, day, coalesce(max(case when value > 100 then 1 else 0 end) over (partition by cell order by day range between 2 following and 5 following), 0) as label
  from d_grid) where day < (select max(day) + 1 from d_grid) - 6""", ("d_grid",))
def wn12(t):
    out = S.future_label(D.d_grid(t), "cell", "day", "value", 100.0, lo=2, hi=6)
    return out.select("cell", "day", F.col("label").cast("int").alias("label"))


@query("wn17_adjacent_gaps", """
select mol, atom, coalesce(lead(x) over (partition by mol order by atom) - x, 1e10) * 2.0 as gap from d_points""", ("d_points",))
def wn17(t):
    return S.gaps(D.d_points(t), ["mol"], "atom", "x", pad=1e10, scale=2.0).select("mol", "atom", "gap")


EMA_PARAMS = dict(beta=0.995, update_after=20, update_every=5, inv_gamma=1.0, power=2 / 3, min_value=0.0)


@query("wn25_ema", f"""
WITH RECURSIVE ev AS (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 as k from events),
m AS (select user_id, k, value,
   greatest(k + 1 - 20 - 1, 0)::double as ep from ev),
m2 AS (select user_id, k, value,
   case when k % 5 <> 0 then 1.0::double
        when k <= 20 or k = 25 or ep <= 0 then 0.0::double
        else least(greatest(1 - pow(1 + ep / 1.0, -{2 / 3!r}), 0.0), 0.995) end as A from m),
m3 AS (select user_id, k, value, A, case when k % 5 <> 0 then 0.0::double when A = 0.0 then value else (1 - A) * value end as C from m2),
r(user_id, k, e) AS (
   select user_id, k, A * value + C from m3 where k = 0
   union all
   select m3.user_id, m3.k, m3.A * r.e + m3.C from r join m3 on m3.user_id = r.user_id and m3.k = r.k + 1)
select r.user_id, r.k as step, m3.value, round(r.e, 9) as ema from r join m3 on r.user_id = m3.user_id and r.k = m3.k""")
def wn25(t):
    out = S.ema(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value", **EMA_PARAMS)
    return out.select("user_id", "step", "value", F.round("ema", 9).alias("ema"))


@query("wn27_topk_softmax", """
WITH k AS (select doc_id, label, score / 0.5 as s from (select *, rank() over (partition by doc_id order by score desc) as r from d_clf) where r <= 2),
e AS (select doc_id, label, exp(s - max(s) over (partition by doc_id)) as e from k)
select doc_id, label, round(e / sum(e) over (partition by doc_id), 9) as prob from e""",
       ("d_clf",))
def wn27(t):
    out = S.topk_softmax(D.d_clf(t), "doc_id", "label", "score", k=2, temperature=0.5)
    return out.select("doc_id", "label", F.round("prob", 9).alias("prob"))


@query("ag23_peak_summary", """
select user_id, arg_min(event_id, (-value, event_id)) as peak_step, max(value) as peak, arg_max(value, event_id) as last_value
from events group by user_id""")
def ag23(t):
    return S.peak(t.events.select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")


@query("ag26_block_mean", """
select run, dataset, seed, cast(case when step = 0 then -1 else (step - 1) // 10 end as bigint) as block, round(avg(val_loss), 6) as mean, max(step) as last_step
from d_runs group by run, dataset, seed, case when step = 0 then -1 else (step - 1) // 10 end""", ("d_runs",))
def ag26(t):
    out = S.block_mean(D.d_runs(t), RUN_KEY, "step", "val_loss", 10)
    return out.select(*RUN_KEY, F.col("block").cast("long").alias("block"), r6("mean").alias("mean"), "last_step")


def _mod_sql(op: str) -> str:
    if op == "add":
        expr, where = "(a + b) % 97", ""
    elif op == "sub":
        expr, where = "((a - b) % 97 + 97) % 97", ""
    else:
        # b^(95) mod 97 by repeated squaring over the bits of 95
        expr = "(a * {}) % 97".format(_pow_sql("b", 95, 97))
        where = "where b <> 0"
    return f"""select a, b, {expr} as c from (select n_nationkey::bigint as a, unnest(range(97))::bigint as b from nation) {where}"""


def _pow_sql(b: str, e: int, p: int) -> str:
    result, base = "1", f"({b} % {p})"
    while e > 0:
        if e & 1:
            result = f"(({result}) * ({base})) % {p}"
        base = f"(({base}) * ({base})) % {p}"
        e >>= 1
    return result


@query("jn11_operation_table_add", _mod_sql("add"))
def jn11a(t):
    out = S.operation_table(t.nation.select(F.col("n_nationkey").cast("long").alias("k")), "k", 97, "add")
    return out.select("a", F.col("b").cast("long").alias("b"), F.col("c").cast("long").alias("c"))


@query("jn11_operation_table_sub", _mod_sql("sub"))
def jn11s(t):
    out = S.operation_table(t.nation.select(F.col("n_nationkey").cast("long").alias("k")), "k", 97, "sub")
    return out.select("a", F.col("b").cast("long").alias("b"), F.col("c").cast("long").alias("c"))


@query("jn11_operation_table_div", _mod_sql("div"))
def jn11d(t):
    out = S.operation_table(t.nation.select(F.col("n_nationkey").cast("long").alias("k")), "k", 97, "div")
    return out.select("a", F.col("b").cast("long").alias("b"), F.col("c").cast("long").alias("c"))


@query("jn11_two_sets_div", f"""
WITH a AS (select row_number() over (order by p_size) - 1 as i, p_size as a from (select distinct p_size from part)),
b AS (select row_number() over (order by n_nationkey) - 1 as j, n_nationkey as b from (select distinct n_nationkey from nation where n_nationkey <> 0))
select i * (select count(*) from b) + j as idx, a::bigint as a, b::bigint as b, (a * {_pow_sql("b", 95, 97)}) % 97 as c from a, b""")
def jn11two(t):
    """Division table of two different element sets, zero left out of the second."""
    first = S.ordered_set(t.part.select(F.col("p_size").cast("long").alias("x")), "x")
    second = S.ordered_set(t.nation.select(F.col("n_nationkey").cast("long").alias("x")), "x")
    return S.pair_table(first, second, lambda a, b: S.mod_div(a, b, 97), allowed=lambda x: x != 0)


PERMS_SQL = """perms AS (select row_number() over (order by a, b, c, d, e) - 1 as r, [a, b, c, d, e] as p from
  (select unnest(range(5)) as a), (select unnest(range(5)) as b), (select unnest(range(5)) as c), (select unnest(range(5)) as d), (select unnest(range(5)) as e)
  where len(list_distinct([a, b, c, d, e])) = 5)"""


@query("jn11_permutation_table", f"""
WITH {PERMS_SQL},
one AS (select distinct p_partkey % 120 as r from part), two AS (select distinct l_suppkey % 120 as r from lineitem),
a AS (select row_number() over (order by r) - 1 as i, perms.* from one join perms using (r)),
b AS (select row_number() over (order by r) - 1 as j, perms.* from two join perms using (r)),
t AS (select i * (select count(*) from b) + j as idx, a.p as a, b.p as b, list_transform(b.p, lambda x: a.p[x + 1]) as c from a, b)
select idx, array_to_string(a, ',') as a, array_to_string(b, ',') as b, array_to_string(t.c, ',') as c, cast(z.r as bigint) as c_rank
from t join perms z on z.p = t.c""")
def jn11perm(t):
    """Composition table of two sets of permutations of five, each given by numbers."""
    first = S.ordered_set(t.part.select((F.col("p_partkey") % 120).alias("x")), "x")
    second = S.ordered_set(t.lineitem.select((F.col("l_suppkey") % 120).alias("x")), "x")
    out = S.pair_table(first, second, lambda a, b: S.compose(S.unrank(a, 5), S.unrank(b, 5)))
    text = {"a": S.unrank(F.col("a"), 5), "b": S.unrank(F.col("b"), 5), "c": F.col("c")}
    return out.withColumn("c_rank", S.rank_of(F.col("c"), 5)).select("idx", *[F.array_join(x, ",").alias(n) for n, x in text.items()], "c_rank")


@query("jn11_fetch_example", f"""
WITH {PERMS_SQL},
i AS (select l_orderkey, l_linenumber, (l_orderkey * 131 + l_partkey * 7 + l_suppkey) % 14400 as idx from lineitem),
e AS (select l_orderkey, l_linenumber, idx, a.p as a, b.p as b, list_transform(b.p, lambda x: a.p[x + 1]) as c
      from i join perms a on a.r = idx // 120 join perms b on b.r = idx % 120)
select l_orderkey, l_linenumber, idx, array_to_string(a, ',') as a, array_to_string(b, ',') as b, array_to_string(e.c, ',') as c, cast(z.r as bigint) as c_rank
from e join perms z on z.p = e.c""")
def jn11fetch(t):
    """Training pairs by index: one equation of the table of five per line item."""
    li = t.lineitem.select("l_orderkey", "l_linenumber",
                           ((F.col("l_orderkey") * 131 + F.col("l_partkey") * 7 + F.col("l_suppkey")) % 14400).alias("idx"))
    a, b, c = S.permutation_example(F.col("idx"), 5)
    e = li.select("*", a.alias("a"), b.alias("b"), c.alias("c")).withColumn("c_rank", S.rank_of(F.col("c"), 5))
    return e.select("l_orderkey", "l_linenumber", "idx", *[F.array_join(x, ",").alias(x) for x in ("a", "b", "c")], "c_rank")


@query("sc20_permutation_compose", """
select p_partkey, array_to_string(list_transform(b, lambda i: a[i + 1]), ',') as composed from (
  select p_partkey, list_transform(range(5), lambda i: (i + p_partkey) % 5) as a,
         list_transform(range(5), lambda i: (i * 2 + p_size) % 5) as b from part)""")
def sc20(t):
    seq = F.sequence(F.lit(0), F.lit(4)).cast("array<long>")
    a = F.transform(seq, lambda i: F.pmod(i + F.col("p_partkey"), F.lit(5)))
    b = F.transform(seq, lambda i: F.pmod(i * 2 + F.col("p_size"), F.lit(5)))
    return t.part.select("p_partkey", F.array_join(S.compose(a, b), ",").alias("composed"))


@query("sc32_noise_schedule_mix", """
WITH s AS (select t, 0.0001 + (0.02 - 0.0001) * t / 99.0 as beta from (select unnest(range(100)) as t)),
c AS (select t, product(1 - beta) over (order by t rows between unbounded preceding and current row) as ac from s),
x AS (select l_orderkey % 100 as t, l_discount as x, l_tax as eps from lineitem)
select x.t, count(*) as n, round(avg(sqrt(c.ac) * x.x + sqrt(1 - c.ac) * x.eps), 9) as mean_noisy from x join c on x.t = c.t group by x.t""")
def sc32(t):
    sched = S.noise_schedule(t.spark, 100, "linear")
    x = t.lineitem.select((F.col("l_orderkey") % 100).cast("int").alias("t"), F.col("l_discount").alias("x"),
                          F.col("l_tax").alias("eps"))
    out = S.mix(x, sched, "t", "x", "eps")
    return out.groupBy(F.col("t").cast("long").alias("t")).agg(F.count("*").alias("n"),
                                                                F.round(F.avg("noisy"), 9).alias("mean_noisy"))


@query("sc32_quadratic_schedule", """
select t, round(beta, 12) as beta, round(product(1 - beta) over (order by t rows between unbounded preceding and current row), 9) as alphas_cumprod
from (select t, pow(sqrt(0.0001) + (sqrt(0.02) - sqrt(0.0001)) * t / (select count(distinct l_linenumber) - 1 from lineitem), 2) as beta
      from (select unnest(range((select count(distinct l_linenumber) from lineitem))) as t))""")
def sc32q(t):
    n = t.lineitem.agg(F.count_distinct("l_linenumber")).first()[0]
    sched = S.noise_schedule(t.spark, n, "quadratic")
    return sched.select(F.col("t").cast("long").alias("t"), F.round("beta", 12).alias("beta"),
                        F.round("alphas_cumprod", 9).alias("alphas_cumprod"))


# ------------------------------------------------------------------ attempts

ATTEMPT_SQL = """
WITH RECURSIVE ev AS (select idea_id, seq, ok, row_number() over (partition by idea_id order by seq) as i from d_attempts),
sm(idea_id, i, run, it, state, stop_seq) AS (
  select distinct idea_id, 0::bigint, 1, 0, 'open', null::bigint from d_attempts
  union all
  select sm.idea_id, ev.i,
    case when ev.ok = 1 then sm.run + 1 else sm.run end,
    case when ev.ok = 1 then 1 else sm.it + 1 end,
    case when ev.ok = 1 and sm.run + 1 = 3 then 'success' when ev.ok = 0 and sm.it + 1 >= 4 then 'fail' else 'open' end,
    ev.seq
  from sm join ev on ev.idea_id = sm.idea_id and ev.i = sm.i + 1 where sm.state = 'open')
select idea_id, state as outcome, case when state = 'open' then null else stop_seq end as stop_seq
from (select *, row_number() over (partition by idea_id order by i desc) as rn from sm) where rn = 1"""


@query("wn15_attempt_outcome", ATTEMPT_SQL, ("d_attempts",))
def wn15(t):
    return AT.outcome(D.d_attempts(t), "idea_id", "seq", "ok", max_runs=2, max_iters=4)


STAGES_SQL = """stages AS (select user_id, case event_id % 4 when 0 then 'experiments' when 1 then 'writeup' when 2 then 'review' else 'improvement' end as stage,
  min(case when event_type in ('view', 'click') then 1 else 0 end) as ok from events group by all)"""


def _stages(t):
    ev = t.events
    stage = (F.when(F.col("event_id") % 4 == 0, "experiments").when(F.col("event_id") % 4 == 1, "writeup")
             .when(F.col("event_id") % 4 == 2, "review").otherwise("improvement"))
    return ev.groupBy("user_id", stage.alias("stage")).agg(
        F.min(F.when(F.col("event_type").isin("view", "click"), 1).otherwise(0)).alias("ok"))


@query("ag36_stage_funnel", f"""
WITH {STAGES_SQL},
f AS (select user_id, coalesce(arg_min(stage, case stage when 'experiments' then 1 when 'writeup' then 2 when 'review' then 3 else 4 end) filter (where ok = 0), 'completed') as failed_stage
      from stages group by user_id)
select failed_stage, count(*) as n from f group by failed_stage""")
def ag36(t):
    first = AT.stage_funnel(_stages(t), "user_id", "stage", "ok")
    return AT.funnel_counts(first)


@query("sc18_error_tail", """
select doc_id, cast(length(e) as integer) as tail_len, md5(e) as tail_md5 from (
  select doc_id, case when length(text) > 1500 then '...' || substring(text, length(text) - 1499, 1500) else text end as e from documents)""")
def sc18(t):
    e = AT.error_tail(F.col("text"), 1500)
    return t.documents.select("doc_id", F.length(e).alias("tail_len"), F.md5(e).alias("tail_md5"))


@query("sc26_run_identifier", """
select event_id, id, count(*) over (partition by id) = 1 as is_new from (
  select event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_idea_' || cast(user_id as varchar) as id from events)""")
def sc26(t):
    ev = t.events.select("event_id", AT.run_id(F.col("ts"), F.concat(F.lit("idea_"), F.col("user_id").cast("string")))
                         .alias("id"))
    return AT.check_new(ev, "id").select("event_id", "id", "is_new")


@query("sc19_modular_ops", f"""
select l_orderkey, l_linenumber, (a + b) % 97 as add_ab, ((a - b) % 97 + 97) % 97 as sub_ab,
       case when b <> 0 then (a * {_pow_sql("b", 95, 97)}) % 97 end as div_ab
from (select l_orderkey, l_linenumber, l_partkey % 97 as a, l_suppkey % 97 as b from lineitem)""")
def sc19(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 97).alias("a"),
                           (F.col("l_suppkey") % 97).alias("b"))
    a, b = F.col("a"), F.col("b")
    return li.select("l_orderkey", "l_linenumber", S.mod_add(a, b, 97).alias("add_ab"),
                     S.mod_sub(a, b, 97).alias("sub_ab"), F.when(b != 0, S.mod_div(a, b, 97)).alias("div_ab"))
