"""Run-summary queries (flagship E4 path, seed statistics, curves, labels)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.fmt import num_list, r6
from quire.operators import runs as R
from quire.operators import series as S
from quire.plans import derived as D
from quire.plans.joins import literal_table
from quire.plans.registry import query

# Run labels used by the reports.
RUN_LABELS = [("run_0", "Baseline"), ("run_1", "Variant A"), ("run_2", "Variant B")]
LABEL_SCHEMA = T.StructType([T.StructField("run", T.StringType()), T.StructField("label", T.StringType())])
SQL_LABELS = "labels_t(run, label) AS (VALUES ('run_0', 'Baseline'), ('run_1', 'Variant A'), ('run_2', 'Variant B'))"


def _labels(spark, rows=RUN_LABELS):
    return literal_table(spark, rows, LABEL_SCHEMA)


def flagship_report(t):
    """Best validation loss per seed -> mean/stderr per run and data set -> labelled."""
    runs = D.d_runs(t)
    per_seed = runs.groupBy("run", "dataset", "seed").agg(
        F.min("val_loss").alias("best_val_loss"),
        F.min_by("step", F.struct("val_loss", "step")).alias("best_step"),
        S.first_crossing_agg("step", F.col("val_acc") >= 0.09, default=50).alias("first_step_acc"),
    )
    stats = per_seed.groupBy("run", "dataset").agg(
        F.count("*").alias("seeds"),
        F.avg("best_val_loss").alias("mean"),
        (F.stddev_pop("best_val_loss") / F.count("*")).alias("stderr"),
        F.avg("first_step_acc").alias("mean_first_step"),
    )
    return R.label_runs(stats, _labels(t.spark)).select(
        "label", "dataset", "seeds", r6("mean").alias("mean"), r6("stderr").alias("stderr"),
        r6("mean_first_step").alias("mean_first_step"))


FLAGSHIP_SQL = f"""
WITH per_seed AS (
  select run, dataset, seed, min(val_loss) as best_val_loss,
         coalesce(min(case when val_acc >= 0.09 then step end), 50) as first_step_acc
  from d_runs group by run, dataset, seed),
per_run AS (
  select run, dataset, count(*) as seeds, avg(best_val_loss) as mean,
         stddev_pop(best_val_loss) / count(*) as stderr, avg(first_step_acc) as mean_first_step
  from per_seed group by run, dataset),
{SQL_LABELS}
select l.label, p.dataset, p.seeds, round(p.mean, 6) as mean, round(p.stderr, 6) as stderr,
       round(p.mean_first_step, 6) as mean_first_step
from per_run p join labels_t l on p.run = l.run
"""

query("flagship_run_report", FLAGSHIP_SQL, ("d_runs",))(flagship_report)


@query("ag3_seed_stats_n", """
select run, dataset, step, round(avg(val_loss), 6) as mean, round(stddev_pop(val_loss) / count(val_loss), 6) as stderr,
       count(val_loss) as n
from d_runs group by run, dataset, step""", ("d_runs",))
def ag3(t):
    s = R.seed_stats(D.d_runs(t), ["run", "dataset", "step"], "val_loss", stderr="n")
    return s.select("run", "dataset", "step", r6("mean").alias("mean"), r6("stderr").alias("stderr"), "n")


@query("ag4_seed_stats_sqrt_n", """
select run, dataset, step, round(avg(val_acc), 6) as mean, round(stddev_pop(val_acc) / sqrt(count(val_acc)), 6) as stderr,
       count(val_acc) as n
from d_runs group by run, dataset, step""", ("d_runs",))
def ag4(t):
    s = R.seed_stats(D.d_runs(t), ["run", "dataset", "step"], "val_acc", stderr="sqrt_n")
    return s.select("run", "dataset", "step", r6("mean").alias("mean"), r6("stderr").alias("stderr"), "n")


@query("ag5_group_mean_sample_std", """
select run, dataset, seed, round(avg(val_loss), 6) as mean, round(stddev_samp(val_loss), 6) as std, count(val_loss) as n
from d_runs group by run, dataset, seed""", ("d_runs",))
def ag5(t):
    s = R.seed_stats(D.d_runs(t), ["run", "dataset", "seed"], "val_loss", stderr="sample_std")
    return s.select("run", "dataset", "seed", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query("ag6_single_run_summary", """
select run, seed, dataset, step, round(avg(val_loss), 6) as mean, cast(0.0 as double) as stderr
from d_runs group by run, seed, dataset, step""", ("d_runs",))
def ag6(t):
    # every (run, seed) pair is one single-seed run: same layout, stderr 0.0
    s = R.single_run(D.d_runs(t), ["run", "seed", "dataset", "step"], "val_loss")
    return s.select("run", "seed", "dataset", "step", r6("mean").alias("mean"), "stderr")


@query("ag7_seed_values", """
select run, dataset, step,
  array_to_string(list_transform(list(val_loss order by seed), lambda x: cast(cast(round(x, 6) as decimal(30,6)) as varchar)), ',') as seed_values
from d_runs group by run, dataset, step""", ("d_runs",))
def ag7(t):
    s = R.seed_values(D.d_runs(t), ["run", "dataset", "step"], "seed", "val_loss")
    return s.select("run", "dataset", "step", num_list(F.col("values")).alias("seed_values"))


CURVE_SQL = """
WITH pos AS (
  select run, dataset, seed, step, val_loss,
         row_number() over (partition by run, dataset, seed order by step) as pos
  from d_runs {filter}),
lens AS (select run, dataset, min(c) as minlen from (select run, dataset, seed, count(*) as c from pos group by all) group by all)
select p.run, p.dataset, cast(p.pos as int) as pos, arg_min(p.step, p.seed) as x, round(avg(p.val_loss), 6) as mean,
       round(stddev_pop(p.val_loss) / sqrt(count(p.val_loss)), 6) as stderr, count(p.val_loss) as n
from pos p join lens l on p.run = l.run and p.dataset = l.dataset
where {trunc}
group by p.run, p.dataset, p.pos
"""


def _curve(t, truncate, where=None):
    log = D.d_runs(t)
    if where is not None:
        log = log.where(where)
    band = R.curve_band(log, ["run", "dataset"], "seed", "step", "val_loss", truncate=truncate)
    return band.select("run", "dataset", F.col("pos").cast("int").alias("pos"), "x",
                       r6("mean").alias("mean"), r6("stderr").alias("stderr"), "n")


@query("ag8_curve_band", CURVE_SQL.format(filter="", trunc="true"), ("d_runs",))
def ag8(t):
    return _curve(t, False)


@query("ag9_curve_band_truncated",
       CURVE_SQL.format(filter="where not (seed = 1 and step > 40)", trunc="p.pos <= l.minlen"),
       ("d_runs",))
def ag9(t):
    return _curve(t, True, ~((F.col("seed") == 1) & (F.col("step") > 40)))


@query("ag10_zero_filled_curve", """
select a.run, a.dataset, a.seed, a.step, coalesce(l.val_acc, 0.0) as val_acc
from (select run, dataset, seed, step from d_runs) a
left join (select run, dataset, seed, step, val_acc from d_runs where val_acc > 0.08) l
  on a.run = l.run and a.dataset = l.dataset and a.seed = l.seed and a.step = l.step""", ("d_runs",))
def ag10(t):
    runs = D.d_runs(t)
    axis = runs.select("run", "dataset", "seed", "step")
    log = runs.where(F.col("val_acc") > 0.08)
    return R.fill_curve(log, axis, ["run", "dataset", "seed"], "step", "val_acc")


@query("jn1_label_runs", f"""
WITH {SQL_LABELS}
select l.label, r.dataset, r.seed, r.step, r.val_loss from d_runs r join labels_t l on r.run = l.run""", ("d_runs",))
def jn1(t):
    return R.label_runs(D.d_runs(t), _labels(t.spark)).select("label", "dataset", "seed", "step", "val_loss")


@query("jn2_label_or_name", """
WITH labels_t(run, label) AS (VALUES ('run_0', 'Baseline'), ('run_2', 'Variant B'))
select coalesce(l.label, r.run) as label, r.dataset, count(*) as n, round(avg(r.val_loss), 6) as mean_loss
from d_runs r left join labels_t l on r.run = l.run group by all""", ("d_runs",))
def jn2(t):
    labelled = R.label_or_name(D.d_runs(t), _labels(t.spark, [RUN_LABELS[0], RUN_LABELS[2]]))
    return labelled.groupBy("label", "dataset").agg(F.count("*").alias("n"), r6(F.avg("val_loss")).alias("mean_loss"))


LOG_KEYS_SQL = """log_keys AS (select distinct concat(lower(dataset), '_', cast(seed as varchar), '_',
  case when step % 2 = 0 then 'val_info' else 'train_info' end) as key from d_runs)"""


def _log_keys(t):
    runs = D.d_runs(t)
    kind = F.when(F.col("step") % 2 == 0, F.lit("val_info")).otherwise(F.lit("train_info"))
    return runs.select(F.concat(F.lower("dataset"), F.lit("_"), F.col("seed").cast("string"), F.lit("_"), kind)
                       .alias("key")).distinct()


@query("jn3_match_log_keys", f"""
WITH {LOG_KEYS_SQL}, ds AS (select distinct lower(dataset) as dataset from d_runs)
select k.key, d.dataset from log_keys k join ds d on contains(k.key, d.dataset) and contains(k.key, 'val_info')""",
       ("d_runs",))
def jn3(t):
    ds = D.d_runs(t).select(F.lower("dataset").alias("dataset")).distinct()
    return R.match_keys(_log_keys(t), ds).select("key", "dataset")


@query("jn3_match_log_keys_strict", f"""
WITH {LOG_KEYS_SQL}, ds AS (select distinct lower(dataset) as dataset from d_runs)
select k.key, d.dataset from log_keys k join ds d on split_part(k.key, '_', 1) = d.dataset
where k.key like '%\\_val\\_info' escape '\\'""", ("d_runs",))
def jn3s(t):
    ds = D.d_runs(t).select(F.lower("dataset").alias("dataset")).distinct()
    return R.match_keys(_log_keys(t), ds, strict=True).select("key", "dataset")


@query("sc22_parse_log_key", f"""
WITH {LOG_KEYS_SQL}
select key, split_part(key, '_', 1) as dataset, split_part(key, '_', 2) as seed,
       array_to_string(string_split(key, '_')[3:], '_') as kind from log_keys""", ("d_runs",))
def sc22(t):
    return _log_keys(t).select("key", R.parse_key(F.col("key")).alias("p")).select("key", "p.*")


@query("st6_distinct_seeds", f"""
WITH {LOG_KEYS_SQL}
select distinct split_part(key, '_', 2) as seed from log_keys""", ("d_runs",))
def st6(t):
    return R.seeds(_log_keys(t))


@query("jn7_wide_run_table", """
select p.run, p.dataset, p.seeds, t.mean_loss, m.max_acc
from (select run, dataset, count(distinct seed) as seeds from d_runs group by all) p
join (select run, dataset, round(avg(val_loss), 6) as mean_loss from d_runs group by all) t on p.run = t.run and p.dataset = t.dataset
join (select run, dataset, max(val_acc) as max_acc from d_runs group by all) m on p.run = m.run and p.dataset = m.dataset""",
       ("d_runs",))
def jn7(t):
    runs = D.d_runs(t)
    keys = ["run", "dataset"]
    params = runs.groupBy(*keys).agg(F.countDistinct("seed").alias("seeds"))
    train = runs.groupBy(*keys).agg(r6(F.avg("val_loss")).alias("mean_loss"))
    md = runs.groupBy(*keys).agg(F.max("val_acc").alias("max_acc"))
    return R.wide({"params": params, "train": train, "md": md}, keys)


@query("wn3_last_eval_record", """
select run, dataset, seed, step, val_loss, val_acc, phase from (
  select *, row_number() over (partition by run, dataset, seed order by step desc) as rn
  from d_runs where phase = 'full1') where rn = 1""", ("d_runs",))
def wn3(t):
    out = R.last_record(D.d_runs(t), ["run", "dataset", "seed"], "step", mode_col="phase", mode="full1")
    return out.select("run", "dataset", "seed", "step", "val_loss", "val_acc", "phase")


@query("pf10_thin_steps", """
select run, dataset, seed, step, val_loss from d_runs where step % 10 = 0
union all select run, dataset, seed, step, val_loss from d_runs where step % 10 = 9""", ("d_runs",))
def pf10(t):
    runs = D.d_runs(t)
    cols = ["run", "dataset", "seed", "step", "val_loss"]
    return R.thin(runs, "step", 10).select(*cols).unionByName(R.thin(runs, "step", 10, r=9).select(*cols))


METRIC_LONG_SQL = """long_t AS (
  select run, dataset, seed, step, 'val_loss' as metric, cast(val_loss as varchar) as value from d_runs
  union all select run, dataset, seed, step, 'val_acc', cast(val_acc as varchar) from d_runs
  union all select run, dataset, seed, step, 'phase', phase from d_runs)"""


def _metric_long(t):
    runs = D.d_runs(t).select("run", "dataset", "seed", "step", F.col("val_loss").cast("string").alias("val_loss"),
                              F.col("val_acc").cast("string").alias("val_acc"), "phase")
    return runs.unpivot(["run", "dataset", "seed", "step"], ["val_loss", "val_acc", "phase"], "metric", "value")


@query("pf14_numeric_metrics_only", f"""
WITH {METRIC_LONG_SQL},
firsts AS (select metric, value from (select metric, value, row_number() over (partition by metric order by run, dataset, seed, step) as rn from long_t) where rn = 1)
select l.metric, count(*) as n, round(sum(try_cast(l.value as double)), 4) as total
from long_t l semi join firsts f on l.metric = f.metric and try_cast(f.value as double) is not null
group by l.metric""", ("d_runs",))
def pf14(t):
    long_t = _metric_long(t).withColumn("_o", F.struct("run", "dataset", "seed", "step"))
    kept = R.numeric_only(long_t, "metric", "_o", "value")
    return kept.groupBy("metric").agg(F.count("*").alias("n"),
                                      F.round(F.sum(F.col("value").try_cast("double")), 4).alias("total"))


@query("pf15_present_metric", """
select run, dataset, seed, step, acc from (
  select run, dataset, seed, step, case when phase = 'partial' then val_acc end as acc from d_runs) where acc is not null""",
       ("d_runs",))
def pf15(t):
    df = D.d_runs(t).select("run", "dataset", "seed", "step",
                            F.when(F.col("phase") == "partial", F.col("val_acc")).alias("acc"))
    return R.present(df, "acc")


@query("wn28_iteration_axis", """
select l_orderkey as epoch, cast(l_orderkey % 32 as int) as batch, l_orderkey * (1000 // 64) + l_orderkey % 32 as iteration
from lineitem""")
def wn28(t):
    df = t.lineitem.select(F.col("l_orderkey").alias("epoch"), (F.col("l_orderkey") % 32).cast("int").alias("batch"))
    return R.iteration_axis(df, "epoch", "batch", 1000, 64).select(
        "epoch", "batch", F.col("iteration").cast("long").alias("iteration"))


@query("st5_append_results", """
select run, dataset, round(avg(val_loss), 6) as mean, cast(null as varchar) as note from d_runs where phase = 'full1' group by all
union all select run, dataset, round(avg(val_loss), 6), 'extra' from d_runs where phase <> 'full1' group by all""", ("d_runs",))
def st5(t):
    runs = D.d_runs(t)
    a = runs.where(F.col("phase") == "full1").groupBy("run", "dataset").agg(r6(F.avg("val_loss")).alias("mean"))
    b = (runs.where(F.col("phase") != "full1").groupBy("run", "dataset").agg(r6(F.avg("val_loss")).alias("mean"))
         .withColumn("note", F.lit("extra")))
    return R.append(a, b)


@query("sc21_explode_means", """
select run, dataset, metric, round(value, 6) as value from (
  select run, dataset, 'val_loss' as metric, avg(val_loss) as value from d_runs group by all
  union all select run, dataset, 'val_acc', avg(val_acc) from d_runs group by all)""", ("d_runs",))
def sc21(t):
    runs = D.d_runs(t)
    per = runs.groupBy("run", "dataset").agg(
        F.struct(F.create_map(F.lit("val_loss"), F.avg("val_loss"), F.lit("val_acc"), F.avg("val_acc"))
                 .alias("means")).alias("s"))
    summaries = per.groupBy("run").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("dataset", "s")))).alias("final_info"))
    out = R.explode_means(summaries, "run", "final_info")
    return out.select("run", "dataset", "metric", r6("value").alias("value"))
