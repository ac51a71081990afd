"""Evaluation-metric queries (AG-11..18, AG-22, AG-25, AG-34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.fmt import r6
from quire.operators import evalmetrics as EM
from quire.plans import derived as D
from quire.plans.registry import query


def _batches(t):
    li = t.lineitem
    return li.groupBy((F.col("l_orderkey") % 200).alias("batch")).agg(
        F.avg("l_discount").alias("loss"), F.count("*").alias("n"),
        F.sum((F.col("l_returnflag") == "R").cast("long")).alias("correct"))


BATCHES_SQL = """batches AS (select l_orderkey % 200 as batch, avg(l_discount) as loss, count(*) as n,
  sum(case when l_returnflag = 'R' then 1 else 0 end) as correct from lineitem group by l_orderkey % 200)"""


@query("ag11_weighted_loss", f"""
WITH {BATCHES_SQL}
select 'first_50' as scope, round(sum(loss * n) / sum(n), 6) as loss, round(sum(correct) / sum(n), 6) as accuracy from batches where batch < 50
union all select 'all', round(sum(loss * n) / sum(n), 6), round(sum(correct) / sum(n), 6) from batches""")
def ag11(t):
    b = _batches(t)
    first = EM.weighted_loss(b, "loss", "n", "correct", order="batch", max_batches=50).withColumn("scope", F.lit("first_50"))
    every = EM.weighted_loss(b, "loss", "n", "correct").withColumn("scope", F.lit("all"))
    return first.unionByName(every).select("scope", r6("loss").alias("loss"), r6("accuracy").alias("accuracy"))


@query("ag12_batch_loss", f"""
WITH {BATCHES_SQL}
select round(avg(loss), 6) as loss, round(100.0 * sum(correct) / sum(n), 6) as accuracy_pct from batches""")
def ag12(t):
    out = EM.batch_loss(_batches(t), "loss", "n", "correct")
    return out.select(r6("loss").alias("loss"), r6("accuracy_pct").alias("accuracy_pct"))


@query("ag13_prefix_accuracy", """
select p_size % 5 as grp, round(avg(case when starts_with(p_name, case when p_partkey % 2 = 0 then split_part(p_name, ' ', 1) else p_brand end) then 1.0 else 0.0 end), 6) as accuracy
from part group by p_size % 5""")
def ag13(t):
    p = t.part
    target = F.when(F.col("p_partkey") % 2 == 0, F.split("p_name", " ").getItem(0)).otherwise(F.col("p_brand"))
    df = p.select((F.col("p_size") % 5).alias("grp"), F.col("p_name").alias("pred"), target.alias("target"))
    return EM.prefix_accuracy(df, "pred", "target", ["grp"]).select("grp", r6("accuracy").alias("accuracy"))


@query("ag14_argmax_accuracy", """
WITH pred AS (select doc_id, label from (select *, row_number() over (partition by doc_id order by score desc, label) as rn from d_clf) where rn = 1)
select round(avg(case when p.label = case when l.quality = 1 then 'scientific article' else 'news article' end then 1.0 else 0.0 end), 6) as accuracy,
       count(*) as n
from pred p join labels l on p.doc_id = l.doc_id""", ("d_clf",))
def ag14(t):
    truth = t.labels.select("doc_id", F.when(F.col("quality") == 1, "scientific article").otherwise("news article")
                            .alias("truth"))
    out = EM.argmax_accuracy(D.d_clf(t), truth, "doc_id", "label", "score", "truth")
    return out.select(r6("accuracy").alias("accuracy"), "n")


@query("ag15_exceedance_frequency", """
select cell, round(sum(case when value > 100 then 1.0 else 0.0 end) / (select count(distinct day) from d_grid), 6) as freq
from d_grid group by cell""", ("d_grid",))
def ag15(t):
    out = EM.exceedance(D.d_grid(t), "cell", "value", thr=100.0, time="day")
    return out.select("cell", r6("freq").alias("freq"))


AUC_SQL = """
WITH c AS (select {by} score, sum(y) as pos, sum(1 - y) as neg from d_scored group by {by} score),
r AS (select *, coalesce(sum(pos + neg) over ({part} order by score rows between unbounded preceding and 1 preceding), 0) as before from c)
select {by} round((sum(pos * (before + (pos + neg + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(neg)), 9) as roc_auc
from r {group}"""


@query("ag16_roc_auc", AUC_SQL.format(by="", part="", group=""), ("d_scored",))
def ag16(t):
    return EM.roc_auc(D.d_scored(t), "y", "score").select(F.round("roc_auc", 9).alias("roc_auc"))


@query("ag16_roc_auc_by_group", """
WITH s AS (select id % 2 as grp, y, score from d_scored),
c AS (select grp, score, sum(y) as pos, sum(1 - y) as neg from s group by grp, score),
r AS (select *, coalesce(sum(pos + neg) over (partition by grp order by score rows between unbounded preceding and 1 preceding), 0) as before from c)
select grp, round((sum(pos * (before + (pos + neg + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * sum(neg)), 9) as roc_auc
from r group by grp""", ("d_scored",))
def ag16g(t):
    df = D.d_scored(t).withColumn("grp", F.col("id") % 2)
    return EM.roc_auc(df, "y", "score", ["grp"]).select("grp", F.round("roc_auc", 9).alias("roc_auc"))


@query("ag17_average_precision", """
WITH c AS (select score, sum(y) as pos, sum(1 - y) as neg from d_scored group by score),
r AS (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as tp,
                sum(neg) over (order by score desc rows between unbounded preceding and current row) as fp from c)
select round(sum(pos / (select sum(pos) from c) * tp / (tp + fp)), 9) as average_precision from r""", ("d_scored",))
def ag17(t):
    return EM.average_precision(D.d_scored(t), "y", "score").select(
        F.round("average_precision", 9).alias("average_precision"))


@query("ag18_weighted_cross_entropy", """
WITH s AS (select y, 0.0::double as l0, score * 4 - 2 as l1 from d_scored),
n AS (select y, greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) - case when y = 0 then l0 else l1 end as nll,
             case when y = 0 then 1.0::double else 10000.0::double end as w from s)
select round(sum(w * nll) / sum(w), 9) as loss from n""", ("d_scored",))
def ag18(t):
    df = D.d_scored(t).select("y", F.lit(0.0).alias("l0"), (F.col("score") * 4 - 2).alias("l1"))
    return EM.weighted_log_loss(df, "y", ["l0", "l1"], [1.0, 10000.0]).select(F.round("loss", 9).alias("loss"))


@query("ag25_psnr_per_image", """
select img, round(avg(pow(l_discount - l_tax, 2)), 9) as mse, round(-10 * log10(avg(pow(l_discount - l_tax, 2))), 6) as psnr
from (select l_orderkey % 50 as img, l_discount, l_tax from lineitem) group by img""")
def ag25(t):
    px = t.lineitem.select((F.col("l_orderkey") % 50).alias("img"), "l_discount", "l_tax")
    per, _ = EM.psnr(px, "img", "l_discount", "l_tax")
    return per.select("img", F.round("mse", 9).alias("mse"), r6("psnr").alias("psnr"))


@query("ag25_psnr_mean", """
select round(avg(mse), 9) as mean_mse, round(avg(-10 * log10(mse)), 6) as mean_psnr from (
  select avg(pow(l_discount - l_tax, 2)) as mse from lineitem group by l_orderkey % 50)""")
def ag25m(t):
    px = t.lineitem.select((F.col("l_orderkey") % 50).alias("img"), "l_discount", "l_tax")
    _, mean = EM.psnr(px, "img", "l_discount", "l_tax")
    return mean.select(F.round("mean_mse", 9).alias("mean_mse"), r6("mean_psnr").alias("mean_psnr"))


@query("ag34_throughput", """
select l_returnflag, round(avg(l_quantity / (l_extendedprice / 1000)), 6) as tokens_per_second,
       round(avg(l_extendedprice / 1000), 6) as seconds_per_item
from lineitem group by l_returnflag""")
def ag34(t):
    df = t.lineitem.select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("secs"))
    out = EM.throughput(df, ["l_returnflag"], "l_quantity", "secs")
    return out.select("l_returnflag", r6("tokens_per_second").alias("tokens_per_second"),
                      r6("seconds_per_item").alias("seconds_per_item"))


OLS_SQL = """
WITH d AS (select l_extendedprice as y, l_quantity as x, l_discount as a, l_tax as b from lineitem),
m AS (select avg(y) as my, avg(x) as mx, avg(a) as ma, avg(b) as mb, count(*) as n,
             covar_pop(a, a) as saa, covar_pop(a, b) as sab, covar_pop(b, b) as sbb, covar_pop(a, x) as sax,
             covar_pop(b, x) as sbx, covar_pop(a, y) as say, covar_pop(b, y) as sby from d),
p AS (select *, (sax * sbb - sbx * sab) / (saa * sbb - sab * sab) as pxa, (sbx * saa - sax * sab) / (saa * sbb - sab * sab) as pxb,
                (say * sbb - sby * sab) / (saa * sbb - sab * sab) as pya, (sby * saa - say * sab) / (saa * sbb - sab * sab) as pyb from m),
r AS (select p.*, (d.x - mx) - pxa * (d.a - ma) - pxb * (d.b - mb) as rx, (d.y - my) - pya * (d.a - ma) - pyb * (d.b - mb) as ry from d, p),
k AS (select sum(rx * ry) / sum(rx * rx) as coef, sum(rx * rx) as sxx from r),
e AS (select sum(pow(r.ry - k.coef * r.rx, 2)) as sse from r, k)
select 'l_quantity' as regressor, round(k.coef, 4) as coef, round(sqrt(e.sse / (p.n - 4) / k.sxx), 4) as std_err,
       round(p.my - k.coef * p.mx - (p.pya - k.coef * p.pxa) * p.ma - (p.pyb - k.coef * p.pxb) * p.mb, 4) as intercept,
       p.n as n
from k, e, p"""


@query("ag22_ols_effect", OLS_SQL)
def ag22(t):
    """OLS of price on quantity given discount and tax (one aggregate, Cholesky in the plan)."""
    df = t.lineitem.select("l_extendedprice", "l_quantity", "l_discount", "l_tax")
    out = EM.ols_effect(df, "l_extendedprice", "l_quantity", ["l_discount", "l_tax"])
    return out.select("regressor", F.round("coef", 4).alias("coef"), F.round("std_err", 4).alias("std_err"),
                      F.round("intercept", 4).alias("intercept"), "n")
