"""Plug-in surface queries (UD-1, UD-2, UD-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import plugins as PL
from quire.plans import derived as D
from quire.plans.registry import query


@query("ud1_plugin_text_scorer", """
select doc_id,
  case when regexp_matches(text, '[0-9]$') then null else contains(text, 'Abstract') end as is_paper,
  case when regexp_matches(text, '[0-9]$') then null else round((length(text) % 100) / 100, 2) end as confidence,
  case when regexp_matches(text, '[0-9]$') then null else 'len=' || cast(length(text) as varchar) end as reason
from d_papers""", ("d_papers",))
def ud1(t):
    return PL.score_text(D.d_papers(t), PL.demo_scorer)


@query("ud2_plugin_binary_op", """
select a, b, (a * a + b) % 97 as c from (select n_nationkey::bigint as a, unnest(range(97))::bigint as b from nation)""")
def ud2(t):
    out = PL.binary_table(t.nation.select(F.col("n_nationkey").cast("long").alias("k")), "k", 97,
                          lambda a, b: F.pmod(a * a + b, F.lit(97)))
    return out.select("a", F.col("b").cast("long").alias("b"), F.col("c").cast("long").alias("c"))


SSIM_SQL = """
WITH g AS (select i, exp(-0.5 * pow((i - 5) / 1.5, 2)) as w from range(11) t(i)),
gn AS (select i, w / (select sum(w) from g) as w from g),
taps AS (select a.i as di, b.i as dj, a.w * b.w as w from gn a, gn b),
imgs AS (select distinct img from d_gridpix),
cells AS (select img, r, c from imgs, range(16) rr(r), range(16) cc(c)),
px AS (select cells.img, cells.r, cells.c, coalesce(g.v, 0.0) as x0,
              case when g.v is null then 0.0 else g.v * 0.5 + 10 end as x1
       from cells left join d_gridpix g on cells.img = g.img and cells.r = g.r and cells.c = g.c),
outp AS (select img, r0, c0 from imgs, range(6) a(r0), range(6) b(c0)),
f AS (select o.img, o.r0, o.c0, sum(t.w * p.x0) as mu0, sum(t.w * p.x1) as mu1, sum(t.w * p.x0 * p.x0) as e00,
             sum(t.w * p.x1 * p.x1) as e11, sum(t.w * p.x0 * p.x1) as e01
      from outp o cross join taps t join px p on p.img = o.img and p.r = o.r0 + t.di and p.c = o.c0 + t.dj
      group by o.img, o.r0, o.c0),
s AS (select img, mu0, mu1, greatest(e00 - mu0 * mu0, 0.0) as s00, greatest(e11 - mu1 * mu1, 0.0) as s11,
             e01 - mu0 * mu1 as s01r from f),
m AS (select img, ((2 * mu0 * mu1 + 0.25) * (2 * s01 + 2.25)) / ((mu0 * mu0 + mu1 * mu1 + 0.25) * (s00 + s11 + 2.25)) as v
      from (select *, sign(s01r) * least(sqrt(s00 * s11), abs(s01r)) as s01 from s))
select img, round(avg(v), 9) as ssim from m group by img"""


@query("ud4_ssim_per_image", SSIM_SQL, ("d_gridpix",))
def ud4(t):
    """SSIM between each grid image and a contrast-reduced copy."""
    g = D.d_gridpix(t).withColumn("v2", F.col("v") * 0.5 + 10)
    out = PL.ssim(g, "img", "r", "c", "v", "v2", 16, 16, 50.0)
    return out.select("img", F.round("ssim", 9).alias("ssim"))
