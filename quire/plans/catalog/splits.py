"""Split, draw, batching, prompt-table and vocabulary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.fmt import r6
from quire.operators import gate as G
from quire.operators import splits as SP
from quire.plans import derived as D
from quire.plans.ordering import SQL_HASH_INT, hash_int
from quire.plans.registry import query
from quire.session import written

HASH_ORDER = "md5(cast(doc_id as varchar) || '42'), doc_id"


@query("wn20_kfold", f"""
select doc_id, cast(ntile(5) over (order by {HASH_ORDER}) - 1 as int) as fold from documents""")
def wn20(t):
    return SP.kfold(t.documents.select("doc_id"), "doc_id", k=5, seed=42)


@query("wn20_kfold_hash_mode", f"""
select doc_id, cast({SQL_HASH_INT.format("cast(doc_id as varchar) || '_42'")} % 5 as int) as fold from documents""")
def wn20h(t):
    """Large-scale fold assignment (hash of key and seed mod k, map-only)."""
    return SP.kfold_hash(t.documents.select("doc_id"), "doc_id", k=5, seed=42)


@query("wn21_fraction_split", f"""
select doc_id, row_number() over (order by {HASH_ORDER}) <= cast(floor(count(*) over () * 0.8) as bigint) as is_train from documents""")
def wn21(t):
    return SP.fraction(t.documents.select("doc_id"), "doc_id", 0.8)


@query("wn22_every_k_holdout", """
select doc_id, (row_number() over (order by doc_id) - 1) % 8 = 0 as holdout from documents""")
def wn22(t):
    return SP.every_k(t.documents.select("doc_id"), ["doc_id"], 8)


@query("wn22_stride_sample", """
select doc_id from (select doc_id, row_number() over (order by doc_id) as rn, count(*) over () as n from documents)
where (rn - 1) % greatest(n // 50, 1) = 0""")
def wn22s(t):
    return SP.stride_sample(t.documents.select("doc_id"), ["doc_id"], 50)


@query("wn23_epoch_batches", f"""
select doc_id, cast((rn - 1) // 64 as bigint) as batch from (
  select doc_id, row_number() over (order by {HASH_ORDER}) as rn, count(*) over () as n from documents)
where rn <= (n // 64) * 64""")
def wn23(t):
    return SP.epoch_batches(t.documents.select("doc_id"), "doc_id", 64)


@query("st4_train_complement", """
select doc_id from documents where doc_id not in (
  select doc_id from (select doc_id, row_number() over (order by doc_id) as rn from documents) where (rn - 1) % 8 = 0)""")
def st4(t):
    docs = t.documents.select("doc_id")
    hold = SP.every_k(docs, ["doc_id"], 8).where("holdout")
    return SP.complement(docs, hold, "doc_id")


@query("pf11_drop_warmup", """
select cell, day, value from (select *, row_number() over (partition by cell order by day) as rn from d_grid) where rn > 10""",
       ("d_grid",))
def pf11(t):
    return SP.drop_head(D.d_grid(t), ["cell"], "day", 10)


@query("wn13_time_holdout", """
select cell, day, day > (select max(day) from d_grid) - 10 as is_test from d_grid""", ("d_grid",))
def wn13(t):
    return SP.time_holdout(D.d_grid(t), "day", 10).select("cell", "day", "is_test")


@query("wn24_random_segments", f"""
WITH b AS (select min(day) as lo, max(day) as hi from d_grid),
s AS (select cast(c.cycle as int) as cycle, cast(b.lo + {SQL_HASH_INT.format("cast(c.cycle as varchar) || '_42'")} % greatest(b.hi - b.lo + 1 - 5 + 1, 1) as int) as start
      from (select unnest(range(3)) as cycle) c, b)
select g.cell, g.day, s.cycle from d_grid g join s on g.day >= s.start and g.day < s.start + 5""", ("d_grid",))
def wn24(t):
    return SP.segments(D.d_grid(t), "day", 5, 3).select("cell", "day", "cycle")


@query("jn22_draw_with_replacement", f"""
WITH f AS (select doc_id, row_number() over (order by doc_id) as rn, count(*) over () as n from documents where lang = 'en'),
d AS (select rn - 1 as draw, {SQL_HASH_INT.format("cast(rn - 1 as varchar) || '_42'")} % n + 1 as pick from f)
select d.draw, f.doc_id from d join f on d.pick = f.rn""")
def jn22(t):
    en = t.documents.where(F.col("lang") == "en").select("doc_id")
    return SP.draw(en, "doc_id", en.count(), seed=42).select("draw", "doc_id")


@query("jn9_zip_rows", """
select a.pos, a.item_id, b.doc_id from
  (select item_id, row_number() over (order by item_id) as pos from benchmark) a
  join (select doc_id, row_number() over (order by doc_id) as pos from documents) b on a.pos = b.pos""")
def jn9(t):
    z = SP.zip_rows(t.benchmark.select("item_id"), t.documents.select("doc_id"), "item_id", "doc_id")
    return z.select("pos", "item_id", "doc_id")


@query("jn9_zip_by_name", """
select a.pos, a.s_name, b.p_name, b.p_partkey from
  (select s_name, row_number() over (order by s_name, s_suppkey) as pos from supplier) a
  join (select p_name, p_partkey, row_number() over (order by p_name, p_partkey) as pos from part) b on a.pos = b.pos""")
def jn9_names(t):
    z = SP.zip_rows(t.supplier.select("s_name", "s_suppkey"), t.part.select("p_name", "p_partkey"),
                    ["s_name", "s_suppkey"], ["p_name", "p_partkey"])
    return z.select("pos", "s_name", "p_name", "p_partkey")


@query("jn10_parameter_grid", """
WITH g AS (select * from (values (0), (1), (2)) s(split), (select distinct layer from d_vectors) l, (values (1), (5)) b(beta))
select g.split, g.layer, g.beta, count(*) as n, round(avg(v.x * g.beta), 6) as score
from g join d_vectors v on v.layer = g.layer and v.vec_id % 3 = g.split group by g.split, g.layer, g.beta""",
       ("d_vectors",))
def jn10(t):
    v = D.d_vectors(t)
    layers = t.embeddings.select("label").where("label is not null").distinct().select(F.col("label").alias("layer"))
    grid = layers.select("layer", SP.grid(split=[0, 1, 2], beta=[1, 5]))
    j = v.join(grid, (v["layer"] == grid["layer"]) & (v["vec_id"] % 3 == grid["split"]))
    return j.groupBy(grid["split"], grid["layer"], grid["beta"]).agg(
        F.count("*").alias("n"), r6(F.avg(v["x"] * grid["beta"])).alias("score"))


VOCAB_SQL = """lists AS (select doc_id, regexp_extract_all(text, '(?s).', 0) as l from documents),
chars AS (select doc_id, unnest(l) as ch, unnest(range(1, len(l) + 1)) as pos from lists),
vocab AS (select ch, cast(row_number() over (order by ch) - 1 + 2 as int) as id from (select distinct ch from chars))"""


@query("jn16_vocab_encode", f"""
WITH {VOCAB_SQL}
select c.doc_id, count(*) as n_ids, cast(sum(v.id) as bigint) as id_sum,
  cast(sum(v.id * pos) as bigint) as id_order_sum from chars c join vocab v on c.ch = v.ch group by c.doc_id""")
def jn16(t):
    docs = t.documents.select("doc_id", "text")
    vocab = SP.build_vocab(docs, "text")
    enc = SP.encode_table(docs, "doc_id", "text", vocab)
    return enc.select("doc_id", F.size("ids").cast("long").alias("n_ids"),
                      F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
                      F.aggregate(F.transform("ids", lambda x, i: x * (i + 1).cast("long")), F.lit(0).cast("long"),
                                  lambda a, x: a + x).alias("id_order_sum"))


@query("jn16_vocab_roundtrip", """
select doc_id, true as roundtrip_ok from documents""")
def jn16r(t):
    docs = t.documents.select("doc_id", "text")
    vocab = written(SP.build_vocab(docs, "text"), "vocab")  # read by both ways
    back = SP.decode_table(SP.encode_table(docs, "doc_id", "text", vocab), "doc_id", "ids", vocab)
    return docs.join(back.withColumnRenamed("text", "_back"), "doc_id") \
        .select("doc_id", (F.col("_back") == F.col("text")).alias("roundtrip_ok"))


@query("ag35_vocab_size", """
select count(distinct s) as n_vocab from (select p_brand as s from part union all select p_type from part)""")
def ag35(t):
    a = t.part.select(F.col("p_brand").alias("s"))
    b = t.part.select(F.col("p_type").alias("s"))
    return SP.vocab_size(a, b, "s")


@query("st3_symbol_union", """
select distinct s from (select p_brand as s from part union all select p_type from part)""")
def st3(t):
    return SP.symbols(t.part.select(F.col("p_brand").alias("s")), t.part.select(F.col("p_type").alias("s")), "s")


@query("tk4_even_picks", """
WITH g AS (select grp, row_number() over (order by grp) - 1 as gi, count(*) over () as ng
           from (select distinct cast(p_size % 3 as int) as grp from part)),
q AS (select grp, 20 // ng + case when gi < 20 % ng then 1 else 0 end as quota from g),
p AS (select distinct grp, case when quota > 1 then (j * 199) // (quota - 1) else 0 end as idx
      from q, (select unnest(range(20)) as j) r where j < quota),
r AS (select p_partkey, cast(p_size % 3 as int) as grp, row_number() over (partition by p_size % 3 order by p_partkey) - 1 as idx from part)
select r.grp, r.p_partkey from r join p on r.grp = p.grp and r.idx = p.idx""")
def tk4(t):
    df = t.part.select("p_partkey", (F.col("p_size") % 3).cast("int").alias("grp"))
    return SP.even_picks(df, "grp", "p_partkey").select("grp", "p_partkey")


@query("wn19_fewshot_prompts", """
WITH n AS (select p_partkey, p_name, p_brand, row_number() over (order by p_partkey) as rn, count(*) over () as total from part)
select cast((rn - 1) // 10 as bigint) as prompt_no,
  string_agg(case when (rn - 1) % 10 = 9 then p_name || ':' else p_name || ':' || p_brand || ', ' end, '' order by rn) as prompt
from n where rn <= (total // 10) * 10 group by (rn - 1) // 10""")
def wn19(t):
    out = SP.fewshot_prompts(t.part.select("p_partkey", "p_name", "p_brand"), "p_partkey", "p_name", "p_brand", 10)
    return out.select(F.col("prompt_no").cast("long").alias("prompt_no"), "prompt")


@query("wn19_test_prompts", "select p_partkey, p_name || ':' as prompt from part")
def wn19t(t):
    return SP.test_prompts(t.part.select("p_partkey", "p_name"), "p_name").select("p_partkey", "prompt")


@query("wn18_token_blocks", f"""
WITH tk AS (select doc_id, case when trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then []::varchar[]
                                else string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') end as tok from documents),
s AS (select doc_id, tok, j, {SQL_HASH_INT.format("concat_ws('_', cast(doc_id as varchar), cast(j as varchar), '42')")} % (len(tok) - 8) as start
      from tk, (select unnest(range(2)) as j) r where len(tok) > 8)
select doc_id, cast(j as int) as j, cast(start as int) as start, array_to_string(tok[start + 1:start + 8], ' ') as x,
       array_to_string(tok[start + 2:start + 9], ' ') as y from s""")
def wn18(t):
    tk = t.documents.select("doc_id", G.tokens(F.col("text")).alias("tok"))
    b = SP.blocks(tk, "doc_id", "tok", 8, 2)
    return b.select("doc_id", F.col("j").cast("int").alias("j"), F.col("start").cast("int").alias("start"),
                    F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


_ = hash_int  # re-exported for callers that build their own draws
