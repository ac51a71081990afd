"""Reply-table queries (SC-1/2, PF-9, WN-1/2, AG-2, WN-9, SC-15, SC-25, SC-28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import replies as RP
from quire.plans import derived as D
from quire.plans.registry import query

EXTRACT_SQL = """(list_filter(list_transform(
    case when len(regexp_extract_all({t}, '(?s)```json(.*?)```', 1)) > 0 then regexp_extract_all({t}, '(?s)```json(.*?)```', 1)
         else regexp_extract_all({t}, '(?s)\\{{.*?\\}}', 0) end,
    lambda x: case when json_valid(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) and regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^[\\[{{]') and regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '[\\]}}]$')
                   then regexp_replace(x, '^\\s+|\\s+$', '', 'g')
                   when json_valid(regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '[\\x00-\\x1F\\x7F]', '', 'g')) and regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '^[\\[{{]') and regexp_matches(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '[\\]}}]$')
                   then regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '[\\x00-\\x1F\\x7F]', '', 'g') end),
  lambda y: y is not null))[1]"""


def extract_sql(t: str = "text") -> str:
    return EXTRACT_SQL.format(t=t)


@query("sc1_extract_json", f"""
select item_id, round, js as json, json_extract_string(js, '$.Name') as name
from (select item_id, round, {extract_sql()} as js from d_responses)""", ("d_responses",))
def sc1(t):
    js = RP.extract_json(F.col("text"))
    return D.d_responses(t).select("item_id", "round", js.alias("json")).withColumn(
        "name", RP.json_field(F.col("json"), "Name"))


@query("sc2_control_char_repair", f"""
select item_id, round, js as json, json_extract_string(js, '$.Name') as name
from (select item_id, round, {extract_sql('t2')} as js
      from (select item_id, round, replace(text, '"Name": "', concat('"Name": "x', chr(9))) as t2 from d_responses))""",
       ("d_responses",))
def sc2(t):
    src = D.d_responses(t).select("item_id", "round",
                                  F.replace("text", F.lit('"Name": "'), F.lit('"Name": "x\t')).alias("t2"))
    js = RP.extract_json(F.col("t2"))
    return src.select("item_id", "round", js.alias("json")).withColumn("name", RP.json_field(F.col("json"), "Name"))


@query("pf9_reply_markers", """
select item_id, round, contains(text, 'I am done') as done, contains(text, 'ALL_COMPLETED') as all_completed,
  case when contains(lower(text), 'decision made: novel') then 'novel'
       when contains(lower(text), 'decision made: not novel') then 'not novel' end as decision
from d_responses""", ("d_responses",))
def pf9(t):
    return RP.markers(D.d_responses(t)).select("item_id", "round", "done", "all_completed", "decision")


def _reflect_sql(max_rounds: int, first_checked: int) -> str:
    return f"""
WITH r AS (select item_id, round, {extract_sql()} as js,
             contains(text, 'I am done') and round >= 2 and round <= {max_rounds} as done
           from d_responses where round <= {max_rounds}),
a AS (select item_id, min(case when done then round end) as done_round, max(round) as last_round,
        min(case when js is null and round >= {first_checked} then round end) as fail
      from r group by item_id),
s AS (select item_id, coalesce(done_round, last_round) as stop_round, fail from a)
select s.item_id, s.stop_round, r.js as json
from s join r on s.item_id = r.item_id and r.round = s.stop_round
where s.fail is null or s.fail > s.stop_round"""


@query("wn1_reflection_fold", _reflect_sql(5, 1), ("d_responses",))
def wn1(t):
    return RP.reflect(D.d_responses(t), max_rounds=5, check_first=True)


@query("wn1_reflection_fold_review", _reflect_sql(3, 2), ("d_responses",))
def wn1r(t):
    return RP.reflect(D.d_responses(t), max_rounds=3, check_first=False)


@query("wn2_novelty_fold", """
WITH d AS (select item_id, round, case when contains(lower(text), 'decision made: novel') then true
                                       when contains(lower(text), 'decision made: not novel') then false end as dec
           from d_responses where round <= 10),
f AS (select item_id, dec from (select *, row_number() over (partition by item_id order by round) as rn
                                from d where dec is not null) where rn = 1)
select a.seq, a.name, coalesce(a.novel, f.dec, false) as novel
from d_archive a left join f on a.seq = f.item_id""", ("d_responses", "d_archive"))
def wn2(t):
    dec = RP.decide_novelty(D.d_responses(t), max_rounds=10)
    return RP.apply_novelty(D.d_archive(t), dec).select("seq", "name", "novel")


@query("ag2_first_valid_review", f"""
WITH r AS (select item_id, round, {extract_sql()} as js from d_responses),
fb AS (select item_id, arg_min(js, round) filter (where js is not null) as first_js, count(*) as n from r group by item_id),
meta AS (select distinct item_id, concat('meta_', cast(item_id as varchar)) as meta from d_responses where item_id % 2 = 0)
select fb.item_id, coalesce(meta.meta, fb.first_js) as review from fb left join meta on fb.item_id = meta.item_id""",
       ("d_responses",))
def ag2(t):
    resp = D.d_responses(t)
    reviews = resp.select("item_id", "round", RP.extract_json(F.col("text")).alias("js"))
    meta = (resp.where(F.col("item_id") % 2 == 0).select("item_id").distinct()
            .withColumn("meta", F.concat(F.lit("meta_"), F.col("item_id").cast("string"))))
    return RP.first_valid(reviews, "item_id", "round", "js", meta)


@query("wn9_growing_prefixes", """
select resp_id, pos, cast(length(p) as integer) as prefix_len, md5(p) as prefix_md5 from (
  select resp_id, pos, replace(string_agg(chunk, '' order by pos) over (partition by resp_id order by pos rows between unbounded preceding and current row), '<|eot_id|>', '') as p
  from d_chunks)""", ("d_chunks",))
def wn9(t):
    p = RP.prefixes(D.d_chunks(t))
    return p.select("resp_id", "pos", F.length("prefix").alias("prefix_len"), F.md5("prefix").alias("prefix_md5"))


@query("sc25_final_text", """
select resp_id, cast(length(t) as integer) as text_len, md5(t) as text_md5 from (
  select resp_id, replace(string_agg(chunk, '' order by pos), '<|eot_id|>', '') as t from d_chunks group by resp_id)""",
       ("d_chunks",))
def sc25(t):
    a = RP.join_prefixes(D.d_chunks(t), final_only=True)
    return a.select("resp_id", F.length("text").alias("text_len"), F.md5("text").alias("text_md5"))


@query("sc25_joined_prefixes_compat", """
WITH p AS (select resp_id, pos, replace(string_agg(chunk, '' order by pos) over (partition by resp_id order by pos rows between unbounded preceding and current row), '<|eot_id|>', '') as p from d_chunks)
select resp_id, cast(length(t) as integer) as text_len, md5(t) as text_md5 from (
  select resp_id, string_agg(p, chr(10) order by pos) as t from p group by resp_id)""", ("d_chunks",))
def sc25c(t):
    a = RP.join_prefixes(D.d_chunks(t), final_only=False)
    return a.select("resp_id", F.length("text").alias("text_len"), F.md5("text").alias("text_md5"))


@query("sc15_chat_history", """
select conv_id, cast(len(m) as integer) as n_messages,
  md5(array_to_string(list_transform(m, lambda x: concat(x.role, ': ', x.content)), chr(10))) as history_md5
from (select conv_id, list_append(list_slice(list(struct_pack(role := role, content := text) order by turn), 1, -2),
                                  struct_pack(role := 'assistant', content := 'ok')) as m
      from conversations group by conv_id)""")
def sc15(t):
    h = RP.history(t.conversations)
    m = RP.append_turn(F.col("messages"), "assistant", F.lit("ok"), drop_last=True)
    flat = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    return h.select("conv_id", F.size(m).alias("n_messages"), F.md5(flat).alias("history_md5"))


SAMPLES_SQL = """last AS (select conv_id, arg_max(coalesce(text, ''), turn) as text from conversations group by conv_id),
s AS (select conv_id, unnest(range(conv_id % 3 + 1)) as sample, text from last),
h AS (select conv_id, list(concat(role, ': ', coalesce(text, '')) order by turn) as m, count(*) as n from conversations group by conv_id)"""


def _samples(t):
    """One to three replies to each conversation, made from its last turn."""
    last = t.conversations.groupBy("conv_id").agg(F.max_by(F.coalesce("text", F.lit("")), "turn").alias("text"))
    s = last.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("conv_id") % 3)).alias("sample"), "text")
    return s.select("conv_id", "sample", F.concat(F.lit("sample "), F.col("sample").cast("string"), F.lit(" for "), F.col("text")).alias("text"))


@query("sc15_sampled_histories", f"""
WITH {SAMPLES_SQL}
select conv_id, sample, cast(n + 1 as int) as n_messages,
       md5(array_to_string(list_append(m, concat('assistant: sample ', sample, ' for ', text)), chr(10))) as history_md5
from s join h using (conv_id)""")
def sc15s(t):
    """One history per sampled reply."""
    h = RP.sampled_histories(t.conversations, _samples(t))
    flat = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    return h.select("conv_id", "sample", F.size("messages").alias("n_messages"), F.md5(flat).alias("history_md5"))


@query("sc15_ensemble_history", f"""
WITH {SAMPLES_SQL}
select conv_id, cast(n + 1 as int) as n_messages, md5(array_to_string(list_append(m, concat('assistant: joint view of ', conv_id % 3 + 1, ' replies')), chr(10))) as history_md5
from last join h using (conv_id)""")
def sc15e(t):
    """The first reply's history with that reply replaced by one joint reply."""
    h = RP.sampled_histories(t.conversations, _samples(t))
    per = h.groupBy("conv_id").agg(F.min_by("messages", "sample").alias("messages"), F.count("*").alias("n"))
    joint = F.concat(F.lit("joint view of "), F.col("n").cast("string"), F.lit(" replies"))
    m = RP.append_turn(F.col("messages"), "assistant", joint, drop_last=True)
    flat = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    return per.select("conv_id", F.size(m).alias("n_messages"), F.md5(flat).alias("history_md5"))


@query("sc28_strip_prompt", """
select doc_id, md5(substring(text, length(substring(text, 1, 50)) + 1)) as out_md5 from documents""")
def sc28(t):
    d = t.documents
    return d.select("doc_id", F.md5(RP.strip_prompt(F.col("text"), F.substring("text", 1, 50))).alias("out_md5"))


@query("sc15_prompt_messages", """
select doc_id, 2 as n_messages,
  md5('system: You review papers.' || chr(10) || 'user: Review this paper:' || chr(10) || text) as messages_md5,
  md5(text) = md5(text) as flattened_ok
from d_papers""", ("d_papers",))
def sc15m(t):
    d = D.d_papers(t)
    m = RP.messages(d, "You review papers.", "Review this paper:\n{paper_text}")
    flat = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")
    nested = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    return d.select("doc_id", F.size(m).alias("n_messages"), F.md5(flat).alias("messages_md5"),
                    (RP.flatten_content(nested) == F.col("text")).alias("flattened_ok"))
