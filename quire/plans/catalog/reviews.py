"""Review queries (SRC-2, PF-12, AG-1, WN-14, WN-16, WN-26, SC-13/14/17, TK-2, TK-6, SC-23/24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import reviews as RV
from quire.plans import derived as D
from quire.plans.registry import query

LIMITS_SQL = ("limits_t(field, lo, hi) AS (VALUES " + ", ".join(
    f"('{f}', {lo}, {hi})" for f, lo, hi in RV.SCORE_LIMITS) + ")")


@query("src2_read_double_encoded_reviews", """
select paper_id, cast(json_extract(r, '$.Overall') as int) as overall, json_extract_string(r, '$.Decision') as decision,
       cast(json_array_length(r, '$.Strengths') as int) as n_strengths
from (select paper_id, json_extract_string(raw, '$.review') as r from d_reviews)""", ("d_reviews",))
def src2(t):
    r = RV.read_reviews(D.d_reviews(t))
    return r.select("paper_id", F.col("review.Overall").alias("overall"), F.col("review.Decision").alias("decision"),
                    F.size("review.Strengths").alias("n_strengths"))


@query("pf12_score_violations", f"""
WITH {LIMITS_SQL}
select s.field, count(*) as n, cast(sum(case when l.lo is null or s.score between l.lo and l.hi then 0 else 1 end) as bigint) as violations
from d_scores s left join limits_t l on s.field = l.field group by s.field""", ("d_scores",))
def pf12(t):
    checked = RV.check_scores(D.d_scores(t), RV.limits_table(t.spark))
    return RV.violation_report(checked).select("field", "n", F.col("violations").cast("long").alias("violations"))


@query("ag1_ensemble_scores", f"""
WITH {LIMITS_SQL}
select s.paper_id, s.field, cast(round_even(avg(case when l.lo is null or s.score between l.lo and l.hi then s.score end), 0) as int) as score,
       avg(case when l.lo is null or s.score between l.lo and l.hi then s.score end) is null as no_valid
from d_scores s left join limits_t l on s.field = l.field group by s.paper_id, s.field""", ("d_scores",))
def ag1(t):
    checked = RV.check_scores(D.d_scores(t), RV.limits_table(t.spark))
    return RV.ensemble_scores(checked)


@query("wn26_numbered_reviews", """
select paper_id, field, reviewer, concat('Review ', cast(row_number() over (partition by paper_id, field order by reviewer) as varchar), '/',
       cast(count(*) over (partition by paper_id, field) as varchar)) as review_label
from d_scores""", ("d_scores",))
def wn26(t):
    return RV.numbered(D.d_scores(t), ["paper_id", "field"]).select("paper_id", "field", "reviewer", "review_label")


@query("wn16_stop_at_score", """
WITH s AS (select paper_id, field, reviewer, score from d_scores where reviewer <= 6),
st AS (select paper_id, field, min(case when score >= 8 or score is null then reviewer end) as stop from s group by paper_id, field)
select s.paper_id, s.field, s.reviewer, s.score, st.stop is not null as stopped_early
from s join st on s.paper_id = st.paper_id and s.field = st.field where st.stop is null or s.reviewer <= st.stop""", ("d_scores",))
def wn16(t):
    return RV.stop_at_score(D.d_scores(t), ["paper_id", "field"], "reviewer", "score", at=8, max_iters=6).select(
        "paper_id", "field", "reviewer", "score", "stopped_early")


FEEDBACK_SQL = """
lines AS (select doc_id, generate_subscripts(string_split(review, chr(10)), 1) as pos, unnest(string_split(review, chr(10))) as line from d_review_md),
tagged AS (select doc_id, pos, starts_with(line, '#') as h,
    last_value(case when starts_with(line, '#') then
        case when contains(lower(trim(line)), 'weakness') then 'weaknesses'
             when contains(lower(trim(line)), 'suggestion') or contains(lower(trim(line)), 'comment') or contains(lower(trim(line)), 'improvement') then 'suggestions'
             else 'none' end end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and current row) as section,
    regexp_replace(line, '^\\s+|\\s+$', '', 'g') as s from lines),
items AS (select doc_id, pos, section, regexp_replace(substring(s, 2), '^\\s+|\\s+$', '', 'g') as item from tagged
          where not h and (starts_with(s, '-') or starts_with(s, '*')) and section in ('weaknesses', 'suggestions')),
fb AS (select d.doc_id,
    coalesce(list(i.item order by i.pos) filter (where i.section = 'weaknesses'), []) as weaknesses,
    coalesce(list(i.item order by i.pos) filter (where i.section = 'suggestions'), []) as suggestions
  from d_review_md d left join (select * from items where item <> '') i on d.doc_id = i.doc_id group by d.doc_id)"""

SCORE_SQL = """coalesce(try_cast(nullif(regexp_extract({t}, '(?i)(?:score|rating).*?(\\d+)(?:/10)?', 1), '') as integer),
         try_cast(nullif(regexp_extract({t}, '(?i)(\\d+)(?:/10)', 1), '') as integer), 0)"""


@query("wn14_feedback_items", f"""
WITH {FEEDBACK_SQL}
select doc_id, array_to_string(weaknesses, '|') as weaknesses, array_to_string(suggestions, '|') as suggestions from fb""",
       ("d_review_md",))
def wn14(t):
    fb = RV.feedback_items(D.d_review_md(t))
    return fb.select("doc_id", F.array_join("weaknesses", "|").alias("weaknesses"),
                     F.array_join("suggestions", "|").alias("suggestions"))


@query("sc13_review_score", f"""
select doc_id, {SCORE_SQL.format(t='review')} as score,
  coalesce(try_cast(nullif(regexp_extract(review, '(?is)(?:score|rating).*?(\\d+)(?:/10)?', 1), '') as integer),
           try_cast(nullif(regexp_extract(review, '(?is)(\\d+)(?:/10)', 1), '') as integer), 0) as score_cross_line
from d_review_md""", ("d_review_md",))
def sc13(t):
    r = F.col("review")
    return D.d_review_md(t).select("doc_id", RV.score(r).alias("score"),
                                   RV.score(r, cross_line=True).alias("score_cross_line"))


@query("tk2_top_feedback_items", f"""
WITH {FEEDBACK_SQL}
select doc_id, array_to_string(weaknesses[1:5], '|') as top_weaknesses, array_to_string(suggestions[1:5], '|') as top_suggestions from fb""",
       ("d_review_md",))
def tk2(t):
    fb = RV.feedback_items(D.d_review_md(t))
    return fb.select("doc_id", F.array_join(RV.top_items(F.col("weaknesses")), "|").alias("top_weaknesses"),
                     F.array_join(RV.top_items(F.col("suggestions")), "|").alias("top_suggestions"))


def _bul_sql(arr: str, none_text: str) -> str:
    b = f"array_to_string(list_transform({arr}[1:5], lambda x: concat('- ', x)), chr(10))"
    return f"case when {b} = '' then '{none_text}' else {b} end"


@query("sc14_improvement_prompt", f"""
WITH {FEEDBACK_SQL}
select fb.doc_id, md5(p) as prompt_md5, cast(length(p) as integer) as prompt_len from fb join (
  select doc_id, review, {SCORE_SQL.format(t='review')} as score from d_review_md) d on fb.doc_id = d.doc_id,
lateral (select concat('Reviewers rate this draft ', cast(d.score as varchar), ' of 10.', chr(10), chr(10), 'Weak points:', chr(10),
   {_bul_sql('fb.weaknesses', 'none')}, chr(10), chr(10), 'Proposals:', chr(10), {_bul_sql('fb.suggestions', 'none')}, chr(10), chr(10),
   'From the review:', chr(10), substring(d.review, 1, 2000), chr(10), chr(10), 'Rework the draft so that every point is dealt with.', chr(10)) as p)""", ("d_review_md",))
def sc14(t):
    fb = RV.feedback_items(D.d_review_md(t))
    p = RV.improvement_prompt(F.col("weaknesses"), F.col("suggestions"), F.col("score"), F.col("full_review"))
    return fb.select("doc_id", F.md5(p).alias("prompt_md5"), F.length(p).alias("prompt_len"))


@query("sc17_meta_review_prompt", """
WITH w AS (select paper_id, reviewer,
     max(case when field = 'Overall' then score end) as o, max(case when field = 'Confidence' then score end) as c,
     max(case when field = 'Soundness' then score end) as s from d_scores group by paper_id, reviewer),
n AS (select *, row_number() over (partition by paper_id order by reviewer) as i, count(*) over (partition by paper_id) as k from w)
select paper_id, count(*) as n_reviews, md5(string_agg(concat(chr(10), 'Review ', cast(i as varchar), '/', cast(k as varchar), ':', chr(10), '```', chr(10),
   '{"Overall": ', cast(o as varchar), ', "Confidence": ', cast(c as varchar), ', "Soundness": ', cast(s as varchar), '}', chr(10), '```', chr(10)), '' order by i)) as prompt_md5
from n group by paper_id""", ("d_scores",))
def sc17(t):
    s = D.d_scores(t)
    wide = s.groupBy("paper_id", "reviewer").pivot("field", ["Overall", "Confidence", "Soundness"]).agg(F.max("score"))
    num = RV.numbered(wide)
    js = F.concat(F.lit('{"Overall": '), F.col("Overall").cast("string"), F.lit(', "Confidence": '),
                  F.col("Confidence").cast("string"), F.lit(', "Soundness": '), F.col("Soundness").cast("string"),
                  F.lit("}"))
    block = F.concat(F.lit("\nReview "), F.col("review_no").cast("string"), F.lit("/"), F.col("n_reviews").cast("string"),
                     F.lit(":\n```\n"), js, F.lit("\n```\n"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("review_no").alias("i"), block.alias("b"))))
    return num.groupBy("paper_id").agg(F.count("*").alias("n_reviews"),
                                       F.md5(F.array_join(F.transform(parts, lambda x: x["b"]), "")).alias("prompt_md5"))


@query("tk6_fewshot_examples", """
select item_id, md5(text) as text_md5 from benchmark order by item_id limit 2""")
def tk6(t):
    return t.benchmark.orderBy("item_id").limit(2).select("item_id", F.md5("text").alias("text_md5"))


@query("sc23_assemble_pages", """
select resp_id as doc_id, md5(string_agg(concat(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10)), '' order by pos)) as text_md5,
       cast(length(string_agg(concat(regexp_replace(chunk, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10)), '' order by pos)) as integer) as text_len
from d_chunks where pos <= 5 group by resp_id""", ("d_chunks",))
def sc23(t):
    a = RV.assemble_pages(D.d_chunks(t), "resp_id", "pos", "chunk", max_pages=5)
    return a.select(F.col("resp_id").alias("doc_id"), F.md5("text").alias("text_md5"), F.length("text").alias("text_len"))


@query("sc23_first_long_extraction", """
select doc_id, md5(case when length(substring(text, 1, 50)) >= 100 then substring(text, 1, 50)
                        when length(substring(text, 1, 500)) >= 100 then substring(text, 1, 500) else text end) as pick_md5
from documents""")
def sc23b(t):
    txt = F.col("text")
    pick = RV.first_long_enough([F.substring(txt, 1, 50), F.substring(txt, 1, 500), txt], 100)
    return t.documents.select("doc_id", F.md5(pick).alias("pick_md5"))


@query("sc24_map_to_markdown", """
select paper_id, md5(concat('## Decision', chr(10), decision, chr(10) || chr(10), '## Overall', chr(10), overall)) as md_md5
from (select paper_id, json_extract_string(r, '$.Decision') as decision, cast(json_extract(r, '$.Overall') as varchar) as overall
      from (select paper_id, json_extract_string(raw, '$.review') as r from d_reviews))""", ("d_reviews",))
def sc24(t):
    r = RV.read_reviews(D.d_reviews(t))
    m = F.create_map(F.lit("Overall"), F.col("review.Overall").cast("string"), F.lit("Decision"), F.col("review.Decision"))
    return r.select("paper_id", F.md5(RV.map_to_markdown(m)).alias("md_md5"))


@query("sc17_fewshot_block", """
WITH p AS (select item_id, text, row_number() over (order by item_id) as pos from benchmark),
r AS (select paper_id, json_extract_string(raw, '$.review') as review, row_number() over (order by paper_id) as pos from d_reviews)
select md5(concat('Papers with the reviews they got:', chr(10),
  string_agg(chr(10) || '[paper]' || chr(10) || p.text || chr(10) || '[review]' || chr(10) || r.review || chr(10), '' order by p.pos))) as prompt_md5
from p join r on p.pos = r.pos where p.pos <= 2""", ("d_reviews",))
def sc17f(t):
    reviews = D.d_reviews(t).select("paper_id", F.from_json("raw", "review string")["review"].alias("review"))
    out = RV.fewshot_block(t.benchmark, reviews, "item_id", "paper_id", "text", "review", n=2)
    return out.select(F.md5("prompt").alias("prompt_md5"))


@query("pf12_review_form_check", """
select paper_id, array_to_string(list_filter([
    case when json_extract(r, '$.Overall') is null then 'missing:Overall' end,
    case when json_extract_string(r, '$.Decision') is null then 'missing:Decision' end,
    case when cast(json_extract(r, '$.Overall') as int) not between 1 and 10 then 'range:Overall' end,
    case when json_extract_string(r, '$.Decision') not in ('Accept', 'Reject') then 'decision' end], lambda x: x is not null), '|') as problems
from (select paper_id, json_extract_string(raw, '$.review') as r from d_reviews)""", ("d_reviews",))
def pf12f(t):
    r = RV.read_reviews(D.d_reviews(t))
    return RV.form_report(r).select("paper_id", F.array_join("problems", "|").alias("problems"))
