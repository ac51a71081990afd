"""Paper-gate queries (PF-1..7, TK-3, SC-3/4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import gate as G
from quire.plans import derived as D
from quire.plans.registry import query

# ---- DuckDB text built from the same fixed patterns -------------------------


def _ind_sql(src: str, text: str = "text", key: str = "doc_id") -> str:
    cols = ",\n  ".join(
        f"regexp_matches({text if orig else f'lower({text})'}, '{p}') as \"{n}\"" for n, p, orig in G.INDICATORS)
    count = " + ".join(f'cast("{n}" as int)' for n, _, _ in G.INDICATORS)
    return (f"ind0 AS (select {key}, {text},\n  {cols}\n from {src}),\n"
            f"ind AS (select *, {count} as indicator_count from ind0)")


def _np_sql(text: str = "text") -> str:
    low = f"lower({text})"
    return (f"((regexp_matches({low}, '{G.NP_INVOICE}') and regexp_matches({low}, '{G.NP_INVOICE_AMOUNT}'))"
            f" or regexp_matches({low}, '{G.NP_PURCHASE}')"
            f" or regexp_matches({low}, '{G.NP_LETTER}')"
            f" or (regexp_matches({low}, '{G.NP_COURSE}') and indicator_count < 3)"
            f" or regexp_matches({low}, '{G.NP_HTML}')"
            f" or (regexp_matches({low}, '{G.NP_RECIPE}') and not regexp_matches({low}, '{G.NP_RECIPE_UNLESS}')))")


MISSING_SQL = ("list_filter([" + ", ".join(f"case when not \"{n}\" then '{n}' end" for n, _, _ in G.INDICATORS)
               + "], lambda x: x is not null)")

REASON_SQL = f"""case when indicator_count = 9 then 'Found all 9/9 academic paper indicators'
  when indicator_count >= 6 then concat('Found only ', cast(indicator_count as varchar), '/9 indicators. Missing: ', array_to_string({MISSING_SQL}, ', '))
  else concat('Found only ', cast(indicator_count as varchar), '/9 indicators. Missing: ', array_to_string(list_slice({MISSING_SQL}, 1, 4), ', ')) end"""


def _verdict_sql(src: str, text: str = "text", key: str = "doc_id") -> str:
    return f"""{_ind_sql(src, text, key)},
v0 AS (select *, {_np_sql(text)} as non_paper from ind),
v1 AS (select *,
  case when {text} is null or length({text}) < 200 then 'short' when non_paper and indicator_count < 6 then 'non_academic' else 'rule' end as stage,
  indicator_count >= 6 as rule_decision,
  case when indicator_count = 9 then 0.9::double when indicator_count >= 6 then 0.6::double else 0.0::double end as rule_confidence,
  {REASON_SQL} as rule_reason from v0),
v AS (select *,
  case when stage = 'rule' then rule_decision else false end as is_paper,
  case when stage = 'rule' then rule_confidence else 0.0::double end as confidence,
  case when stage = 'short' then '{G.TOO_SHORT}' when stage = 'non_academic' then '{G.NON_ACADEMIC}'
       when rule_confidence >= 0.9 then concat('High confidence: ', rule_reason)
       when rule_decision then concat('Warning: ', rule_reason)
       else concat('Does not appear to be a research paper. ', rule_reason) end as reason from v1)"""


IND_NAMES = ", ".join(f'"{n}"' for n, _, _ in G.INDICATORS)


@query("pf1_paper_indicators", f"WITH {_ind_sql('d_papers')}\nselect doc_id, {IND_NAMES}, indicator_count from ind",
       ("d_papers",))
def pf1(t):
    return G.indicators(D.d_papers(t)).select("doc_id", *[n for n, _, _ in G.INDICATORS], "indicator_count")


@query("pf2_non_paper_flags", f"WITH {_ind_sql('d_papers')}\nselect doc_id, {_np_sql()} as non_paper from ind",
       ("d_papers",))
def pf2(t):
    return G.non_paper_flags(D.d_papers(t)).select("doc_id", "non_paper")


@query("pf2_non_paper_flags_pages",
       f"WITH {_ind_sql('pages', 'html', 'page_id')}\nselect page_id, {_np_sql('html')} as non_paper from ind")
def pf2p(t):
    return G.non_paper_flags(t.pages.select("page_id", "html"), "html").select("page_id", "non_paper")


@query("pf3_gate_verdict", f"WITH {_verdict_sql('d_papers')}\nselect doc_id, is_paper, confidence, reason from v",
       ("d_papers",))
def pf3(t):
    return G.verdict(D.d_papers(t)).select("doc_id", "is_paper", "confidence", "reason")


@query("pf3_gate_verdict_raw_documents",
       f"WITH {_verdict_sql('documents')}\nselect doc_id, is_paper, confidence, reason from v")
def pf3raw(t):
    return G.verdict(t.documents.select("doc_id", "text")).select("doc_id", "is_paper", "confidence", "reason")


@query("pf4_reason_string", f"WITH {_ind_sql('d_papers')}\nselect doc_id, {REASON_SQL} as rule_reason from ind",
       ("d_papers",))
def pf4(t):
    return G.indicators(D.d_papers(t)).select("doc_id", G.reason(4).alias("rule_reason"))


LABEL_VERDICT_SQL = """top AS (select doc_id, label, score from (
   select *, row_number() over (partition by doc_id order by score desc, label) as rn from d_clf) where rn = 1),
lv AS (select doc_id,
  case when label in ('academic research paper', 'scientific article', 'technical report') and score > 0.5 then true else false end as ai_result,
  case when label in ('academic research paper', 'scientific article', 'technical report') then
         case when score > 0.7 then score when score > 0.5 then 0.6::double else score end
       else 1 - score end as ai_confidence,
  case when label in ('academic research paper', 'scientific article', 'technical report') then
         case when score > 0.7 then concat('AI detected: ', label, ' (confidence: ', printf('%.2f', score), ')')
              when score > 0.5 then concat('AI detected: likely ', label, ' (confidence: ', printf('%.2f', score), ')')
              else 'AI detected: uncertain document type' end
       else concat('AI detected: ', label, ', not a research paper') end as ai_reason
  from top)"""


@query("tk3_best_label", """
select doc_id, label, score from (
  select *, row_number() over (partition by doc_id order by score desc, label) as rn from d_clf) where rn = 1""",
       ("d_clf",))
def tk3(t):
    return G.best_label(D.d_clf(t))


@query("pf6_label_verdict", f"WITH {LABEL_VERDICT_SQL}\nselect doc_id, ai_result, round(ai_confidence, 6) as ai_confidence, ai_reason from lv",
       ("d_clf",))
def pf6(t):
    v = G.label_verdict(D.d_clf(t))
    return v.select("doc_id", "ai_result", F.round("ai_confidence", 6).alias("ai_confidence"), "ai_reason")


CODE_LABELS_SQL = """code_labels AS (select doc_id,
  case doc_id % 4 when 0 then 'cs.LG' when 1 then 'Math.ST' when 2 then 'q-bio.NC' else 'Literature' end as label,
  cast((doc_id * 37) % 100 as double) / 100 as score from labels)"""


@query("pf6_code_verdict", f"""
WITH {CODE_LABELS_SQL}
select doc_id, list_bool_or(list_transform(['cs', 'math', 'physics', 'eess', 'econ', 'stat', 'q-bio'], lambda c: contains(lower(label), c))) as ai_result,
  round(case when list_bool_or(list_transform(['cs', 'math', 'physics', 'eess', 'econ', 'stat', 'q-bio'], lambda c: contains(lower(label), c))) then score else 1 - score end, 6) as ai_confidence
from code_labels""")
def pf6c(t):
    d = F.col("doc_id")
    lab = (F.when(d % 4 == 0, "cs.LG").when(d % 4 == 1, "Math.ST").when(d % 4 == 2, "q-bio.NC")
           .otherwise("Literature"))
    labels = t.labels.select("doc_id", lab.alias("label"), (((d * 37) % 100).cast("double") / 100).alias("score"))
    v = G.code_verdict(labels)
    return v.select("doc_id", "ai_result", F.round("ai_confidence", 6).alias("ai_confidence"))


COMBINE_SQL = f"""WITH {_verdict_sql('d_papers')},
{LABEL_VERDICT_SQL},
j AS (select v.*, lv.ai_result, lv.ai_confidence, lv.ai_reason,
        v.rule_confidence * 0.6::double + lv.ai_confidence * 0.4::double as c,
        v.stage = 'rule' and lv.ai_result is not null as has_ai
      from v left join lv on v.doc_id = lv.doc_id)
select doc_id,
  case when not has_ai then is_paper when rule_decision and ai_result then true
       when not rule_decision and not ai_result then false else c >= 0.5 end as is_paper,
  case when not has_ai then confidence when rule_decision and ai_result then (case when c >= 0.9 then 0.9::double else 0.6::double end)
       when not rule_decision and not ai_result then 0.0::double else (case when c >= 0.5 then 0.6::double else 0.0::double end) end as confidence,
  case when not has_ai then reason
       when rule_decision and ai_result then (case when c >= 0.9 then concat('High confidence: ', rule_reason, '. ', ai_reason) else concat('Warning: ', rule_reason, '. ', ai_reason) end)
       when not rule_decision and not ai_result then concat('Not a research paper. ', rule_reason, '. ', ai_reason)
       else (case when c >= 0.5 then concat('Mixed signals: ', rule_reason, '. ', ai_reason) else concat('Likely not a research paper. ', rule_reason, '. ', ai_reason) end) end as reason
from j"""


@query("pf5_combine_rule_classifier", COMBINE_SQL, ("d_papers", "d_clf"))
def pf5(t):
    rules = G.verdict(D.d_papers(t))
    out = G.combine(rules, G.label_verdict(D.d_clf(t)))
    return out.select("doc_id", "is_paper", "confidence", "reason")


@query("pf7_accept_upload", f"""
WITH stripped AS (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from d_papers),
{_verdict_sql('stripped')}
select doc_id, length(text) > 200 and is_paper as ok,
  md5(case when not length(text) > 200 then 'Refused: too little text.'
       when not is_paper then 'Refused: the gate does not take this text for a research paper (' || reason || ').' || chr(10)
       when confidence < 0.9 then 'Doubtful (' || reason || '); parts of the paper may be missing.' || chr(10) || chr(10) || text
       else text end) as out_md5
from v""", ("d_papers",))
def pf7(t):
    out = G.accept_upload(D.d_papers(t))
    return out.select("doc_id", "ok", F.md5("out_text").alias("out_md5"))


@query("sc3_head_tail_sample", """
select doc_id, cast(length(s) as integer) as sample_len, md5(s) as sample_md5 from (
  select doc_id, case when length(text) > 4000 then concat(substring(text, 1, 2000), chr(10) || '...' || chr(10), substring(text, length(text) - 1999, 2000))
                      else substring(text, 1, 4000) end as s from documents)""")
def sc3(t):
    s = G.head_tail(F.col("text"))
    return t.documents.select("doc_id", F.length(s).alias("sample_len"), F.md5(s).alias("sample_md5"))


@query("sc4_last_tokens", """
select doc_id, cast(len(tok) as integer) as n_tokens, md5(array_to_string(case when len(tok) <= 2048 then tok else tok[len(tok) - 2047:] end, ' ')) as tail_md5
from (select doc_id, case when trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then []::varchar[]
        else string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') end as tok from documents)""")
def sc4(t):
    tok = G.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(tok).alias("n_tokens"),
                              F.md5(G.last_tokens(F.col("text"), 2048)).alias("tail_md5"))


@query("jn8_rule_with_optional_classifier", f"""WITH {_verdict_sql('d_papers')},
{LABEL_VERDICT_SQL}
select v.doc_id, v.stage, v.rule_decision, lv.ai_result, round(lv.ai_confidence, 6) as ai_confidence
from v left join lv on v.doc_id = lv.doc_id""", ("d_papers", "d_clf"))
def jn8(t):
    j = G.with_classifier(G.verdict(D.d_papers(t)), G.label_verdict(D.d_clf(t)))
    return j.select("doc_id", "stage", "rule_decision", "ai_result", F.round("ai_confidence", 6).alias("ai_confidence"))
