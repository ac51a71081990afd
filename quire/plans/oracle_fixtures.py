"""DuckDB text of the derived inputs, used to build oracle statements.

These mirror ``quire.plans.derived`` one to one; ``cte(sql, *names)``
prefixes an oracle statement with the fixtures it reads.
"""

from __future__ import annotations

NL = "chr(10)"

SQL = {
    "d_papers": """
select doc_id, concat(text,
  case when doc_id % 4 <> 3 then concat(chr(10), 'Method and results [1, 2] in Figure 3. We propose a novel model.') else '' end,
  case when doc_id % 2 = 0 then concat(chr(10), 'Abstract') else '' end,
  case when doc_id % 3 <> 1 then concat(chr(10), 'Introduction') else '' end,
  case when doc_id % 5 <> 2 then concat(chr(10), 'Conclusion') else '' end,
  case when doc_id % 7 <> 3 then concat(chr(10), 'References') else '' end,
  case when doc_id % 11 = 4 then concat(chr(10), 'Dear customer') else '' end,
  case when doc_id % 13 = 5 then concat(chr(10), 'Invoice total') else '' end,
  case when doc_id % 17 = 6 then concat(chr(10), 'Chapter 2') else '' end,
  case when doc_id % 19 = 7 then concat(chr(10), 'recipe') else '' end) as text
from documents""",
    "d_clf": """
select doc_id, 'scientific article' as label, cast((doc_id * 37) % 100 as double) / 100 as score from labels
union all select doc_id, 'news article', cast((doc_id * 53) % 100 as double) / 100 from labels
union all select doc_id, 'blog post', cast(0.3 as double) from labels""",
    "d_responses": """
select o_custkey as item_id, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as round, concat('THOUGHT:', chr(10),
  case o_orderkey % 6
  when 0 then concat('ok', chr(10), '```json', chr(10), '{"Name": "idea_', cast(o_orderkey as string), '", "Novelty": ', cast(o_orderkey % 10 + 1 as string), '}', chr(10), '```')
  when 1 then concat('two', chr(10), '```json', chr(10), '{bad}', chr(10), '```', chr(10), '```json', chr(10), '{"Name": "second_', cast(o_orderkey as string), '"}', chr(10), '```')
  when 2 then concat('bare {"Name": "bare_', cast(o_orderkey as string), '"} end')
  when 3 then 'nothing to parse'
  when 4 then concat('I am done', chr(10), '```json', chr(10), '{"Name": "done_', cast(o_orderkey as string), '"}', chr(10), '```')
  else case when floor(o_orderkey / 6) % 2 = 0 then 'Decision made: novel.' else 'Decision made: not novel.' end end) as text
from orders""",
    "d_reviews": """
select p_partkey as paper_id, concat('{"review": "{', chr(92), '"Overall', chr(92), '": ', cast(p_size % 10 + 1 as string), ', ', chr(92), '"Decision', chr(92), '": ', chr(92), '"',
  case when p_size % 10 >= 5 then 'Accept' else 'Reject' end, chr(92), '", ', chr(92), '"Strengths', chr(92), '": [', chr(92), '"clear', chr(92), '"]}"}') as raw from part""",
    "d_scores": """
select l_orderkey as paper_id, l_linenumber as reviewer, 'Overall' as field, min(cast(l_quantity as int)) as score from lineitem group by l_orderkey, l_linenumber
union all select l_orderkey, l_linenumber, 'Confidence', min(cast(l_partkey % 8 as int)) from lineitem group by l_orderkey, l_linenumber
union all select l_orderkey, l_linenumber, 'Soundness', min(cast(l_suppkey % 6 as int)) from lineitem group by l_orderkey, l_linenumber""",
    "d_review_md": """
select doc_id, concat('# Review', chr(10), '## Summary', chr(10), '- not collected', chr(10), '## Weaknesses', chr(10), '- w', cast(doc_id as string), chr(10),
  '  * indented', chr(10), '**bold** start', chr(10), '-', chr(10), 'plain line', chr(10),
  case when doc_id % 3 = 0 then concat('## Suggestions for improvement', chr(10), '- s', cast(doc_id as string), chr(10)) else concat('## Questions', chr(10), '- q', chr(10)) end,
  case doc_id % 4 when 0 then concat('## Rating', chr(10), cast(doc_id % 10 as string), ': accept')
                  when 1 then concat('Overall rating: ', cast(doc_id % 11 as string), '/10')
                  when 2 then concat('We give ', cast(doc_id % 11 as string), '/10') else 'no number' end) as review
from documents""",
    "d_latex": """
select p_partkey as doc_id, concat(
  case when p_partkey % 9 <> 8 then concat(chr(92), 'begin{filecontents}{references.bib}', chr(10), '@article{k1, title={A}}', chr(10), '@article{k2, title={B}}', chr(10), chr(92), 'end{filecontents}', chr(10)) else '' end,
  chr(92), 'section{Introduction}', chr(10), 'See ', chr(92), 'cite{k1, k', cast(p_partkey % 4 as string), '} and ', chr(92), 'citep{k2}.', chr(10),
  chr(92), 'includegraphics[width=1]{f', cast(p_partkey % 3 as string), '.png}', chr(10),
  case when p_partkey % 5 = 0 then concat(chr(92), 'section{Introduction}', chr(10)) else concat(chr(92), 'section{Results}', chr(10)) end,
  chr(92), 'includegraphics{f1.png}', chr(10)) as tex
from part""",
    "d_files": """
select p_partkey as doc_id, 'f1.png' as file from part
union all select p_partkey, 'f2.png' from part where p_size % 2 = 0
union all select p_partkey, concat(cast(p_partkey % 3 as string), '_', cast(p_partkey as string), '.txt') from part""",
    "d_runs": """
select concat('run_', cast(l_suppkey % 4 as string)) as run, l_returnflag as dataset, cast(l_linenumber % 3 as int) as seed, cast(l_orderkey % 50 as int) as step,
  min(l_extendedprice) as val_loss, max(l_discount) as val_acc, case when l_orderkey % 50 < 20 then 'full1' else 'partial' end as phase
from lineitem group by l_suppkey % 4, l_returnflag, l_linenumber % 3, l_orderkey % 50""",
    "d_attempts": """
select user_id as idea_id, event_id as seq, case when event_type in ('view', 'click') then 1 else 0 end as ok from events""",
    "d_grid": """
select user_id as cell, cast(datediff('day', date '2024-01-01', cast(ts as date)) as int) as day, max(value) as value from events group by all""",
    "d_scored": """
select l.doc_id as id, l.quality as y, cast(d.n_chars % 97 as double) / 97 as score from labels l join documents d on l.doc_id = d.doc_id""",
    "d_vectors": """
select vec_id, label as layer, cast(generate_subscripts(embedding, 1) - 1 as int) as pos, cast(unnest(embedding) as double) as x from embeddings""",
    "d_points": """
select l_orderkey as mol, l_linenumber as atom, min(l_quantity) as x, min(l_discount) * 100 as y, min(l_tax) * 100 as z from lineitem group by l_orderkey, l_linenumber""",
    "d_frames": """
select l_suppkey as mol, l_linenumber as atom, cast(l_orderkey % 20 as int) as frame, min(l_quantity) as x, min(l_discount) as y, min(l_tax) as z
from lineitem group by l_suppkey, l_linenumber, l_orderkey % 20""",
    "d_rays": """
select l_orderkey * 10 + l_linenumber as ray, min(l_suppkey % 10) as scene, (min(l_quantity) - 25) / 10 as ox, cast(min(l_partkey % 7) - 3 as double) as oy, cast(-4 as double) as oz,
  cast(l_orderkey % 5 - 2 as double) as dx, min(l_discount) - 0.05e0 as dy, cast(1 as double) as dz
from lineitem group by l_orderkey, l_linenumber""",
    "d_poses": """
select s_suppkey as frame, cos(s_suppkey / 7.0e0) as r00, -sin(s_suppkey / 7.0e0) as r01, sin(s_suppkey / 7.0e0) as r10, cos(s_suppkey / 7.0e0) as r11, s_acctbal / 1000 as tx, cast(s_nationkey as double) as ty
from supplier""",
    "d_gridpix": """
select l_suppkey % 5 as img, cast(l_orderkey % 16 as int) as r, cast(l_partkey % 16 as int) as c, min(l_quantity) as v
from lineitem group by l_suppkey % 5, l_orderkey % 16, l_partkey % 16""",
    "d_archive": """
select p_partkey as seq, concat('idea_', cast(p_partkey % 1900 as string)) as name, p_name as title, p_type as experiment, cast(p_size % 10 + 1 as int) as interestingness,
  cast(p_partkey % 10 + 1 as int) as feasibility, cast((p_partkey * 7) % 10 + 1 as int) as novelty, case when p_partkey % 6 = 0 then null else p_size % 4 <> 0 end as novel
from part""",
    "d_chunks": """
select conv_id as resp_id, turn as pos, concat(text, case when role = 'assistant' then '<|eot_id|>' else '' end) as chunk from conversations""",
}


def cte(sql: str, *names: str) -> str:
    """``WITH d_x AS (...), ... <sql>`` for the named fixtures."""
    if not names:
        return sql
    parts = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in names)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {parts},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"
